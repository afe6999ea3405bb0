"""Keys of lines from a batch's bytes, against the words of each line."""

import numpy as np

from rungwise.llm import lines


def test_keys_follow_the_words():
    rng = np.random.default_rng(1)
    words = ["a", "ab", "ba", "é", "語", "x y", "zz", "the"]
    made = [" ".join(rng.choice(words, n)) for n in (1, 4, 5, 6, 7, 19, 20, 21, 29, 30, 31, 39, 40, 41, 44, 300)]
    texts = ["", " ", "\t", *made, *["\t " + t.replace(" ", "  ", 1) + " " for t in made], "x"]
    raw = [t.encode() for t in texts]
    n, columns, (parts, many, long) = lines.line_keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), 5, 4)
    split = [lines._words(t) for t in texts]
    split = [[w for w in s if w] for s in split]
    assert n.tolist() == [len(s) for s in split]
    rows = np.split(parts, np.cumsum(many)[:-1])
    assert many.tolist() == [sum(2 * k + 1 for k in (2, 3, 4) if m >= max(20, 10 * k) and (k == 4 or m < 10 * (k + 1) + k)) for m in n]
    for i, a in enumerate(split):
        assert columns["k0"][1][i] == (5 <= len(a) <= 20) and long[i] == (len(a) >= 20) == columns["b0"][1][i]
        for j, b in enumerate(split):
            if a == b:
                assert rows[i].tolist() == rows[j].tolist() and all(v[i] == v[j] for v, _ in columns.values())
            if columns["k0"][1][i] and columns["k0"][1][j]:
                half = lambda s, side, less: tuple(s[: len(s) // 2 - less]) if side == 0 else tuple(s[len(s) - len(s) // 2 + less :])
                for side in (0, 1):
                    for p, q in ((0, 0), (0, 2), (2, 2)):
                        if columns[f"k{side + p}"][1][i] and columns[f"k{side + q}"][1][j]:
                            assert (columns[f"k{side + p}"][0][i] == columns[f"k{side + q}"][0][j]) == (half(a, side, p // 2) == half(b, side, q // 2))
    # An edit of k words leaves one part of 2k + 1 whole, and turns at most 2k bits.
    for i, (size, k) in enumerate(((20, 2), (30, 3), (40, 4))):
        line = [f"w{int(x)}" for x in rng.integers(0, 999, size + 3)]
        other = [w for at, w in enumerate(line) if at not in (1,)]
        for at in range(k - 1):
            other[3 + 2 * at] = "new"
        two = [" ".join(line).encode(), " ".join(other).encode()]
        _, c, (p, m, _) = lines.line_keys(np.frombuffer(b"".join(two), np.uint8), np.cumsum([len(t) for t in two]), 5, 4)
        assert set(p[: m[0]].tolist()) & set(p[m[0] :].tolist())
        assert sum(int(c[b][0][0] ^ c[b][0][1]).bit_count() for b in ("b0", "b1")) <= 2 * k
