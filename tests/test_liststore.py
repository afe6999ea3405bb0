"""A store of lists: which files reads and changes touch, versions, and views."""

import re

import pytest

from rungwise.sources import liststore


def frame(spark, rows):
    return spark.createDataFrame([(i, k, [float(i), float(k)]) for i, k in rows], "vec_id long, list int, e array<double>")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "vec_id long")


def held(df):
    return sorted((r["vec_id"], r["list"], list(r["e"])) for r in df.collect())



@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(liststore, "FILE_ROWS", 5)
    return liststore.created(frame(spark, [(i, i % 4 if i < 40 else 9) for i in range(60)]), str(tmp_path / "store"))


def test_reads_open_only_their_lists(spark, store):
    rows = [(i, i % 4 if i < 40 else 9, [float(i), float(i % 4 if i < 40 else 9)]) for i in range(60)]
    assert held(store.read()) == rows and store.lists == {0: (1, 10), 1: (1, 10), 2: (1, 10), 3: (1, 10), 9: (1, 20)}
    some = store.read([1, 9, 77])
    assert held(some) == [r for r in rows if r[1] in (1, 9)]
    named = some.selectExpr("input_file_name() AS f").distinct().collect()
    assert {int(re.search(r"list=(\d+)", r["f"])[1]) for r in named} == {1, 9} and len(named) > 4
    assert held(store.probed(frame(spark, [(500, 2), (501, 2)]))) == [r for r in rows if r[1] == 2]
    got = store.reconstructed(ids(spark, [3, 41, 1000]))
    assert held(got) == [rows[3], rows[41]]
    assert {r["vec_id"]: r["list"] for r in store.lists_of(ids(spark, [5, 59, 60])).collect()} == {5: 1, 59: 9}


def test_changes_touch_only_their_lists(spark, store):
    new = store.changed(frame(spark, [(100, 2), (101, 7), (4, 3)]), ids(spark, [4, 6, 900]))
    assert {k: g for k, (g, _) in new.lists.items()} == {0: 2, 1: 1, 2: 2, 3: 2, 7: 2, 9: 1}
    assert {k: n for k, (_, n) in new.lists.items()} == {0: 9, 1: 10, 2: 10, 3: 11, 7: 1, 9: 20}
    assert {r[0] for r in held(new.read([2]))} == {i for i in range(40) if i % 4 == 2 and i != 6} | {100}
    assert {r["vec_id"]: r["list"] for r in new.lists_of(ids(spark, [4, 6, 100, 101, 8])).collect()} == {4: 3, 100: 2, 101: 7, 8: 0}
    # The older version reads as before, and both can be opened again.
    assert len(held(store.read())) == 60
    for version, n in ((1, 60), (2, 61), (None, 61)):
        again = liststore.opened(spark, store.path, version)
        assert len(held(again.read())) == n and again.lists == (store if version == 1 else new).lists
    # A list that loses all its members has no files.
    bare = new.changed(removed=ids(spark, [101]))
    assert 7 not in bare.lists and held(bare.read([7])) == []


def test_refusals(spark, store):
    with pytest.raises(FileExistsError):
        liststore.created(frame(spark, [(1, 1)]), store.path)
    with pytest.raises(ValueError, match="already"):
        store.changed(frame(spark, [(5, 1)]))
    with pytest.raises(ValueError, match="already"):
        store.changed(frame(spark, [(500, 1), (500, 2)]))


def test_views_and_stacks(spark, store, tmp_path):
    assert set(store.sliced(1, 4).lists) == {1, 2, 3} and set(store.masked([0, 9, 50]).lists) == {0, 9}
    assert set(store.without_stop_lists(10).lists) == {0, 1, 2, 3}
    assert {r[1] for r in held(store.sliced(1, 4).read())} == {1, 2, 3} and held(store.masked([]).read()) == []
    other = liststore.created(frame(spark, [(200, 1), (201, 2)]), str(tmp_path / "other"))
    assert {r[0] for r in held(liststore.beside([store, other])) if r[1] == 1} == {i for i in range(40) if i % 4 == 1} | {200}
    assert {r[0]: r[1] for r in held(liststore.below([store, other])) if r[0] >= 200} == {200: 11, 201: 12}
