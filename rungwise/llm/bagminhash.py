"""MinHash near-dedup with weights: BagMinHash signatures, bands, verified multiset overlap.

A text is the multiset of its five-word shingles.  Every shingle carries one Poisson process for each
dyadic block of discretised weights, (0, 1], (1, 2], (2, 4], ...; a block is only opened if the weight
reaches into it, and a point in it is placed by halving the block down to one unit and counts if that
unit lies below the weight.  Points come in order of time; each falls into a random slot, a slot keeps
its first point, and a process ends once its time passes the text's slowest slot.  So a text takes
about SLOTS * ln(SLOTS) points whatever its length, and two texts agree in a slot with probability
equal to their weighted Jaccard similarity.

Equal texts are one class from the start.  Classes that share a band are compared with LEADERS of its
classes, by exact multiset overlap, and components of these links are found.  In bands that still hold
several components, every member outside the largest one is compared with all members of other
components, in blocks: a row holds BLOCK members of either side, and one matrix product over the
shingles of the block counts all overlaps.  So every pair that shares a band is either compared or
already in one component, and pairs never become rows unless they are links.

Words are lower-cased and split at white space.  Defined results: texts with one to four words are one
shingle; null, empty and wordless texts match nothing, not even each other; rows with equal doc_id and
text are one document; a component's id is its least doc_id (null if it has none); texts of any length
are read whole; other columns are kept by :func:`deduplicated`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, scratch, small_batches, table
from rungwise.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SLOTS = 125
#: Rows of a band: pairs at the similarity share one of 25 bands with probability 1 - 5e-5.
BAND = 5
#: Members of a band that the others are compared with first.
LEADERS = 3
#: Members of a band in a block, about; a block of long texts is split further by BLOCK_CHARS.
BLOCK, BLOCK_CHARS = 128, 1 << 20
#: Shingles that are signed at once.
PORTION = 100_000
CACHE_WORDS = 100_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Shingles of a text as 64-bit hashes; word hashes are cached."""

    _POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

    def __init__(self):
        self.cache: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        n = len(h)
        if not n:
            return h
        if n < SHINGLE:
            return _mix((h * self._POWERS[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n))
        total = sum(h[k : n - SHINGLE + 1 + k] * self._POWERS[k] for k in range(SHINGLE))
        return _mix(total + _U(SHINGLE))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of (elements, whole weights) for each text: the times of the slots' first points."""
    n = len(bags)
    times = np.full((n, slots), np.inf)
    if not n:
        return times
    doc = np.repeat(np.arange(n), [len(x) for x, _ in bags])
    element = np.concatenate([x for x, _ in bags]).astype(np.uint64)
    weight = np.concatenate([w for _, w in bags]).astype(np.int64)
    # A process for each block that the weight reaches into: block 0 is (0, 1], block k is (2**(k-1), 2**k].
    blocks = np.where(weight > 0, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 0)
    which = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, weight = doc[which], weight[which]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    seed = _mix(element[which] + block.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    at = np.zeros(len(doc))
    flat, point = times.reshape(-1), 0
    while len(doc):
        point += 1
        draw = _mix(seed + _U((point * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log1p(-((draw >> _U(11)).astype(np.float64) * 2.0**-53)) / rate
        place = _mix(draw + _U(0x632BE59BD9B4E019))
        slot = (place % _U(slots)).astype(np.int64)
        unit = low + ((place >> _U(32)).astype(np.int64) & (np.maximum(low, 1) - 1))  # the half after half that it falls into
        counts = (unit < weight) & np.isfinite(at)
        np.minimum.at(flat, doc[counts] * slots + slot[counts], at[counts])
        live = at < times.max(axis=1)[doc]
        if not live.all():
            doc, weight, low, rate, seed, at = doc[live], weight[live], low[live], rate[live], seed[live], at[live]
    return times


def bands_of(times: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), times.shape[1] // BAND, BAND)
    key = np.arange(bits.shape[1], dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for k in range(BAND):
        key = _mix(key + bits[:, :, k])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def _portions(shingler: Shingler, texts) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """(positions, multisets) of texts with a word, so many at once that their shingles fit PORTION."""
    at, bags, size = [], [], 0
    for i, text in enumerate(texts):
        bag = np.unique(shingler.shingles(text), return_counts=True)
        if not len(bag[0]):
            continue
        if bags and size + len(bag[0]) > PORTION:
            yield at, bags
            at, bags, size = [], [], 0
        at.append(i)
        bags.append(bag)
        size += len(bag[0])
    if bags:
        yield at, bags


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"), "text")


def classes_of(docs: DataFrame) -> DataFrame:
    """One row for each distinct text with a word: cid, text keys, least doc_id, band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            batch = batch.drop_duplicates(["h0", "h1", "doc_id"])
            for at, bags in _portions(shingler, batch["text"]):
                part = batch.iloc[at].drop(columns="text")
                yield part.assign(bands=pd.Series(list(bands_of(signatures(bags))), index=part.index, dtype=object))

    schema = "doc_id long, h0 long, h1 long, bands array<long>"
    signed = _keyed(small_batches(docs).select(F.col("doc_id").cast("long"), "text")).filter("text IS NOT NULL").mapInPandas(run, schema)
    grouped = signed.groupBy("h0", "h1").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    return materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "text-classes")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, bag = Shingler(), None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch["a"], batch["ta"], batch["tb"]):
                if a != last:
                    last, bag = a, shingler.shingles(x)
                good.append(overlap(bag, shingler.shingles(y)) >= similarity)
            yield batch.loc[good, ["a", "b"]]

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """cid and text of the classes that share a band with another; copies stay behind."""
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "h0", "h1", "least_id")
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    on = (rows["h0"] == wanted["h0"]) & (rows["h1"] == wanted["h1"]) & rows["doc_id"].eqNullSafe(wanted["least_id"])
    return materialise(rows.join(wanted, on).select("cid", "text").dropDuplicates(["cid"]), "texts")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leaders(members: DataFrame, seed: str, n: int) -> DataFrame:
    """band and leader: n members of each band, by a hash. Spark cuts to n before it shuffles."""
    by_hash = Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "band", "cid"))
    return members.select("band", "cid").withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= n).select("band", F.col("cid").alias("leader"))


def _open_bands(members: DataFrame, found: DataFrame) -> DataFrame:
    """band, cid, component and minor (outside the band's largest component) where a band has several."""
    placed = members.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("several")).filter("several > 1").select("band", "main")
    return materialise(placed.join(largest, "band").select("band", "cid", "component", (F.col("component") != F.col("main")).alias("minor")), "open-bands")


def _across(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between the minor members of a band and its members in other components, by blocks."""
    sized = rows.join(texts.select("cid", "text"), "cid").withColumn("chars", F.length("text"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS)).cast("int")
    counts = sized.groupBy("band").agg(blocks.alias("n"))
    member = F.struct("cid", "component", "text")
    dealt = sized.join(counts, "band").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), "n").cast("int"))
    every = dealt.groupBy("band", "block").agg(F.collect_list(member).alias("right"))
    minors = dealt.filter("minor").groupBy("band", "n", F.col("block").alias("left_block")).agg(F.collect_list(member).alias("left"))
    # Each block of minors goes to each block of the band: the pairs of blocks are dealt out, not the band.
    sent = minors.select("band", "left", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    pairs = sent.join(every, ["band", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                yield pd.DataFrame(_block_links(shingler, left, right, similarity), columns=["a", "b"]).astype("int64")

    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, 8)  # a row is two blocks
    try:
        return materialise(pairs.select("left", "right").mapInPandas(run, "a long, b long").distinct(), "links")
    finally:
        spark.conf.set(name, usual)


def _block_links(shingler: Shingler, left, right, similarity: float) -> list[tuple[int, int]]:
    """(a, b) of the pairs of other components whose overlap reaches the similarity.

    The k-th occurrence of a shingle in a text is an element of its own, so that multisets are sets.
    Elements that both sides hold become the columns of two 0/1 matrices, a slice at a time.
    """
    rows, owners = [], []
    for i, member in enumerate([*left, *right]):
        h = np.sort(shingler.shingles(member["text"]))
        n = np.arange(len(h))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), n, 0)) if len(h) else n
        rows.append(_mix(h + (n - first).astype(np.uint64) * _U(0xD1342543DE82EF95)))
        owners.append(np.full(len(h), i))
    sizes = np.array([len(r) for r in rows], np.float64)
    element, owner = np.concatenate(rows), np.concatenate(owners)
    codes = np.unique(element, return_inverse=True)[1]
    split = len(left)
    both = np.zeros(codes.max() + 1 if len(codes) else 0, bool)
    in_left = np.zeros_like(both)
    in_left[codes[owner < split]] = True
    both[codes[owner >= split]] = True
    both &= in_left
    column = np.cumsum(both) - 1
    used = both[codes]
    at, owner = column[codes[used]], owner[used]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((split, len(right)))
    for begin in range(0, int(both.sum()), 4096):
        lo, hi = np.searchsorted(at, [begin, begin + 4096])
        held = np.zeros((split + len(right), 4096), np.float32)
        held[owner[lo:hi], at[lo:hi] - begin] = 1
        common += held[:split] @ held[split:].T
    union = sizes[:split, None] + sizes[None, split:] - common
    component = np.array([m["component"] for m in [*left, *right]])
    x, y = np.nonzero((common >= similarity * union) & (component[:split, None] != component[None, split:]))
    ids = np.array([m["cid"] for m in [*left, *right]])
    return [(int(min(p, q)), int(max(p, q))) for p, q in zip(ids[x], ids[split + y])]


def grouped_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """h0, h1, least_id of each class and component_id, the least doc_id of its component."""
    with scratch():
        return materialise(_grouped(docs, similarity), "text-groups", keep=True)


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    classes = classes_of(docs)
    rows = classes.select("cid", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y").select("band")
    members = materialise(rows.join(shared, "band", "left_semi"), "bands")
    texts = _texts(docs, classes, members)

    leaders = _leaders(members, "first", LEADERS)
    compared = materialise(members.join(leaders, "band").filter("cid <> leader").select(*_pair("cid", "leader")).distinct(), "pairs")
    links = materialise(_verified(compared, texts, similarity), "links")

    more = _across(_open_bands(members, components(links)), texts, similarity)
    every_link = materialise(links.unionByName(more), "all-links")

    whole = classes.drop("bands").join(components(every_link).withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return whole.join(least, "component").select("h0", "h1", "least_id", "component_id")


def op9_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, component_id (of its group of near copies), kept, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = grouped_classes(docs)
    joined = _keyed(docs).drop("text").join(done, ["h0", "h1"], "left")
    component = F.when(F.col("h0").isNotNull() & F.col("least_id").isNull() & F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which one stands for each group; wordless ones all stay."""
    done = grouped_classes(docs.select("doc_id", "text"), similarity).withColumn("stays", F.col("least_id").eqNullSafe(F.col("component_id")))
    # The caller's columns travel inside one, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"))
    joined = rows.join(done.select("h0", "h1", "least_id", "stays"), ["h0", "h1"], "left")
    first = F.col("stays").isNull() | (F.col("stays") & F.col("row.doc_id").eqNullSafe(F.col("least_id")))
    return joined.filter(first).select("row.*")


_BLANK = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
# Every pair of texts with a shingle in common, by exact counts, and what the links reach by recursion.
OP9_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS i, text, list_filter(regexp_split_to_array(lower(text), '{_BLANK}'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
w AS MATERIALIZED (SELECT i, text, ws FROM t WHERE len(ws) > 0),
s AS (SELECT i, CASE WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda k: array_to_string(ws[k:k + {SHINGLE - 1}], ' ')) END AS l FROM w),
c AS MATERIALIZED (SELECT i, sh, count(*) AS n FROM (SELECT i, unnest(l) AS sh FROM s) GROUP BY ALL),
z AS (SELECT i, sum(n) AS n FROM c GROUP BY i),
o AS (SELECT a.i AS a, b.i AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.sh = b.sh AND a.i <> b.i GROUP BY ALL),
h AS MATERIALIZED (SELECT a, b FROM o JOIN z x ON x.i = a JOIN z y ON y.i = b WHERE m / (x.n + y.n - m) >= {SIMILARITY}),
reach AS (SELECT i, i AS j FROM w UNION SELECT reach.i, h.b FROM reach JOIN h ON h.a = reach.j),
d AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
g AS (SELECT x.text, min(d.first) AS component_id FROM reach JOIN w x ON x.i = reach.i JOIN w y ON y.i = reach.j JOIN d ON d.text = y.text GROUP BY x.text)
SELECT doc_id, CASE WHEN g.text IS NULL THEN doc_id ELSE component_id END AS component_id, doc_id IS NOT DISTINCT FROM CASE WHEN g.text IS NULL THEN doc_id ELSE component_id END AS kept FROM documents LEFT JOIN g USING (text)
"""
