"""SimHash near-duplicates by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Ball hashing comes first (``simhash.links``): texts meet whose first 64 bits are within RADIUS bits.  At 0.8 some 15 of 100 bits of two
fingerprints differ, which no ball of a few bits holds, so what the balls have not joined meets once more: fingerprints are WIDE bits, and texts
whose bits agree in all places of one of many chosen segments meet, so many segments that a pair at 0.8 meets with
probability RECALL.  Every link of either step is confirmed by sets.

* Of texts with equal first bits, and of fingerprints in one ball, each is compared with the smallest.
* A segment's value that many texts share is split into groups of about GROUP, other ones for each segment.  In a group each text is
  paired with the PARTNERS nearest ones by 64 bits.
* Each text's nearest partner is compared first, by sets, exactly; then, in turns, the nearest partner outside of each component; then all
  pairs that still join two components.
* Values where a text had more near ones than partners, or that were split, are open.  Of those that lie in several components, each text is
  compared with the text of most links that it meets there (STARS turns), which joins the family of a hub.  What then still lies outside the
  largest component of its value is compared with all texts of the value: a task gets PART by PART texts with their fingerprints and sets
  and hands on links that join components.  So no cap loses a link between texts that meet.

A text's set travels once for each CHUNK of its partners; no group is paired in full outside a block, and none lies in one task.

Defined cases: null and wordless texts are one empty shingle, so they are alike; texts of fewer than five words are one shingle; equal texts
are one group whatever its size; of rows with one doc_id the first by content stays; rows without doc_id come last; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import release_memory, rounds, row_key, small, text_or_empty, written
from .minhash import shared_counts
from .simhash import RADIUS, SEED, _survivors, components, links

#: Words of a shingle, least Jaccard similarity, probability that a pair at it meets.
WORDS = 5
SIMILAR = 0.8
RECALL = 0.99
#: Bits of a wide fingerprint, and in how many two of similar texts may differ: 78 are expected at 0.8, 256 of others.
WIDE = 512
NEAR = 130
#: The same of the first 64 bits, compared before pairs are written: 10 are expected at 0.8, 32 of others.
NEAR_FIRST = 24
#: A segment's value that at least HOT_IN_SAMPLE texts of a sample of one in ONE_IN share is split into groups of about GROUP.
ONE_IN, HOT_IN_SAMPLE, GROUP = 64, 4, 64
#: Of the texts of its group that are near, each is paired with so many nearest ones; the open values make up for the others.
PARTNERS = 1
#: Turns of nearest pairs, and of texts with most links.
TURNS, STARS = 2, 2
#: Texts on a side of a block; partners of a text that lie in one group of exact comparisons.
PART, CHUNK = 512, 64
#: Most rows of a table of hot values that is broadcast, under 10 MB.
BROADCAST_ROWS = 200_000


def shingles(text: str, shingle: int = WORDS) -> set[bytes]:
    words = text.encode().lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else {b" ".join(words)}


def hashed(text: str, seed: int = SEED) -> np.ndarray:
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in shingles(text)), np.uint64))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def wide_fingerprint(text: str, seed: int = SEED) -> np.ndarray:
    """WIDE bits, as WIDE / 64 numbers: the majority of each bit over the text's set of shingles."""
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles(text)), np.uint64)
    n, size = len(hashes), WIDE // 8
    counts = np.zeros(size * 256, np.int64)
    for k in range(0, n, 1 << 14):
        z = hashes[k : k + (1 << 14), None] + np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.bincount((z.view(np.uint8).reshape(-1, size) + np.arange(size) * 256).ravel(), minlength=size * 256)
    ones = counts.reshape(size, 256) @ _BYTE_BITS
    return np.packbits((ones * 2 > n).ravel(), bitorder="little").view(np.int64)


FP = [f"f{k}" for k in range(WIDE // 64)]


def wide_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, r, t, f0 ...) for each row; t is the hash of the text, the same for equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in rounds(batch, "text")):
            found = np.array([wide_fingerprint(t) for t in part.column("text").to_pylist()], np.int64).reshape(part.num_rows, len(FP))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("r"), part.column("t"), *(pa.array(c) for c in found.T)], ["doc_id", "r", "t", *FP])
        release_memory()

    texts = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), row_key("doc_id", "text").alias("r"), F.xxhash64(text_or_empty()).alias("t"))
    return texts.mapInArrow(run, "doc_id long, r long, t long, " + ", ".join(f"{c} long" for c in FP))


def segments(n: int) -> np.ndarray:
    """Places of bits, one row a segment: wide enough that few of ``n`` texts agree by chance, and enough of them for RECALL."""
    width = max(20, math.ceil(math.log2(max(n, 1))) + 2)
    same = (1 - math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi) ** width
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - same))
    return np.random.default_rng(SEED).random((count, WIDE)).argsort(axis=1)[:, :width]


def meetings(distinct: DataFrame) -> DataFrame:
    """(s, pairs, open) for each group of a segment's value: pairs (a, b, n), a < b, with the bits in which they differ; the texts of an open value."""
    places = segments(distinct.count())
    width = places.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, first = 1 << np.arange(width, dtype=np.int64), np.arange(len(places), dtype=np.int64) << width
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                bits = np.unpackbits(_matrix(part).view(np.uint8), axis=1, bitorder="little")
                values = np.stack([bits[:, p] @ powers for p in places], axis=1) + first
                t, f0 = (pa.array(np.repeat(part.column(c).to_numpy(), len(places))) for c in ("t", "f0"))
                yield pa.RecordBatch.from_arrays([t, f0, pa.array(values.ravel())], ["t", "f0", "s"])

    conf = distinct.sparkSession.conf
    spread = distinct.select("t", *FP).repartition(int(conf.get("spark.sql.shuffle.partitions")), "t")
    schema = "t long, f0 long, s long"
    # values that many texts share are known from a sample of texts, so that segments shuffle once
    counts = spread.where(F.pmod(F.xxhash64("t"), F.lit(ONE_IN)) == 0).mapInArrow(run, schema).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") >= HOT_IN_SAMPLE).select("s", F.ceil(F.col("n") * ONE_IN / GROUP).alias("parts")))
    met = spread.mapInArrow(run, schema).join(small(hot, BROADCAST_ROWS), "s", "left")
    group = F.pmod(F.xxhash64("t", "s"), F.coalesce("parts", F.lit(1)))
    lists = met.groupBy("s", group.alias("g")).agg(F.collect_list(F.struct("t", "f0")).alias("l"), F.max("parts").isNotNull().alias("split"))

    def near(a: Column) -> Column:
        apart = F.transform("l", lambda b: F.struct(F.bit_count(a["f0"].bitwiseXOR(b["f0"])).alias("n"), b["t"].alias("t")))
        return F.struct(a["t"].alias("t"), F.sort_array(F.filter(apart, lambda b: (b["t"] != a["t"]) & (b["n"] <= NEAR_FIRST))).alias("near"))

    def partners(x: Column) -> Column:
        return F.transform(F.slice(x["near"], 1, PARTNERS), lambda b: F.struct(F.least(x["t"], b["t"]).alias("a"), F.greatest(x["t"], b["t"]).alias("b"), b["n"].alias("n")))

    found = lists.where((F.size("l") > 1) | F.col("split")).select("s", "split", F.transform("l", near).alias("x"))
    capped = F.exists("x", lambda x: F.size(x["near"]) > PARTNERS)
    members = F.when(F.col("split"), F.col("x")).when(capped, F.filter("x", lambda x: F.size(x["near"]) > 0))
    pairs = F.array_distinct(F.flatten(F.transform("x", partners)))
    found = found.select("s", pairs.alias("pairs"), F.transform(members, lambda x: x["t"]).alias("open"))
    return found.where((F.size("pairs") > 0) | F.col("open").isNotNull())


def near(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) that are near as whole fingerprints."""
    names = pairs.columns
    for side in ("a", "b"):
        pairs = pairs.join(distinct.select(F.col("t").alias(side), *[F.col(c).alias(side + c) for c in FP]), side)
    apart = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in FP), F.lit(0))
    return pairs.where(apart <= NEAR).select(*names)


def balls(distinct: DataFrame) -> DataFrame:
    """(a, b): texts of ``distinct`` (t, f0 ...) whose first 64 bits are equal or within RADIUS bits, enough pairs to connect all such."""
    first = written(distinct.groupBy(F.col("f0").alias("fp")).agg(F.min("t").alias("t")))
    met = links(first.select("fp"), RADIUS)
    for side in ("a", "b"):
        met = met.join(first.select(F.col("fp").alias(side), F.col("t").alias("t" + side)), side)
    same = distinct.select(F.col("f0").alias("fp"), F.col("t").alias("tb")).join(first.withColumnRenamed("t", "ta"), "fp").where("ta <> tb")
    # fingerprints of ``met`` differ and those of ``same`` are equal, so no pair is there twice
    return met.select("ta", "tb").unionAll(same.select("ta", "tb")).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), hashes of texts, whose sets of shingles are similar; ``texts`` (t, text) has each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for part in (x for batch in batches for x in rounds(batch, "x")):
            good = []
            for a, x, y in zip(part.column("a").to_pylist(), part.column("x").to_pylist(), part.column("y").to_pylist()):
                if a != last:
                    last, of_last = a, shingles(x)
                good.append(jaccard(of_last, shingles(y)) >= SIMILAR)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    count = written(_ends(pairs).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    for side in ("a", "b"):
        pairs = pairs.join(count.select(F.col("t").alias(side), F.col("n").alias("n" + side)), side)
    texts = texts.join(small(count, BROADCAST_ROWS), "t")  # with a broadcast, no other texts shuffle
    more = F.col("nb") > F.col("na")  # the end with more partners comes first
    turned = pairs.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("na", "nb").alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = turned.withColumn("chunk", F.pmod(F.xxhash64("b"), chunks).cast("int")).join(texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b")
    heads = texts.select(F.col("t").alias("a"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("text").alias("x"))
    return rows.join(heads, ["a", "chunk"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("t"))


def _labelled(rows: DataFrame, label: DataFrame | None, *names: str) -> DataFrame:
    """``rows`` with the component of each of columns ``names`` as l<name>; a text without links is its own."""
    for name in names:
        if label is None:
            rows = rows.withColumn("l" + name, F.col(name))
        else:
            rows = rows.join(label.select(F.col("node").alias(name), F.col("label").alias("l" + name)), name, "left").withColumn("l" + name, F.coalesce("l" + name, name))
    return rows


def _matrix(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in FP], axis=1))


def joining(one: np.ndarray, two: np.ndarray) -> list[int]:
    """The places of links between components one[k] and two[k] that join what those before them have not joined."""
    root: dict[int, int] = {}
    found = []

    def top(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = k = root.get(up, up)
        return k

    for k, (a, b) in enumerate(zip(one.tolist(), two.tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            found.append(k)
    return found


def _block(rows: pa.Table) -> pa.Table:
    """(a, b): links between the sides of one block that join components."""
    t, label, side = (rows.column(c).to_numpy() for c in ("t", "lt", "side"))
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    fps = _matrix(rows).view(np.uint64)  # bits of signed numbers would be counted without their sign
    apart = np.zeros((len(x), len(y)), np.int16)
    for k in range(len(FP)):
        apart += np.bitwise_count(fps[x, k][:, None] ^ fps[y, k][None, :])
    u, v = np.nonzero((apart <= NEAR) & (label[x][:, None] != label[y][None, :]))
    if len(u):
        sets = rows.column("set")
        (left, u), (right, v) = np.unique(x[u], return_inverse=True), np.unique(y[v], return_inverse=True)
        of_left, of_right = ([np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in ks] for ks in (left, right))
        both = shared_counts(of_left, of_right)[u, v]
        union = np.array([len(s) for s in of_left])[u] + np.array([len(s) for s in of_right])[v] - both
        good = both >= SIMILAR * union
        u, v = left[u[good]], right[v[good]]
        taken = joining(label[u], label[v])
        u, v = u[taken], v[taken]
    return pa.table({"a": pa.array(np.minimum(t[u], t[v]), pa.int64()), "b": pa.array(np.maximum(t[u], t[v]), pa.int64())})


def blocks(rest: DataFrame, texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links in the values ``rest`` (s, t, lt) that join components: texts outside the largest one meet all of their value."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in rounds(batch, "text")):
            found = [hashed(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(found, pa.binary())], ["t", "set"])

    count = lambda n: F.ceil(n / PART).cast("int")
    sizes = rest.groupBy("s", "lt").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "lt")).alias("m"), F.sum("n").alias("all"))
    sizes = written(sizes.select("s", F.col("m.lt").alias("most"), count(F.col("all")).alias("p_all"), count(F.col("all") - F.col("m.n")).alias("q_all")))
    rows = rest.join(sizes, "s")
    part = lambda n: F.pmod(F.xxhash64("t"), F.col(n)).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = F.transform(F.sequence(F.lit(0), F.col("q_all") - 1), lambda q: place(part("p_all"), q, 1))
    outside = F.transform(F.sequence(F.lit(0), F.col("p_all") - 1), lambda p: place(p, part("q_all"), 0))
    placed = rows.select("s", "t", "lt", F.explode(F.when(F.col("lt") == F.col("most"), every).otherwise(F.concat(every, outside))).alias("x"))
    known = texts.join(small(written(rest.select("t").distinct()), BROADCAST_ROWS), "t").select("t", "text").mapInArrow(sets, "t long, set binary").join(distinct, "t")
    full = placed.join(written(known), "t").select("s", "x.i", "x.j", "x.side", "t", "lt", *FP, "set")
    return full.groupBy("s", "i", "j").applyInArrow(_block, "a long, b long").distinct()


def linked(distinct: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, label): the component of each text of ``distinct`` (t, f0 ...) that has a link."""
    found = written(meetings(distinct))
    left = written(near(found.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.n").distinct(), distinct))
    ball = written(balls(distinct))
    members = written(found.where("open is not null").select("s", F.explode("open").alias("t")))
    asked = written(written(_ends(left).unionAll(_ends(ball)).unionAll(members.select("t"))).distinct())
    hashed_texts = documents.select(F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))
    texts = written(hashed_texts.join(asked, "t", "left_semi").dropDuplicates(["t"]))
    edges = label = None

    def confirm(pairs: DataFrame) -> None:
        nonlocal edges, label
        good = written(similar(pairs, texts))
        edges = good if edges is None else written(edges.unionAll(good))
        label = components(edges)

    confirm(ball)
    for turn in range(TURNS + 1):
        left = written(_labelled(left, label, "a", "b").where("la <> lb"))
        if turn < TURNS:
            ends = left.select(F.explode(F.array("la", "lb")).alias("c"), "n", "a", "b")
            tried = written(ends.groupBy("c").agg(F.min(F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
        else:
            tried = left.select("a", "b")
        confirm(written(tried))
        left = left.select("a", "b", "n").join(tried, ["a", "b"], "left_anti")
    for turn in range(STARS + 1):
        rest = written(_labelled(members, label, "t"))
        several = rest.groupBy("s").agg(F.min("lt").alias("lo"), F.max("lt").alias("hi")).where("lo <> hi").select("s")
        rest = written(rest.join(written(several), "s"))
        if rest.isEmpty():
            break
        members = rest.select("s", "t")
        if turn < STARS:
            # links are counted for texts of values in several components only
            degree = _ends(edges).groupBy("t").agg(F.count(F.lit(1)).alias("d"))
            known = written(rest.join(degree, "t", "left").withColumn("d", F.coalesce("d", F.lit(0))))
            heads = known.groupBy("s").agg(F.max(F.struct("d", "t", "lt")).alias("h"))
            most = known.join(written(heads), "s").where(F.col("lt") != F.col("h.lt")).groupBy("t").agg(F.max("h").alias("h"))
            tried = most.select(F.least("t", "h.t").alias("a"), F.greatest("t", "h.t").alias("b")).distinct()
            confirm(written(near(tried, distinct)))
        else:
            confirm(written(blocks(rest.select("s", "t", "lt"), texts, distinct)))
    return label


def keep_first(documents: DataFrame) -> DataFrame:
    """``documents`` without all but one row of each component of similar texts, that with the smallest doc_id."""
    docs = written(wide_fingerprints(documents))
    distinct = written(docs.groupBy("t").agg(*[F.first(c).alias(c) for c in FP]))
    label = linked(distinct, documents)
    found = docs.select("doc_id", "r", "t").join(label, F.col("t") == F.col("node"), "left")
    return _survivors(documents, found.select("doc_id", "r", F.coalesce("label", "t").alias("root")))
