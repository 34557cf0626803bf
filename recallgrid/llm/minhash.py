"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of four words.  Texts whose sets have a Jaccard similarity of 0.8 or more are
linked, and each document gets the smallest doc_id that links reach.  Equal texts are one text from the start.

* Every text has BANDS x ROWS minimum hashes.  Texts that agree in all hashes of a band share a bucket.
* Of a bucket, each text is first compared with the text of the smallest hash, then, where a bucket is not in one component yet, with one drawn
  at random (stars, so no group is paired in full).  What then still lies in other components than most of its bucket is compared with all of
  the bucket: a task gets PART by PART texts with their signatures and sets, and hands on links that join components, one for two components.
  So no cap on partners loses a link.
* A comparison reads the signatures, one byte a hash, in batches of BATCH.  After each batch the posterior probability that
  the similarity is 0.8 or more, from a uniform prior, must be MISS at least, or the pair is dropped.
* Pairs that are left are held against the full sets of shingles.  A text meets its partners where the one with more
  partners is, in groups of CHUNK partners, so neither a hub nor a large family lies in one task.

Defined cases: null and wordless texts have an empty set and link with nothing, not even with each other; fewer than four words
are one shingle; rows with one doc_id get one row each; a null doc_id names a component only if all its members are null;
ties of similarity count as linked (80 of 100 exactly); other columns of the input are ignored.  Texts are told apart by
64 bits, so among 10^9 different texts some two are taken for one with a probability of 0.03.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import release_memory, rounds, table, text_or_empty, written
from .simhash import components

WORDS = 4
#: Least similarity, in hundredths: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: At 0.8 a pair misses all bands with probability 0.00006.
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
SEED = 42
#: Hashes compared at once, and the posterior probability below which a pair is dropped.
BATCH, MISS = 32, 1e-4
#: Texts on a side of a block; partners of a text that lie in one group of exact comparisons; turns of stars with drawn leaders.
PART, CHUNK, STARS = 512, 64, 1
#: Shingles hashed at once.
BLOCK = 1 << 16

_random = np.random.default_rng(SEED)
_WORD = _random.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + _random.integers(0, 2, HASHES, np.uint64)
_TIMES = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, and white space is space and \x09-\x0D


def shingles(text: str) -> set[bytes]:
    w = words(text)
    if len(w) < WORDS:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(WORDS)))))


def alike(x: set[bytes], y: set[bytes]) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hashed_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes; each word of the batch is hashed once."""
    split = [words(t) for t in texts]
    known = {w: xxh64_intdigest(w, SEED) for w in set(itertools.chain.from_iterable(split))}
    found = []
    for w in split:
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        if 0 < len(h) < WORDS:
            h = np.append(h, np.arange(1, WORDS - len(h) + 1, dtype=np.uint64))
        rolled = sum((h[i : len(h) - WORDS + 1 + i] * _WORD[i] for i in range(WORDS)), np.zeros(max(0, len(h) - WORDS + 1), np.uint64))
        found.append(np.unique(_mixed(rolled)))
    return found


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minimum hashes for each set, none of them empty."""
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    found = np.full((len(sets), HASHES), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(every), BLOCK):
        part = every[lo : lo + BLOCK]
        first = int(np.searchsorted(starts, lo, "right")) - 1
        after = int(np.searchsorted(starts, lo + len(part), "left"))
        cuts = np.maximum(starts[first:after] - lo, 0)
        turned = np.empty_like(part)
        for k in range(HASHES):
            np.bitwise_xor(part, _XOR[k], out=turned)
            np.multiply(turned, _TIMES[k], out=turned)
            rows = found[first:after, k]
            np.minimum(rows, np.minimum.reduceat(turned, cuts), out=rows)
    return found


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band."""
    keys = np.zeros((len(found), BANDS), np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys + found[:, k::ROWS] + np.uint64(k))
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * _WORD[0])


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, t, n, sig, keys) for each row: the hash of the text, the size of its set, a byte of each minimum hash, the keys of its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in rounds(batch, "text", 400_000)):
            sets = hashed_sets(part.column("text").to_pylist())
            sig, keys = [None] * len(sets), [None] * len(sets)
            if some := [i for i, s in enumerate(sets) if len(s)]:
                found = minima([sets[i] for i in some])
                low = (found >> np.uint64(24)).astype(np.uint8)
                for i, s, k in zip(some, low, bands(found).view(np.int64)):
                    sig[i], keys[i] = s.tobytes(), k
            columns = [part.column("doc_id"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release_memory()

    return _texts(documents).mapInArrow(run, "doc_id long, t long, n long, sig binary, keys array<long>")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))


def least_matches(miss: float = MISS) -> np.ndarray:
    """How many of BATCH, 2 BATCH ... hashes must match for a pair to stay."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256  # one byte of two different hashes agrees by chance
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        tail = weight[:, j >= SIMILAR / 100].sum(axis=1) / weight.sum(axis=1)
        least.append(int(np.argmax(tail >= miss)))
    return np.array(least)


LEAST = least_matches()


def survivors(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (x[i], y[j]) are left after all batches, and how many of their hashes match."""
    left, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, least in enumerate(LEAST):
        places = slice(k * BATCH, (k + 1) * BATCH)
        for lo in range(0, len(left), BLOCK):
            at = left[lo : lo + BLOCK]
            matches[at] += (x[i[at], places] == y[j[at], places]).sum(axis=1, dtype=np.int32)
        left = left[matches[left] >= least]
    return left, matches[left]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def plausible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, m): those of ``pairs`` (a, b) whose signatures may be similar, and how many hashes match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                left, m = survivors(_matrix(batch.column("x")), _matrix(batch.column("y")), every, every)
                taken = batch.select(["a", "b"]).take(pa.array(left))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(m.astype(np.int32))], ["a", "b", "m"])

    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(distinct.select(F.col("t").alias(side), F.col("sig").alias(name)), side)
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, m int")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), a and b in order, whose full sets are similar; ``texts`` (t, text) has each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for part in (x for batch in batches for x in rounds(batch, "x")):
            good = []
            for a, x, y in zip(part.column("a").to_pylist(), part.column("x").to_pylist(), part.column("y").to_pylist()):
                if a != last:
                    last, of_last = a, shingles(x)
                good.append(alike(of_last, shingles(y)))
            a, b = (part.column(c).to_numpy()[np.array(good, bool)] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ends = pairs.select(F.col("a").alias("t")).unionAll(pairs.select("b")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    ends = written(ends)
    for side in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("t").alias(side), F.col("n").alias("n" + side)), side)
    more = F.col("nb") > F.col("na")  # the end with more partners comes first
    turned = pairs.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("na", "nb").alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = turned.withColumn("chunk", F.pmod(F.xxhash64("b"), chunks).cast("int")).join(texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b")
    heads = texts.join(ends, "t").select(F.col("t").alias("a"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("text").alias("x"))
    return members.join(heads, ["a", "chunk"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, label: DataFrame | None, *names: str) -> DataFrame:
    """``rows`` with the component of each of columns ``names`` as l<name>; a text without links is its own."""
    for name in names:
        if label is None:
            rows = rows.withColumn("l" + name, F.col(name))
        else:
            rows = rows.join(label.select(F.col("node").alias(name), F.col("label").alias("l" + name)), name, "left").withColumn("l" + name, F.coalesce("l" + name, name))
    return rows


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets ``left`` has in common with each of ``right``, by products of indicator matrices."""
    both = [*left, *right]
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        here = np.zeros((len(both), 4096), np.float32)
        here[row[a:b], column[a:b] - lo] = 1
        found += here[: len(left)] @ here[len(left) :].T
    return found.astype(np.int64)


def _block(table: pa.Table) -> pa.Table:
    """(a, b): links between the sides of one block, one for two components that are not joined yet."""
    t, label, side = (table.column(c).to_numpy() for c in ("t", "lt", "side"))
    x, y = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))  # 2: on both sides
    a, b = [], []
    met = label[x][:, None] != label[y][None, :]
    if len(side) and side[0] == 2:
        met &= t[x][:, None] < t[y][None, :]
    u, v = np.nonzero(met)
    if len(u):
        sig = _matrix(table.column("sig").combine_chunks())
        left, _ = survivors(sig[x], sig[y], u, v)
        u, v = u[left], v[left]
    if len(u):
        sets = table.column("set")
        of = {k: np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in {*x[u].tolist(), *y[v].tolist()}}
        (rows, u), (columns, v) = np.unique(x[u], return_inverse=True), np.unique(y[v], return_inverse=True)
        left, right = [of[int(k)] for k in rows], [of[int(k)] for k in columns]
        both = shared_counts(left, right)[u, v]
        sizes = np.array([len(s) for s in left])[u] + np.array([len(s) for s in right])[v]
        good = 100 * both >= SIMILAR * (sizes - both)
        u, v = rows[u[good]], columns[v[good]]
        _, first = np.unique(np.stack([np.minimum(label[u], label[v]), np.maximum(label[u], label[v])]), axis=1, return_index=True)
        root = {}

        def top(k: int) -> int:
            while (up := root.get(k, k)) != k:
                k = up
            return k

        for k in first:
            one, two = top(int(label[u[k]])), top(int(label[v[k]]))
            if one != two:
                root[one] = two
                a.append(min(t[u[k]], t[v[k]]))
                b.append(max(t[u[k]], t[v[k]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def blocks(rest: DataFrame, texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links in the buckets ``rest`` (s, t, lt) that join components.

    The texts of a bucket's largest component are alike already: they meet those of the others only, and these meet each other.
    """
    sizes = rest.groupBy("s", "lt").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "lt")).alias("m"), F.sum("n").alias("all"))
    count = lambda n: F.ceil(n / PART).cast("int")
    sizes = written(sizes.select("s", F.col("m.lt").alias("most"), count(F.col("m.n")).alias("p_all"), count(F.col("all") - F.col("m.n")).alias("q_all")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in rounds(batch, "text")):
            found = [h.tobytes() for h in hashed_sets(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(found, pa.binary())], ["t", "set"])

    rows = rest.join(sizes, "s")
    part = lambda n: F.pmod(F.xxhash64("t"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    large = F.transform(each("q_all"), lambda q: place(0, part("p_all"), q, F.lit(0)))
    other = F.transform(each("p_all"), lambda p: place(0, p, part("q_all"), F.lit(1)))
    among = F.transform(each("q_all"), lambda q: place(1, F.least(q, part("q_all")), F.greatest(q, part("q_all")), F.when(q == part("q_all"), 2).otherwise((q < part("q_all")).cast("int"))))
    placed = rows.select("s", "t", "lt", F.explode(F.when(F.col("lt") == F.col("most"), large).otherwise(F.concat(other, among))).alias("x"))
    # a block within one part of the others holds each text once; between two parts, those of the first are on the left
    known = texts.join(rest.select("t").distinct(), "t").select("t", "text").mapInArrow(sets, "t long, set binary").join(distinct.select("t", "sig"), "t")
    full = placed.join(known, "t").select("s", "x.kind", "x.i", "x.j", "x.side", "t", "lt", "sig", "set")
    return full.groupBy("s", "kind", "i", "j").applyInArrow(_block, "a long, b long").distinct()


def linked(distinct: DataFrame, documents: DataFrame) -> DataFrame | None:
    """(node, label): the component of each text of ``distinct`` (t, doc_id, sig, keys) that has a link; None without links."""
    met = distinct.select("t", F.explode("keys").alias("s"))
    least = written(met.groupBy("s").agg(F.min("t").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "a"))
    members = written(met.join(least, "s").select("s", "t", "a"))
    star = members.where("t <> a").select("a", F.col("t").alias("b")).distinct()
    pairs = written(plausible(star, distinct))
    shared = members.select("t").distinct().join(distinct.select("t", "doc_id"), "t")
    key = F.coalesce("doc_id", F.lit(-1)).alias("d")
    found = _texts(documents).withColumn("d", key).drop("doc_id").join(shared.select("t", key), ["d", "t"])
    texts = written(found.select("t", "text").dropDuplicates(["t"]))
    # the nearest text of each first; what still joins two components then
    nearest = written(pairs.groupBy("b").agg(F.max(F.struct("m", "a")).alias("p")).select("p.a", "b"))
    edges = written(confirmed(nearest, texts))
    label = components(edges)
    more = written(_labelled(pairs.join(nearest, ["a", "b"], "left_anti").select("a", "b"), label, "a", "b").where("la <> lb").select("a", "b"))
    if not more.isEmpty():
        edges = edges.unionAll(written(confirmed(more, texts)))
        label = components(edges)
    # buckets that are not in one component yet, without the text that all others were compared with
    rest = members.where("t <> a").select("s", "t")
    known = pairs.select("a", "b")
    for turn in range(STARS + 1):
        rest = _labelled(rest, label, "t")
        open_ = rest.groupBy("s").agg(F.min("lt").alias("lo"), F.max("lt").alias("hi"), F.min_by("t", F.xxhash64("t", "s", F.lit(turn))).alias("a")).where("lo <> hi").select("s", "a")
        rest = written(rest.join(written(open_), "s"))
        if rest.isEmpty():
            return label
        if turn < STARS:
            asked = _labelled(rest.where("t <> a").select(F.least("a", "t").alias("a"), F.greatest("a", "t").alias("b")).distinct(), label, "a", "b").where("la <> lb").select("a", "b")
            found = written(plausible(asked.join(known, ["a", "b"], "left_anti"), distinct))
            edges = edges.unionAll(written(confirmed(found, texts)))
            rest = rest.where("t <> a").select("s", "t")
        else:
            edges = edges.unionAll(written(confirmed(written(blocks(rest.select("s", "t", "lt"), texts, distinct)), texts)))
        label = components(edges)
    return label


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    docs = written(signatures(documents))
    distinct = written(docs.where("n > 0").select("t", "doc_id", "sig", "keys").dropDuplicates(["t"]))
    label = linked(distinct, documents)
    rows = docs.where("n > 0").groupBy("t").agg(F.min("doc_id").alias("low"))
    of = _labelled(rows, label, "t")
    ids = of.groupBy("lt").agg(F.min("low").alias("component_id"))
    of = written(of.join(written(ids), "lt").select("t", "component_id"))
    found = docs.select("doc_id", "t", "n").join(of, "t", "left")
    # rows without words are joined with nothing, whatever their number
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op11_minhash": op11_minhash}
ORACLES: dict[str, str] = {}
