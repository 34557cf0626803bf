"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two fingerprints within
``2 r`` bits share a variant within ``r`` bits of both, so every distinct fingerprint emits all its variants
within half the radius, variants shuffle, and fingerprints that meet are verified and linked.  All fingerprints of one
variant are within the radius of each other; each is linked with the smallest of them, which loses no connection
and makes no pairs within a group.  Components come from alternating star contractions over links, written to the
shared folder each round; texts and documents do not take part, only distinct fingerprints that have a link.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; a text with fewer words than
a shingle is one shingle; equal fingerprints are one group whatever its size; rows with one doc_id get one row each; a
null doc_id never names a component unless all its members are null; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, rounds, row_key, salted, table, text_or_empty, written

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
#: Most edges of a round whose minima, of two nodes an edge at most, are broadcast: under 10 MB, and no shuffle of edges.
FEW_EDGES = 100_000
#: Shingles counted at once: 64 bytes each.
BLOCK = 1 << 17


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is space and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        joined: Iterator[bytes] = iter([b" ".join(words)])
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in joined), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, r, fp) for each row; r tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in rounds(batch, "text")):
            found = np.fromiter((fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("r"), pa.array(found.view(np.int64))], ["doc_id", "r", "fp"])

    texts = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), row_key("doc_id", "text").alias("r"))
    return texts.mapInArrow(run, "doc_id long, r long, fp long")


def variants(fp: Column, radius: int) -> Column:
    """All values within ``radius`` (0 or 1) bits of ``fp``."""
    if radius == 0:
        return F.array(fp)
    masks = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(BITS))]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: enough pairs of linked fingerprints to connect all that link."""
    if radius not in (0, 2):
        raise ValueError("radius 0 or 2: with an odd one, fingerprints of one variant need not link with the smallest of them")
    # few bytes a fingerprint, many a variant: dealt out again, or they would be expanded in one task
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    met = spread.select("fp", F.explode(variants(F.col("fp"), radius // 2)).alias("v"))
    least = met.groupBy("v").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("v", "a")
    pairs = salted(met, least, "v", "fp").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star in turn: neighbours move to the smallest of the neighbourhood, until the edges are
    stars.  Neighbourhoods are grouped by minima that combine before the shuffle and joined back with a salt, so no task
    holds one; those of few edges are broadcast instead.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = lambda: edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    now = state()
    while now["n"]:
        # a round has no more edges than the one before, and two nodes an edge at most
        each = (lambda rows, side, key, by: rows.join(F.broadcast(side), key)) if now["n"] <= FEW_EDGES else salted
        # large star: each node hands its larger neighbours to the smallest of itself and its neighbours
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = each(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = each(large, low, "b", "a").select(F.col("m").alias("a"), F.col("a").alias("c")).where("a <> c").select("a", F.col("c").alias("b"))
        edges = written(small.unionAll(low.select(F.col("m").alias("a"), "b")).distinct())
        before, now = now, state()
        if now == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))


def _grouped(documents: DataFrame, radius: int, shingle: int, seed: int) -> DataFrame:
    """(doc_id, r, fp, root, component_id) for each row; root: the smallest fingerprint that a row's reaches."""
    docs = cut(fingerprints(documents, shingle, seed))
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("root"))
    roots = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    return salted(docs, salted(grouped, roots, "root", "fp").select("fp", "root", "component_id"), "fp", "doc_id", "r")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    return _grouped(documents, radius, shingle, seed).select("doc_id", "fp", "component_id")


def _survivors(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``documents`` that come first of each root of ``found`` (doc_id, r, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")).alias("w")
    keep = cut(found.groupBy("root").agg(first).select(F.col("w.doc_id").alias("__d"), F.col("w.r").alias("__q")))
    docs = documents.withColumn("__r", row_key("doc_id", "text"))
    kept = docs.join(keep, (F.col("__r") == F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
    # equal rows of one doc_id are all there still: number them, where there are any
    if kept.groupBy("doc_id", "__r").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        return kept.drop("__r")
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__r").orderBy("text"))).where("__n = 1").drop("__n", "__r")


def keep_first(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``documents`` without all but one row of each component, that with the smallest doc_id; rows without doc_id come last.

    Only the survivors' ids meet the texts again.
    """
    return _survivors(documents, _grouped(documents, radius, shingle, seed))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
