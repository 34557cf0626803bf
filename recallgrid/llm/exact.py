"""Exact deduplication behind two passes of Bloom filtering.

Pass one: each task sets its texts' bits in a filter, and in a second filter the bits that were set before; the
filters of all tasks merge segment by segment on executors, and a bit that two of them have set also goes to the second.
A text that occurs twice has all its bits in the second filter.  Pass two: only rows whose bits are all there shuffle, to be
grouped by the SHA-256 of the text; the rest pass straight through as groups of one.  False positives shuffle in vain but
change nothing.

A filter holds RANGE_ROWS rows at most, so what is broadcast is bounded.  Larger tables are dealt by hash into ranges,
each with a filter of its own, and one range is tested after the other; digests, not texts, are dealt.  A task sends the
bits of a segment as a list where that is shorter, so what merges is bounded by rows, however many tasks there are.

Equal texts are identical after no change; null counts as empty.  Of equal texts the row with the largest doc_id stays;
rows without doc_id come last, and of rows equal in text and doc_id exactly one stays.  Other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, salted, shared_folder, table, text_or_empty

BITS_PER_ROW = 24
HASHES = 4
#: Rows of one range: a filter of 2**28 bits, 32 MB.
RANGE_ROWS = (1 << 28) // BITS_PER_ROW
#: Bits of one segment of a filter, the unit that merges.
SEGMENT = 1 << 20


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each hash, by double hashing."""
    h = hashes.astype(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return np.stack([((h >> np.uint64(3)) + step * np.uint64(i)) % np.uint64(bits) for i in range(HASHES)], axis=1).astype(np.int64)


def _set(filter_: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(filter_, bits >> 3, (1 << (bits & 7)).astype(np.uint8))


def _has(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _packed(segment: np.ndarray) -> bytes:
    """A segment's bytes, or the numbers of its bits if those are fewer bytes."""
    bits = np.flatnonzero(np.unpackbits(segment, bitorder="little")) if np.count_nonzero(segment) * 4 < len(segment) else None
    return segment.tobytes() if bits is None or len(bits) * 4 >= len(segment) else bits.astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT // 8:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(SEGMENT // 8, np.uint8)
    _set(out, np.frombuffer(data, np.uint32).astype(np.int64))
    return out


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The second filter over all rows of ``hashes`` (h)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            places = _places(values, bits)
            _set(twice, places[(n > 1) | _has(once, places)].ravel())
            _set(once, places.ravel())
        size = SEGMENT // 8
        for k in range(0, bits // 8, size):
            if once[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size]), *(pa.array([_packed(x[k : k + size])], pa.binary()) for x in (once, twice))], ["segment", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                a, b = _unpacked(a), _unpacked(b)
                twice |= b | once & a
                once |= a
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([_packed(twice)], pa.binary())], ["segment", "twice"])

    parts = hashes.select("h").mapInArrow(fill, "segment long, once binary, twice binary")
    found = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("segment").applyInArrow(merge, "segment long, twice binary").toLocalIterator():  # bits / 8 bytes at most
        at = row["segment"] * (SEGMENT // 8)
        found[at : at + SEGMENT // 8] = _unpacked(row["twice"])
    return found


def marked(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` (h, ...) with again: whether h may occur twice."""
    bits = max(SEGMENT, 1 << int(np.ceil(np.log2(max(1, rows) * BITS_PER_ROW))))
    seen = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, bits))
    names = [*docs.columns, "again"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = _has(seen.value, _places(batch.column("h").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again)], names)

    return docs.mapInArrow(mark, docs.schema.simpleString()[7:-1].replace(":", " ") + ", again boolean")


def exact_groups(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row."""
    text = text_or_empty()
    # digests are all that is needed of a text; they are written once, so the passes read no text again and u stays as it is
    docs = cut(documents.select(F.col("doc_id").cast("long"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u")))
    rows = docs.count()
    ranges = -(-rows // range_rows)
    if ranges <= 1:
        tested = marked(docs, rows)
    else:
        spark = documents.sparkSession
        path = f"{shared_folder(spark)}/exact-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
        in_range = F.pmod(F.xxhash64("h"), F.lit(ranges)).alias("g")
        docs.select("*", in_range).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", F.pmod("u", F.lit(64))).write.partitionBy("g").parquet(path)
        tested = None
        for g in range(ranges):
            one = marked(spark.read.parquet(path).where(F.col("g") == g).drop("g"), range_rows)
            tested = one if tested is None else tested.unionAll(one)
    tested = cut(tested)
    alone = tested.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = tested.where("again").select("doc_id", "text_sha256", "u")
    groups = rest.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "u")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    met = salted(rest, groups, "text_sha256", "u").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("u") == F.col("top.u")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact": op8_exact}
ORACLES = {
    "op8_exact": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
