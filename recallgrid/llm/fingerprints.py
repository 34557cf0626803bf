"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles (five
lower-cased words; a shorter text is one shingle, a text without words has an empty sketch).  Sketches
merge: the bottom-k of a union is the bottom-k of the united sketches, so parts of a collection can be
sketched apart.  From two sketches come resemblance (Jaccard), containment and the distinct shingle count.

Only SQL functions are used.  Defined cases: a null text counts as empty; two empty sketches resemble each
other fully (1.0), an empty and another one not at all (0.0); rows with one doc_id are ordered by text;
rows without doc_id come first, as if it were the smallest there is; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

K = 128
WIDTH = 5
#: Documents in one bucket of the successor search, about, and most buckets: their bounds are in the plan and their heads are broadcast.
BUCKET_DOCS, MOST_BUCKETS = 512, 16_384


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the sketch of ``text`` as array<long> ``name``."""
    df = df.withColumn("__w", F.array_remove(F.split(F.lower(text), r"[\s 　]+"), ""))
    df = df.withColumn("__w", F.transform("__w", lambda w: F.xxhash64(w)))
    rolled = F.transform(
        F.sequence(F.lit(0), F.size("__w") - width),
        lambda i: F.xxhash64(*[F.col("__w")[i + j] for j in range(width)]),
    )
    shingles = F.when(F.size("__w") >= width, rolled).when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("__w")


def as_string(sketch: Column) -> Column:
    """Sixteen hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Distinct shingles: exact under k, else (k - 1) over the share of the hash range up to the k-th hash."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the merged sketch that both have."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(merged(a, b, k)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    inter = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_count(a, k)))


def merge_sketches(df: DataFrame, by: list[str], name: str, k: int = K) -> DataFrame:
    """One sketch for each group of sketches.

    Ranks are cut before the shuffle, so a group of any size sends k hashes from each task.
    """
    hashes = df.select(*by, F.explode(name).alias("__h")).groupBy(*by, "__h").agg(F.lit(1).alias("__one"))
    first = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__n") <= k)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(name))


def _key() -> Column:
    """A string in the order of doc_id and the text's beginning; rows without doc_id come first."""
    number = F.coalesce("doc_id", F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.lpad(F.hex(number), 16, "0"), F.hex(F.substring("text", 1, 16)))


def _with_bucket(docs: DataFrame, bounds: list[str]) -> DataFrame:
    """Add the number ``__b`` of bounds but the first that ``__key`` reaches, in two steps of about the root of their number.

    Bounds are constant lists of strings, made once and not for each row.
    """
    later = bounds[1:]
    if not later:
        return docs.withColumn("__b", F.lit(0))
    step = max(1, math.isqrt(len(later)))
    constant = lambda some: F.split(F.lit(",".join(some)), ",")
    reached = lambda some: F.size(F.filter(some, lambda b: b <= F.col("__key")))
    docs = docs.withColumn("__whole", reached(constant(later[step - 1 :: step])) * step)
    return docs.withColumn("__b", F.col("__whole") + reached(F.slice(constant(later), F.col("__whole") + 1, step))).drop("__whole")


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the next row's columns as struct ``nxt``, the first row's after the last.

    Rows are in order of doc_id and text.  Spark's range partitioning of ids and texts' beginnings gives the bounds of buckets
    of about BUCKET_DOCS rows (MOST_BUCKETS at most), however ids are spread; an id that many texts share spans several buckets.  Then texts shuffle once: each row goes to its bucket, and the first row of each
    bucket also to the bucket before.
    """
    docs = docs.withColumn("__key", _key())
    keys = cut(docs.select("__key"))
    wanted = min(MOST_BUCKETS, max(1, keys.count() // BUCKET_DOCS))
    first = F.min("__key").alias("first")
    bounds = sorted(r["first"] for r in keys.repartitionByRange(wanted, "__key").groupBy(F.spark_partition_id().alias("p")).agg(first).collect())
    columns = [c for c in docs.columns if c != "__key"]
    rows = _with_bucket(docs, bounds)
    # a bucket's first key is its bound, so rows with it are known where they are read
    place = lambda bucket, ghost: F.struct(bucket.alias("b"), F.lit(ghost).alias("ghost"))
    own, before = place(F.col("__b"), 0), place(F.pmod(F.col("__b") - 1, F.lit(max(1, len(bounds)))), 1)
    head = F.element_at(F.split(F.lit(",".join(bounds)), ","), F.col("__b") + 1) == F.col("__key")
    rows = rows.withColumn("__at", F.explode(F.when(head, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("__at.b").orderBy("__at.ghost", "__key", "text")
    return rows.withColumn("nxt", F.lead(F.struct(*columns)).over(order)).where("__at.ghost = 0").drop("__b", "__at", "__key")


def fingerprint(documents: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, sketch, n_shingles) for each row."""
    docs = with_sketch(documents.select("doc_id", text_or_empty().alias("text")), F.col("text"), "sketch", k, width)
    return docs.withColumn("n_shingles", distinct_count(F.col("sketch"), k))


def edited_neighbours(documents: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document against an edited text of it and against the next document."""
    docs = with_sketch(documents.select("doc_id", text_or_empty().alias("text")), F.col("text"), "sketch", k, width)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = _with_next(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", F.col("nxt.sketch").alias("next_sketch"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("nxt.text", F.lit(1), half)).alias("edited"),
    )
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", k, width)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("contained_edited"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
