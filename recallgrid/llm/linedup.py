"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate.  Lines are told apart by hash; a HyperLogLog sketch of sites for each
line hash merges by aggregation, and lines whose estimate is near the threshold get an exact distinct count.  Of each
boilerplate line one occurrence stays, that of the smallest doc_id, so no passage leaves the corpus altogether.

Lines that occur fewer times than the threshold cannot be on that many sites; they drop out of the search (not of the
documents) by a plain count, and only the rest gets sketches.  Texts are split once, into a table of hashes; only hashes
shuffle; texts meet the numbers of their removed lines once, at the end.  Tables of lines that fit a checked size are
broadcast, larger ones meet the lines with a salt, so a line that is everywhere spreads over tasks.

Defined cases: a null text stays null and has no lines; a null site counts as no site; blank lines are never
boilerplate; lines are compared without white space at their ends; rows with one doc_id are told apart by text, and
equal rows are treated alike.  A document may become empty; it stays as a row.  Extra columns pass through.

Lines of more than ``long_words`` words are passages: two documents that carry one are enough, on whatever sites.  The
least and the greatest document of a line tell that exactly, without a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, salted, table

#: Sites that make a line boilerplate.
SITES = 5
#: Share of the threshold within which an estimate is not trusted.
MARGIN = 0.2
LOG_K = 10
#: Words beyond which a line is a passage.
LONG_WORDS = 50
#: Most rows of a table of line hashes that is broadcast, under 10 MB; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def _with(lines: DataFrame, side: DataFrame) -> DataFrame:
    """``lines`` joined with a written table of one row a hash."""
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(side), "h")
    return salted(lines, side, "h", "doc_id", "__r", "pos")


def _lines(docs: DataFrame, site: str, long_words: int) -> DataFrame:
    """(doc_id, __r, site, pos, h, long) for each line that is not blank."""
    bare = F.trim("line", F.lit(" \t\r"))
    long = F.size(F.split(bare, r"[ \t\r]+")) > long_words
    lines = docs.select("doc_id", "__r", F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "__r", "site", "pos", line_hash(F.col("line")).alias("h"), long.alias("long")).where("h is not null")


def line_hash(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(lines: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(h): hashes of ``lines`` (site, h) on at least ``sites`` distinct sites."""
    frequent = cut(lines.groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("h"))
    some = _with(lines.where("site is not null"), frequent)
    spread = some.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"))
    spread = cut(spread.where(F.col("sites") >= sites * (1 - margin)))
    near = spread.where(F.col("sites") <= sites * (1 + margin)).select("h")
    exact = _with(some, near).groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    return spread.where(F.col("sites") > sites * (1 + margin)).select("h").unionByName(exact.where(F.col("sites") >= sites).select("h"))


def passages(lines: DataFrame) -> DataFrame:
    """(h): hashes of long ``lines`` that at least two documents carry."""
    place = F.struct("doc_id", "__r")
    ends = lines.where("long").groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    return ends.where(~F.col("a").eqNullSafe(F.col("b"))).select("h")


def removed_lines(docs: DataFrame, site: str, sites: int = SITES, margin: float = MARGIN, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, __r, removed array<int>): numbers of each document's removed lines, for documents that have any."""
    lines = cut(_lines(docs, site, long_words))
    shared = cut(boilerplate(lines.where("not long"), sites, margin).unionByName(passages(lines)))
    found = _with(lines.select("doc_id", "__r", "pos", "h"), shared)
    place = F.struct("doc_id", "__r", "pos")
    first = cut(found.groupBy("h").agg(F.min(F.when(F.col("doc_id").isNotNull(), place)).alias("stays")))
    gone = _with(found, first).where(~place.eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "__r").agg(F.collect_set("pos").alias("removed"))


def drop_boilerplate(documents: DataFrame, site: str = "source", sites: int = SITES, margin: float = MARGIN, long_words: int = LONG_WORDS) -> DataFrame:
    """``documents`` with boilerplate lines taken out of text, and n_lines, n_removed added."""
    names = documents.columns
    docs = documents.withColumn("__r", row_key("doc_id", "text"))
    gone = removed_lines(docs.select("doc_id", "text", site, "__r"), site, sites, margin, long_words).withColumnsRenamed({"doc_id": "__d", "__r": "__q"})
    kept = docs.join(cut(gone), (F.col("__r") == F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    # the lines that stay are looked up by number: one pass over the lines, whatever number goes
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: x[i])
    lines = F.split("text", "\n")
    rest = F.transform(F.array(lines), lambda x: F.array_join(stay(x), "\n"))[0]
    return kept.select(
        *[F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op5_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "n_lines", "n_removed")


QUERIES = {"op5_linedup": op5_linedup}
ORACLES = {
    "op5_linedup": f"""
        WITH parts AS (
            SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
            FROM documents WHERE text IS NOT NULL),
        lines AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS bare FROM parts),
        sized AS (SELECT *, len(string_split_regex(bare, '[ \t\r]+')) > {LONG_WORDS} AS long FROM lines WHERE bare <> ''),
        spread AS (
            SELECT bare FROM sized GROUP BY bare, long
            HAVING CASE WHEN long THEN count(DISTINCT doc_id) >= 2 ELSE count(DISTINCT source) >= {SITES} END),
        marked AS (
            SELECT l.*, s.bare IS NOT NULL AND row_number() OVER (PARTITION BY l.bare ORDER BY doc_id, pos) > 1 AS gone
            FROM lines l LEFT JOIN spread s ON l.bare = s.bare),
        built AS (
            SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest,
                   count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN sha256(rest) END AS text_sha256, length(rest) AS n_chars,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN built b USING (doc_id)"""
}
