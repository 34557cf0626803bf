"""Chat formatting of reply trees.

A tree's nodes point to their parents.  Root-to-leaf paths are enumerated from the leaves by iterative self-joins
with doubling: after round i a node knows its ancestor 2^i up, and each leaf has its nearest 2^(i+1) - 1 ancestors,
so a path of d turns takes log d rounds.  Branches rank by the mean score of their nodes (ties: the smaller leaf), and each
chosen path becomes one conversation, formatted by a template that marks turns and escapes its own control strings in
texts; a loss mask marks the assistant's texts.  ``read_back`` gets roles and texts from the formatted string again.

Defined cases: null role, text and score count as empty, empty and zero; a parent that does not exist makes a root; a
cycle has no root and no leaf and yields no path; a tree that is one node is one path; turns of one
conversation with equal numbers are ordered by role and text; other columns are ignored.  Numbers of conversations
may be null: those rows are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

# The template: "### role: text</turn>\n" for each turn.  A backslash comes before each control string in a role or text.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPED = r"(\\|###|:(?= )|</turn>)"
_TURN = r"(?s)### ((?:[^\\:]++|\\.|:(?! ))*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n"
ROLE_OF_LOSS = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for each node of each root-to-leaf path; up: steps from the leaf.  nodes: (tree, node, parent)."""
    nodes = nodes.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    step = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))).select("tree", "node", F.col("parent").alias("above"))
    step = cut(step)
    parents = step.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    n = 1
    while not step.isEmpty():
        by = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        more = found.join(by, on).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + n).alias("up"))
        grown = cut(found.unionAll(more))
        if n > 1 and more.isEmpty():
            break  # no path is that long; what still has ancestors is a cycle
        found = grown
        further = by.withColumnRenamed("above", "higher")
        step = cut(step.join(further, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select("tree", "node", F.col("higher").alias("above")))
        n *= 2
    return found


def ranked_branches(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, leaf, score, rank) for each path."""
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    total = found.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): the ``best`` paths of each tree (None: all) as conversations.

    nodes: (tree, node, parent, role, text, score).  loss: array of (start, length) in characters of formatted, from 0.
    """
    found = paths(nodes)
    chosen = ranked_branches(nodes, found)
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    chosen = chosen.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank")
    turns = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("t", "n", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE)).alias("head"), escape(F.col("text")).alias("body"), (F.lower("role") == ROLE_OF_LOSS).alias("loss"))
    rows = found.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).join(turns, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    one = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "head", "body", "loss"))).alias("p"))
    written = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        span = F.array(F.struct(begin.alias("start"), F.length(x["body"]).cast("long").alias("length")))
        spans = F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + F.length(x["body"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return one.select("tree", "leaf", "rank", written.alias("formatted"), F.aggregate("p", start, add, lambda a: a["spans"]).alias("loss"))


def read_back(formatted: Column) -> tuple[Column, Column]:
    """Roles and texts of a formatted conversation."""
    return tuple(F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)), unescape) for i in (1, 2))


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_trees(cut(linear_trees(given.unionByName(more))), best=1)
    roles, texts = read_back(F.col("formatted"))
    lossy = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = done.select("tree", "formatted", roles.alias("roles"), texts.alias("texts"), lossy.alias("lossy"))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("texts").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op4_chat": op4_chat}
ORACLES = {
    "op4_chat": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        turns AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS o,
                   length(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g')) + length(role) - length(replace(role, ': ', ':'))
                   + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length(text) - length(replace(text, ': ', ':')) + 14 AS n
            FROM given)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY o) FILTER (lower(role) = 'assistant'), '')) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY o) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id"""
}
