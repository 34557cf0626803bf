"""Merkle manifests of a dataset as a persistent tree: a change copies the path above it and shares everything else.

Each row is a leaf.  Per lang, leaves in order of doc_id meet in runs of two, up to the lang's subroot; subroots, ordered by lang, meet likewise
up to the root.  Trees are cut into aligned blocks of 2^HEIGHT leaves.  One task holds a block, all inner nodes of a block are made there, and the
roots of blocks are the leaves of the next stage, so no lang lies in one task and the stages are few (four for 10^12 rows).

A version of the tree is what one changed leaf makes: new nodes on the path to the root, everything else shared.  In a block only the ancestors of
the leaf are copied; the block's root then goes on along the siblings of its block in the stages above, which are found once a block, in the
distributed upper tree, and meet the block's leaves in its task.  So a version costs one hash a level, and no tree is built again.

Defined cases: a null lang is a lang of its own and comes first; rows with one doc_id are ordered by their leaves, and rows without one come
first; nulls in any column are a ``-`` in the leaf; rows that are equal in all columns are leaves of their own; a row without doc_id or n_chars is
never tampered with; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Levels of a block: 1,024 leaves.
HEIGHT = 10


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(n_chars: Column) -> Column:
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), n_chars.cast("string"), F.col("text")]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, changed): tree orders and names the lang; changed is the tampered leaf, null where nothing is tampered with."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(F.col("n_chars")).alias("digest"), F.when(chosen, leaf(F.col("n_chars") + 1)).alias("changed"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` of trees with ``pos``, the place in the tree from 0, and ``size``, the number of leaves of the tree.

    Rows are range partitioned, so a large tree lies in many tasks; counts for each tree and partition tell where a tree goes on.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows need not share a partition
    dealt = rows.repartitionByRange(n, "tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
    dealt = written(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = dealt.groupBy("tree", "__p").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("tree").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("tree", "__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("tree")).alias("size")))
    found = dealt.join(counts, ["tree", "__p"])
    return found.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__p", "__at", "__first", "__before")


class Block:
    """The nodes over one aligned block of leaves, level by level; the last block of a tree may be short."""

    def __init__(self, leaves: list[str], size: int, height: int = HEIGHT):
        self.levels = [leaves]
        whole = size > 1 << height  # else the tree has one block and ends at its root
        while len(self.levels) <= height if whole else len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([digest(*low[k : k + 2]) for k in range(0, len(low), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, index: int) -> list[str]:
        """For each level ``<`` or ``>`` and the digest that stands left or right of the path, or nothing."""
        found = []
        for level in self.levels[:-1]:
            other = index ^ 1
            found.append(("<" if index & 1 else ">") + level[other] if other < len(level) else "")
            index >>= 1
        return found


def copied(node: str, siblings: list[str]) -> list[str]:
    """The new nodes of the version that has ``node`` for a leaf, from the leaf to the root: its path, everything beside it shared."""
    path = [node]
    for s in siblings:
        node = digest(node) if not s else digest(s[1:], node) if s[0] == "<" else digest(node, s[1:])
        path.append(node)
    return path


def _blocks(rows: DataFrame, height: int):
    return rows.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block")


def _root(group: pa.Table, height: int) -> pa.Table:
    group = group.sort_by("pos")
    size = group.column("size")[0].as_py()
    up = -(-size // (1 << height))
    return pa.table({"tree": group.column("tree")[:1], "pos": group.column("block")[:1], "size": pa.array([up], pa.int64()), "digest": [Block(group.column("digest").to_pylist(), size, height).root]})


def _paths(group: pa.Table, height: int) -> pa.Table:
    group = group.sort_by("pos")
    block = Block(group.column("digest").to_pylist(), group.column("size")[0].as_py(), height)
    paths = [block.siblings(k) for k in range(group.num_rows)]
    return pa.table({"tree": group.column("tree"), "pos": group.column("pos"), "block": group.column("block"), "path": pa.array(paths, pa.list_(pa.string())), "root": pa.array([block.root] * group.num_rows)})


def roots(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, size, digest): the roots of the blocks of ``rows`` (tree, pos, size, digest), the leaves of the stage above."""
    return written(_blocks(rows.select("tree", "pos", "size", "digest"), height).applyInArrow(lambda g: _root(g, height), "tree string, pos long, size long, digest string"))


def climbed(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, path, root) for each of ``rows`` (tree, pos, size, digest): the siblings up to the root of its tree."""
    here = _blocks(rows.select("tree", "pos", "size", "digest"), height).applyInArrow(lambda g: _paths(g, height), "tree string, pos long, block long, path array<string>, root string")
    if rows.where(F.col("size") > 1 << height).isEmpty():
        return written(here.drop("block"))
    above = climbed(roots(rows, height), height).select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), F.col("root").alias("top"))
    return written(here.join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "above").alias("path"), F.col("top").alias("root")))


def forest(documents: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Leaves in their places, and for each of their blocks (tree, block) the path above it, the subroot and the root."""
    rows = placed(written(leaves(documents)), "doc_id", "digest")
    above = climbed(roots(rows, height), height).select("tree", F.col("pos").alias("block"), "path", F.col("root").alias("subroot"))
    subroots = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("subroot").alias("digest"))
    subroots = placed(subroots, "lang")
    top = climbed(subroots, height).select("pos", F.col("path").alias("last"), "root").join(subroots.select("pos", F.col("lang").alias("tree")), "pos")
    above = above.join(top.drop("pos"), "tree").select("tree", "block", F.concat("path", "last").alias("path"), "subroot", "root")
    return rows, written(above)


def _with_blocks(documents: DataFrame, run, schema: str, height: int) -> DataFrame:
    """``run`` (Block, leaves of the block, what stands above it) for each block."""
    rows, above = forest(documents, height)

    def both(group: pa.Table, up: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        return run(Block(group.column("digest").to_pylist(), group.column("size")[0].as_py(), height), group, up.to_pylist()[0])

    return _blocks(rows, height).cogroup(above.groupBy("tree", "block")).applyInArrow(both, schema)


def manifest(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row."""

    def run(block: Block, group: pa.Table, up: dict) -> pa.Table:
        proofs, folded = [], []
        for k, (one, new) in enumerate(zip(group.column("digest").to_pylist(), group.column("changed").to_pylist())):
            siblings = block.siblings(k) + up["path"]
            proofs.append(digest(*[s[1:] for s in siblings]))
            folded.append(copied(new or one, siblings)[-1])
        n = group.num_rows
        same = pa.array([f == up["root"] for f in folded], pa.bool_())
        return pa.table({"doc_id": group.column("doc_id"), "leaf": group.column("digest"), "subroot": [up["subroot"]] * n, "root": [up["root"]] * n, "proof_sha256": proofs, "folded_root": folded, "verified": same})

    return _with_blocks(documents, run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", height)


def versions(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, level, index, digest): the new nodes of each version, level 0 the changed leaf; all other nodes are those of the first tree."""

    def run(block: Block, group: pa.Table, up: dict) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "level": [], "index": [], "digest": []}
        for k, (i, new, pos) in enumerate(zip(*(group.column(c).to_pylist() for c in ("doc_id", "changed", "pos")))):
            if new is not None:
                path = copied(new, block.siblings(k) + up["path"])
                out["doc_id"] += [i] * len(path)
                out["level"] += range(len(path))
                out["index"] += [pos >> n for n in range(len(path))]
                out["digest"] += path
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]))

    return _with_blocks(documents, run, "doc_id long, level int, index long, digest string", height)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 by bits: for each byte an exclusive or, then eight shifts, which are marked -1.
_CRC = """xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"""
_UP = """sha256(CASE WHEN s.digest IS NULL THEN f.node WHEN f.idx % 2 = 1 THEN s.digest || f.node ELSE f.node || s.digest END)"""
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(n="(n_chars + 1)")} END AS changed
  FROM documents),
d AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest, size FROM d
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 2, size),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos AS idx, digest, size FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (size + 1) // 2 FROM tops WHERE size > 1 GROUP BY level, idx // 2, size),
f AS (
  SELECT rid, tree, 0 AS level, pos AS idx, coalesce(changed, leaf) AS node, '' AS proof, size FROM d
  UNION ALL
  SELECT f.rid, f.tree, f.level + 1, f.idx // 2, {_UP}, f.proof || coalesce(s.digest, ''), (f.size + 1) // 2
  FROM f LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.size > 1),
t AS (
  SELECT f.rid, 0 AS level, b.pos AS idx, f.node, f.proof, b.size, b.digest AS subroot FROM f JOIN subroots b ON b.tree = f.tree WHERE f.size = 1
  UNION ALL
  SELECT f.rid, f.level + 1, f.idx // 2, {_UP}, f.proof || coalesce(s.digest, ''), (f.size + 1) // 2, f.subroot
  FROM t f LEFT JOIN tops s ON s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.size > 1)
SELECT d.doc_id, d.leaf, t.subroot, r.digest AS root, sha256(t.proof) AS proof_sha256, t.node AS folded_root, t.node = r.digest AS verified
FROM d JOIN t ON t.rid = d.rid AND t.size = 1, (SELECT digest FROM tops WHERE size = 1) r
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": ORACLE}
