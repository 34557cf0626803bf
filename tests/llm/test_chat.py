from pyspark.sql import functions as F

from recallgrid.llm import chat as X

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_paths_and_rank(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 2, "user", "more", 0.5), (2, 1, None, None, None, None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(nodes, NODES)
    got = {(r.tree, r.leaf): r.rank for r in X.format_trees(df, best=None).collect()}
    assert got == {(1, 4): 1, (1, 3): 2, (2, 1): 1}
    best = X.format_trees(df, best=1).where("tree = 1").first()
    assert best.formatted == "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n"
    assert [best.formatted[s.start : s.start + s.length] for s in best.loss] == ["good"]


def test_deep_chain(spark):
    n = 300
    df = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, "user", f"t{i}", 1.0) for i in range(1, n + 1)], NODES)
    r = X.format_trees(df).first()
    assert r.formatted.count("</turn>") == n and r.formatted.startswith("### user: t1<") and r.formatted.endswith(f"t{n}</turn>\n")


def test_round_trip(spark):
    texts = ["\\", "###", "</turn>", "\\</turn>\n### x: y", "a: b", "", None, "\\\\### ", ": ", "#" * 7, "x" * 30_000]
    rows = [(1, k, "us: er\\" if k % 2 else None, t) for k, t in enumerate(texts)] + [(None, 0, "assistant", "z"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    done = X.format_trees(X.linear_trees(given))
    roles, back = X.read_back(F.col("formatted"))
    got = {r.tree: (r.roles, r.texts) for r in done.select("tree", roles.alias("roles"), back.alias("texts")).collect()}
    assert got[1] == (["us: er\\" if k % 2 else "" for k in range(len(texts))], [t or "" for t in texts])
    assert got[None] == (["assistant"], ["z"]) and got[2] == (["assistant"] * 2, ["a", "b"])


def test_empty(spark):
    assert X.format_trees(spark.createDataFrame([], NODES)).count() == 0
