"""JDBC by the database that comes with Spark, deep JSON, fuzzy tokens by brute force, first rows of hot groups."""

import json
import random
import threading
from difflib import SequenceMatcher

from recallgrid.operators import documents, joins, windows
from recallgrid.sources import tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_reads_in_parts_with_a_pushed_owner(spark):
    url = "jdbc:derby:memory:memories;create=true"
    rows = [(i, f"u{i % 4}", f"title {i}") for i in range(400)]
    spark.createDataFrame(rows, "id long, user_id string, title string").write.format("jdbc").options(url=url, dbtable="memories", driver=DRIVER, createTableColumnTypes="user_id VARCHAR(20)").save()
    parts = dict(url=url, driver=DRIVER, partitionColumn="id", lowerBound="0", upperBound="400", numPartitions="4")
    found = tables.read_table(spark, "memories", owner="u2", **parts)
    assert sorted((r[0], r[1]) for r in found.collect()) == [(i, u) for i, u, _ in rows if u == "u2"]
    assert found.rdd.getNumPartitions() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(" in plan and "u2" in plan.split("PushedFilters")[1]
    assert tables.read_table(spark, "memories", **parts).count() == 400


def test_paths_at_depth_and_by_two_callers(spark):
    def nested(depth, name):
        doc = {"path": f"{name}-0"}
        for k in range(1, depth):
            doc = {"x": [doc, {"other": k}], "path": f"{name}-{k}"}
        return json.dumps(doc)

    got = {}

    def run(name):
        df = spark.createDataFrame([(name, nested(40, name)), (name + "!", "not json"), (name + "?", None)], "id string, j string")
        got[name] = sorted((r.id, r.value) for r in tables.find_paths(df, "id", "j").collect())

    callers = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    for t in callers:
        t.start()
    for t in callers:
        t.join()
    assert got == {n: sorted((n, f"{n}-{k}") for k in range(40)) for n in ("a", "b")}


def test_fuzzy_tokens_by_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcde", k=rng.randrange(1, 13))) for _ in range(250)} | {"aaaaaaaa", "aaaaaaa", "abababab", "babababa", "receipt", "reciept", "receipts", "a" * 60, "é" * 9}
    asked = {w[:i] + rng.choice("abcdex") + w[i + rng.randrange(2) :] for w in list(words)[:120] for i in [rng.randrange(len(w))]} | {"recipt", "aaaaaaaaa", "abab", "é" * 8}
    got = {(r.q, r.token, round(r.ratio, 9)) for r in documents.fuzzy_tokens(spark.createDataFrame([(w,) for w in asked], "token string"), spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    expected = {(q, t, round(x, 9)) for q in asked if len(q) >= 4 and q not in words for t in words if (x := SequenceMatcher(None, q, t).ratio()) >= 0.84}
    assert got == expected and len(expected) > 60


def test_first_rows_of_hot_groups(spark):
    rows = [(i, "hot" if i % 3 else f"h{i}", f"P{i:04d}" if i % 2 else f"p{i:04d}") for i in range(300)]
    scan = spark.createDataFrame(rows, "id long, sha256 string, path string")
    marked = {r.id: r.duplicate for r in windows.mark_duplicates(scan).collect()}
    assert marked == {i: h == "hot" and i != 1 for i, h, _ in rows}
    fresh = {r.id for r in joins.new_content(scan, scan.where("id = 0")).collect()}
    assert fresh == {i for i, h, _ in rows if h != "hot" and i} | {min((p, i) for i, h, p in rows if h == "hot")[1]}
    empty = scan.where("id < 0")
    assert windows.mark_duplicates(empty).count() == 0 and joins.new_content(empty, empty).columns == scan.columns
    one, two = scan.where("id < 5"), scan.where("id between 3 and 8").withColumnRenamed("path", "path")
    assert sorted(r.id for r in joins.merge_pages([one, two, empty], "id").collect()) == list(range(9))
