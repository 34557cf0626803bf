import hashlib

from pyspark.sql import functions as F

from recallgrid.llm import fingerprints as X


def test_edited_text_and_next_document(spark, edge):
    rows = X.edited_neighbours(edge).collect()
    given = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in edge.collect()))
    texts = [t for _, _, t in given]
    expected = []
    for k, (_, i, t) in enumerate(given):
        n = len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_many_buckets(spark):
    docs = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    found = {r.doc_id: r.edited_sha256 for r in X.edited_neighbours(docs).collect()}
    texts = [f"t {i}" for i in range(0, 3000, 3)]
    for k, t in enumerate(texts):
        n = len(t) // 2
        assert found[k * 3] == hashlib.sha256((t[: len(t) - n] + texts[(k + 1) % 1000][:n]).encode()).hexdigest()


def test_estimates_and_merges(spark):
    a, b = [f"x{i}" for i in range(900)], [f"x{i}" for i in range(300, 1200)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a))], "doc_id long, text string")
    s = X.fingerprint(docs)
    one, two, three = (r.sketch for r in s.orderBy("doc_id").collect())
    assert one == three and one != two
    pair = s.where("doc_id = 1").select(F.col("sketch").alias("a")).join(s.where("doc_id = 2").select(F.col("sketch").alias("b")))
    r = pair.select(X.resemblance(F.col("a"), F.col("b")).alias("j"), X.containment(F.col("a"), F.col("b")).alias("c"), X.distinct_count(F.col("a")).alias("n")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.c - 596 / 896) < 0.2 and abs(r.n - 896) < 250
    merged = X.merge_sketches(s.withColumn("g", F.lit(1)), ["g"], "sketch").first().sketch
    assert merged == sorted(set(one) | set(two))[: X.K]


def test_empty(empty):
    assert X.edited_neighbours(empty).count() == 0


def test_ids_far_apart_and_shared(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 8)
    ids = [-(2**62), 2**62, 2**63 - 1, -(2**63), None, None, *range(60), *[7] * 40, 10**15]
    docs = spark.createDataFrame([(i, f"text {k % 50} of {i}") for k, i in enumerate(ids)], "doc_id long, text string")
    texts = [t for _, _, t in sorted((i is not None, i or 0, f"text {k % 50} of {i}") for k, i in enumerate(ids))]
    order = sorted((i if i is not None else -(2**63), f"text {k % 50} of {i}") for k, i in enumerate(ids))
    expected = []
    for k, (_, t) in enumerate(order):
        n = len(t) // 2
        expected.append(hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in X.edited_neighbours(docs).collect()) == sorted(expected) and len(texts) == len(order)


def test_sketch_is_the_smallest_hashes(spark):
    """Against brute force on exploded shingles, and likeness against the sets themselves."""
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 7 : k * 7 + 200])) for k in range(20)], "doc_id long, text string")
    shingle = F.explode(F.expr("transform(sequence(0, size(w) - 5), i -> xxhash64(xxhash64(w[i]), xxhash64(w[i+1]), xxhash64(w[i+2]), xxhash64(w[i+3]), xxhash64(w[i+4])))"))
    brute = docs.withColumn("w", F.split("text", " ")).select("doc_id", shingle.alias("h")).distinct().groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("h")), 1, X.K).alias("s"))
    got = {r.doc_id: r.sketch for r in X.fingerprint(docs).collect()}
    assert got == {r.doc_id: r.s for r in brute.collect()}
    near = {r.doc_id: r.near_next for r in X.edited_neighbours(docs).collect()}
    assert all(abs(near[k] - 189 / 203) < 0.06 for k in range(19))


def test_buckets_cost_a_row_the_root_of_their_number(spark, monkeypatch):
    """Bounds are constants of the plan, not lists made for each row, and heads of buckets are known without a join."""
    import bisect

    bounds = [f"{k:04}" for k in range(0, 900, 3)]
    given = spark.createDataFrame([(f"{k:04}",) for k in range(1000)], "__key string")
    found = X._with_bucket(given, bounds)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["__key"]: r["__b"] for r in found.collect()} == {f"{k:04}": bisect.bisect_right(bounds[1:], f"{k:04}") for k in range(1000)}
    monkeypatch.setattr(X, "BUCKET_DOCS", 8)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    plan = X.edited_neighbours(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Range (") == 1 and "arrays_zip" not in plan
