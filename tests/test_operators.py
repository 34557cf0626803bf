"""Formulas by hand, properties and edge rows of the reference's own operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid import registry
from recallgrid.functions import ids, numbers, text
from recallgrid.operators import classify, documents, joins, scoring, search, stats, vectors, windows
from recallgrid.sources import tables
from recallgrid.streaming import streams

EDGE = [None, "", "  \t\n ", "é ₹ 写真", "a\r\n\r\n\r\n\r\nb", "x​y", "aaaaaaaaaa", "word " * 7000]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "doc_id long, text string")


def test_hybrid_score_of_one_candidate(spark):
    one = spark.createDataFrame([(1, "m", 0.95)], "query_id long, memory_id string, score double")
    other = one.withColumn("score", F.lit(0.50))
    r = joins.merge_candidates(one, other).select(scoring.hybrid_score(F.col("semantic_score"), F.col("keyword_score")).alias("s")).first()
    assert r.s == pytest.approx(0.7925)
    with pytest.raises(ValueError):
        scoring.hybrid_score(F.lit(1.0), F.lit(1.0), 0, 0)


def test_text_of_edge_rows(edge):
    out = edge.select("doc_id", text.clean_text(F.col("text")).alias("c"), text.normalize_for_search(F.col("text")).alias("s"), F.size(text.tokenize_doc(F.col("text"))).alias("n"), text.truncate_text(F.col("text"), 20).alias("t")).orderBy("doc_id").collect()
    assert [r.c for r in out[1:3]] == ["", ""] and out[4].c == "a\n\nb" and out[5].c == "xy" and out[6].c == "aaa"
    assert out[7].n == 7000 and len(out[7].t) <= 20 and out[7].t.endswith("…")
    assert edge.transform(lambda d: text.text_statistics(d, "text")).count() == len(EDGE)


def test_chunks_cover_the_text():
    body = "one two three. " * 900
    spans = list(text.chunk_spans(body, 500, 50))
    assert spans[0][1] == 0 and all(b - a <= 500 for _, a, b in spans)
    assert all(nxt[1] <= prev[2] for prev, nxt in zip(spans, spans[1:])) and spans[-1][2] >= len(body) - 1


def test_vectors_that_are_not_valid(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "memory_id long, vec array<float>")
    assert [r.memory_id for r in df.where(numbers.is_valid_vector(F.col("vec"), 2)).collect()] == [1]
    near = vectors.knn(df.where("memory_id = 1").select(F.col("memory_id").alias("query_id"), "vec"), df.withColumnRenamed("memory_id", "vec_id"), 5)
    assert {(r.vec_id, r.rank) for r in near.collect()} == {(1, 1), (2, 2)}


def test_knn_paths_agree(spark, data, monkeypatch):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    exact = {(r.query_id, r.rank, r.vec_id) for r in vectors.knn(q, v, 5).collect()}
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 1)
    monkeypatch.setattr(vectors, "SHARD", 300)
    assert exact == {(r.query_id, r.rank, r.vec_id) for r in vectors.knn(q, v.repartition(7), 5).collect()}
    owner = (F.col("vec_id") % 3).alias("owner")
    own = vectors.knn(q.select("*", (F.col("query_id") % 3).alias("owner")), v.select("*", owner), 5, distance=True, by=["owner"]).collect()
    m = {r.vec_id: np.array(r.vec, np.float64) for r in v.collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in m.items()}
    for qid in {r.query_id for r in own}:
        want = sorted((round(float(1 - unit[qid] @ unit[i]), 6), i) for i in m if i % 3 == qid % 3)[:5]
        assert [(abs(r.score), r.vec_id) for r in sorted(own, key=lambda r: r.rank) if r.query_id == qid] == [(abs(s), i) for s, i in want]
    found = {(r.query_id, r.vec_id) for r in vectors.approx_knn(q, v, 5).collect()}
    assert len(found & {(a, c) for a, _, c in exact}) / len(exact) >= 0.9


def test_lexical_prefix_filter_loses_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("ocr_text"))
    q = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.slice(text.meaningful_tokens(F.col("text")), 1, 5).alias("q_tokens"))
    got, probed = ({(r.query_id, r.memory_id): round(r.score, 9) for r in search.lexical_scores(q, search.token_index(docs), written=w).collect()} for w in (False, True))
    tokens = {r.memory_id: set(r.t) for r in docs.select("memory_id", text.tokenize_doc(F.col("ocr_text")).alias("t")).collect()}
    want = {}
    for r in q.collect():
        terms = set(r.q_tokens)
        for m, t in tokens.items():
            if terms and len(terms & t) / len(terms) >= 0.5:
                want[(r.query_id, m)] = round(len(terms & t) / len(terms), 9)
    assert got == want == probed


def test_classification_counts_the_read_text_twice(spark):
    df = spark.createDataFrame([(1, "pizza menu", None, None, None), (2, "nothing here", None, "Health", None), (3, "", None, None, None)], "id long, ocr string, ai string, llm string, intent string")
    r = {x.id: x for x in classify.classify(df, "ocr", "ai", "llm", "intent").collect()}
    assert r[1].category == "food" and r[1].margin == pytest.approx(10.0) and r[1].category_confidence == pytest.approx(1.0)
    assert r[2].category == "health" and r[3].category == "other" and r[3].category_confidence == pytest.approx(0.20)


def test_intent_keywords_are_substrings(spark):
    df = spark.createDataFrame([("an email", []), ("zzz", []), ("", [("MONEY", 1.0)])], "t string, e array<struct<type:string,confidence:double>>")
    out = [(r.intent, r.intent_confidence) for r in classify.detect_intent(df, "t", "e").collect()]
    assert out[0][0] == "COMMUNICATION" and out[1] == ("OTHER", 0.35) and out[2][0] == "PAYMENT"


def test_analysis_in_any_wrapping(spark):
    rows = ['{"title": "a"}', '```json\n{"title": "a"}\n```', 'Sure: {"title": "a", "x": {"y": "}"}} bye', "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, raw string")
    got = [r.title for r in df.select("i", documents.parse_analysis(F.col("raw")).alias("a")).select("i", "a.title").orderBy("i").collect()]
    assert got == ["a", "a", "a", None, None]


def test_receipt(spark):
    df = spark.createDataFrame([("Hotel Blue\n12 Main Road, Salem\nGrand Total: Rs. 1,250.50\n12/03/2024 call 9876543210 a@b.co",), ("plain",)], "t string")
    a, b = documents.receipt_fields(df, "t").collect()
    assert (a.merchant, a.total, a.receipt_date, a.phone, a.email) == ("Hotel Blue", "1,250.50", "12/03/2024", "9876543210", "a@b.co") and b.merchant is None


def test_fuzzy_tokens(spark):
    q, t = (spark.createDataFrame([(x,) for x in words], "token string") for words in (["recipt", "exact", "abc"], ["receipt", "exact", "receipts"]))
    assert {(r.q, r.token) for r in documents.fuzzy_tokens(q, t).collect()} == {("recipt", "receipt"), ("recipt", "receipts")}


def test_fuzzy_tokens_read_tokens_once(spark):
    """All pairs as by brute force, while the function that makes the tokens runs once for each."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(60)})
    asked = sorted({w[:2] + rng.choice("abcdx") + w[2:] for w in words[::4]} - set(words))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def token(x):
        made.add(1)
        return x

    tokens = spark.createDataFrame([(w,) for w in words], "w string").select(token.asNondeterministic()("w").alias("token"))
    got = {(r.q, r.token) for r in documents.fuzzy_tokens(spark.createDataFrame([(w,) for w in asked], "token string"), tokens).collect()}
    assert got == {(q, t) for q in asked for t in words if SequenceMatcher(None, q, t).ratio() >= 0.84} and got
    assert made.value == len(words)


def test_ids_are_consecutive(spark):
    got = sorted(r.vector_id for r in windows.assign_ids(spark.range(1000).withColumnRenamed("id", "k"), 7, "k", shards=5).collect())
    assert got == list(range(7, 1007))


def test_rate_limit_accepts_only_so_many(spark):
    rows = [("a", "s", i, t) for i, t in enumerate([0, 1, 2, 3, 59, 60, 61, 200])]
    df = spark.createDataFrame(rows, "client string, area string, request_id long, at long")
    got = [r.accepted for r in streams.rate_limit_batch(df, limit=3, seconds=60).orderBy("request_id").collect()]
    assert got == [True, True, True, False, False, True, True, True]


def test_substring_lookup_loses_no_token(spark):
    texts = [(1, "xxabcxx ab"), (2, "a b c"), (3, "cab-abc.d"), (4, "abd"), (5, "")]
    words = spark.createDataFrame(texts, "memory_id long, t string").select(F.explode(F.regexp_extract_all("t", F.lit(text.DOC_TOKEN), F.lit(0))).alias("word")).distinct()
    tokens = ["ab", "abc", "abc.d", "zz"]
    got = {(r.token, r.word) for r in search.substring_words(spark.createDataFrame([(t,) for t in tokens], "token string"), words).collect()}
    assert got == {(t, r.word) for t in tokens for r in words.collect() if t in r.word}


def test_candidates_of_two_rankings_are_merged_once(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    named = lambda df: df.select("query_id", F.col("vec_id").cast("string").alias("memory_id"), "score")
    near, wide = named(vectors.knn(q, v, 50)), named(vectors.knn(q, v, 120))
    both = joins.merge_candidates(near, wide)
    base = near.select("query_id", "memory_id").unionByName(wide.select("query_id", "memory_id")).repartition("query_id", "memory_id").distinct()
    rows = base.join(both, ["query_id", "memory_id"], "left").collect()
    assert len(rows) == len({(r.query_id, r.memory_id) for r in rows}) == wide.count()
    assert sum(r.semantic_score != 0 for r in rows) == near.where("score <> 0").count()


def test_names_of_files(spark):
    names = ["../../secret.txt", "My Screenshot (1).PNG", "a" * 200 + ".jpeg", "", None, "..", "a/b/"]
    got = [r.n for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, c string").orderBy("i").select(ids.display_filename(F.col("c")).alias("n")).collect()]
    assert got == ["secret.txt", "My_Screenshot_1_.PNG", "a" * 175 + ".jpeg", "unnamed_file", "unnamed_file", "unnamed_file", "b"]


def test_jobs_back_off(spark):
    events = [(1, 100, 0, "queue"), (1, 110, 1, "claim"), (1, 120, 2, "fail"), (2, 100, 3, "claim"), (3, 100, 4, "done")]
    got = {r.job_id: (r.status, r.next_attempt) for r in streams.job_state(spark.createDataFrame(events, "job_id long, at long, o long, kind string"), 2000).collect()}
    assert got == {1: ("retrying", 122), 2: ("retrying", 2000), 3: ("completed", None)}


def test_upsert_keeps_columns_it_does_not_own(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    u = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(t, u, "k").collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]


def test_swapped_write(spark, tmp_path):
    where, beside = str(tmp_path / "t"), str(tmp_path / "s")
    spark.range(3).write.parquet(where)
    tables.write_swapped(spark.range(5), where, beside)
    assert spark.read.parquet(where).count() == 5


def test_rates_of_nothing(spark):
    none = spark.createDataFrame([], "status string, indexed_s long")
    r = stats.memory_stats(none).first()
    assert (r.total, r.success_rate, r.indexing_rate) == (0, 0.0, 0.0)


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries()) and len(registry.queries()) > 150


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 200, done.stderr[-500:]


def test_approximate_neighbours_write_no_pairs(spark, monkeypatch):
    """Buckets, scores and radius as by plain numpy, in both ways of meeting; no candidate pair is shuffled."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(600, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, x.astype(np.float32).tolist()) for i, x in enumerate(m)], "vec_id long, vec array<float>")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    found = vectors.approx_knn(q, v, 5, bucket=0.3, tables=2, radius=1.0)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.query_id, r.rank, r.vec_id) for r in found.collect())

    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    features = v.select("vec_id", array_to_vector("vec").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.3, numHashTables=2, seed=7).fit(features)
    b = {r.vec_id: [x[0] for x in r.h] for r in model.transform(features).collect()}
    want = []
    for i in range(0, 600, 20):
        near = sorted((-round(float(m[i] @ m[j]), 6), j) for j in b if any(x == y for x, y in zip(b[i], b[j])) and m[i] @ m[j] > 0.5)[:5]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert rows == sorted(want) and len(rows) < 30 * 5 + 1
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 1)
    assert rows == sorted((r.query_id, r.rank, r.vec_id) for r in vectors.approx_knn(q, v, 5, bucket=0.3, tables=2, radius=1.0).collect())


def test_file_names_of_any_length(spark):
    """As by plain Python on names beyond the part that is looked at first; long runs of dots take no square of their length."""
    import re
    import time

    names = ["", "a/b\\", "..__x..", "/a b/c..d", "é" * 800 + "z", "x" * 300 + "." * 900, "." * 800 + "ab c" * 300, "ab  c" * 500, "_." * 500, "w" * 179 + "." * 700 + "v", None, "a" + "." * 150_000 + "b"]
    clean = lambda n: re.sub(r"^[._]+|[._]+\Z", "", re.sub("_{2,}", "_", re.sub(r"[^A-Za-z0-9._-]+", "_", re.split(r"[/\\]", n)[-1])))[:180] if len(n) < 10_000 else "a" + "." * 179
    df = spark.createDataFrame(list(enumerate(names)), "i long, t string")
    began = time.time()
    got = {r.i: r.n for r in df.select("i", ids.sanitize_filename(F.col("t")).alias("n")).collect()}
    assert time.time() - began < 15
    assert got == {i: None if n is None else clean(n) or "upload" for i, n in enumerate(names)}


def test_json_texts_are_parsed_once(spark):
    rows = [
        '{"visual_description": "a \\"b\\"", "objects": ["x", "", " ", "y"], "scene": 1.50, "vision_analysis": {"summary": "in", "objects": ["z", 2, null], "environment": ""}}', "{}", "no json", None,
        '{"objects": "[not a list", "visual_description": null, "vision_analysis": "text"}', '{"visual_description": true, "actions": [["a"], {"b": 1}], "other": [1]}',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, j string").select("i", documents.visual_text(F.col("j")).alias("t"))
    assert "get_json_object" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in df.orderBy("i").collect()] == ['a "b" in x y 1.5 z 2', "", "", "", "", 'true ["a"] {"b":1}']
