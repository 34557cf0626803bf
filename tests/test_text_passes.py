"""One-pass keywords, entities and phrases against plain Python over whole texts."""

import random
import re

from pyspark.sql import functions as F

from recallgrid.functions.keywords import keywords_in
from recallgrid.functions.text import meaningful_tokens, normalize
from recallgrid.operators import classify, rules, search

EXTRA = [
    None, "", "  ", "Mail A.B@c.io, see www.x.io/y and http://é.example/q?a=1\nOrder #AB-12345 invoice: X99 @some_one", "₹ 1,200.50 rs.5 USD 7 on 3 Jan 2024, Feb 3, 2024 at 10:30 pm +91 98765 43210 1234567890",
    "Python and React in New York; node.js, C++ and machine learning at Google", "word " * 500 + "12/12/2024", "ordering orders", "1" * 300, "rs" + " " * 40 + "5",
]


def texts_of(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    return rows + [(10_000 + i, t) for i, t in enumerate(EXTRA)]


def test_keywords_against_substring_tests(spark, data):
    rows = texts_of(spark, data)
    words = sorted({w for ws in rules.INTENT_KEYWORDS.values() for w in ws} | {"é", "er", "erer", "the", "th"})
    df = spark.createDataFrame(rows, "id long, text string").select("id", keywords_in(F.lower("text"), words).alias("k"))
    got = {r.id: r.k for r in df.collect()}
    assert got == {i: [w for w in words if w in (t or "").lower()] for i, t in rows}


def plain_entities(text):
    found = []
    for kind, (pattern, conf) in classify.ENTITY_PATTERNS.items():
        for x in dict.fromkeys(m.group(0) for m in re.finditer(pattern, text, re.ASCII)):
            found.append((kind, x.strip(" "), conf))
    tokens = list(dict.fromkeys(re.split(r"[^\w]+", text.lower())))
    for (kind, conf), words in rules.DICTIONARIES.items():
        found += [(kind, w, conf) for w in tokens if w in words and w.isalnum()]
        found += [(kind, w, conf) for w in words if not w.isalnum() and w in text.lower()]
    return sorted(found)


def test_entities_of_whole_texts(spark, data):
    rows = texts_of(spark, data)
    e = F.concat(classify.pattern_entities(F.coalesce("text", F.lit(""))), classify.dictionary_entities(F.coalesce("text", F.lit(""))))
    found = spark.createDataFrame(rows, "id long, text string").select("id", e.alias("e")).collect()
    shared = F.concat(classify.pattern_entities(F.coalesce("text", F.lit(""))), classify.dictionary_entities(F.coalesce("text", F.lit("")), classify.substrings(F.coalesce("text", F.lit("")))))
    again = spark.createDataFrame(rows, "id long, text string").select("id", shared.alias("e")).collect()
    expected = {i: plain_entities(t or "") for i, t in rows}
    for side in (found, again):
        assert {r.id: sorted((x.type, x.text, x.confidence) for x in r.e) for r in side} == expected
    assert len({k for ents in expected.values() for k, _, _ in ents}) >= 11


def test_phrases_by_positions(spark):
    rng, words = random.Random(1), ["alpha", "beta", "gamma", "delta", "of", "the", "x-1", "né", "alphabet", "a"]
    docs = [(f"m{i}", " ".join(rng.choices(words, k=rng.randrange(0, 40))), " ".join(rng.choices(words, k=4))) for i in range(120)]
    docs += [("n1", None, None), ("n2", "gamma,beta. gamma", ""), ("n3", "pre" + "alpha beta of deltas", "zz")]
    asked = [(i, " ".join(rng.choices(words, k=1 + i % 6))) for i in range(60)] + [(100, "alpha beta of delta"), (101, "gamma,beta."), (102, "pha"), (103, "ha be"), (104, "of the of"), (105, ""), (106, "beta.  GAMMA")]
    m = spark.createDataFrame(docs, "memory_id string, ocr string, concept string")
    q = spark.createDataFrame(asked, "query_id long, text string").select("query_id", normalize(F.col("text")).alias("q_norm"), meaningful_tokens(F.col("text")).alias("q_tokens")).where(F.size("q_tokens") > 0)
    fields = {"ocr": F.col("ocr"), "concept": F.col("concept")}
    wanted = q.select(F.explode("q_tokens").alias("token")).unionByName(search._inside(q).select("token"))
    index = search.postings(m, fields, wanted)
    found = {tuple(r) for r in search.phrase_candidates(q, index, m, fields).collect()}
    plain = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip()
    kept = {r.query_id: r.q_norm for r in q.collect()}
    whole = {(i, d) for i, p in kept.items() for d, *texts in docs if any(p in plain(t) for t in texts)}
    assert whole and whole <= found
    # the tokens are there, but not as far apart as in the phrase
    far = spark.createDataFrame([("m1", "a gamma y delta b", ""), ("m2", "xa gamma delta bx", ""), ("m3", "a gamma", "delta b")], "memory_id string, ocr string, concept string")
    one = spark.createDataFrame([(1, "a gamma delta b", ["gamma", "delta"])], "query_id long, q_norm string, q_tokens array<string>")
    assert [r.memory_id for r in search.phrase_candidates(one, search.postings(far, fields), far, fields).collect()] == ["m2"]
    full = {(r.token, r.memory_id, r.field): r.positions for r in search.postings(m, fields).collect()}
    assert full[("gamma", "n2", "ocr")] == [0, 2] and ("x-1", "n1", "ocr") not in full


def test_money_of_odd_texts_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    from recallgrid.plans import text as plans

    odd = ["pay Rs. 7.50 and Rs. 7.50 again", "€ 5 or £6 or $7", "rſ 5 RS.8 inr 1,200.75 $\x0b9 ₹\xa03 ₹\t4", "", None, "€5 $5 $5"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = sorted(tuple(r) for r in plans.QUERIES["c19_extract_money"](spark, str(tmp_path)).collect())
    assert found == sorted(db.execute(plans.ORACLES["c19_extract_money"]).fetchall())


def test_keywords_take_one_text_at_a_time(spark):
    """The function gets Arrow arrays (250), not all texts of a batch as Python strings (200)."""
    df = spark.createDataFrame([("a b",)], "t string").select(keywords_in(F.col("t"), ["a"]).alias("k"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and ", 250" in plan and df.first().k == ["a"]


def test_search_makes_no_rows_of_pairs_that_only_share_words(spark, monkeypatch):
    n, asked = 300, 20
    phrase = "alpha beta gamma rare{0} delta{0} omega{0}"
    text = [phrase.format(k) if k < asked else f"alpha beta other{k} words" for k in range(n)]
    rows = [(f"m{k}", text[k], None, None, f"shot {k}", "rechnungen" if k == 250 else None, f"shot {k} " + ("rechnungen" if k == 250 else ""), 1, 1, 1) for k in range(n)]
    memories = spark.createDataFrame(rows, "memory_id string, ocr_text string, summary string, title string, filename string, category string, concept_text string, captured_s long, created_s long, indexed_s long")
    texts = [(k, phrase.format(k)) for k in range(asked)] + [(99, "rechnungen"), (100, "alpha none neither beta")]
    queries = spark.createDataFrame(texts, "query_id long, query_text string").select("*", normalize(F.col("query_text")).alias("q_norm"), meaningful_tokens(F.col("query_text")).alias("q_tokens"), *[F.lit(None).cast("long").alias(c) for c in ("date_from_s", "date_to_s")])
    near = spark.createDataFrame([(0, "m0", 0.3), (0, "m299", 0.1)], "query_id long, memory_id string, score double")
    feedback = spark.createDataFrame([(phrase.format(3), "m3", -1)], "query_norm string, memory_id string, signal int")
    counts, write = [], search.staged

    def counted(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(search, "staged", counted)
    found = {(r.query_id, r.memory_id, r["rank"], r.evidence) for r in search.search(queries, memories, near, near, feedback).collect()}
    assert found == {(0, "m0", 1, "visual,ocr")} | {(k, f"m{k}", 1, "ocr") for k in range(1, asked) if k != 3} | {(99, "m250", 1, "concept")}
    assert max(counts) == n  # the texts' tokens; pairs and places are fewer


def test_enrichment_names_each_pass_over_a_text_once(spark):
    from recallgrid.operators import documents

    rows = [("a", t, None, None, None) for t in EXTRA]
    done = documents.enrich(spark.createDataFrame(rows, "memory_id string, ocr_text string, title string, category string, intent string"))
    done = done.select("memory_id", "title", "category", F.size("entities").alias("n"), "confidence")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(r"\p{C}") == 1
    assert plan.count(r"(?U)[^\w]+") == 3  # the text, the description, the intent
    assert done.count() == len(EXTRA)


def test_text_statistics_equal_their_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from recallgrid.plans import text as plans

    texts = [None, "", "a\n", "a\n\n", "\n", "a\r\n", "a\n\r", "a\n ", "a\n\x85", "a\x0bb", "a b", "éa@b.com", "a@b.comé", "a@b.co_", "é.a@b.com", "x a.b@c.de y", "٣", "a\U0001f600b\n\n\n"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = plans.QUERIES["a15_text_statistics"](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({plans.ORACLES['a15_text_statistics']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == want and len(want) == len(texts)
