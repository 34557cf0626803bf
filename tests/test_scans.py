"""Whole passages as queries against brute force, in one block and in several; pairs that only share words are not shuffled."""

import random

from pyspark.sql import functions as F

from recallgrid.functions.text import DOC_TOKEN, STOP_WORDS
from recallgrid.operators import scans, search
from recallgrid.plans import search as plans

WORDS = [f"w{i}" for i in range(60)] + ["a", "of", "the", "invoice", "inv", "vo", "né", "x-1"]


def made(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(len(WORDS))], k=rng.choice([0, 1, 2, 3, 10, 40, 90]))) for _ in range(n)]


def joins_in(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_substring_hits(spark, data, monkeypatch):
    texts = made(150, 1) + [None, "", "Invoice  OF voice"]
    m = spark.createDataFrame([(f"m{i:03}", t, "f", "c", "s") for i, t in enumerate(texts)], "memory_id string, ocr_text string, filename string, category string, summary string")
    asked = made(30, 2) + ["invoice invoice w1", "vo"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    import re

    want = []
    for i, a in enumerate(asked):
        t = [w for w in re.findall(DOC_TOKEN, re.sub(r"\s+", " ", a.lower()).strip()) if len(w) >= 2 and w not in STOP_WORDS]
        scored = []
        for k, body in enumerate(texts):
            x = " ".join(["f", "c", "s"] + ([body] if body is not None else [])).lower()
            hit = [w for w in t if w in x]
            if hit and (len(hit) / len(t) >= 0.5 or len(t) == 1):
                scored.append((round(len(hit) / len(t) * 6 + sum(3 if len(w) >= 5 else 2 for w in hit) + (8 if " ".join(t) in x else 0), 6), f"m{k:03}"))
        want += [(i, n, b, s) for n, (s, b) in enumerate(sorted(scored, reverse=True)[:4], 1)]
    for tokens in (scans.BLOCK_TOKENS, 100):
        monkeypatch.setattr(scans, "BLOCK_TOKENS", tokens)
        assert sorted((r.query_id, r.rank, r.memory_id, r.score) for r in search.fast_lookup(q, m).collect()) == sorted(want)
    assert joins_in(plans.QUERIES["k7_fast_lookup"](spark, data)) == 0


def test_overlaps(spark, data, monkeypatch):
    texts = made(200, 3)
    texts[7] = texts[3] + " more"
    m = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "memory_id string, ocr_text string")
    own = lambda t: set(t.split()) - {""}
    q = m.where(F.substring("memory_id", -1, 1) == "3").select(F.substring("memory_id", 2, 9).cast("long").alias("query_id"), F.col("memory_id").alias("own"), F.filter(F.split("ocr_text", " "), lambda w: (w != "") & (w != "né")).alias("q_tokens"))
    plain = lambda t: {w for w in own(t) if w != "né"} | ({"n"} if "né" in t.split() else set())
    want = {}
    for i in range(3, 200, 10):
        t = own(texts[i]) - {"né"}
        for k, body in enumerate(texts):
            if t and k != i and 2 * len(t & plain(body)) >= len(t):
                want[(i, f"m{k}")] = len(t & plain(body)) / len(t)
    for tokens in (scans.BLOCK_TOKENS, 100):
        monkeypatch.setattr(scans, "BLOCK_TOKENS", tokens)
        assert {(r.query_id, r.memory_id): r.score for r in scans.overlaps(q, m).collect()} == want and want
    assert joins_in(plans.QUERIES["j7_related_text"](spark, data)) == 0


def test_owner_hits(spark):
    """An owner's newest memories with a term, against brute force; terms meet words, not texts, where they are plain letters."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Invoice", "voice", "in", "KKelvin", "the1the", "x_ray", "İnv"], k=rng.randrange(1, 5))) if i % 9 else None for i in range(120)]
    rows = [(i, f"o{i % 3}", t, f"Shot {i}.PNG", ("ready", "partial", "failed")[i % 7 % 3], i // 4) for i, t in enumerate(texts)]
    m = spark.createDataFrame(rows, "memory_id long, user_id string, ocr_text string, filename string, status string, created_s long")
    asked = [(i, f"o{i % 4}", t) for i, t in enumerate(["voice", "NV", "kk", "png", "ray", "the", "zz", "in"] * 3)]
    q = spark.createDataFrame(asked, "query_id long, user_id string, term string")
    low = {r.memory_id: (r.t, r.f) for r in m.select("memory_id", F.lower("ocr_text").alias("t"), F.lower("filename").alias("f")).collect()}
    want = set()
    for i, owner, term in asked:
        held = [(-c, k) for k, o, _, _, status, c in rows if o == owner and status != "failed" and any(term.lower() in (x or "") for x in low[k])]
        want |= {(i, k) for _, k in sorted(held)[:5]}
    found = search.owner_hits(q, m, 5)
    assert {tuple(r) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " LIKE " not in plan and "ILIKE" not in plan.upper()
    other = search.owner_hits(spark.createDataFrame([(1, "o0", "x_r"), (2, "o0", "voice")], "query_id long, user_id string, term string"), m, 5)
    assert {r.query_id for r in other.collect()} == {1, 2}


def test_overlaps_split_texts_once(spark, monkeypatch):
    """Several blocks of queries pass over tokens that were written once; none splits the texts again."""
    monkeypatch.setattr(scans, "BLOCK_TOKENS", 100)
    m = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(made(60, 5))], "memory_id string, ocr_text string")
    q = m.select(F.substring("memory_id", 2, 9).cast("long").alias("query_id"), F.col("memory_id").alias("own"), F.split("ocr_text", " ").alias("q_tokens"))
    plan = scans.overlaps(q, m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "regexp_extract_all" not in plan
