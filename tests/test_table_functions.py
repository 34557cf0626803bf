"""Table functions against plain Python, by SQL and by lateral join."""

import re

from pyspark.sql import functions as F

from recallgrid.functions import tables
from recallgrid.functions import text as T
from recallgrid.operators import classify, rules
from recallgrid.plans import text as plans

TEXTS = [
    None, "", "Mail a@b.co and A@B.co; a@b.co again", "pay Rs. 5 or ₹ 6.50 on 2024-01-02 at 10:30, order #AB12345", "Python, python and PYTHON in New York; machine learning machine learning", "x" * 3000 + " a@b.co",
    "İstanbul python é 写真 react", "https://x.y/z?a=1 www.q.w @user_1 inv-77X", "tokyo tokyos c++ node.js",
]


def brute(text):
    """Every start is tried, so nothing is borrowed from finditer's way through the text."""
    found = []
    for kind, (pattern, confidence) in classify.ENTITY_PATTERNS.items():
        at, compiled = 0, re.compile(pattern, re.ASCII)
        while at <= len(text):
            m = next((m for i in range(at, len(text) + 1) if (m := compiled.match(text, i))), None)
            if m is None:
                break
            whole = m.group(0)
            first = m.start() + len(whole) - len(whole.lstrip())
            found.append((kind, whole.strip(), first, first + len(whole.strip())))
            at = max(m.end(), at + 1)
    for (kind, _), words in rules.DICTIONARIES.items():
        at = 0
        while at < len(text):
            here = [w for w in words if text[at : at + len(w)].lower() == w]
            inside = lambda c: re.match(r"\w", c) is not None
            here = [w for w in here if not w.isalnum() or not ((at and inside(text[at - 1])) or inside(text[at + len(w) : at + len(w) + 1] or " "))]
            if here:
                best = max(here, key=len)
                found.append((kind, text[at : at + len(best)], at, at + len(best)))
            at += len(max(here, key=len)) if here else 1
    return sorted(found)


def test_spans(spark):
    tables.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    by_sql = spark.sql("SELECT id, s.type, s.text, s.start, s.end FROM {df}, LATERAL entity_spans(text) AS s", df=df)
    by_join = df.lateralJoin(tables.EntitySpans(F.col("text").outer()).alias("s")).select("id", "s.type", "s.text", "s.start", "s.end")
    expected = sorted((i, *e) for i, t in enumerate(TEXTS) for e in brute(t or ""))
    assert len(expected) > 20
    for found in (by_sql, by_join):
        assert sorted(tuple(r) for r in found.collect()) == expected
    for r in by_sql.collect():
        assert TEXTS[r.id][r.start : r.end] == r.text


def test_spans_agree_with_the_entities_of_a_text(spark, data):
    found = {(r.doc_id, r.type, r.value) for r in plans.QUERIES["u4_entity_spans_all"](spark, data).collect()}
    rows = plans.rich(spark, data).select("doc_id", F.explode(classify.pattern_entities(F.col("text"))).alias("e")).select("doc_id", "e.type", "e.text").collect()
    assert {tuple(r) for r in rows} == {f for f in found if f[1] in classify.ENTITY_PATTERNS}


def test_chunks(spark, data):
    one = sorted(tuple(r) for r in plans.QUERIES["u4_chunk_text"](spark, data).collect())
    docs = plans.docs(spark, data)
    assert one == sorted(tuple(r) for r in T.chunk_text(docs, "doc_id", "text").collect()) and len(one) > docs.count()
    whole = {r.doc_id: r.t for r in docs.select("doc_id", T.normalize_ws(F.col("text")).alias("t")).collect()}
    last = {}
    for doc, i, first, after, chunk in one:
        assert whole[doc][first:after] == chunk and 0 < len(chunk) <= 1500
        assert i == last.get(doc, (-1, 0))[0] + 1 and not whole[doc][last.get(doc, (-1, 0))[1] : first].strip()
        last[doc] = (i, after)
    assert all(not whole[doc][after:].strip() for doc, (_, after) in last.items())


def test_dictionaries_take_one_pass(data, monkeypatch):
    """The automaton finds what the alternatives of all words find, and these are tried on texts only whose places move in lower case."""
    import random

    import pyarrow.parquet as pq

    words, rng = sorted(tables.KINDS), random.Random(3)
    texts = pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()[:60]
    texts += ["".join(rng.choice([*words, " ", "_", ".", "x", "é", "7", "-"]) for _ in range(60)) for _ in range(200)] + ["+91 98765 43210 1234567890"]
    plain = [[(kind, m.start(), m.end()) for (kind, _), ws in rules.DICTIONARIES.items() for m in re.finditer(tables._words(ws), t.lower())] for t in texts]
    monkeypatch.setattr(tables, "_words", None)
    found = [[(kind, a, b) for kind, _, a, b, _, source in tables.spans(t) if source == "dictionary"] for t in texts]
    assert found == plain and sum(map(len, found)) > 200
