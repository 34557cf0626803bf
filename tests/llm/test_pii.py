import re
import time

from recallgrid.llm import pii as X

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m[0]))


def test_base_against_brute_force(spark, edge, empty):
    texts = [
        "a@b.c.d@e.f x_a@b.c_d@e.f.", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.2.3.004 1.2.3", "4111-1111 1111-1111 4111111111111111, 4111 1111  1111 1111 49927398716", "+1 (212) 555-1234- +44 20 7946 0958. +1 2", "\U0001f600 é a.b%c@x-y.z +12345678901234567890",
        "9" * 60_000, "x" * 60_000 + "@y.z", "1-2 " * 5000, "." * 1000 + "1.1.1.1",
    ]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (more, edge):
        got = sorted((r.doc_id if r.doc_id is not None else -1, sorted((x.start, x.kind, x.end) for x in r.base)) for r in X.spans(docs).collect())
        assert got == sorted((r.doc_id if r.doc_id is not None else -1, brute(r.text or "")) for r in docs.collect())
    assert X.spans(empty).count() == 0


def test_contexts_discover(spark):
    secret = [(i, f'alpha{i} session token = "{i:040x}f" beta') for i in range(10)]
    odd = [(100, 'gamma session token = "hunter2-is-not-hex" delta'), (101, "release number 2024.11 is out, chapter 1234567")]
    r = {x.doc_id: x for x in X.spans(spark.createDataFrame(secret + odd, "doc_id long, text string")).collect()}
    assert all(r[i].more[0].kind == "secret" for i in range(10))
    text = odd[0][1]
    assert [(text[x.start : x.end], x.kind) for x in r[100].more] == [("hunter2-is-not-hex", "found_secret")]
    assert not r[101].more and not r[101].base


def test_mask(spark, edge):
    docs = spark.createDataFrame([(1, "mail a@b.co, +1 (212) 555-1234!", 1), (2, "clean text", 2), (3, None, 3), (1, "mail a@b.co, +1 (212) 555-1234!", 1)], "doc_id long, text string, extra long")
    assert sorted(map(str, [(r.doc_id, r.text, r.extra) for r in X.mask(docs).collect()])) == sorted(map(str, [(1, "mail [EMAIL], [PHONE]!", 1), (1, "mail [EMAIL], [PHONE]!", 1), (2, "clean text", 2), (3, None, 3)]))
    assert X.mask(edge).count() == edge.count() and X.mask(edge).columns == edge.columns


def test_many_identifiers_in_one_text(spark):
    n = 10_000
    text = " ".join(f"mail u{i}@ex{i}.com id AB{i:06d}x" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in X.spans(docs).collect()}
    assert [text[s.start : s.end] for s in rows[1].base] == [f"u{i}@ex{i}.com" for i in range(n)] and not rows[2].base
    masked = {r.doc_id: r.text for r in X.mask(docs).collect()}
    expected = list(text)
    for s in sorted(rows[1].base + rows[1].more, key=lambda s: -s.start):
        expected[s.start : s.end] = ["[" + s.kind.removeprefix("found_").upper() + "]"]
    assert masked == {1: "".join(expected), 2: "nothing"}
    assert time.time() - began < 90
