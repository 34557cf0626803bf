import re

from recallgrid.llm import licenses as X


def found(spark, text):
    return X.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_hundreds_of_rules():
    assert len(X.rules()) > 300
    for word, before, after, *_ in X.rules():
        assert re.fullmatch("[a-z0-9]+", word) and re.compile(before) and re.compile(after)


def test_containment_and_priority(spark):
    r = found(spark, "Licensed under the Apache License, Version 2.0 (the License).")
    assert [d.label for d in r.base] == ["apache"] and r.base[0].start == 3
    assert [d.label for d in r.detections] == ["apache-2.0"]
    labels = {d.label for d in found(spark, "Released under CC BY-NC-SA 4.0. GNU Lesser General Public License version 2.1; SPDX-License-Identifier: MIT").detections}
    assert {"cc-by-nc-sa-4.0", "lgpl-2.1", "mit"} <= labels and "cc-by-nc-4.0" not in labels


def test_base_against_brute_force(spark, edge, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = ["MIT License mit LICENSE, x", "gnu GENERAL public-license", "a general  public license apache\nlicense", "\u212alicense mit licenses", "mit", None]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (edge, more):
        expected = []
        for r in docs.collect():
            w = words.findall((r.text or "").translate(lower))
            places = [(k, label) for phrase, label in X.BASE.items() for p in [[*phrase.split(), "license"]] for k in range(len(w)) if w[k : k + len(p)] == p]
            expected.append((r.doc_id or -1, len(w), sorted(places)))
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, sorted((d.start, d.label) for d in r.base)) for r in X.scan(docs).collect()]
        assert sorted(got) == sorted((i or (0 if docs is more else -1), n, p) if i != -1 or docs is edge else (0, n, p) for i, n, p in expected)
    assert X.scan(empty).count() == 0
