import corpus_pipeline


def test_passages_of_two_sources_and_of_one(spark):
    two, one, short = (" ".join(f"{w}{k}" for k in range(n)) for w, n in (("two", 51), ("one", 60), ("short", 50)))
    rows = [(1, two, "a"), (2, f"own 2\n  {two}\t", "b"), (3, one, "c"), (4, f"own 4\n{one}", "c"), (5, f"{one}\nown 5", "c"), (6, f"{short}\nown 6", "a"), (7, f"{short}\nown 7", "b"), (None, f"own 8\n{two}", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_shared_lines(spark, docs, "").collect()}
    assert got == {1: two, 2: "own 2", 3: one, 4: "own 4", 5: "own 5", 6: rows[5][1], 7: rows[6][1], None: "own 8"}
