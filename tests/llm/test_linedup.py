from collections import defaultdict

from recallgrid.llm import linedup as X


def brute(rows, sites):
    where = defaultdict(set)
    places = defaultdict(list)
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            bare = line.strip(" \t\r")
            if t is not None and bare and s is not None:
                where[bare].add(s)
            if t is not None and bare and i is not None:
                places[bare].append((i, t, k))
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None))
            continue
        first = {}
        kept = []
        for k, line in enumerate(t.split("\n")):
            bare = line.strip(" \t\r")
            spread = bare and len(where[bare]) >= sites
            lead = min(places[bare], key=lambda p: (p[0], p[2])) if places[bare] else None
            if not spread or lead and (i, k) == (lead[0], lead[2]) and t == lead[1]:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def test_against_brute_force(spark, edge, empty):
    rows = [(r.doc_id, r.text, r.source) for r in edge.collect()]
    got = [(r.doc_id, r.text) for r in X.drop_boilerplate(edge).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, X.SITES)))
    assert sum("Shared line" in (t or "") for _, t in got) == 2  # the two equal rows that hold its first place
    assert X.drop_boilerplate(empty).count() == 0
    assert X.drop_boilerplate(edge).columns[:7] == edge.columns


def test_threshold_is_exact(spark):
    docs = [(d, f"line on {n} sites\nown {n} {d}", f"s{d % n}") for n in range(2, 10) for d in range(n * 100, n * 100 + n)]
    got = X.drop_boilerplate(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for n in range(2, 10):
        kept = sum(f"line on {n} sites" in r.text for r in got)
        assert kept == (1 if n >= X.SITES else n)
