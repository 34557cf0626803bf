import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from recallgrid.llm import exact, simhash, toxicity


def test_exact_groups(spark, edge, empty):
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact.exact_groups(edge).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id and hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[text]))
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_groups(empty).count() == 0


def test_ranges_give_the_same_groups(spark, edge):
    docs = edge.select("doc_id", "text").unionAll(spark.range(300).select(F.col("id"), F.concat(F.lit("t"), F.col("id") % 120)))
    one, many = (sorted(map(str, exact.exact_groups(docs, n).collect())) for n in (10**6, 60))
    assert one == many and len(one) == docs.count()


def test_segments_as_lists():
    rng = np.random.default_rng(1)
    for share in (0, 1e-5, 1e-3, 0.2):
        segment = np.packbits(rng.random(exact.SEGMENT) < share, bitorder="little")
        assert (exact._unpacked(exact._packed(segment)) == segment).all()
    assert len(exact._packed(np.zeros(exact.SEGMENT // 8, np.uint8))) == 0


def test_filter_holds_every_repeated_hash(spark):
    hashes = spark.range(50_000).select(F.xxhash64(F.col("id") % 49_000).alias("h")).repartition(7)
    bits = 1 << 21
    found = exact.repeated_filter(hashes, bits)
    again = np.array([r.h for r in hashes.groupBy("h").count().where("count > 1").collect()])
    alone = np.array([r.h for r in hashes.groupBy("h").count().where("count = 1").collect()])
    assert exact._has(found, exact._places(again, bits)).all()
    assert exact._has(found, exact._places(alone, bits)).mean() < 0.01


def test_simhash_against_brute_force(spark, edge, empty):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the deep dark wood".split()
    near = [(100 + k, " ".join([*base, *(["again"] * 300), *([f"x{k}"] if k % 2 else [])])) for k in range(6)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in docs.collect()]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    low = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in label}
    expected = sorted(str((i, fp, low[g])) for (i, fp), g in zip(rows, label))
    got = sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.count() == len(set(label)) and kept.columns == docs.columns


def test_chain_of_links(spark):
    values = [0]
    for k in range(60):
        values.append(values[-1] ^ (0b11 << k))
    fps = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    found = simhash.components(simhash.links(fps))
    assert found.select("label").distinct().count() == 1


def test_gradients():
    x = toxicity.Network({"a": 1, "b": 2}, seed=3)
    x.p = {k: v.astype(np.float64) for k, v in x.p.items()}
    words = ["a", "b", "c", "dd"]
    index, live = np.array([[0, 1, 2], [3, 1, 0]]), np.array([[True, True, True], [True, True, False]])

    def loss():
        z = x.logits(x.inputs(x.embed(words)), index, live)
        return float((z * np.array([0.7, -1.3])).sum())

    tape: dict = {}
    x.logits(x.inputs(x.embed(words)), index, live, tape)
    g = x.gradients(index, live, tape, np.array([0.7, -1.3]), len(words))
    vectors = x.embed(words)
    g |= {"Wf": vectors.T @ g["xf"], "Wb": vectors.T @ g["xb"]}
    for name in ("Wf", "Wb", "Uf", "Ub", "A", "a", "v", "o", "k"):
        flat = x.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-4 - g[name].reshape(-1)[k]) < 2e-3, name


def test_windows_cover_all_words():
    first, size, owner = toxicity.windows(np.array([0, 1, 48, 49, 500]))
    covered = defaultdict(set)
    for a, n, o in zip(first, size, owner):
        covered[o] |= set(range(a, a + n))
        assert n <= toxicity.WINDOW
    assert [len(covered[k]) for k in range(5)] == [0, 1, 48, 49, 500]


def test_toxicity_learns_and_holds_out(spark, edge, empty):
    import random

    random.seed(1)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(500):
        words = random.choices(plain, k=random.randint(5, 150))
        bad = i % 4 == 0
        if bad:
            for w in random.sample(["scoundrel", "wretch", "blockhead"], 2):
                words.insert(random.randrange(len(words)), w)
        rows.append((i, " ".join(words), 1))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic long"), spark.createDataFrame(marks, "doc_id long, toxic int")
    network = toxicity.train(docs, labels)
    got = {r.doc_id: (r.score, r.out) for r in toxicity.score(docs, network).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("out")).collect()}
    out = [(got[i][0] >= toxicity.THRESHOLD, bool(t)) for i, t in marks if got[i][1]]
    assert all(got[i][1] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in marks)
    assert sum(a == b for a, b in out) / len(out) > 0.9
    scored = toxicity.score(edge, network).collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, network).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert set(toxicity.score(edge, None).select("score").toPandas()["score"]) == {0.0}
    clean = toxicity.clean(docs, network)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()


def _insults(spark, n):
    import random

    draw = random.Random(5)
    texts = [" ".join([*(f"word{draw.randrange(4000)}" for _ in range(draw.randint(1, 90))), *(["wretch"] if i % 3 == 0 else [])]) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int").repartition(3), texts


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    docs, labels, texts = _insults(spark, 240)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows = sorted((int(i % 3 == 0), hashes[i], i) for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1)
    sample = [x for k in (0, 1) for x in [r for r in rows if r[0] == k][:40]]
    expected = toxicity.fit([texts[i] for _, _, i in sample], np.array([k for k, _, _ in sample]))
    monkeypatch.setattr(toxicity, "fit", None)  # in this process, not in the workers
    got = toxicity.train(docs, labels, 40)
    assert got.vocabulary == expected.vocabulary
    # a worker's matrix products may use another number of threads
    assert np.allclose(toxicity.Scorer(got).scores(texts), toxicity.Scorer(expected).scores(texts), atol=1e-3)


def test_characters_of_words_are_held_in_parts(monkeypatch):
    import tracemalloc

    words = [f"word{i * 7919 % 1_000_003}é" for i in range(60_000)]
    network = toxicity.Network({"word7919é": 1})
    tracemalloc.start()
    vectors = network.embed(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # 100 MB where all words are looked at together
    monkeypatch.setattr(toxicity, "PART_WORDS", 1_000_000)
    assert (network.embed(words) == vectors).all()


def test_exploded_sides_are_not_broadcast(spark):
    """Spark sizes variants and salted rows as if each fingerprint gave one; both sides of their joins stay where they are."""
    from recallgrid.llm.common import salted

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    met = salted(rows, rows.groupBy("k").agg(F.max("id").alias("m")), "k", "id")
    found = simhash.links(spark.range(500).select(F.xxhash64("id").alias("fp")))
    for df, n in ((met, 1000), (found, 0)):
        assert df.count() == n
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_components_of_few_edges_shuffle_no_edges(spark, monkeypatch):
    """The same labels with minima broadcast and with salted joins; edges that are stars already take one round."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 100), (200, 201)], "a long, b long")
    want = {**{i: 1 for i in range(2, 31)}, 101: 100, 102: 100, 201: 200}
    for few in (simhash.FEW_EDGES, 0):
        monkeypatch.setattr(simhash, "FEW_EDGES", few)
        assert {r.node: r.label for r in simhash.components(edges).collect()} == want
    rounds, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: rounds.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(simhash, "FEW_EDGES", 100_000)
    assert simhash.components(edges.where("a >= 200")).count() == 1
    assert len(rounds) == 2 and "SortMergeJoin" not in rounds[1] and "__salt" not in rounds[1]
