import random

import pytest

import corpus_pipeline
from recallgrid.llm import similar, simhash


def near_copies(n, share, words, seed):
    """Texts and copies with some words changed, to a five-word similarity around 0.8 and above."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        rows.append((2 * i, " ".join(base)))
        for k in rng.sample(range(words), max(1, int(words * share * rng.random()))):
            base[k] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    return rows


def brute(rows):
    sets = [similar.shingles(t or "") for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i) if similar.jaccard(sets[i], sets[j]) >= similar.SIMILAR]


def roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root
    return root


def test_recall_against_brute_force(spark):
    rows = near_copies(150, 0.024, 200, 1) + [(1000 + i, t) for i, t in near_copies(40, 0.03, 60, 2)]
    pairs = brute(rows)
    assert len(pairs) > 100
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in similar.keep_first(documents).collect()}
    root = roots(len(rows), pairs)
    expected = {rows[k][0] for k in set(root)}
    assert expected <= kept  # nothing goes that is not similar
    assert len(rows) - len(kept) >= 0.95 * (len(rows) - len(expected))
    old = len(rows) - simhash.keep_first(documents).count()
    assert old < 0.5 * (len(rows) - len(expected))


def test_large_group_and_edges(spark, edge, empty):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    group = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(400)] = f"x{i}"
        group.append((100 + i, " ".join(words)))
    documents = spark.createDataFrame(group, "doc_id long, text string")
    assert [r.doc_id for r in similar.keep_first(documents).collect()] == [100]
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    kept = similar.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(roots(len(rows), brute(rows))))
    assert similar.keep_first(empty).count() == 0


def test_odd_radii_are_refused(spark):
    fps = spark.createDataFrame([(0,), (1,)], "fp long")
    for radius in (1, 3):
        with pytest.raises(ValueError):
            simhash.links(fps, radius)


def hub(n, seed):
    """A text of 400 words and texts that are like it and not like each other: eight words changed each, far apart."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        words = list(base)
        for j in range(8):
            words[j * 48 + rng.randrange(48)] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [10, 400])
def test_family_of_a_hub_is_one(spark, n):
    rows = hub(n, n)
    sets = [similar.shingles(t) for _, t in rows[:11]]
    assert all(similar.jaccard(sets[0], s) >= similar.SIMILAR for s in sets)
    assert not any(similar.jaccard(sets[i], sets[j]) >= similar.SIMILAR for i in range(1, 11) for j in range(1, i))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in similar.keep_first(documents).collect()]
    assert len(kept) - 1 <= 0.02 * n and 0 in kept


def test_blocks_join_what_turns_left(spark, monkeypatch):
    """Without turns of stars, and with small blocks, the open values alone join the family."""
    monkeypatch.setattr(similar, "STARS", 0)
    monkeypatch.setattr(similar, "PART", 16)
    documents = spark.createDataFrame(hub(120, 5), "doc_id long, text string")
    assert similar.keep_first(documents).count() <= 3


def test_links_that_join_components():
    import numpy as np

    assert similar.joining(np.array([1, 2, 1, 4]), np.array([2, 3, 3, 1])) == [0, 1, 3]


def test_balls_join_close_fingerprints(spark, monkeypatch):
    """Without segments, ball hashing alone joins all similar texts whose first 64 bits are within two bits."""
    real = similar.meetings
    monkeypatch.setattr(similar, "meetings", lambda distinct: real(distinct).where("false"))
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(1200)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(1200)] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    bits = [int(similar.wide_fingerprint(t)[0]) & (1 << 64) - 1 for _, t in rows]
    pairs = [(i, j) for i, j in brute(rows) if (bits[i] ^ bits[j]).bit_count() <= simhash.RADIUS]
    assert len(pairs) > 15
    kept = {r.doc_id for r in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[k][0] for k in set(roots(len(rows), pairs))}
