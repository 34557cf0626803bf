import zlib
from collections import defaultdict

import duckdb
import pytest

from recallgrid.llm import merkle

H = merkle.digest


def plain(rows):
    """The manifest by the definition, in one process."""

    def leaf(r, more=0):
        fields = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
        return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def up(level):
        return [H(*level[k : k + 2]) for k in range(0, len(level), 2)]

    def levels(first):
        found = [first]
        while len(found[-1]) > 1:
            found.append(up(found[-1]))
        return found

    trees = defaultdict(list)
    for r in rows:
        trees[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([row[2] for row in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for pos, (_, _, one, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            node, siblings = leaf(r, 1) if tampered else one, []
            for tree, at in ((built[x], pos), (top, n)):
                for level in tree[:-1]:
                    run = level[at - at % 2 : at - at % 2 + 2]
                    siblings += [d for k, d in enumerate(run) if k != at % 2]
                    run[at % 2] = node
                    node, at = H(*run), at // 2
            out.append((r.doc_id, one, built[x][-1][0], top[-1][0], H(*siblings), node, node == top[-1][0]))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_against_the_definition(spark, edge, empty, height):
    more = [(100 + 3 * i, f"text {i}", "en" if i % 3 else "fr", "s", i) for i in range(83)] + [(1000, "alone", "zz", None, None), (1001, None, "é", "s", 4)]
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    assert rows_of(merkle.manifest(docs, height)) == sorted(plain(docs.collect()), key=str)
    assert rows_of(merkle.manifest(edge, height)) == sorted(plain(edge.collect()), key=str)
    assert merkle.manifest(empty).count() == 0


def test_one_row(spark):
    docs = spark.createDataFrame([(5, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = merkle.manifest(docs).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("")


def test_sql_gives_the_same(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = con.execute(merkle.ORACLE)
    assert [c[0] for c in expected.description] == names
    assert rows_of(merkle.manifest(docs)) == sorted(expected.fetchall(), key=str) == sorted(plain(docs.collect()), key=str)


def test_versions_share_all_but_a_path(spark, edge):
    found = merkle.versions(edge, 2).collect()
    end = {r.doc_id: r.folded_root for r in merkle.manifest(edge).where("not verified").collect()}
    paths = defaultdict(dict)
    for r in found:
        paths[r.doc_id][r.level] = r
    assert end and set(paths) == set(end)
    for i, path in paths.items():
        assert sorted(path) == list(range(len(path))) and path[len(path) - 1].digest == end[i]
