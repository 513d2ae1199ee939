"""Hash trees and proofs against trees built node by node in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hirespan.llm import merkle
from hirespan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def up(nodes):
    """All levels of a tree, from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, place):
    """(left or right, digest) by level; None where a node is alone."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((("L" if other < place else "R"), level[other]) if other < len(level) else None)
        place //= 2
    return out


def expected(rows):
    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = n_chars + 1 if n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars
        good, bad = (leaf(doc_id, source, lang, n, text) for n in (n_chars, changed))
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, good, bad, doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: up([r[2] for r in by_lang[x]]) for x in langs if by_lang[x].sort() is None}
    top = up([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for place, (_, _, good, bad, doc_id) in enumerate(by_lang[x]):
            path = siblings(trees[x], place) + siblings(top, k)
            fold = bad
            for s in path:
                fold = H(fold) if s is None else H(s[1], fold) if s[0] == "L" else H(fold, s[1])
            root = top[-1][0]
            out.append((doc_id, good, trees[x][-1][0], root, H(*[s[1] for s in path if s]), fold, fold == root))
    return sorted(out, key=repr)


def found(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, str(folder)).collect()), key=repr)


@pytest.mark.parametrize("band", [1, 2, 10])
def test_against_plain_trees(spark, tmp_path, monkeypatch, band):
    """Narrow bands make the same trees need many of them."""
    monkeypatch.setattr(merkle, "BAND", band)
    rows = [(i, f"text {i} ßé", ["en", "de", None, "", "漢"][min(i % 7, 4)], "s", i) for i in range(1, 60)]
    rows += [(None, None, None, None, None), (3, "again", "en", None, None), (3, "again", "en", None, None), (90, "", "lone", "s", 9)]
    rows += [(91, "x" * 300_000, "de", "s", None), (7_000_000_000, "t", "en", "s", 2**63 - 1)]
    assert found(spark, tmp_path, rows) == expected(rows)


def test_one_row_has_no_siblings(spark, tmp_path):
    (row,) = found(spark, tmp_path, [(5, "a", "en", None, 1)])
    assert row[1] == row[2] == row[3] == row[5] and row[4] == H() and row[6]


def test_tampering_shows(spark, tmp_path):
    tampered = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 7 == 0]
    rows = [(i, "t", "en", "s", i) for i in range(1, 40)]
    assert sorted(r[0] for r in found(spark, tmp_path, rows) if not r[6]) == tampered


def test_empty_and_clashing_names(spark):
    records = spark.createDataFrame([(1, "en", "a" * 64, "x", "y"), (2, "en", "b" * 64, "x", "y")], "id long, tree string, lo string, path string, n string")
    out = merkle.manifest(records, tree="tree", order=["id"], leaf="lo").orderBy("id").collect()
    assert [(r.id, r.n, r.path) for r in out] == [(1, "y", ["R" + "b" * 64]), (2, "y", ["L" + "a" * 64])]
    assert merkle.manifest(records.where("id > 5"), tree="tree", order=["id"], leaf="lo").collect() == []


def test_siblings_fill_what_a_parent_leaves(spark):
    digests = [H(str(k)) for k in range(11)]
    paths, top = merkle.climb(list(range(11)), digests, 0, None)
    assert top == up(digests)[-1][0]
    assert [[p and p[1:] for p in path] for path in paths] == [[s[1] if s else "" for s in siblings(up(digests), k)] for k in range(11)]
    frame = spark.createDataFrame([(digests[k], paths[k]) for k in range(11)], "leaf string, path array<string>")
    assert {r[0] for r in frame.select(merkle.folded(F.col("leaf"), F.col("path"))).collect()} == {top}
