"""Benchmark items in documents: recall against brute force over item lengths, answers, ties and repeated items."""

import random
from itertools import count

import numpy as np
import pyarrow as pa
import pytest

from hirespan.llm import decontaminate
from hirespan.llm.decontaminate import ANSWER_COVER, COVER, findings

DOCS = "doc_id long, text string"


def subsequence(a, b):
    """Length of the longest common subsequence, by the usual table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], (last + 1 if x == y else max(row[k], row[k - 1]))
    return row[-1]


def holds(item, text):
    mine, words = item.split(), text.split()
    answer = mine[-(len(mine) // 4) :] if len(mine) >= 4 else []
    return subsequence(mine, words) >= COVER * len(mine) and subsequence(answer, words) >= ANSWER_COVER * len(answer)


def altered(rng, words):
    """One word in six replaced, at random places."""
    out = list(words)
    for k in rng.sample(range(len(out)), round(len(out) / 6)):
        out[k] = f"other{rng.randrange(999)}"
    return out


def test_recall_over_lengths(spark):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(60)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else f"p{rng.randrange(4000)}" for _ in range(n)]

    items, docs, planted, number = [], [], {}, count(1000)
    for length in [*range(4, 24), *range(24, 61, 6)]:
        for _ in range(8):
            words = prose(length)
            items.append((len(items), " ".join(words)))
            for kind, copy in (("verbatim", words), ("altered", altered(rng, words))):
                if holds(items[-1][1], " ".join(copy)):
                    doc = next(number)
                    planted[doc] = (kind, length, len(items) - 1)
                    docs.append((doc, " ".join([*prose(rng.randrange(150)), *copy, *prose(rng.randrange(150))])))
    clean = [(next(number), " ".join(prose(300))) for _ in range(200)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in findings(spark.createDataFrame(docs + clean, DOCS), benchmark).collect()}
    share = {}
    for doc, (kind, length, item) in planted.items():
        for group in (kind, (kind, "short" if length < 11 else "middle" if length < 24 else "long")):
            hit, all_of = share.get(group, (0, 0))
            share[group] = hit + ((doc, item) in found), all_of + 1
    rates = {group: hit / all_of for group, (hit, all_of) in share.items()}
    assert rates["verbatim"] == 1, share
    assert all(rates["altered", size] >= 0.9 for size in ("short", "middle", "long")), share
    short = {i for i, (_, text) in enumerate(items) if len(text.split()) < 8}
    assert not {(d, i) for d, i in found if d in dict(clean) and i not in short}


def test_answers_ties_and_repeated_rows(spark):
    question = " ".join(f"q{k}" for k in range(30))
    benchmark = spark.createDataFrame(
        [(7, question, "q28 q29"), (3, question, "q28 q29"), (4, question, "elsewhere entirely"), (5, None, None), (None, question, "q1"), (6, "", "x")],
        "item_id long, text string, answer string",
    )
    docs = spark.createDataFrame([(1, question), (1, question), (2, "nothing of it"), (3, None), (None, question), (4, " ".join(question.split()[:27]))], DOCS)
    found = sorted((r.doc_id, r.item_id, r.covered) for r in findings(docs, benchmark).distinct().collect())
    assert found == [(1, 3, 1.0), (1, 7, 1.0)]  # 4 lacks the answer of all items
    best = {(r.doc_id, r.item_id, r.contaminated) for r in decontaminate.best_of(docs.select("doc_id"), findings(docs, benchmark)).collect()}
    assert best == {(1, 3, True), (2, None, False), (3, None, False), (None, None, False), (4, None, False)}


@pytest.mark.parametrize("items", [3, 1000])
def test_blocks_of_items_and_small_products(spark, monkeypatch, items):
    monkeypatch.setattr(decontaminate, "ITEMS", items)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    rng = random.Random(items)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(10)]
    docs = [(k, f"before {t} after " * (1 + k % 2)) for k, t in enumerate(texts)] + [(99, "before after")]
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in findings(spark.createDataFrame(docs, DOCS), benchmark).collect()) == [(k, k) for k in range(10)]


@pytest.mark.parametrize("counted", [4096, 0])
def test_directions_come_from_all_documents(spark, monkeypatch, counted):
    monkeypatch.setattr(decontaminate, "COUNTED", counted)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 90, n) for n in (0, 1, 9, 10, 11, 25, 300, *[40] * 60)]
    place = np.full(decontaminate.CODES, -1)
    place[:80:2] = np.arange(40)
    weight = rng.random(decontaminate.CODES).astype(np.float32)
    random = rng.standard_normal((40, 12)).astype(np.float32)
    want = np.zeros((40, 40))
    for doc in docs:
        for first in range(0, len(doc), decontaminate.PASSAGE):
            row = np.zeros(40)
            for code in doc[first : first + decontaminate.PASSAGE]:
                if place[code] >= 0:
                    row[place[code]] += weight[code]
            want += np.outer(row, row)
    codes = spark.createDataFrame([(k, d.astype("<u2").tobytes()) for k, d in enumerate(docs)], "doc_id long, codes binary")
    got = decontaminate.moments(codes.repartition(5), weight, place, random)
    assert np.allclose(got, want @ random, rtol=1e-6)
    assert decontaminate.directions(codes, weight, place).shape == (40, 40)


def test_pairs_have_one_place_and_give_the_moments_of_all_passages(monkeypatch):
    rng = np.random.default_rng(3)
    size, rank = 90, 5
    place = np.full(decontaminate.CODES, -1, np.int64)
    own = np.sort(rng.choice(400, size, replace=False))
    place[own] = np.arange(size)
    weight = rng.random(decontaminate.CODES).astype(np.float32)
    texts = [rng.integers(0, 400, n).astype("<u2") for n in (0, 1, 9, 10, 11, 537, 40)] + [own[:1].repeat(25).astype("<u2")]
    random = rng.standard_normal((size, rank)).astype(np.float32)
    want = np.zeros((size, rank))
    for text in texts:
        for k in range(0, len(text), decontaminate.PASSAGE):
            row = np.bincount(place[text[k : k + decontaminate.PASSAGE]] + 1, minlength=size + 1)[1:] * weight[own]
            want += row[:, None] * (row @ random)

    class Frame:  # the one task of a small table
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pydict({"codes": pa.array([t.tobytes() for t in texts], pa.binary())})
            self.rows = [row for out in run(iter([batch])) for row in out.to_pylist()]
            return self

        groupBy = applyInArrow = select

        def toLocalIterator(self):
            return iter(self.rows)

    for counted in (decontaminate.COUNTED, size - 1):
        monkeypatch.setattr(decontaminate, "COUNTED", counted)
        assert np.allclose(decontaminate.moments(Frame(), weight, place, random), want, rtol=1e-4, atol=1e-4)
    rows = np.array([[5, 2, 9, 5, 9, 9, 9, 9, 9, 9]])  # 9: no code
    assert sorted(np.concatenate(list(decontaminate.pairs_of(rows, 9))).tolist()) == [5 * 6 // 2 + 2] * 2 + [5 * 6 // 2 + 5]


def test_no_subsequence_is_looked_for_where_words_are_missing(monkeypatch):
    item = decontaminate.Item(1, list(range(8)), [6, 7])
    assert item.covered([0, 1, 2, 9, 4, 5, 6, 7]) == 7 / 8
    assert item.covered([0, 1, 2, 3, 4, 5, 6, 9]) == 7 / 8 and item.covered(list(range(7, -1, -1))) == 0.0
    monkeypatch.setattr(decontaminate, "common", lambda *_: pytest.fail("looked for"))
    assert item.covered([0, 1, 2, 3, 4, 9, 9, 9]) == 0.0
