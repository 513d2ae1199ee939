"""Near duplicates against all pairs, and components against a plain union of sets."""

import random

import pytest

from hirespan.llm import neardup
from hirespan.llm.components import components, merged


def shingles(text, width):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, share):
    """Smallest id reachable, for rows (id, text) that may repeat ids."""
    sets = [shingles(t or "", width) for _, t in rows]
    at = list(range(len(rows)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= share * len(x | y):
                at[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(sets[k]), low[root(k)], low[root(k)] == i) for k, (i, _) in enumerate(rows))


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rep int")
    return sorted(map(tuple, neardup.near_duplicates(frame, **options).collect()))


def mutated(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
    return " ".join(words)


@pytest.mark.parametrize("width, members", [(2, 1000), (5, 7)])
def test_chains_of_copies_against_all_pairs(spark, monkeypatch, width, members):
    """Copies of copies: much is linked by way of others only. Small blocks make many of them meet."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    rng, rows = random.Random(width), []
    for group in range(6):
        texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90)))]
        for _ in range(40):
            texts.append(mutated(rng, rng.choice(texts[-8:]), rng.randint(0, 5 if width == 2 else 2)))
        rows += [(1000 * rng.randrange(6) + 10 * len(rows) + group, t) for t in texts]
    rows += [(7, None), (8, ""), (9, "word"), (10, "Word"), (11, "two words")]
    assert found(spark, rows, width=width) == brute(rows, width, 80)


def test_many_short_texts_of_one_shingle(spark, monkeypatch):
    """Texts that share one of two shingles fall into common entries, yet none is linked but the planted ones."""
    monkeypatch.setattr(neardup, "MEMBERS", 20)
    rows = [(i, f"thank you u{i}") for i in range(3000)] + [(5000 + i, f"Thank  you U{i}") for i in range(0, 3000, 500)]
    singles = {i: i for i, _ in rows} | {5000 + i: i for i in range(0, 3000, 500)}
    assert found(spark, rows) == sorted((i, 2, c, c == i) for i, c in singles.items())


def test_equal_ids_with_different_texts_are_told_apart(spark):
    long = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [(5, long), (5, other), (6, long + " more"), (4, other + " more"), (5, long)]
    assert found(spark, rows) == brute(rows, 2, 80)
    assert [r[2] for r in found(spark, rows)] == [4, 4, 5, 5, 5]


def unions(pairs):
    groups = []
    for a, b in pairs:
        meeting = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in meeting] + [{a, b}.union(*meeting)]
    return sorted((i, min(g)) for g in groups for i in g)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_unions(spark, seed):
    rng = random.Random(seed)
    paths = [(k, k + 1) for k in range(1000, 1060)] + [(k * 37 % 61 + 2000, (k + 1) * 37 % 61 + 2000) for k in range(60)]
    stars = [(rng.randrange(3000, 3050), 3077) for _ in range(60)]
    chance = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)]
    pairs = [(a, b) for a, b in paths + stars + chance if a != b]
    frame = spark.createDataFrame([*pairs, *pairs[:9], (5000, 5000)], "a long, b long")
    assert sorted(map(tuple, components(frame).collect())) == unions(pairs)
    # In two parts, the second on top of the first.
    first, second = (spark.createDataFrame(p or [], "a long, b long") for p in (pairs[::2], pairs[1::2]))
    assert sorted(map(tuple, merged(components(first), second).collect())) == unions(pairs)
    assert components(first.where("a < 0")).collect() == []
