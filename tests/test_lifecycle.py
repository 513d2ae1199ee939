"""Life cycles against a plain loop."""

import random

import pytest

from hirespan.operators import lifecycle

ORDER = ["ts", "event_id"]


def plain(log, legal):
    states, out = {}, []
    for key, step, ts, event in sorted((r for r in log if r[0] is not None and r[1] is not None), key=lambda r: (r[2], r[3])):
        before = states.get(key, "")
        good = step in legal.get(before, [])
        states[key] = step if good else before
        out.append((key, step, ts, event, before, good))
    return out + [(*r, None, False) for r in log if r[0] is None or r[1] is None]


@pytest.mark.parametrize("legal", [lifecycle.RESUME, lifecycle.APPLICATION])
@pytest.mark.parametrize("parts", [8, 64])
def test_against_a_plain_loop(spark, legal, parts):
    rng = random.Random(parts)
    steps = [*{s for after in legal.values() for s in after}, "UNHEARD"]
    log = [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), rng.choice(steps), rng.randrange(500), n) for n in range(2500)]
    log += [(None, "UPLOADED", 1, 3000), ("a", None, 1, 3001)]
    frame = spark.createDataFrame(log, "user string, status string, ts int, event_id int")
    folded = lifecycle.steps(frame, "user", legal, ORDER, parts=parts)
    expected = plain(log, legal)
    assert sorted(map(tuple, folded.collect()), key=repr) == sorted(expected, key=repr)
    present = {r.user: (r.state, r.steps, r.rejected) for r in lifecycle.current(folded, "user", ORDER).collect()}
    for key in ("hot", "a", "b", "c"):
        own = [r for r in expected if r[0] == key]
        last = [r[1] for r in own if r[5]]
        assert present[key] == (last[-1] if last else "", len(last), len(own) - len(last))
    reasons = [r.reason for r in lifecycle.rejects(folded).collect()]
    assert reasons.count("key or state is missing") == 2 and len(reasons) == sum(not r[5] for r in expected)


def test_no_log(spark):
    frame = spark.createDataFrame([], "user string, status string, ts int, event_id int")
    folded = lifecycle.steps(frame, "user", lifecycle.RESUME, ORDER)
    assert folded.collect() == [] and lifecycle.current(folded, "user", ORDER).collect() == []
