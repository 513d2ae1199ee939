"""What Python workers are sent, and what they keep when a task of one operator ends and another's begins."""

import gc
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from hirespan.llm import decontaminate, neardup, packing, tables, tokens
from hirespan.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
TEXTS = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["one two three four", "", None]})


class Taken:
    """In place of a DataFrame: keeps the function it is handed."""

    sparkSession = type("Session", (), {"conf": type("Conf", (), {"set": staticmethod(lambda *a: None)})})

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def select(self, *columns):
        return self

    selectExpr = select  # noqa: N815


@pytest.fixture(autouse=True)
def task(monkeypatch):
    number = type("Task", (), {"get": staticmethod(lambda: type("Of", (), {"partitionId": staticmethod(lambda: 0)}))})
    monkeypatch.setattr(packing, "TaskContext", number)


def ran(frame, batch):
    return pa.Table.from_batches(list(frame.run(iter([batch])))).to_pylist()


@pytest.mark.parametrize("operator", [decontaminate.coded, lambda docs: neardup.described(docs, 2)])
def test_no_tokenizer_stays_beside_other_operators(operator):
    ran(packing.packed(Taken(), PATH), TEXTS)
    assert tokens.encoder.cache_info().currsize
    assert [r["doc_id"] for r in ran(operator(Taken()), TEXTS)] == [1, 2, 3]
    assert not tokens.encoder.cache_info().currsize


@pytest.mark.parametrize(
    "operator", [decontaminate.coded, lambda docs: neardup.described(docs, 2), lambda docs: packing.packed(docs, PATH)]
)
def test_memory_is_given_back_at_the_end_of_a_task(operator, monkeypatch):
    given = []
    monkeypatch.setattr(tables, "give_back", lambda: given.append(1))
    assert ran(operator(Taken()), TEXTS)
    assert given == [1]


def test_search_sends_no_rows_for_codes_outside_the_benchmark(monkeypatch):
    basis = np.random.default_rng(3).standard_normal((8, decontaminate.DIRECTIONS)).astype(np.float32)
    monkeypatch.setattr(decontaminate, "directions", lambda codes, weight, place: basis[: place.max() + 1])
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    items = decontaminate.items_of([{"item_id": 7, "text": " ".join(words)}])
    weight = np.ones(decontaminate.CODES, np.float32)
    frame = decontaminate.search(Taken(), items, weight)
    assert len(cloudpickle.dumps(frame.run)) < 8 << 20
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [f"x y {' '.join(words)} z", "x y z u v w"]})
    codes = list(decontaminate.coded(Taken()).run(iter([texts])))[0]
    assert ran(frame, codes) == [{"doc_id": 1, "item_id": 7}]


def test_memory_goes_back_to_the_system():
    tables.give_back()  # also where nothing is held
    assert list(tables.frugal(iter)([1, 2])) == [1, 2]


def test_packing_keeps_no_ids_of_blocks_that_are_out():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [f"word{k} other " * 500 for k in range(200)]})
    frame = packing.packed(Taken(), PATH)
    list(frame.run(iter([TEXTS])))  # loads the tokenizer
    tracemalloc.start()
    try:
        held = sum(sum(map(len, part.column("ids").to_pylist())) for part in frame.run(iter([batch])))
        gc.collect()
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held > 1 << 20
    assert kept < held / 4
