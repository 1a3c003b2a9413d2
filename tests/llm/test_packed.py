"""Packed entries come back as they were."""

import numpy as np
import pyarrow as pa
import pytest

from relscope.llm import _packed as P


@pytest.mark.parametrize("n", [0, 1, 3, 50, 100_000])
@pytest.mark.parametrize("wide", [False, True])
def test_packed_entries_round_trip(n, wide):
    rng = np.random.default_rng(n)
    doc = rng.integers(-(2**63), 2**63 - 1, n) if wide else np.sort(rng.integers(0, 1000, n))
    key, hashes = rng.integers(0, 9, n), rng.integers(0, 2**63, n).astype(np.uint64)
    extra, more = rng.integers(0, 2000, n).astype(np.int32), rng.integers(0, 2**63, n).astype(np.uint64)
    table = pa.Table.from_batches(P.pack(key, doc, hashes, extra, 0, more=more), P.ARROW)
    order = np.argsort(key, kind="stable")
    for got, put in zip((*P.unpack(table), P.more(table)), (doc, hashes, extra, more), strict=True):
        assert (got == put[order]).all()


def test_held_entries_make_few_rows_and_come_back(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [(rng.integers(0, 50, n), np.sort(rng.integers(0, 99, n)), rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 99, n)) for n in (0, 300, 1, 0, 500, *[100] * 30)]
    for most in (10**6, 700):  # held to the end, and packed several times
        monkeypatch.setattr(P, "MOST", most)
        held, rows = P.Held(50, 0), []
        for x in parts:
            rows += held.add(*x)
        rows += held.rest()
        table = pa.Table.from_batches(rows, P.ARROW)
        n = np.array([len(P.unpack(table.slice(i, 1))[0]) for i in range(table.num_rows)])
        got = zip(np.repeat(np.asarray(table["key"]), n).tolist(), *(c.tolist() for c in P.unpack(table)), strict=True)
        assert sorted(got) == sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts, strict=True)), strict=True))
        assert table.num_rows <= 50 * (1 if most > 700 else 6) and held.rest() == []


def test_a_map_task_of_substring_dedup_sends_a_row_for_each_bucket_not_for_each_chunk():
    from relscope.llm.substring_dedup import _anchor_map

    texts = [[" ".join(f"c{c}d{d}w{i}" for i in range(200)) for d in range(5)] for c in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(5 * c, 5 * c + 5)), pa.array(t)], names=["doc_id", "text"]) for c, t in enumerate(texts)]
    rows = pa.Table.from_batches(list(_anchor_map(13, 7, 64, 65)(iter(batches))), P.ARROW)
    assert rows.num_rows == 64 and len(P.unpack(rows, 4)[0]) == 200 * (200 - 6)  # before: 40 times 64 rows
