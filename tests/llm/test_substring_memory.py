"""What the first pass of the removal of repeated passages holds at a time."""

import random
import tracemalloc

import pyarrow as pa

from hazeline.llm import substring_dedup


class Batches:
    """Runs what is mapped over Arrow batches in this process."""

    def mapInArrow(self, run, ddl):  # noqa: N802
        return run


def window_rows(texts):
    batch = pa.record_batch({"doc": pa.array(range(len(texts)), pa.int64()), "text": texts})
    return substring_dedup.window_rows(Batches(), [], 20)(iter([batch]))


def test_long_texts_are_not_looked_at_all_at_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", 1 << 16, raising=False)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=10_000)) for _ in range(20)]
    list(window_rows(texts[:1]))  # what is loaded once
    tracemalloc.start()
    n = sum(batch.num_rows for batch in window_rows(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 20 and peak < 8_000_000  # 200,000 windows in all


def test_runs_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", 10)
    batch = pa.record_batch({"doc": pa.array(range(6)), "text": ["a" * n for n in (4, 6, 1, 30, 0, 10)]})
    assert substring_dedup.runs(batch) == [(0, 2), (2, 3), (3, 4), (4, 6)]
