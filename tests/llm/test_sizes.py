"""What operators hold in a task."""

import tracemalloc

import numpy as np
import pandas as pd

from counterpoise.llm import induced_sort, suffix_dedup


def _peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_of_suffix_dedup_stay_small():
    rng = np.random.default_rng(51)
    text = rng.integers(97, 123, 6000).astype(np.uint8)
    n = suffix_dedup.SHARD_BYTES // 801
    starts = rng.integers(0, 5200, n)
    shard = pd.DataFrame({"key": np.arange(n), "one": 0, "two": 0, "many": False, "bytes": [text[a : a + 800].tobytes() for a in starts]})
    found = []
    assert _peak(lambda: found.extend(suffix_dedup.repeated_starts(400)(iter([shard])))) < 130
    assert sum(len(f) for f in found) >= n
    long = rng.integers(97, 123, suffix_dedup.CHUNK + 399).astype(np.uint8)
    assert _peak(lambda: suffix_dedup.segments(long, 400, 200)) < 60
    # shards of twice the usual size still take the external way
    assert induced_sort.IN_MEMORY <= suffix_dedup.SHARD_BYTES
