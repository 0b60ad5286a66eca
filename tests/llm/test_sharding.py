import heapq
import random
import zlib
from collections import Counter

import pytest

from platewright.llm.sharding import longest_first, shard_by_size


def heap_schedule(classes, n_shards):
    """Each item by itself, largest first, to the least-loaded shard."""
    heap, out = [(0, shard) for shard in range(n_shards)], []
    for size, count in sorted(classes, reverse=True):
        given = [0] * n_shards
        for _ in range(count):
            load, shard = heapq.heappop(heap)
            given[shard] += 1
            heapq.heappush(heap, (load + size, shard))
        out.append((size, given))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_classes_are_dealt_like_single_items(seed):
    rng = random.Random(seed)
    n_shards = rng.choice([1, 2, 5, 8])
    classes = [(size, rng.choice([1, 2, 7, 40, 300])) for size in {rng.randint(1, rng.choice([5, 50, 5000])) for _ in range(30)}]
    classes += [(100_000, 1)] if seed % 2 else []  # a hot group
    assert longest_first(classes, n_shards) == heap_schedule(classes, n_shards)


@pytest.mark.parametrize("cell_rows", [3, 100_000])
def test_every_group_goes_where_the_schedule_says(spark, cell_rows):
    texts = [f"{i:06d}" + "x" * (i % 5) for i in range(400)] + ["y" * 5000]
    out = shard_by_size(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell_rows=cell_rows, broadcast_classes=0 if cell_rows == 3 else 10).collect()
    want = dict(longest_first(Counter(len(t) + 1 for t in texts).items(), 8))
    got = {size: [0] * 8 for size in want}
    for r in out:
        got[r["size"]][r["shard"]] += 1
    assert got == want
    assert {r["shard"] for r in out if r["size"] == 5001} == {0}


def test_groups_slots_and_edge_cases(spark):
    texts = [None, "", "a", "é" * 50, "hot"] + [f"text {i} " * (i % 7 + 1) for i in range(300)] + ["hot"] * 200
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "hot", "x"), (7, "hot", "x")]
    out = shard_by_size(spark.createDataFrame(rows, "doc_id long, text string, size string"), n_shards=4).collect()
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        text = texts[r["doc_id"]] if r["size"] != 4 else "hot"
        assert r["size"] == len((text or "").encode()) + 1
        assert r["text_crc32"] == zlib.crc32((text or "").encode())
        by_text.setdefault(text or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    loads = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) < 0.05 * sum(loads)


def test_empty_table(spark):
    assert shard_by_size(spark.createDataFrame([], "doc_id long, text string")).count() == 0
