import math
import random

import pytest
from pyspark.sql import functions as F

from loamsift.llm import packing


def check(rows, sizes, caps):
    """Every document whole, in full once; no container above its capacity. Returns the containers used by capacity."""
    used = {}
    for k, cap in caps.items():
        mine = [r for r in rows if r.capacity_id == k]
        box = {}
        for r in mine:
            box[r.container] = box.get(r.container, 0) + r.tokens
        assert all(t <= cap for t in box.values())
        for d, s in sizes.items():
            parts = [r for r in mine if r.doc_id == d]
            assert sum(p.tokens for p in parts) == s
            assert len(parts) == math.ceil(s / cap) == parts[0].pieces
            assert sorted(p.piece for p in parts) == list(range(1, len(parts) + 1))
        used[k] = len(box)
    return used


def test_containers_hold_everything_and_are_nearly_as_few_as_can_be(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 150)
    rng = random.Random(1)
    sizes = {i: rng.choice([rng.randint(1, 300), rng.randint(200, 900), 1000, 2500]) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, size int")
    caps = {1: 1000, 2: 3000}
    c = spark.createDataFrame(list(caps.items()), "capacity_id int, capacity_tokens int")
    used = check(packing.pack(df, "doc_id", F.col("size"), c).collect(), sizes, caps)
    for k, cap in caps.items():
        # Best-fit decreasing over all items at once, which no single task could do at scale.
        rest = [s % cap if s > cap else s for s in sizes.values() if s <= cap or s % cap]
        order = sorted(range(len(rest)), key=lambda i: -rest[i])
        whole = sum(s // cap for s in sizes.values() if s > cap)
        assert used[k] <= 1.01 * (whole + len(packing.packed(order, rest, cap).bins)) + 1


def test_breeding_never_loses_an_item_nor_a_container():
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 70, 300).tolist()
    first = packing.packed(list(range(300)), sizes, 100)
    best = packing.breed(sizes, 100, [packing._assignment(first, 300)], rng, 30)
    for p in best:
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert p.fills.max() <= 100
    assert len(best[0].bins) <= len(first.bins)


@pytest.mark.parametrize("island_count", [1, 3])
def test_islands(spark, island_count):
    rows = [(1, 10, 0, i, s, None) for i, s in enumerate([6, 4, 5, 5, 7, 3])]
    df = spark.createDataFrame(rows, "capacity_id int, capacity int, shard int, item long, size int, start int")
    got = packing.pack_items(df, 1, islands=island_count).collect()
    assert len({r.bin for r in got}) == 3 and all(r.fill == 10 for r in got)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c"), (None, 5, "d"), (3, 0, "e"), (4, 20, "f")], "doc_id long, size int, container string").withColumn("pieces", F.lit(9))
    caps = spark.createDataFrame([(1, 10), (2, None), (3, 0), (None, 5)], "capacity_id int, capacity_tokens int")
    check(packing.pack(df, "doc_id", F.col("size"), caps).collect(), {1: 5, 4: 20}, {1: 10})
    assert packing.pack(df.limit(0), "doc_id", F.col("size"), caps).count() == 0
    assert packing.pack(df, "doc_id", F.col("size"), caps.limit(0)).count() == 0


def test_counts_are_enough_for_best_fit_decreasing():
    from collections import Counter

    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 60 if seed % 2 else 9) for _ in range(rng.randint(0, 200))]
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        assert packing.best_fit_decreasing(Counter(sizes), 60) == len(packing.packed(order, sizes, 60).bins)
    assert packing.best_fit_decreasing({130: 2, 10: 1}, 60) == 5


def test_any_number_of_capacities(spark, monkeypatch):
    monkeypatch.setattr(packing, "CAPACITY_PACK", 2)
    sizes = {i: 1 + i * 7 % 30 for i in range(40)}
    caps = {k: 20 + 5 * k for k in range(5)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, size int")
    check(packing.pack(df, "doc_id", F.col("size"), spark.createDataFrame(list(caps.items()), "capacity_id int, capacity_tokens int")).collect(), sizes, caps)


def test_containers_are_filled_by_subsets():
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = rng.integers(5, 60, 400).tolist()
    bins = packing.filled(list(range(400)), sizes, 100, rng)
    assert sorted(i for b in bins for i in b) == list(range(400)) and max(sum(sizes[i] for i in b) for b in bins) <= 100
    order = sorted(range(400), key=lambda i: -sizes[i])
    assert len(bins) <= len(packing.packed(order, sizes, 100).bins)
