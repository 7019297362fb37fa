"""Filling fixed-capacity containers, by a grouping genetic algorithm on islands.

Documents are dealt to shards of bounded size by a hash of their key. For each shard and capacity several islands, tasks
of their own, breed packings: crossover injects whole well-filled containers of one parent into the other, takes out the other's containers that hold the
same items, and packs the items displaced by that again: the largest first, each with the one, two or three items that together with it leave the least room (best fit is the case of one). Weak containers are opened at random, too. After every epoch the best packing of an island migrates to its neighbour. The containers
that aren't full are then opened and packed in other groups the same way, starting from what they hold, so that the number of
containers never grows; and what each group couldn't fill, once more. Only keys and sizes move; texts never do.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHARD_ITEMS = 2000
ISLANDS = 2
EPOCHS = 2
#: An island's epoch ends after so many children, or after so many in a row that didn't better its best packing.
CHILDREN, PATIENCE = 40, 5
POPULATION = 4
#: Containers filled less than this are opened again: in the second pass all that have room left, in the third what each group of it couldn't fill.
REOPEN = (1.0, 1.0, 0.97)
#: Capacities that one pass over the sizes packs for.
CAPACITY_PACK = 200
#: First items that are tried for a triple.
TRIES = 8


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], room: list[tuple[int, int]]) -> None:
    """Puts each item, in the order given, into the container with the least room that takes it; ``room`` is sorted (room, container)."""
    for i in items:
        s = sizes[i]
        k = bisect_left(room, (s, -1))
        if k < len(room):
            r, b = room.pop(k)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r - s > 0:
            insort(room, (r - s, b))


def fitness(fills: np.ndarray, capacity: int) -> float:
    """The mean square of the fill, which prefers few containers, and among as many, well-filled ones."""
    return float(np.mean((fills / capacity) ** 2)) if len(fills) else 1.0


class Packing:
    """One individual: its containers with the items in them."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins = [b for b in bins if b]
        self.fills = np.array([sum(sizes[i] for i in b) for b in self.bins], dtype=np.int64)
        self.fitness = fitness(self.fills, capacity)

    def rank(self) -> tuple[int, float]:
        return (len(self.bins), -self.fitness)


def packed(order: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = []
    best_fit(order, sizes, capacity, bins, [])
    return Packing(bins, sizes, capacity)


def filled(items: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Containers one after another: the largest item left, and with it the one, two or three others that leave the least room; some at random."""
    order = sorted(items, key=lambda i: (sizes[i], i))
    s = np.array([sizes[i] for i in order], dtype=np.int64)
    ids = np.array(order, dtype=np.int64)
    bins: list[list[int]] = []
    while len(s):
        room = capacity - int(s[-1])
        take = [len(s) - 1]
        while room and len(s) > len(take):
            free = s if len(take) == 1 else np.delete(s, take)
            back = np.arange(len(s)) if len(take) == 1 else np.delete(np.arange(len(s)), take)
            if len(take) == 1:
                free, back = free[:-1], back[:-1]
            top = int(np.searchsorted(free, room, "right"))
            if not top:
                break
            one = int(free[top - 1])
            best, chosen = one, [top - 1]
            if best < room and top > 1:
                j = np.searchsorted(free, room - free[:top], "right") - 1
                j = np.where(j >= np.arange(top), np.minimum(j, np.arange(top) - 1), j)
                two = np.where(j >= 0, free[:top] + free[np.maximum(j, 0)], 0)
                k = int(two.argmax())
                if two[k] > best:
                    best, chosen = int(two[k]), [k, int(j[k])]
                if best < room and top > 2:
                    for k in rng.integers(0, top, TRIES).tolist():
                        left = room - int(free[k])
                        m = int(np.searchsorted(free, left, "right"))
                        i = np.arange(min(m, k))
                        if not len(i):
                            continue
                        j = np.minimum(np.searchsorted(free, left - free[i], "right") - 1, i - 1)
                        three = np.where(j >= 0, free[i] + free[np.maximum(j, 0)], 0)
                        x = int(three.argmax())
                        if three[x] and int(three[x]) + int(free[k]) > best:
                            best, chosen = int(three[x]) + int(free[k]), [k, x, int(j[x])]
                            if best == room:
                                break
            take += [int(back[c]) for c in chosen]
            room -= best
        bins.append(ids[take].tolist())
        keep = np.ones(len(s), dtype=bool)
        keep[take] = False
        s, ids = s[keep], ids[keep]
    return bins


def crossover(taker: Packing, giver: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled containers of ``giver`` go into ``taker``; the items they displace, and those of some weak containers, are packed again."""
    order = np.argsort(-giver.fills, kind="stable")
    top = order[: max(1, len(order) // 2)]
    chosen = top[rng.random(len(top)) < rng.uniform(0.1, 0.5)]
    if not len(chosen):
        chosen = top[:1]
    injected = [giver.bins[k] for k in chosen]
    inside = {i for b in injected for i in b}
    bins: list[list[int]] = [list(b) for b in injected]
    loose: list[int] = []
    for b in taker.bins:
        if inside.isdisjoint(b):
            bins.append(list(b))
        else:
            loose += [i for i in b if i not in inside]
    fills = np.array([sum(sizes[i] for i in b) for b in bins])
    # The weakest containers are opened, and as many of all that aren't full.
    weak = set(np.argsort(fills, kind="stable")[: max(1, len(bins) // 20)].tolist())
    short = np.nonzero(fills < capacity)[0]
    weak.update(rng.choice(short, min(len(short), max(2, len(bins) // 20)), replace=False).tolist() if len(short) else [])
    for k in weak:
        loose += bins[k]
    kept = [b for k, b in enumerate(bins) if k not in weak]
    return Packing(kept + filled(loose, sizes, capacity, rng), sizes, capacity)


def breed(sizes: list[int], capacity: int, seeds: list[list[int]], rng: np.random.Generator, children: int = CHILDREN) -> list[Packing]:
    """An epoch of one island: from the packings given (container of each item) to a bred population, the best first."""
    n = len(sizes)
    population = []
    for assigned in seeds:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(assigned):
            bins.setdefault(b, []).append(i)
        population.append(Packing(list(bins.values()), sizes, capacity))
    falling = sorted(range(n), key=lambda i: (-sizes[i], i))
    if len(population) < POPULATION:
        population.append(packed(falling, sizes, capacity))
    bound = -(-sum(sizes) // capacity)
    while len(population) < POPULATION and min(len(p.bins) for p in population) > bound:
        population.append(Packing(filled(falling, sizes, capacity, rng), sizes, capacity))
    population.sort(key=Packing.rank)
    idle = 0
    for _ in range(children):
        if len(population[0].bins) <= bound or len(population) < 2 or idle >= PATIENCE:
            break
        before = population[0].rank()
        a, b = rng.choice(len(population), 2, replace=False)
        child = crossover(population[min(a, b)], population[max(a, b)], sizes, capacity, rng)
        population.append(child)
        population.sort(key=Packing.rank)
        population.pop()
        idle = 0 if population[0].rank() < before else idle + 1
    return population


def _assignment(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(p.bins):
        for i in b:
            out[i] = k
    return out


_STATE = "capacity_id int, capacity int, shard int, island int, {items}, sizes array<int>, genomes array<array<int>>, used int, fit double"


def _evolve(state: DataFrame, items: str, epoch: int) -> DataFrame:
    """Breeds each island's row once."""
    names = ["capacity_id", "capacity", "shard", "island", "items", "sizes", "genomes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.slice(r, 1)
                cap_id, cap, shard, island = (b.column(c)[0].as_py() for c in range(4))
                sizes = b.column(5).flatten().to_pylist()
                rng = np.random.default_rng([cap, shard, island, epoch])
                best = breed(sizes, cap, b.column(6)[0].as_py(), rng)
                keep = [_assignment(p, len(sizes)) for p in best[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in range(6)), pa.array([keep], type=pa.list_(pa.list_(pa.int32()))), pa.array([len(best[0].bins)], type=pa.int32()), pa.array([best[0].fitness])],
                    names=[*names, "used", "fit"],
                )

    return state.select(*names).mapInArrow(run, _STATE.format(items=items))


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island gets the best packing of the one before it in the ring."""
    guest = state.select("capacity_id", "shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genomes")[0].alias("guest"))
    return state.join(guest, ["capacity_id", "shard", "island"]).withColumn("genomes", F.concat("genomes", F.array("guest"))).drop("guest")


def pack_items(items: DataFrame, shards: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(capacity_id, capacity, shard, bin, item, size, fill) of items (capacity_id, capacity, shard, item, size, start).

    ``start`` is a container that the item comes from, or NULL in all items of a shard.
    """
    kind = f"items array<{items.schema['item'].dataType.simpleString()}>"
    rows = items.groupBy("capacity_id", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("item", "size", "start"))).alias("r"))
    seeds = F.when(F.exists("r.start", lambda s: s.isNotNull()), F.array(F.col("r.start"))).otherwise(F.array().cast("array<array<int>>"))
    state = rows.select("capacity_id", "capacity", "shard", F.lit(0).alias("island"), F.col("r.item").alias("items"), F.col("r.size").alias("sizes"), seeds.alias("genomes"))
    first = written(_evolve(state.repartition(max(1, shards), "capacity_id", "shard"), kind, 0), "epoch-0")
    # A shard that is at its bound needs no islands.
    bound = F.ceil(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x) / F.col("capacity"))
    state = first.where(F.col("used") > bound).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.repartition(max(1, shards * islands), "capacity_id", "shard", "island")
    for epoch in range(1, epochs + 1):
        state = written(_evolve(state if epoch == 1 else _migrate(state, islands), kind, epoch), f"epoch-{epoch}")
    state = first.where(F.col("used") <= bound).unionByName(state)
    best = state.groupBy("capacity_id", "capacity", "shard").agg(F.min_by(F.struct("items", "sizes", F.col("genomes")[0].alias("bins")), F.struct("used", -F.col("fit"), "island")).alias("b"))
    each = best.select("capacity_id", "capacity", "shard", F.explode(F.arrays_zip(F.col("b.items").alias("item"), F.col("b.sizes").alias("size"), F.col("b.bins").alias("bin"))).alias("x")).select("capacity_id", "capacity", "shard", "x.bin", "x.item", "x.size")
    fill = each.groupBy("capacity_id", "shard", "bin").agg(F.sum("size").alias("fill"))
    return each.join(fill, ["capacity_id", "shard", "bin"])


def pack(df: DataFrame, key: str, size: F.Column, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container, key, piece, pieces, tokens): every document in containers of every capacity.

    ``capacities`` holds capacity_id and capacity_tokens; they are taken in packs of ``CAPACITY_PACK``. A document larger than the capacity is split into full containers of
    its own and a rest that is packed like a document; all others stay whole (pieces = 1). Documents with a NULL key or size are left out, of
    size 0 or less too; rows that repeat a key count once, with the largest size; NULL and non-positive capacities are left out; empty tables give
    an empty result; extra columns are ignored.
    """
    sized = written(sizes_of(df, key, size), "sizes")
    shards = max(1, -(-sized.count() // SHARD_ITEMS))
    caps: list[tuple[int, int]] = []
    done: list[DataFrame] = []
    for r in capacities.select("capacity_id", "capacity_tokens").distinct().where("capacity_id IS NOT NULL AND capacity_tokens > 0").toLocalIterator():
        caps.append((r[0], r[1]))
        if len(caps) == CAPACITY_PACK:
            done.append(_pack(sized, key, caps, shards))
            caps = []
    if caps or not done:
        done.append(_pack(sized, key, caps, shards))
    return reduce(DataFrame.unionByName, done)


def sizes_of(df: DataFrame, key: str, size: F.Column) -> DataFrame:
    """(item, size) of the documents that count."""
    return df.select(F.col(key).alias("item"), size.cast("int").alias("size")).where(F.col("item").isNotNull() & (F.col("size") > 0)).groupBy("item").agg(F.max("size").alias("size"))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> int:
    """How many containers best-fit-decreasing over all items takes; ``counts`` has how many items there are of each size. Of a size, a container takes as many as fit before the next one is looked at, so
    counts of containers by their room are enough: the cost is bounded by the capacity, not by the number of items."""
    rooms: dict[int, int] = {}
    used = 0
    for size, n in sorted(counts.items(), reverse=True):
        used += n * (size // capacity) if size > capacity else 0
    rest: dict[int, int] = {}
    for size, n in counts.items():
        s = size % capacity if size > capacity else size
        if s:
            rest[s] = rest.get(s, 0) + n
    for s, n in sorted(rest.items(), reverse=True):
        for room in sorted(r for r in rooms if r >= s):
            if not n:
                break
            each = room // s
            k = min(rooms[room], n // each)
            moves = [(k, each)] + ([(1, n - k * each)] if k < rooms[room] and n - k * each else [])
            for bins, items in moves:
                if bins and items:
                    rooms[room] -= bins
                    rooms[room - items * s] = rooms.get(room - items * s, 0) + bins
                    n -= bins * items
            if not rooms[room]:
                del rooms[room]
        if n:
            each = capacity // s
            full, left = divmod(n, each)
            used += full + (left > 0)
            for bins, items in ((full, each), (1 if left else 0, left)):
                if bins:
                    rooms[capacity - items * s] = rooms.get(capacity - items * s, 0) + bins
    return used


def _pack(sized: DataFrame, key: str, caps: list[tuple[int, int]], shards: int) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("capacity_id"), F.lit(c).cast("int").alias("capacity")) for k, c in caps))) if caps else F.explode(F.array().cast("array<struct<capacity_id:int,capacity:int>>"))
    rows = sized.withColumn("c", each).select("c.*", "item", "size").withColumn("whole", F.floor(F.col("size") / F.col("capacity")).cast("int")).withColumn("pieces", F.ceil(F.col("size") / F.col("capacity")).cast("int"))
    rest = F.when(F.col("size") <= F.col("capacity"), F.col("size")).otherwise(F.pmod("size", "capacity")).cast("int")
    loose = rows.withColumn("rest", rest).where("rest > 0").select("capacity_id", "capacity", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", F.col("rest").alias("size"), F.lit(None).cast("int").alias("start"))
    first = written(pack_items(loose, shards), "first")

    boxes: list[DataFrame] = []
    left = first
    for turn, share in enumerate(REOPEN):
        full = F.col("fill") >= F.col("capacity") * share
        again = left.where(~full)
        n = {r[0]: r[1] for r in again.groupBy("capacity_id").count().collect()}
        if not n:
            break
        boxes.append(left.where(full).select("capacity_id", F.concat_ws("-", F.lit(str(turn)), "shard", "bin").alias("container"), "item", "size"))
        groups = {k: max(1, -(-c // SHARD_ITEMS)) for k, c in n.items()}
        count = F.element_at(F.create_map(*(F.lit(x) for k, g in groups.items() for x in (k, g))), F.col("capacity_id"))
        # A container's number within its group: the containers of one shard after those of the other.
        start = ((F.col("shard") / count).cast("int") * F.lit(SHARD_ITEMS * 8) + F.col("bin")).cast("int")
        reopened = again.select("capacity_id", "capacity", F.pmod("shard", count).cast("int").alias("group"), "item", "size", start.alias("start")).withColumnRenamed("group", "shard")
        left = written(pack_items(reopened, sum(groups.values())), f"again-{turn}")
    boxes.append(left.select("capacity_id", F.concat_ws("-", F.lit(str(len(boxes))), "shard", "bin").alias("container"), "item", "size"))
    boxes = reduce(DataFrame.unionByName, boxes)
    placed = boxes.join(rows.select("capacity_id", "item", "pieces"), ["capacity_id", "item"])
    last = placed.select("capacity_id", "container", F.col("item").alias(key), F.col("pieces").alias("piece"), "pieces", F.col("size").alias("tokens"))
    whole = rows.where(F.col("size") > F.col("capacity")).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    own = whole.select("capacity_id", F.concat_ws("-", F.lit("c"), F.col("item").cast("string"), "piece").alias("container"), F.col("item").alias(key), "piece", "pieces", F.col("capacity").alias("tokens"))
    return last.unionByName(own)
