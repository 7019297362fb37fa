"""Deduplicating new batches against all history, by a prefix-tree hash forest that is kept in a folder.

A record is the set of its word shingles. Its signature is a row of MinHash values. Each tree of the forest is a permutation of the signature's
positions; a record's label in the tree is the first ``DEPTH`` of its values in that order, and the sorted table of all labels is the tree (a label's prefixes are the inner nodes). The first ``BASE`` positions of the trees are
disjoint, so the trees are independent of each other at that depth.

A new record is located in every tree by a range search: first with its whole label, then with ever shorter prefixes of it, until the recall target is reached. Widening stops
for each record by itself, as the similarity that a match must have at least depends on the record's number of sequences: small sets can't be just at the threshold. What is
found is verified on the full sets, which are looked up by their print in another sorted table. Accepting a batch adds runs to the tables; runs are merged as in a
log-structured tree (``runs.SortedTable``). The history's texts are never read again, and nothing of the history is shuffled for a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, minhashes, scratch_dir, written
from .neardup import classes, flat_sets, signatures, verified
from .runs import SortedTable, filesystem

TREES = 36
#: Values of a label, and the first of them that no two trees share.
DEPTH, BASE = 4, 3
VALUE_BITS = 14
RECALL = 0.9998
#: Sets from which the ranges of the files of labels are drawn.
SAMPLE = 2000


def permutations(trees: int = TREES) -> np.ndarray:
    """The first DEPTH positions of each tree's permutation of the signature of BASE * trees values."""
    rng = np.random.default_rng(11)
    base = np.arange(trees * BASE).reshape(trees, BASE)
    return np.array([[*row, *rng.choice(np.setdiff1d(np.arange(trees * BASE), row), DEPTH - BASE, replace=False)] for row in base])


def least_similarity(n: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest similarity of at least ``threshold`` that a set of n elements can have with any set."""
    out = np.full(len(n), threshold)
    for size in np.unique(n[n <= 64]).tolist():
        fits = [k / (size + m - k) for m in range(1, int(size / threshold) + 2) for k in range(1, min(size, m) + 1) if k / (size + m - k) >= threshold - 1e-12]
        out[n == size] = min(fits)
    return out


def recall_at(depth: np.ndarray, similarity: np.ndarray, trees: int) -> np.ndarray:
    """The probability that a pair of the similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def widened(n: np.ndarray, threshold: float, trees: int, recall: float) -> np.ndarray:
    """The depth at which each record's search ends: prefixes are shortened while its recall is below the target."""
    depth = np.full(len(n), DEPTH)
    similarity = least_similarity(n, threshold)
    while True:
        short = (recall_at(depth, similarity, trees) < recall) & (depth > 1)
        if not short.any():
            return depth
        depth[short] -= 1


def labels(cls: DataFrame, trees: int = TREES, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(part, k, cls, n): the label of each shingle set (cls, n, shingles) in each tree, the tree in its first bits; ``part`` counts the bounds (k, cls) up to it."""
    order = permutations(trees)
    shift = VALUE_BITS * np.arange(DEPTH - 1, -1, -1, dtype=np.int64)
    bk = np.array([b[0] for b in bounds or []], dtype=np.int64)
    bc = np.array([b[1] for b in bounds or []], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                m = minhashes(*flat_sets(b.column(2)), trees * BASE, seed=7).astype(np.int64) & ((1 << VALUE_BITS) - 1)
                k = (m[:, order] << shift).sum(axis=2) + (np.arange(trees, dtype=np.int64) << (VALUE_BITS * DEPTH))
                k, cls = k.reshape(-1), np.repeat(b.column(0).to_numpy(), trees)
                first, last = np.searchsorted(bk, k, "left"), np.searchsorted(bk, k, "right")
                part = first.copy()
                for hot in np.unique(k[last > first]).tolist():
                    i = np.nonzero(k == hot)[0]
                    part[i] = first[i] + np.searchsorted(bc[first[i[0]] : last[i[0]]], cls[i], "right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(k), pa.array(cls), pa.array(np.repeat(b.column(1).to_numpy(), trees))], names=["part", "k", "cls", "n"])

    return cls.select("cls", "n", "shingles").mapInArrow(run, "part int, k long, cls long, n int")


class Forest:
    """The accepted records, in a shared folder: ``labels`` (k: label, cls), ``sets`` (k: cls, n, shingles), ``members`` (k: cls, key) and ``keys`` (k: hash, key), the last with all keys that were ever seen."""

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "string", trees: int = TREES, threshold: float = 0.6, width: int = 3) -> None:
        self.spark, self.path = spark, (path or scratch_dir(spark)).rstrip("/")
        fs, root = filesystem(self.path)
        name = f"{root}/forest.json"
        if fs.get_file_info(name).is_file:
            with fs.open_input_stream(name) as f:
                s = json.loads(f.read())
            key, trees, threshold, width = s["key"], s["trees"], s["threshold"], s["width"]
        else:
            fs.create_dir(root)
            with fs.open_output_stream(name) as f:
                f.write(json.dumps({"key": key, "trees": trees, "threshold": threshold, "width": width}).encode())
        self.key, self.trees, self.threshold, self.width = key, trees, threshold, width
        self._tables()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Forest:
        """The forest kept in a folder, with the settings it was made with."""
        return cls(spark, path)

    def _tables(self) -> None:
        self.labels = SortedTable(self.spark, f"{self.path}/labels", "k long, cls long")
        self.sets = SortedTable(self.spark, f"{self.path}/sets", "k long, n int, shingles array<int>")
        self.members = SortedTable(self.spark, f"{self.path}/members", f"k long, key {self.key}")
        self.keys = SortedTable(self.spark, f"{self.path}/keys", f"k long, key {self.key}")

    def append(self, df: DataFrame, key: str, text: str) -> None:
        """Accepts all records of ``df`` as they are."""
        tables = Scratch(self.spark)
        sigs = tables.write(signatures(df, key, text, self.width), "signatures")
        every = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
        self._add_keys(tables.write(every, "keys"))
        self._add(sigs.select("cls", F.col(key).alias("key")), classes(sigs))
        tables.drop_all()

    def _add_keys(self, keys: DataFrame) -> None:
        self.keys.append(self.keys.ranged(keys.select(F.xxhash64("key").alias("k"), "key"), keys.count(), "key"))

    def _add(self, members: DataFrame, cls: DataFrame) -> None:
        """Adds (cls, key) and the sets (cls, n, shingles) behind them."""
        self.members.append(self.members.ranged(members.select(F.col("cls").alias("k"), "key"), members.count(), "key"))
        tables = Scratch(self.spark)
        sets = tables.write(cls.select(F.col("cls").alias("k"), "n", "shingles"), "sets")
        rows = sets.count()
        self.sets.append(self.sets.ranged(sets, rows))
        tables.drop_all()
        self._add_labels(self.sets, rows)

    def _add_labels(self, sets: SortedTable, rows: int) -> None:
        stored = sets.read(sets.runs[-1:]).select(F.col("k").alias("cls"), "n", "shingles")
        write_labels(self.labels, stored, rows, self.trees)

    def merge_runs(self, whole: bool = False) -> None:
        """Merges the newest runs of each table, or all of them; classes and keys that stand in several runs then stand once."""
        for table, unique, ties in ((self.labels, ["k", "cls"], ("cls",)), (self.sets, ["k"], ()), (self.members, ["k", "key"], ("key",)), (self.keys, ["k", "key"], ("key",))):
            runs = (table.runs if len(table.runs) > 1 else []) if whole else table.stale()
            if runs:
                table.merge(runs, unique, *ties)

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (key) that the forest has seen."""
        h = F.xxhash64("key")
        return self.keys.lookup(keys.select(h.alias("lo"), h.alias("hi"), F.col("key").alias("asked")), ["key"]).where("asked = key").select("key").distinct()

    def probe(self, asked: DataFrame, cls: DataFrame, recall: float = RECALL) -> DataFrame:
        """(a, b, similarity): classes ``a`` of the batch, with labels ``asked`` (k, cls, n) and sets ``cls``, and ``b`` of the forest that reach the threshold; equal classes included."""
        found = located(self.labels, asked, self.threshold, self.trees, recall).join(cls.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
        both = self.sets.lookup(found.select(F.col("b").alias("lo"), F.col("b").alias("hi"), "a", "b", "na", "sa"), ["n", "shingles"])
        t = self.threshold
        fit = (F.col("na") >= F.col("n") * t) & (F.col("n") >= F.col("na") * t)
        k = F.size(F.array_intersect("sa", "shingles"))
        alike = both.where(fit).withColumn("similarity", k / (F.col("n") + F.col("na") - k)).where(F.col("similarity") >= F.lit(t))
        return alike.select("a", "b", "similarity").distinct()


def write_labels(table: SortedTable, cls: DataFrame, rows: int, trees: int) -> None:
    """Adds the labels of the sets (cls, n, shingles) as a run, in ranges drawn from a sample of them; equal labels of a hot group are cut by class."""
    parts = table.parts(rows * trees)
    bounds: list[tuple[int, int]] = []
    if parts > 1:
        few = labels(cls.sample(min(1.0, SAMPLE / max(1, rows)), seed=3).limit(4 * SAMPLE), trees).select("k", "cls").collect()
        drawn = sorted((r[0], r[1]) for r in few)
        bounds = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    out = labels(cls, trees, bounds)
    ordered = out.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("k", "cls")
    table.append(ordered, in_place=True)


def located(table: SortedTable, asked: DataFrame, threshold: float, trees: int, recall: float) -> DataFrame:
    """(a, b), distinct: the classes whose labels share a prefix with a label of ``asked`` (k, cls, n), each prefix widened as far as its record needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            free = (np.int64(1) << (VALUE_BITS * (DEPTH - widened(n, threshold, trees, recall))).astype(np.int64)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(k & ~free), pa.array(k | free), b.column(1)], names=["lo", "hi", "a"])

    ranges = asked.select("k", "cls", "n").mapInArrow(run, "lo long, hi long, a long")
    return table.lookup(ranges, ["cls"]).select("a", F.col("cls").alias("b")).distinct()


def _settle(edges: list[tuple[int, int]]) -> dict[int, bool]:
    """The greedy choice among the nodes of edges (early, late), which have no cycle."""
    waits: dict[int, int] = {}
    after: dict[int, list[int]] = {}
    for early, late in edges:
        waits.setdefault(early, 0)
        waits[late] = waits.get(late, 0) + 1
        after.setdefault(early, []).append(late)
    accepted: dict[int, bool] = {}
    hit: set[int] = set()
    ready = [x for x, k in waits.items() if k == 0]
    while ready:
        x = ready.pop()
        accepted[x] = x not in hit
        for late in after.get(x, ()):
            if accepted[x]:
                hit.add(late)
            waits[late] -= 1
            if waits[late] == 0:
                ready.append(late)
    return accepted


def decide(nodes: DataFrame, edges: DataFrame, gather: int = 100_000) -> DataFrame:
    """(cls, accepted): the greedy choice in the order of ``ord``: a node is accepted if no accepted node before it is its neighbour.

    nodes: (cls, ord, lost), ``lost`` marks nodes that are out from the start; edges: (early, late) between nodes, early before late.
    Each round settles all nodes whose earlier neighbours are settled, so at least the first of those left, and drops the edges that tell nothing more;
    rounds go on until all is settled. They are the longest chain of undecided nodes, not their number, and each is written
    to the shared folder. Up to ``gather`` edges that are left are settled at once, so that a long chain doesn't cost a round for each of its nodes.
    """
    settled = F.col("accepted").isNotNull()
    state = written(nodes.select("cls", F.when(F.col("lost"), F.lit(0)).alias("accepted")), "state")
    live = edges
    while True:
        s = state.select(F.col("cls").alias("early"), F.col("accepted").alias("early_accepted"))
        seen = live.join(s, "early").groupBy(F.col("late").alias("cls")).agg(F.max(F.coalesce("early_accepted", F.lit(0))).alias("hit"), F.max(F.when(F.col("early_accepted").isNull(), 1).otherwise(0)).alias("open"))
        verdict = F.when(settled, F.col("accepted")).when(F.col("hit") == 1, 0).when(F.coalesce("open", F.lit(0)) == 0, 1)
        state = written(state.join(seen, "cls", "left").select("cls", verdict.cast("int").alias("accepted")), "state")
        if state.where(~settled).isEmpty():
            break
        # Edges to a settled node or from one that is out tell nothing more; an accepted node tells its late ones in the next round.
        undecided, out = state.where(~settled).select("cls"), state.where("accepted = 0").select("cls")
        live = written(live.join(undecided.toDF("late"), "late", "left_semi").join(out.toDF("early"), "early", "left_anti").select("early", "late"), "live")
        few = live.limit(gather + 1).collect() if gather else []
        if gather and len(few) <= gather:
            last = state.sparkSession.createDataFrame([(k, int(v)) for k, v in _settle([(r.early, r.late) for r in few]).items()], "cls long, last int")
            # A node left without an edge has no accepted neighbour before it.
            state = state.join(last, "cls", "left").select("cls", F.coalesce("accepted", "last", F.lit(1)).alias("accepted"))
            break
    return state.select("cls", (F.col("accepted") == 1).alias("accepted"))


def match_batch(forest: Forest, batch: DataFrame, key: str, text: str, order: str, recall: float = RECALL, append: bool = True) -> tuple[DataFrame, DataFrame]:
    """Decides the rows of a new batch, in the order of ``order``, against everything the forest has accepted and the rows accepted before, and adds what is accepted to the forest (but not without ``append``, for a forest that no other batch comes to).

    Returns the decisions (order, key, status: accepted, duplicate or skipped) and the matches (new, old, similarity, order) of
    each duplicate with every accepted record that reaches the threshold. A row whose key was seen before, in this batch or an earlier one, is
    skipped. Rows with NULL text or too few words resemble nothing and are accepted. Accepted records with one shingle set
    all stand in the matches, however many they are: a matching row costs a row for each. Rows with a NULL key or order are skipped; empty
    batches give empty results and leave the forest as it is; other columns are ignored.
    """
    spark = forest.spark
    tables = Scratch(spark)
    rows = batch.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text"))
    usable = rows.where(F.col("key").isNotNull() & F.col("ord").isNotNull())
    first = usable.groupBy("key").agg(F.min("ord").alias("ord"))
    first = tables.write(first.join(forest.known(first), "key", "left_anti"), "first")
    new = rows.join(first, ["key", "ord"]).dropDuplicates(["key"])
    sigs = tables.write(signatures(new.withColumnRenamed("ord", "ord__"), "key", "text", forest.width), "signatures")
    placed = tables.write(sigs.select("cls", "key").join(first, "key"), "placed")
    heads = placed.groupBy("cls").agg(F.min("ord").alias("ord"), F.min_by("key", "ord").alias("rep"))
    cls = tables.write(classes(sigs).join(heads, "cls"), "classes")
    size = cls.count()
    own = SortedTable(spark, f"{tables.path}/own", "k long, cls long, n int")
    write_labels(own, cls, size, forest.trees)
    asked = own.read()

    to_old = tables.write(forest.probe(asked, cls, recall), "to_old")
    within = located(own, asked, forest.threshold, forest.trees, recall).where("a < b")
    o = cls.select("cls", "ord")
    among = verified(within, cls, cls, forest.threshold).join(o.toDF("a", "oa"), "a").join(o.toDF("b", "ob"), "b")
    early = F.col("oa") < F.col("ob")
    among = tables.write(among.select(F.when(early, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("late"), "similarity"), "among")
    lost = to_old.select(F.col("a").alias("cls")).distinct().withColumn("lost", F.lit(True))
    nodes = o.join(lost, "cls", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    accepted = tables.write(decide(nodes, among.select("early", "late")).where("accepted").select("cls").join(cls.select("cls", "rep"), "cls"), "accepted")

    with_old = forest.members.lookup(to_old.select(F.col("b").alias("lo"), F.col("b").alias("hi"), "a", "similarity"), ["key"]).select("a", F.col("key").alias("old"), "similarity").distinct()
    with_new = among.join(accepted.select(F.col("cls").alias("early"), F.col("rep").alias("old")), "early").select(F.col("late").alias("a"), "old", "similarity")
    same = accepted.select(F.col("cls").alias("a"), F.col("rep").alias("old"), F.lit(1.0).alias("similarity"))
    each = placed.select(F.col("cls").alias("a"), F.col("key").alias("new"), F.col("ord").alias(order))
    out = f"{scratch_dir(spark)}"
    matches = with_old.unionByName(with_new).unionByName(same).join(each, "a").where("new <> old").select("new", "old", "similarity", order)
    matches.write.parquet(f"{out}/matches")
    kept = accepted.select(F.col("rep").alias("key"), F.lit("accepted").alias("status"))
    status = first.join(placed.select("key", "cls"), "key", "left").join(kept, "key", "left").select("key", "ord", F.when(F.col("cls").isNull(), "accepted").otherwise(F.coalesce("status", F.lit("duplicate"))).alias("status"))
    # Of rows with one key and order, as of one row that comes twice, one is decided.
    nth = F.row_number().over(Window.partitionBy("key", "ord").orderBy("key"))
    decided = usable.select("key", "ord").withColumn("nth", nth).join(status.withColumn("nth", F.lit(1)), ["key", "ord", "nth"], "left").select("key", "ord", F.coalesce("status", F.lit("skipped")).alias("status"))
    void = rows.where(F.col("key").isNull() | F.col("ord").isNull()).select("key", "ord", F.lit("skipped").alias("status"))
    decided.unionByName(void).select(F.col("ord").alias(order), F.col("key").alias(key), "status").write.parquet(f"{out}/decisions")

    if append and not first.isEmpty():
        forest._add_keys(first.select("key"))
    if append and not accepted.isEmpty():
        forest._add(accepted.select("cls", F.col("rep").alias("key")), cls.join(accepted.select("cls"), "cls"))
    if append:
        forest.merge_runs()
    tables.drop_all()
    return spark.read.parquet(f"{out}/decisions"), spark.read.parquet(f"{out}/matches")
