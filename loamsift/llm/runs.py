"""Tables kept as sorted runs of files, and range search in them.

A table has a whole-number column ``k``. Each append writes a run: files below the table's folder, sorted by ``k``, each with a range of its own. The
run's manifest, with the range of each file, is written last, so that a run is there as a whole or not at all, and a table can be opened again in
another session. A search brings the ranges asked for to the files that hold them, and only there; a task opens a file, reads only the row groups that its ranges touch,
and finds them by binary search. So the cost is that of what is asked for, not of what is stored, and nothing that is stored is shuffled. Runs are merged as in a
log-structured tree: the newest ones as long as together they are as large as the one before.

Files are opened with ``pyarrow.fs`` by the folder's URI (local and shared folders, hdfs, s3, gs and the like).
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a file on average at most, and the least for which another core is used.
FILE_ROWS, TASK_ROWS = 4_000_000, 500_000
ROW_GROUP_BYTES = 1 << 20
#: Rows, and about how many bytes, that a search puts out at once.
STEP, STEP_BYTES = 100_000, 32 << 20
_MANIFEST = "_manifest.json"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    if re.match(r"^file:/", uri):
        uri = re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class SortedTable:
    """Runs of rows (k long, and other columns) below a folder. ``schema`` names all columns, ``k`` first."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema)
        self._load()

    def _load(self) -> None:
        """Reads the manifests; runs without one, and those that another one has taken in, are not there."""
        fs, root = filesystem(self.path)
        there = {}
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.type == pafs.FileType.Directory and re.fullmatch(r"run-\d+", info.base_name):
                name = f"{info.path}/{_MANIFEST}"
                if fs.get_file_info(name).type == pafs.FileType.File:
                    with fs.open_input_stream(name) as f:
                        there[int(info.base_name[4:])] = json.loads(f.read())
        gone = {r for m in there.values() for r in m["replaces"]}
        self.manifests = {k: m for k, m in sorted(there.items()) if k not in gone}
        self.next = max(there, default=-1) + 1

    @property
    def runs(self) -> list[int]:
        return list(self.manifests)

    @property
    def rows(self) -> int:
        return sum(m["rows"] for m in self.manifests.values())

    def parts(self, rows: int) -> int:
        """How many files so many rows make."""
        return max(1, -(-rows // FILE_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))

    def append(self, df: DataFrame, replaces: list[int] | None = None, in_place: bool = False) -> None:
        """Writes the rows as a run. With ``in_place`` each partition of ``df`` is sorted by ``k`` and has a range of its own already."""
        k = self.next
        folder = f"{self.path}/run-{k}"
        (df if in_place else df.sortWithinPartitions("k")).select(*self.schema.names).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(folder)
        fs, root = filesystem(folder)
        names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".parquet"))

        def bounds(name: str) -> tuple[str, int, int, int]:
            m = pq.ParquetFile(fs.open_input_file(f"{root}/{name}")).metadata
            stats = [m.row_group(g).column(0).statistics for g in range(m.num_row_groups) if m.row_group(g).num_rows]
            return name, min((s.min for s in stats), default=0), max((s.max for s in stats), default=-1), m.num_rows

        with ThreadPoolExecutor(16) as pool:
            files = sorted((b for b in pool.map(bounds, names) if b[3]), key=lambda b: (b[1], b[2]))
        manifest = {"replaces": replaces or [], "rows": sum(b[3] for b in files), "files": [b[:3] for b in files]}
        with fs.open_output_stream(f"{root}/{_MANIFEST}") as f:
            f.write(json.dumps(manifest).encode())
        self._load()

    def ranged(self, df: DataFrame, rows: int, *ties: str) -> DataFrame:
        """The rows in as many ranges of (k, ties) as they make files; equal ``k`` of a hot group may go to several. ``df`` is read twice, so it should be a table."""
        n = self.parts(rows)
        return df.coalesce(1) if n == 1 else df.repartitionByRange(n, "k", *ties)

    def read(self, runs: list[int] | None = None) -> DataFrame:
        use = self.runs if runs is None else runs
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/run-{r}" for r in use)) if use else self.spark.createDataFrame([], self.schema)

    def stale(self) -> list[int]:
        """The newest runs that are to be merged: as long as together they have as many rows as the one before."""
        rows = [m["rows"] for m in self.manifests.values()]
        at = len(rows) - 1
        while at > 0 and sum(rows[at:]) >= rows[at - 1]:
            at -= 1
        return self.runs[at:] if at < len(rows) - 1 else []

    def merge(self, runs: list[int], unique: list[str], *ties: str) -> None:
        """Makes one run of several; of rows alike in ``unique`` one stays. The old files stay for readers that hold them, until ``vacuum``."""
        rows = sum(self.manifests[r]["rows"] for r in runs)
        old = self.read(runs)
        if unique:
            old = old.dropDuplicates(unique)
        self.append(self.ranged(old, rows, *ties), replaces=runs)

    def vacuum(self) -> None:
        """Deletes the files of runs that are no longer used."""
        fs, root = filesystem(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.type == pafs.FileType.Directory and re.fullmatch(r"run-\d+", info.base_name) and int(info.base_name[4:]) not in self.manifests:
                fs.delete_dir(info.path)

    def lookup(self, asked: DataFrame, columns: list[str]) -> DataFrame:
        """Each row (lo, hi, ...) of ``asked`` with each stored row of lo <= k <= hi: the other columns of ``asked`` and ``columns`` of the table."""
        files = [(f"{self.path}/run-{r}/{name}", lo, hi, i) for i, (r, m) in enumerate(self.manifests.items()) for name, lo, hi in m["files"]]
        carried = [f for f in asked.schema.fields if f.name not in ("lo", "hi")]
        out = T.StructType([*carried, *(self.schema[c] for c in columns)])
        if not files:
            return self.spark.createDataFrame([], out)
        per_run = [[j for j, f in enumerate(files) if f[3] == i] for i in range(len(self.manifests))]
        bounds = [(js[0], np.array([files[j][1] for j in js]), np.maximum.accumulate(np.array([files[j][2] for j in js]))) for js in per_run if js]
        split = max(1, -(-self.spark.sparkContext.defaultParallelism // len(files)))
        # Halved, so that a range over all whole numbers fits.
        widths = np.array([(f[2] // 2 - f[1] // 2) // split + 1 for f in files], dtype=np.int64)
        lows = np.array([f[1] // 2 for f in files], dtype=np.int64)
        sent = T.StructType([T.StructField("file__", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), *carried])
        names = [f.name for f in carried]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lo, hi = b.column(0).to_numpy(), b.column(1).to_numpy()
                at, row = [], []
                for base, low, high in bounds:
                    first, last = np.searchsorted(high, lo, "left"), np.searchsorted(low, hi, "right")
                    n = np.maximum(last - first, 0)
                    i = np.repeat(np.arange(len(lo)), n)
                    at.append(base + np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                    row.append(i)
                f, i = np.concatenate(at), np.concatenate(row)
                place = f * split + np.clip((lo[i] // 2 - lows[f]) // widths[f], 0, split - 1)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(place), *(b.column(c).take(take) for c in range(b.num_columns))], schema=to_arrow_schema(sent))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: OrderedDict[int, pq.ParquetFile] = OrderedDict()
            groups: OrderedDict[tuple[int, int], tuple[np.ndarray, pa.Table]] = OrderedDict()
            kind = to_arrow_schema(out)

            def group(f: int, g: int) -> tuple[np.ndarray, pa.Table]:
                if (f, g) not in groups:
                    t = opened[f].read_row_group(g, columns=list(dict.fromkeys(["k", *columns])))
                    groups[f, g] = (t.column("k").to_numpy(), t)
                    if len(groups) > 4:
                        groups.popitem(last=False)
                return groups[f, g]

            for b in batches:
                place, lo, hi = (b.column(c).to_numpy() for c in range(3))
                at = place // split
                for f in np.unique(at):
                    f = int(f)
                    if f not in opened:
                        fs, p = filesystem(files[f][0])
                        opened[f] = pq.ParquetFile(fs.open_input_file(p))
                        if len(opened) > 4:
                            opened.popitem(last=False)
                    mine = np.nonzero(at == f)[0]
                    low, high = lo[mine], hi[mine]
                    meta = opened[f].metadata
                    for g in range(meta.num_row_groups):
                        s = meta.row_group(g).column(0).statistics
                        touch = np.nonzero((low <= s.max) & (high >= s.min))[0]
                        if not len(touch):
                            continue
                        k, table = group(f, g)
                        i, j = np.searchsorted(k, low[touch], "left"), np.searchsorted(k, high[touch], "right")
                        n = np.maximum(j - i, 0)
                        ends = np.cumsum(n)
                        wide = table.nbytes / max(1, table.num_rows) + b.nbytes / b.num_rows
                        step = max(1, min(STEP, int(STEP_BYTES / max(1.0, wide))))
                        for x in range(0, int(ends[-1]), step):
                            z = np.arange(x, min(x + step, int(ends[-1])))
                            r = np.searchsorted(ends, z, "right")
                            rows, hits = pa.array(mine[touch[r]]), pa.array(i[r] + z - (ends[r] - n[r]))
                            arrays = [b.column(3 + c).take(rows) for c in range(len(names))]
                            arrays += [table.column(c).take(hits).combine_chunks() for c in columns]
                            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
                            yield pa.RecordBatch.from_arrays([a.cast(t.type) for a, t in zip(arrays, kind)], schema=kind)

        tasks = min(len(files) * split, max(len(files), self.spark.sparkContext.defaultParallelism), 4096)
        ranges = asked.select("lo", "hi", *names).mapInArrow(send, sent)
        return ranges.repartitionById(tasks, F.pmod(F.col("file__"), F.lit(tasks)).cast("int")).sortWithinPartitions("file__", "lo").mapInArrow(search, out)
