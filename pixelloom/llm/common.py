"""Pieces shared by the training-data operators: reading, Arrow plumbing, staging, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of words: space and the controls from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir where the cluster names one.

    Only a single-machine session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.applicationId not in _scratch:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        _scratch[sc.applicationId] = f"{base.rstrip('/')}/pixelloom-{uuid.uuid4().hex}"
        atexit.register(purge, spark)
    return _scratch[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that any executor can read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def counted_stage(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stage(), and how many rows were written, counted on the way."""
    seen = Observation()
    return stage(df.observe(seen, F.count("*").alias("n")), name), seen.get["n"]


#: Keys that more than 1 / HEAVY of all rows have are heavy; there are fewer than HEAVY of them.
HEAVY = 1024


def heavy_join(rows: DataFrame, groups: DataFrame, on: str, k: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """Inner join of rows with groups (a row for each key; column k: how many of the `total` rows have it), without a task that gets all rows of a key.

    Heavy keys are a list of bounded length, so their rows meet it by broadcast; all others go by a shuffle."""
    many = F.col(k) * heavy > total
    new = [c for c in groups.columns if c not in (on, k)]
    met = rows.join(F.broadcast(groups.filter(many).drop(k).withColumn("met", F.lit(True))), on, "left")
    rest = met.filter("met is null").drop("met", *new).join(groups.filter(~many).drop(k), on)
    return met.filter("met").drop("met").unionByName(rest)


def dealt(files: DataFrame, many: int, per: int = 8) -> DataFrame:
    """A list of `many` files (uri) over tasks: one for each while they are few, then up to `per` for one task."""
    tasks = max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-many // per))
    return files.repartition(max(1, min(many, tasks)), "uri")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a staged path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, once nothing that is still to run reads it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def purge(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results must be written before."""
    try:
        root = _scratch.pop(spark.sparkContext.applicationId, None)
        if root:
            discard(spark, root)
    except Exception:  # the session may be gone at interpreter exit
        pass


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have ended. It does so once the driver's collector has seen that they are gone, which with little work on the driver may be never."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives a process's freed memory back to the system: allocators keep what a large table took, on the driver and in workers that wait for their next task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def others(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that an operator keeps: all but those its own outputs replace (names match in any case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def ref(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Arrow batches sent to Python workers hold about so many bytes, as rows of text are long and workers share an executor's memory.
ARROW_BYTES = 6 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches, unless the session has set its own. Spark reads it when a plan runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def append_arrow(df: DataFrame, inputs: list, outputs: list[tuple[str, T.DataType]], fn, rows: int = 512) -> DataFrame:
    """Adds columns that fn computes batch by batch in Python workers over Arrow.

    inputs: Column expressions; fn: list of Arrow arrays -> list of Arrow arrays, called for `rows` rows at a time, which
    bounds what a worker holds. A column of df with the name
    of an output is replaced; all others are kept as they are, whatever they are called."""
    small_batches(df.sparkSession)
    keep = others(df, [n for n, _ in outputs])
    n = len(keep)
    src = df.select(*[ref(c).alias(f"k{i}") for i, c in enumerate(keep)], *[e.alias(f"i{i}") for i, e in enumerate(inputs)])
    fields = [T.StructField(f"k{i}", df.schema[c].dataType, True) for i, c in enumerate(keep)]
    fields += [T.StructField(f"o{i}", t, True) for i, (_, t) in enumerate(outputs)]
    names = [f.name for f in fields]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                got = fn([b.column(i) for i in range(n, b.num_columns)])
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *got], names)
        release()

    out = src.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"o{i}").alias(c) for i, (c, _) in enumerate(outputs)])


# ---- words as numbers -------------------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9DDFEA08EB382D69)
_INV = np.uint64(pow(0x9DDFEA08EB382D69, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes all words of a block of UTF-8 bytes at once.

    A word's hash is its polynomial value over the bytes, from differences of one running sum, with its
    length mixed in. Sums run over blocks of bounded size, so memory does not follow the text's length."""

    def __init__(self, lower: bool = False, most: int = 1 << 19):
        self.lower, self.most = lower, most
        self._p, self._q = _powers(_BASE, 1024), _powers(_INV, 1024)

    def _grown(self, n: int) -> None:
        if len(self._p) < n:
            m = max(n, 2 * len(self._p))
            self._p, self._q = _powers(_BASE, m), _powers(_INV, m)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: uint8. Gives the words' hashes, starts and ends (byte offsets)."""
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate([[0], edge])
        if len(data) and not space[-1]:
            edge = np.concatenate([edge, [len(data)]])
        starts, ends = edge[0::2], edge[1::2]
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + self.most, side="right"))
            j = max(j, i + 1)
            a, b = int(starts[i]), int(ends[j - 1])
            self._grown(b - a + 1)
            x = data[a:b].astype(np.uint64)
            if self.lower:
                x[(x >= 65) & (x <= 90)] += np.uint64(32)
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum((x + np.uint64(1)) * self._p[: b - a], out=run[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix64((run[e] - run[s]) * self._q[s] + (e - s).astype(np.uint64) * _MUL)
            i = j
        return out, starts, ends


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words; order counts. One multiply and add per word of the run, then a finaliser."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64((seed * 0x632BE59BD9B4E019 + k) % (1 << 64)), np.uint64)
    for i in range(k):
        acc = (acc ^ words[i : i + n]) * _MUL
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the rows' offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
