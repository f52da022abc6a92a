"""What several operators share: the shared work folder, row-safe column names and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomsieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomsieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Materialises as above, and deletes what an operator no longer needs once its own result is written."""

    def __init__(self) -> None:
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of these frames; without any, all."""
        for key in [id(f) for f in frames] or list(self._paths):
            out, path = self._paths.pop(key)
            _remove(out.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, by: str, most: dict | int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """Rows for the driver to learn from: of each value of ``by`` at most ``most``, in the order of the hashes of id and text,
    whose texts take ``max_bytes`` at most together. A text that would take more is passed over.

    Sizes come first, and then the texts that are wanted. Rows of one id and text count once; null texts don't count.
    """
    spark = rows.sparkSession
    keyed = rows.filter(F.col(text_col).isNotNull() & F.col(by).isNotNull()).withColumns({"__h": F.xxhash64(id_col), "__t": F.xxhash64(text_col)})
    ends = Window.partitionBy(by).orderBy("__h", "__t")
    limit = most if isinstance(most, int) else max(most.values())
    slim = keyed.select(by, "__h", "__t", F.octet_length(text_col).alias("size")).distinct().withColumn("rank", F.row_number().over(ends)).filter(F.col("rank") <= limit)
    taken: dict = {}
    kept = set()
    for value, h, t, size, _ in slim.orderBy(by, "rank").collect():  # ``most`` small rows a value
        n, used = taken.get(value, (0, 0))
        if n < (most if isinstance(most, int) else most.get(value, 0)) and used + size <= max_bytes:
            kept.add((value, h, t))
            taken[value] = (n + 1, used + size)
    if not kept:
        return []
    wanted = spark.createDataFrame(sorted(kept), f"{by} {rows.schema[by].dataType.simpleString()}, __h long, __t long")
    return keyed.join(F.broadcast(wanted), [by, "__h", "__t"]).dropDuplicates([by, "__h", "__t"]).orderBy("__h", "__t", by).drop("__h", "__t").collect()


def text_key(text: Column) -> Column:
    """128-bit identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from. A null id belongs to it as well."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


# --- words as numpy arrays -------------------------------------------------------------------------------------

#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; the runs don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    values = data[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= _powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each closed by a newline; and where each begins (one more at the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(0, np.uint8), offsets


def blocks(texts: list[str], limit: int = 1 << 21):
    """Slices of the list that hold about ``limit`` characters at most (or one longer text)."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def cut_long(texts: list[str], limit: int = 1 << 22, overlap: int = 0) -> tuple[list[str], np.ndarray]:
    """Texts above ``limit`` characters in parts, cut at white space where there is some; and which text each part is of.

    Each later part begins ``overlap`` characters before the cut (then moved to white space).
    """
    if all(len(t) <= limit for t in texts):
        return texts, np.arange(len(texts))
    parts, owner = [], []
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = at + limit
            if end < len(t):
                space = t.rfind(" ", at + limit // 2, end)
                end = space if space > 0 else end
            parts.append(t[at:end])
            owner.append(k)
            if end >= len(t):
                break
            back = t.rfind(" ", at + limit // 2, max(end - overlap, at + 1)) if overlap else end
            at = back if back > 0 else end
    return parts, np.array(owner)


#: What operators remember in a worker process, by operator: how to forget it.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def worker_serves(operator: str) -> None:
    """Called where an operator's task begins: a reused worker forgets what other operators remembered in it."""
    for other in [o for o in WORKER_CACHES if o != operator]:
        WORKER_CACHES.pop(other)()
        trim()


def trim() -> None:
    """Give memory that a worker no longer uses back to the system: reused workers stay, and idle ones would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


class Once:
    """A fixed-size model on the executors: the driver's broadcast, prepared once in each worker."""

    _ready: dict = {}

    def __init__(self, spark: SparkSession, model, prepare=lambda m: m):
        self.name, self.prepare = uuid.uuid4().hex, prepare
        self.sent = spark.sparkContext.broadcast(model)

    def get(self):
        worker_serves(self.name)
        if self.name not in Once._ready:
            Once._ready.clear()
            Once._ready[self.name] = self.prepare(self.sent.value)
            WORKER_CACHES[self.name] = Once._ready.clear
        return Once._ready[self.name]


def release(spark: SparkSession) -> None:
    """Let the driver notice handles that are gone: their shuffle files are deleted only when its JVM collects garbage.

    Twice, since the JVM's handles only become garbage after Python's are detached by the first round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root being the least node of its component.

    Every round each node takes the least root among its neighbours' and then that root's own root, so the number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    scratch = Scratch()
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("to"))
        roots = labels.select(F.col("node").alias("to"), F.col("root").alias("above"))
        best = F.least("to", F.coalesce("above", "to"))
        after = scratch(moved.join(roots, "to", "left").select("node", best.alias("root"), (best < F.col("root")).alias("changed")))
        scratch.drop(labels)
        labels = after
        if not after.filter("changed").limit(1).count():
            out = materialise(labels.select("node", "root"))
            scratch.drop()
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")
