"""What the operators share: shared storage for cut lineage, word splitting and hashing over Arrow arrays."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts are worked on in slices of about so many bytes, so a worker's memory doesn't follow the batch size.
SLICE_BYTES = 4 << 20

#: A table to be broadcast has at most so many rows, and its texts at most so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

#: `ranked` ranks about so many different rows in a task, in 2 ** 6 parts at least, and makes so many equal rows from their count at a time.
PART_ROWS = 250_000
LEAST_BITS = 6
CHUNK = 100_000

_OWN: dict[str, str] = {}

#: What was `stored` within the innermost `scratch` that is open.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)

#: Has Spark remove the shuffle files of a query once it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster, whose machines don't share one, an error."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            root = f"file://{tempfile.mkdtemp(prefix='veritab-')}"
        _OWN[app] = f"{root.rstrip('/')}/veritab-{app}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        return


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. Shuffle files that were made for it go at once, as nothing reads
    them again; else they stay until the driver happens to collect its garbage. Those below a cached table stay, since its lost blocks would be made from them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLES_GO, None)
    try:
        if "InMemoryRelation" not in df._jdf.queryExecution().withCachedData().toString():
            spark.conf.set(SHUFFLES_GO, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._veritab_folder = path
    if (made := _MADE.get()) is not None:
        made.append(back)
    return back


def discard(*used: DataFrame) -> None:
    """Deletes what `stored` wrote for these tables. Only for those that no table still to be computed reads."""
    for df in used:
        _remove(df.sparkSession, df._veritab_folder)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is `stored` within is deleted at the end, but for the tables given to the function that it gives. So no table made within may be read later, unless it is kept and all
    that it reads was `stored` before or is kept too."""
    made, kept, outer = [], [], _MADE.get()
    token = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _MADE.reset(token)
        discard(*[df for df in made if not any(df is x for x in kept)])
        if outer is not None:
            outer.extend(kept)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows and bytes (see `BROADCAST_ROWS`); beyond, a join with it shuffles. ``df`` should be cheap to read: it is measured first."""
    sizes = [F.octet_length(c) if t == "string" else F.octet_length(F.concat_ws(" ", c)) for c, t in df.dtypes if t in ("string", "array<string>")]
    size = sum(map(F.coalesce, sizes, [F.lit(0)] * len(sizes)), F.lit(0))
    n, total = df.select(size.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.col("size").cast("long"))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def ranked(rows: DataFrame, by: str, draw: str) -> DataFrame:
    """``rows`` with ``__rank``, which counts those of each value of ``by`` (not null) from 0 without gaps, in the order of ``draw`` and then of all columns.

    ``draw`` is a whole number from 0, below 2**32, which different rows have by a hash: parts of its range are ranked by tasks of their own, however many rows share a
    value of ``by``. Equal rows are counted before they are shuffled, and made again from their count, in chunks; so a row that a third of the table equals is no hot key.
    """
    counted = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), "ranked")
    different, most = counted.agg(F.count("*"), F.max("__n")).first()
    bits = max(LEAST_BITS, math.ceil(math.log2(max(different, 1) / PART_ROWS)))
    own = counted.withColumn("__part", F.shiftright(F.col(draw).cast("long"), 32 - bits))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(by, "__part").agg(F.sum("__n").alias("__size"))
    starts = sizes.select(by, "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__part").orderBy(draw, *[c for c in rows.columns if c not in (by, draw)]).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, [by, "__part"])
    placed = placed.select(*rows.columns, "__n", (F.col("__start") + F.col("__before")).alias("__first"))

    def made(df: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
        return df.select(*rows.columns, "__first", each.alias("__i")).select(*rows.columns, (F.col("__first") + F.col("__i")).alias("__rank"))

    if not most or most <= CHUNK:
        return made(placed)
    many = placed.where(F.col("__n") > CHUNK).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK)))).repartition("__first", "__chunk")
    at = F.col("__chunk") * CHUNK
    cut = many.withColumn("__first", F.col("__first") + at).withColumn("__n", F.least(F.lit(CHUNK).cast("long"), F.col("__n") - at)).drop("__chunk")
    return made(placed.where(F.col("__n") <= CHUNK)).union(made(cut))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text; rows that agree in both get the same results and may share a key."""
    return F.concat_ws(
        ":",
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
        F.hex(F.xxhash64(F.col(text_col))),
        F.coalesce(F.length(text_col), F.lit(-1)).cast("string"),
    )


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns what the C library's heap holds free to the system, where it can; workers live on between tasks."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches that hold about ``max_bytes`` of ``column`` each, one row at least. Arrow's memory comes from the system, so what is freed goes back."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
            give_back()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words begin (one offset more than texts). Null: no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not there.all():
        flat = flat.filter(pa.array(there))
        offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
    return flat, offsets


_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _Q
    x = x ^ (x >> np.uint64(29))
    x = x * _P
    return x ^ (x >> np.uint64(32))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; words must not be empty or null."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    starts, lengths = at[:-1] - at[0], np.diff(at)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(lengths.max()), _P))
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        return mixed(np.add.reduceat(_BYTES[data] * power[place], starts) + lengths.astype(np.uint64) * _Q)


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words, by doubling; it knows nothing of where texts end."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, width = None, 0, word_hashes, 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                piece = run[done : done + n]
                out = piece.copy() if out is None else out * _power(width) + piece
                done += width
            if width * 2 > k:
                return mixed(out)
            run = run[:-width] * _power(width) + run[width:]
            width *= 2


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_P), k, 2**64))


def full_windows(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts, in the row of all words, of the windows of ``k`` words that lie within one text."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie within ``width`` places from any start."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return np.cumsum(marks[:-1]) > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
