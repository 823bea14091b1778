"""Shared pieces of the training-data operators: session settings, checkpoints,
and a vectorised word splitter over Arrow string buffers.

Conventions of every operator here: a null text is the empty text; input columns
other than those an operator needs are ignored, whatever their names; an empty
table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Texts may be long, so it is small.
ARROW_ROWS = 1000
#: And bytes, where the session can bound them.
ARROW_BYTES = 8 << 20
#: Bytes of text that numpy works on at once; a longer document is a chunk by itself.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and a checkpoint folder where the session has none: beside the warehouse,
    or on one machine a temporary one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return spark


def checkpoint(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; with `files`, after a shuffle into so many
    partitions, where many tasks make little."""
    tune(df.sparkSession)
    return (df.repartition(files) if files else df).checkpoint()


#: Narrow rows in one partition of a frame that is checkpointed again and again.
NARROW_ROWS = 250_000


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A frame of about so many narrow rows in as few partitions as hold them well, so that small
    frames don't become many files."""
    return df.coalesce(max(1, -(-rows // NARROW_ROWS)))


def keep(df: DataFrame) -> DataFrame:
    """Hold narrow rows on the executors' disks until `unpersist`. The lineage stays, so what a lost
    executor held is made again; no files are left in the shared folder."""
    tune(df.sparkSession)
    return df.persist(StorageLevel.DISK_ONLY)


#: Bytes of files up to which a table that lies in fewer files than there are cores is dealt anew.
SPREAD_BYTES = 1 << 30


@functools.cache
def one_thread() -> None:
    """Products of matrices on one thread in this process: tasks fill the cores already, and threads
    that wait for each other's small shares use twice the CPU time. Without effect on other libraries
    than the one that numpy brings."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; a small one in few files is dealt to all cores."""
    rows = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < SPREAD_BYTES and len(rows.inputFiles()) < cores else rows


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; a null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key is hot if it holds more than one in so many of the rows; so there are at most so many hot keys.
HOT_SHARE = 1000
#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def hot_keys(counted: DataFrame, key: str, total: int) -> list:
    """The hot ones among the keys of `counted` (key, count), of `total` rows: at most `HOT_SHARE`."""
    return [r[0] for r in counted.filter(F.col("count") * HOT_SHARE > total).select(key).collect()] if total > HOT_SHARE else []


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """`many` joined (inner or left) with `one`, which has each key once, where some keys may hold most
    rows of `many`: rows of hot keys are dealt to `SALTS` parts by a hash of the row, and their partners
    are copied to each. Without `hot` the keys are counted first, which evaluates `many` once more."""
    if hot is None:
        hot = hot_keys(many.groupBy(key).count(), key, many.count())
    if not hot:
        return many.join(one, key, how)
    is_hot, salt = F.coalesce(F.col(key).isin(*hot), F.lit(False)), fresh(many, "salt")
    left = many.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = one.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt], how).drop(salt)


def text_bytes(spark_df: DataFrame) -> int:
    """Bytes of all texts: what shard counts are derived from."""
    return int(spark_df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows with at most `size` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `data` on, as one little-endian number; zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()


#: Bytes that `span_hash` takes one after another; longer spans are hashed by pieces.
_PIECE = 1024


def span_hash(at: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), wherever they lie; `at` comes from `loads`.
    Eight bytes at a time are mixed in by steps that are not linear, so that texts with a regular
    structure collide no more than others."""
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    salt = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64)
    out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(salt))
    long = np.flatnonzero(size > _PIECE)
    if len(long):
        pieces = -(-size[long] // _PIECE)
        first = np.repeat(start[long], pieces) + _PIECE * ragged(np.zeros(len(long), np.int64), pieces)
        last = np.minimum(first + _PIECE, np.repeat(start[long] + size[long], pieces))
        inner = span_hash(at, first, last, seed)
        ends = 8 * np.cumsum(pieces)
        out[long] = mix(span_hash(loads(inner.view(np.uint8)), ends - 8 * pieces, ends, seed) ^ out[long])
        rest = np.flatnonzero(size <= _PIECE)
    else:
        rest = np.arange(len(size))
    place, left = start[rest], size[rest]
    own = out[rest]
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        n = left[open_]
        word = at[place[open_]]
        short = n < 8
        word[short] &= (U64(1) << (n[short] * 8).astype(U64)) - U64(1)
        own[open_] = mix((own[open_] ^ word) * U64(salt)) + U64(0xA0761D6478BD642F)
        left[open_] -= 8
        place[open_] += 8
        open_ = open_[n > 8]
    out[rest] = mix(own)
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes from `a` and from `b` hold the same bytes."""
    if not len(size):
        return np.zeros(0, bool)
    differ = data[ragged(a, size)] != data[ragged(b, size)]
    total = np.concatenate([[0], np.cumsum(differ)])
    ends = np.cumsum(size)
    return total[ends] == total[ends - size]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row: starts, ends, and rows' offsets among the runs."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside & edge[:-1]
    begin[1:] |= inside[1:] & ~inside[:-1]
    stop = inside & edge[1:]
    stop[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, rows' offsets among the words."""
    return spans(~SPACE[data], offsets)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two-choice hash table over distinct hashes: an index for each slot, -1 if empty."""
    out, mask = np.full(1 << bits, -1, np.int32), (1 << bits) - 1
    left = []
    for i, h in enumerate(hashes.tolist()):
        a, b = h & mask, (h >> 32) & mask
        if out[a] < 0:
            out[a] = i
        elif out[b] < 0:
            out[b] = i
        else:
            left.append(i)
    if left:
        return slots(hashes, bits + 1)
    return out


def lookup(found: np.ndarray, hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h among `hashes` by the table of `slots`, or -1."""
    if not len(hashes):
        return np.full(len(h), -1, np.int32)
    mask = U64(len(found) - 1)
    a = found[(h & mask).astype(np.int64)]
    hit = (a >= 0) & (hashes[a] == h)
    b = found[((h >> U64(32)) & mask).astype(np.int64)]
    hit_b = (b >= 0) & (hashes[b] == h)
    return np.where(hit, a, np.where(hit_b, b, -1)).astype(np.int32)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return out + np.repeat(starts - first, lengths)
