"""Staging in the cluster's shared folder, and vectorised word hashing for Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster set it; a local temporary folder only where it is unset and
    driver and executors are one process, as in tests. Elsewhere executors would each write to a folder of
    their own and the driver would read an empty table, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="markfuse-"))
    return f"file://{_own[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    import shutil

    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the shared folder is then the cluster's to clear
            pass
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_clean)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, so a lost
    executor costs no more than the running stage. Removed by unstage(), at the end of the surrounding
    scratch(), or when the driver process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/markfuse-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    inside = _scope.get()
    if inside is not None:
        inside.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it waits for the driver's garbage
    collector, which an idle driver may not run for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(path: str) -> None:
    for item in [x for x in _written if x[1] == path]:
        _delete(*item)
        _written.remove(item)


def remove(*staged: DataFrame) -> None:
    """Remove what stage() wrote once nothing reads it any more."""
    for df in staged:
        _remove(df._staged_at)


def unstage(df: DataFrame) -> None:
    """remove(), and the shuffle files that led to it: worth it for large tables."""
    remove(df)
    free(df.sparkSession)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside go at its end, but for those handed to the function it gives: the operators'
    results, which are staged themselves so that nothing reads the others any more."""
    mine: list[str] = []
    outer = _scope.get()
    token = _scope.set(mine)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    try:
        yield keep
    finally:
        _scope.reset(token)
        for path in mine:
            if path not in kept:
                _remove(path)
            elif outer is not None:
                outer.append(path)
        free(spark)


BUCKET = 1 << 15  # bits of a bitmap


def _marked(rows: DataFrame, keys: DataFrame, column: str, bits: int, how: str) -> DataFrame:
    """rows plus __maybe: whether `column` may be among keys' single column."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = keys.select(place(F.col(keys.columns[0])).alias("__p"))
    maps = marks.groupBy(F.expr(f"__p div {BUCKET}").alias("__b")).agg(F.bitmap_construct_agg(F.expr(f"__p % {BUCKET}")).alias("__bits"))
    at = rows.withColumn("__p", place(F.col(column)))
    met = at.join(F.broadcast(maps), F.expr(f"__p div {BUCKET}") == F.col("__b"), how)
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast((__p % {BUCKET}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__p % 8 as int))")) != 0
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(hit, F.lit(False)).alias("__maybe"))


def sieve(rows: DataFrame, keys: DataFrame, column: str, bits: int = 1 << 26) -> DataFrame:
    """Rows whose `column` may be among keys' single column, and all whose is: a Bloom filter of one hash
    whose size is fixed (bits / 8 bytes, broadcast), to spare a shuffle most rows that will not match.
    However many the keys, it loses none; with very many it merely lets more through."""
    return _marked(rows, keys, column, bits, "inner").where("__maybe").drop("__maybe")


def without(rows: DataFrame, keys: DataFrame, column: str, bits: int = 1 << 26) -> DataFrame:
    """Rows whose `column` is not among keys' single column, which holds distinct values. Rows that the
    filter of sieve() clears pass where they lie; only the rest are shuffled to meet the keys. (An outer
    join, because the optimiser would push an anti join below the filter and shuffle all rows.)"""
    marked = _marked(rows, keys, column, bits, "left")
    rest = marked.where("__maybe").drop("__maybe")
    gone = keys.select(F.col(keys.columns[0]).alias("__gone"), F.lit(True).alias("__is_gone"))
    met = rest.join(gone, F.col(f"`{column}`").eqNullSafe(F.col("__gone")), "left").where("__is_gone IS NULL").drop("__gone", "__is_gone")
    return marked.where("NOT __maybe").drop("__maybe").unionByName(met)


def attach(rows: DataFrame, facts: DataFrame, column: str, bits: int = 1 << 26) -> DataFrame:
    """rows plus the other columns of facts (staged; one row for each value of `column`), null where there
    is none. Rows that the filter of sieve() clears pass where they lie."""
    marked = _marked(rows, facts.select(column), column, bits, "left")
    new = [c for c in facts.columns if c != column]
    own = [F.col(f"`{c}`") for c in rows.columns]
    met = marked.where("__maybe").drop("__maybe").join(facts.withColumnRenamed(column, "__fact"), F.col(f"`{column}`") == F.col("__fact"), "left")
    empty = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in new]
    return marked.where("NOT __maybe").select(*own, *empty).unionByName(met.select(*own, *new))


# ---------------------------------------------------------------- word hashing, vectorised

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser: a permutation of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows that hold
    about `limit` bytes, or one longer text. Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of the rows, and the rows' offsets in the word list.
    A word is a run of bytes other than 0x20 and 0x09-0x0D; rows never share a word."""
    n = len(data)
    inside = ~WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x 2: the halves of each word's 128-bit BLAKE2b digest. Distinct words are told apart byte by
    byte and digested once for these rows."""
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    flat = data[~WHITE[data]]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    known = column.dictionary_encode()
    digest = b"".join([blake2b(w, digest_size=16).digest() for w in known.dictionary.to_pylist()])
    return np.frombuffer(digest, np.uint64).reshape(-1, 2)[known.indices.to_numpy()]


_LEFT, _TURN = np.uint64(0xD6E8FEB86659FD93), np.uint64(23)


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Hash of what a[i] and b[i + gap] stand for, side by side."""
    n = min(len(a), len(b) - gap)
    y = b[gap : gap + n]
    return mix(a[:n] * _LEFT + ((y << _TURN) | (y >> (np.uint64(64) - _TURN))))


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every `size` consecutive word hashes, by doubling: a window's hash is mixed from those of its
    two halves, so unlike a polynomial it has no structure that some arrangement of words cancels. Rows'
    borders are the caller's affair."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, have, block, width, rest = None, 0, mix(h, salt), 1, size
    while True:
        if rest & 1:
            out = block if out is None else _joined(out, block, have)
            have += width
        rest >>= 1
        if not rest:
            return mix(out[: len(h) - size + 1], size)
        block = _joined(block, block, width)
        width *= 2
