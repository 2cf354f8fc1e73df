"""Substring dedup by level-wise doubling.

A word goes if it lies in a window of `window` words whose sequence also starts in a document with a
smaller id. Windows are judged on the input. Lengths double towards `window` (50: 13, 25, 50), and only
what repeats across documents at one length is looked at with the next:

1. Length a quarter. Each full window is represented by its sub-window of least hash, so a repeated
   window has the same representative wherever it occurs, and neighbours share one: about two hashes
   for every 38 words are grouped, not one for each word.
2. Length a half. Only windows whose representative repeats go on; they are represented again, by
   their half-length sub-window of least hash.
3. Full length. Only windows whose half-length representative repeats are compared as such, by 128
   bits: that representative, from one half of the words' 128-bit digests, and the window's own hash,
   from the other half. The least id of each is the occurrence that stays.

Groupings combine on the map side, so a passage in a third of all documents costs a row for each task.
Their results are written before anything joins them, so both sides of those joins are plain tables:
rows that cannot match are left out by a filter of fixed size before the shuffle, and adaptive execution
splits what a frequent key makes large. Windows are rows, not lists, until a single text's own are put
together. A row is known by its id and a hash of its text, so rows without an id do not fall into one
group; rows equal in both are judged alike.

Defined cases: null text has no words; texts shorter than the window lose nothing; repetition within
one document removes nothing; a null id counts as larger than all others, and rows with equal ids never
remove each other's words; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.session import ship

from .common import attach, chunks, scratch, sieve, stage, unstage, window_hashes, word_digests, words

def lengths(window: int) -> list[int]:
    """The lengths of the levels, each at most twice the one before."""
    out = [window]
    while len(out) < 3:
        out.insert(0, -(-out[0] // 2))
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Texts:
    """Word hashes of some rows, and which words start a full window."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.rows = words(data, off)
        both = word_digests(data, self.starts, self.ends)
        self.h, self.h2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        n = np.diff(self.rows)
        self.row = np.repeat(np.arange(len(n)), n)
        self.full = np.zeros(len(self.h), bool)
        if len(self.h):
            self.full = self.rows[1:][self.row] - np.arange(len(self.h)) >= window

    def representative(self, size: int, salt: int) -> np.ndarray:
        """For each word that starts a full window, the least hash of its sub-windows of `size`."""
        sub = window_hashes(self.h, size, salt)
        out = np.zeros(len(self.h), np.uint64)
        if len(self.h) >= self.window:
            out[: len(self.h) - self.window + 1] = _least(sub, self.window - size + 1)
        return out


def _first(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mask of the values that differ from the one before in the same row."""
    out = np.ones(len(keys), bool)
    out[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return out


def _level1(window: int, size: int):
    """row, text -> representative, row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, off in chunks(batch.column(1)):
                t = Texts(data, off, window)
                at = np.flatnonzero(t.full)
                if not len(at):
                    continue
                r, row = t.representative(size, 1)[at], t.row[at]
                new = _first(r, row)
                yield pa.RecordBatch.from_arrays([pa.array(r[new].view(np.int64)), batch.column(0).take(pa.array(a + row[new]))], ["h", "row"])

    return run


def _level2(window: int, quarter: int, half: int):
    """row, text, good -> representative, row, number of the first word, hashes of the windows from there on
    that share the representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(2)
            for a, b, data, off in chunks(batch.column(1)):
                t = Texts(data, off, window)
                at = np.flatnonzero(t.full)
                if not len(at):
                    continue
                at = at[_member(t, at, t.representative(quarter, 1), good, a, b)]
                if not len(at):
                    continue
                r, row = t.representative(half, 2)[at], t.row[at]
                whole = window_hashes(t.h2, window, 3)[at].view(np.int64)
                new = _first(r, row)
                new[1:] |= at[1:] != at[:-1] + 1
                new = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(r)).astype(np.int32)), pa.array(whole))
                first = at[new] - t.rows[row[new]]
                yield pa.RecordBatch.from_arrays([pa.array(r[new].view(np.int64)), batch.column(0).take(pa.array(a + row[new])), pa.array(first.astype(np.int64)), lists], ["h", "row", "first", "w"])

    return run


def _member(t: Texts, at: np.ndarray, keys: np.ndarray, good: pa.Array, a: int, b: int) -> np.ndarray:
    """Mask over `at`: the key there is in the row's own list of good keys."""
    out = np.zeros(len(at), bool)
    row = t.row[at]
    cut = np.searchsorted(row, np.arange(b - a + 1))
    for i in range(b - a):
        lo, hi = cut[i], cut[i + 1]
        if lo < hi and good[a + i].is_valid:
            own = good[a + i].values.to_numpy().view(np.uint64)
            out[lo:hi] = np.isin(keys[at[lo:hi]], own)
    return out


def _final(window: int, text_out: bool):
    """id, text, numbers of the words that start a window to remove -> the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(2)
            n_words, n_removed, sha, kept_text = [], [], [], []
            for a, b, data, off in chunks(batch.column(1)):
                starts, ends, rows = words(data, off)
                drop = np.zeros(len(starts) + 1, np.int64)
                for i in range(a, b):
                    if gone[i].is_valid:
                        bad = np.unique(gone[i].values.to_numpy()) + rows[i - a]
                        drop[bad] += 1
                        drop[bad + window] -= 1
                covered = np.cumsum(drop)[:-1] > 0
                raw = data.tobytes()
                for i in range(b - a):
                    lo, hi = rows[i], rows[i + 1]
                    c = covered[lo:hi]
                    if c.any():
                        keep = np.flatnonzero(~c) + lo
                        text = b" ".join(raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
                    else:
                        text = b" ".join(raw[off[i] : off[i + 1]].split())
                    n_words.append(hi - lo)
                    n_removed.append(int(c.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if text_out:
                        kept_text.append(text.decode("utf-8", "replace"))
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if text_out:
                out, names = [*out, pa.array(kept_text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def across(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and lo, the least id, of the keys that rows (with a struct `row` of id and k) of different ids
    share; a null id is larger than all others."""
    ids = F.col("row.id")
    found = rows.groupBy(*keys).agg(F.min(ids).alias("lo"), F.max(ids).alias("hi"), F.bool_or(ids.isNull()).alias("some_null"))
    return found.where((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & F.col("some_null"))).select(*keys, "lo")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if
    asked for, kept_text. Ids must be integers."""
    ship(docs.sparkSession)
    if window < 2:
        raise ValueError("a window has two words at least")
    quarter, half, _ = lengths(window)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.struct(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("k")).alias("row"), text.alias("text"))
    row = "row struct<id:bigint,k:bigint>"

    with scratch(docs.sparkSession) as keep:
        one = stage(slim.mapInArrow(_level1(window, quarter), f"h bigint, {row}"), "level1")
        again = stage(across(one, "h").select("h"), "again1")
        # a text's own representatives: as many as its words at most
        good = stage(sieve(one, again, "h").join(again, "h", "left_semi").groupBy("row").agg(F.collect_set("h").alias("good")), "good")
        unstage(one)
        looks = sieve(slim, good.select("row"), "row").join(good, "row").select("row", "text", "good")
        two = stage(looks.mapInArrow(_level2(window, quarter, half), f"h bigint, {row}, first bigint, w array<bigint>"), "level2")
        again = stage(across(two, "h").select("h"), "again2")
        three = stage(sieve(two, again, "h").join(again, "h", "left_semi"), "level3")
        unstage(two)
        every = three.select("h", "row", "first", F.posexplode("w").alias("step", "w")).select("h", "w", "row", (F.col("first") + F.col("step")).alias("at"))
        stay = stage(across(every, "h", "w"), "stay")
        later = F.col("row.id").isNull() | (F.col("lo") < F.col("row.id"))
        bad = every.join(stay, ["h", "w"]).where(later).groupBy("row").agg(F.collect_set("at").alias("gone"))
        gone = stage(bad, "gone")
        unstage(three)
        # whole texts of the result are not worth a second copy: only what this reads stays
        keep(gone)
    kinds = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return attach(slim, gone, "row").select("row.id", "text", "gone").mapInArrow(_final(window, with_text), kinds)
