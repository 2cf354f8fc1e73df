"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Signatures: shingles (`size` words, A-Z lower-cased; fewer words make one shingle) are elements of
Z(2**32). One permutation scatters them; a second, shifted circularly by k, gives coordinate k of the
signature as its least value: two permutations stand for all bands x rows coordinates.

Documents with equal shingle sets (by size and 128 bits of the set) form a class, represented by its
smallest id, so copies cost one row and not pairs. In each band bucket the smallest representative is
the centre and every other one is paired with it: a bucket of m gives m - 1 pairs. Pairs whose
signatures do not put them clearly below the threshold are verified on the full sets. Buckets whose
members still lie in different components are then searched again, in blocks of bounded size: first the
members that have a possible partner of another component there are found from the signatures; then
only their full sets are fetched, and pairs that their distances to a pivot do not rule out are verified.
Only links leave a block, at most one for each pair of components in it. No pair of a bucket that
may matter to the components is skipped, and none within a component is looked at: the members of a
bucket's largest component are dealt against the others only.

A shingle is 64 bits, mixed non-linearly from 64 bits of the BLAKE2b digest of each of its words: two
different shingles of a pair of documents are taken for one with chance 2**-64, whatever their words.

With 30 bands of 6 rows a pair at similarity 0.85 shares no bucket with probability below 1e-6 (at
0.8: 2e-4); the estimate passes over a pair at the threshold with probability below 1e-4, and only if
nothing else connects its ends does that change a component.

Defined cases: null, empty and white texts have no shingles and no links; rows with a null id are kept
and get a null component; rows that repeat an id are one node; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.session import ship

from .common import LOWER, chunks, mix, scratch, sieve, stage, unstage, window_hashes, without, word_digests, words
from .graph import connected_components

BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # rows and shingles of a block, about


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows, one after the other, and the rows' offsets in them."""
    data = LOWER[data]
    starts, ends, rows = words(data, off)
    h = np.ascontiguousarray(word_digests(data, starts, ends)[:, 0])
    n = np.diff(rows)
    out: list[np.ndarray] = []
    grams = window_hashes(h, size)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, 1))
        else:
            out.append(h[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    assert len(n) == len(out)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of Z(2**32): odd multiplications and xor-shifts."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """rows x count least values; rows without shingles get 2**32 - 1 throughout."""
    n = len(off) - 1
    out = np.full((n, count), 2**32 - 1, np.uint32)
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return out
    step = 1 << 15
    scattered = _permute((sets >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    group: list[int] = []
    begin = 0
    for at, row in enumerate(full):  # runs of rows that fit a cache, or one longer row
        group.append(row)
        if off[row + 1] - off[full[begin]] >= step or at == len(full) - 1:
            lo, hi = off[group[0]], off[group[-1] + 1]
            part, cuts = scattered[lo:hi], (off[group] - lo).astype(np.int64)
            for k in range(count):
                out[group, k] = np.minimum.reduceat(_permute(part + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), 0x21F0AAAD, 0xD35A2D97), cuts)
            group, begin = [], at + 1
    return out


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in chunks(batch.column(1)):
                sets, cut = shingle_sets(data, off, size)
                sums = []
                for salt in (11, 12):
                    total = np.append(np.uint64(0), np.cumsum(mix(sets, salt)))
                    sums.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                sig = signatures(sets, cut, bands * rows)
                keys = np.zeros((b - a, bands), np.uint64)
                for i in range(bands):
                    key = np.full(b - a, i, np.uint64)
                    for k in range(i * rows, (i + 1) * rows):
                        key = mix(key ^ sig[:, k].astype(np.uint64), k)
                    keys[:, i] = key
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), flat)
                small = pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(cut)), *map(pa.array, sums), lists, small], ["id", "n", "s0", "s1", "bands", "sig"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1)):
                sets, cut = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "set"])

    return run


def _similar(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _likely(least: int):
    """Pairs whose signatures agree on `least` coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((a == b).sum(1) >= least))

    return run


def _partners(p: int, same: bool, right: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Rows of a block that row p may be linked with: of another component, by size and by signature."""
    q = right[right > p] if same else right
    q = q[(label[q] != label[p]) & (100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p]))]
    return q[(sig[q] == sig[p]).sum(1) >= least] if len(q) else q


def _block(table: pa.Table) -> tuple:
    i, label, n, half = (table.column(k).to_numpy() for k in ("rep", "label", "n", "half"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(i), -1)
    same = bool(table.column("same")[0].as_py())
    left, right = (np.arange(len(i)), np.arange(len(i))) if same else (np.flatnonzero(half == 0), np.flatnonzero(half == 1))
    return i, label, n, sig, same, left, right


def _open(percent: int, least: int):
    """Rows of a block pair that have a possible partner there; no full set is needed to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            _, label, n, sig, same, left, right = _block(table)
            hit = np.zeros(len(label), bool)
            for p in left:
                q = _partners(p, same, right, label, n, sig, percent, least)
                if len(q):
                    hit[q] = hit[p] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).to_batches()

    return run


def _compare(percent: int, least: int):
    """Links between rows of a block pair that lie in different components, checked on the full sets.
    Jaccard distance is a metric: rows whose distances to one pivot differ by more than the threshold
    allows cannot be linked and are not compared."""
    far = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            i, label, n, sig, same, left, right = _block(table)
            column = table.column("set").combine_chunks()
            sets = [column[k].values.to_numpy() for k in range(len(i))]
            pivot = None
            out = []
            for p in left:
                q = _partners(p, same, right, label, n, sig, percent, least)
                if len(q) > 8:
                    if pivot is None:
                        pivot = np.array([1 - _similar(sets[0], x) for x in sets])
                    q = q[np.abs(pivot[q] - pivot[p]) <= far]
                for k in q.tolist():
                    if label[k] == label[p]:
                        continue
                    both = len(np.intersect1d(sets[k], sets[p], assume_unique=True))
                    if 100 * both >= percent * (n[k] + n[p] - both):
                        out.append((min(i[k], i[p]), max(i[k], i[p])))
                        label = np.where(label == label[k], label[p], label)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (key, i, j) of batches sorted by them; a run holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(c[a] for c in cols)
            if last is not None and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    met = met.select("a", "b", inter.alias("x"), (F.size("sa") + F.size("sb")).alias("both"))
    return met.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("both") - F.col("x"))).select("a", "b")


def blocked(named: DataFrame) -> DataFrame:
    """The members of buckets (key, rep, n, c, label) that lie in several components, dealt to block pairs:
    key, i, j, rep, n, label, half (of the pair), same (i = j). Members of the bucket's largest component
    are never paired with each other: a hot group of copies costs a row for each block of strangers, not
    one for each block of its own. The others meet each other and all of the largest component."""
    counts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    sums = counts.groupBy("key").agg(
        F.max_by("label", F.struct("k", "label")).alias("most"), F.max(F.struct("k", "label", "s")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")
    )
    need = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    open_ = sums.where("parts > 1").select("key", "most", need(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("na"), need(F.col("top.k"), F.col("top.s")).alias("nm"))
    open_ = stage(open_, "open")
    # the centre has met all others
    rest = named.where("rep != c").join(open_, "key").withColumn("big", F.col("label") == F.col("most"))
    at = F.xxhash64("rep")
    rest = rest.withColumn("bk", F.when(F.col("big"), F.col("na") + F.pmod(at, F.col("nm"))).otherwise(F.pmod(at, F.col("na"))).cast("int"))
    last = F.when(F.col("big"), F.col("na")).otherwise(F.col("na") + F.col("nm")) - 1
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rest.select(
        "key", F.least("bk", "other").alias("i"), F.greatest("bk", "other").alias("j"), "rep", "n", "label", (F.col("bk") > F.col("other")).cast("int").alias("half"), (F.col("bk") == F.col("other")).alias("same")
    )


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = 30, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(stage(_judge(slim, percent, size, bands, rows), "near"))


def _judge(slim: DataFrame, percent: int, size: int, bands: int, rows: int) -> DataFrame:
    kinds = "id bigint, n bigint, s0 bigint, s1 bigint, bands array<bigint>, sig binary"
    signed = stage(slim.mapInArrow(_sign(size, bands, rows), kinds), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("n", "s0", "s1").agg(F.min("id").alias("rep"))
    classes = stage(classes, "classes")
    # a class is known by its least id and the digest of its set: an id may repeat with different texts
    reps = signed.join(classes.select(F.col("rep").alias("id"), "n", "s0", "s1"), ["id", "n", "s0", "s1"]).select(F.col("id").alias("rep"), "n", "bands", "sig")
    reps = stage(reps, "reps")
    s, k = percent / 100, bands * rows
    least = int(k * (s + (1 - s) / 256) - 4 * (k * s * (1 - s)) ** 0.5)

    # most buckets hold one representative: only the others' members are shuffled again
    spread = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = stage(spread.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    members = stage(sieve(spread, buckets.select("key"), "key").join(buckets, "key"), "members")
    stars = members.where("rep != c").select(F.col("c").alias("a"), F.col("rep").alias("b"), F.col("n").alias("bn")).distinct()
    stars = stage(stars, "stars")
    looks = stage(sieve(reps, members.select("rep").distinct(), "rep").select("rep", "n", "sig"), "looks")
    met = stars.join(looks.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").join(looks.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("sig").alias("sa")), "a")
    met = met.where(F.lit(100) * F.least("an", "bn") >= F.lit(percent) * F.greatest("an", "bn"))
    pairs = stage(met.select("a", "b", "sa", "sb").mapInArrow(_likely(least), "a bigint, b bigint"), "pairs")
    unstage(stars)

    def full_sets(wanted: DataFrame, tag: str) -> DataFrame:
        wanted = stage(wanted, "wanted")
        return stage(sieve(slim, wanted, "id").join(wanted, "id").mapInArrow(_sets(size), "id bigint, set array<bigint>"), tag)

    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "sets")
    links = stage(verify(pairs, sets, percent), "links")
    unstage(sets)
    found = stage(connected_components(links), "found")

    # buckets with members in different components, beyond the pairs with the centre
    named = members.where("m > 2").join(found.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left")
    named = stage(named.select("key", "rep", "n", "c", F.coalesce("label", "rep").alias("label")), "named")
    rest = blocked(named)
    rest = rest.join(looks.select("rep", "sig"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    kept = "key bigint, i int, j int, rep bigint, n bigint, label bigint, half int, same boolean, sig binary"
    rest = rest.select(*(c.split()[0] for c in kept.split(", "))).mapInArrow(_open(percent, least), kept)
    rest = stage(rest, "blocks")
    sets = full_sets(rest.select(F.col("rep").alias("id")).distinct(), "sets")
    rest = rest.join(sets.withColumnRenamed("id", "rep"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links2 = stage(rest.mapInArrow(_compare(percent, least), "a bigint, b bigint").distinct(), "links2")
    unstage(sets)
    unstage(members)
    # most often no bucket brings a link that was not there: then the components stand
    if not links2.isEmpty():
        found = stage(connected_components(links.unionByName(links2)), "found")
    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s0", "s1", F.coalesce("component", "rep").alias("component"))
    labelled = stage(labelled, "labelled")
    # an id that repeats with different texts is one node
    out = signed.select("id", "n", "s0", "s1").join(labelled, ["n", "s0", "s1"], "left")
    label = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() does not keep, all its columns. A row goes by its id: rows
    that share an id are one node, so they stay or go together (exact.drop_copies leaves no two rows equal
    in id and text)."""
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs, percent, id_col=id_col, text_col=text_col)
        gone = keep(stage(found.where(~F.col("kept")).select("id").distinct(), "gone"))
    return without(docs, gone, id_col)
