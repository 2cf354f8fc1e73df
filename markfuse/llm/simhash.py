"""SimHash fingerprints and Hamming search, in DataFrame functions only.

Fingerprint: the terms of a text are its word pairs (the last word stands alone), where words are runs
without white space. A term's 128-bit hash votes with the term's weight (1 to 3, by the length of its
first word) for or against each bit; the sign of each sum is the bit. The votes are counted by one
hash aggregation over the exploded terms of a text: 16 counters share four 16-bit lanes of a long, and
a block of 8,192 terms cannot overflow a lane, so a term costs 32 additions instead of 128. A text's
terms lie in one task, so nothing but the grouped rows would ever be shuffled.

Search: permuted block tables. 128 bits fall into `blocks` blocks; fingerprints at most `radius` apart
agree on at least blocks - radius of them, so one table for each choice of that many blocks, keyed by
the permuted leading bits, holds every such pair in one bucket. Pairs are found between distinct
fingerprints and then checked by the exact distance, in the join itself: candidates are never rows.

Defined cases: null counts as empty; a text without words has the fingerprint 0; equal texts have
equal fingerprints; repeated rows, null ids, empty tables and other columns are harmless.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, sieve, stage

LANES = 0x0001000100010001
BLOCK = 13  # 2**13 terms of weight 3 stay below 2**15 in each lane
BITS = 128


def terms(text: Column) -> Column:
    """Hash of each word pair; its two lowest bits hold the weight."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # the outer transform binds the words once; a lambda would otherwise split the text for each word
    pairs = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)).bitwiseAND(F.lit(-4)).bitwiseOR(_weight(w)))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def _weight(word: Column) -> Column:
    n = F.length(word)
    return F.when(n < 4, F.lit(1).cast("long")).when(n < 8, F.lit(2).cast("long")).otherwise(F.lit(3).cast("long"))


def fingerprint(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys plus f0 and f1, the fingerprint's halves. Rows with equal keys count as one text: keep
    something that tells rows apart among the keys."""
    exploded = rows.select(*keys, F.posexplode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "h0"))
    w = F.coalesce(F.col("h0").bitwiseAND(F.lit(3)), F.lit(0).cast("long"))
    both = exploded.select(
        *keys,
        F.shiftright(F.coalesce("pos", F.lit(0)), BLOCK).alias("block"),
        w.alias("w"),
        F.coalesce(F.xxhash64("h0", F.lit(1)), F.lit(0).cast("long")).alias("a0"),
        F.coalesce(F.xxhash64("h0", F.lit(2)), F.lit(0).cast("long")).alias("a1"),
    )
    lanes = lambda c, s: F.shiftrightunsigned(F.col(c), s).bitwiseAND(F.lit(LANES)) * F.col("w")
    packed = both.groupBy(*keys, "block").agg(
        F.sum("w").alias("total"), *(F.sum(lanes(f"a{k}", s)).alias(f"p{k}_{s}") for k in (0, 1) for s in range(16))
    )
    votes = lambda k, bit: F.shiftrightunsigned(F.col(f"p{k}_{bit % 16}"), bit // 16 * 16).bitwiseAND(F.lit(0xFFFF))
    summed = packed.groupBy(*keys).agg(
        F.sum("total").alias("total"), *(F.sum(votes(k, bit)).alias(f"v{k}_{bit}") for k in (0, 1) for bit in range(64))
    )

    def half(k: int) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            on = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(F.col(f"v{k}_{bit}") * 2 > F.col("total"), on).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def as_text(f0: Column, f1: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1 less the share of bits that differ."""
    return F.lit(1.0) - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def _block_keys(blocks: int, agree: int) -> Column:
    """Array of the keys of the tables: the number of the table and the chosen blocks' bits."""
    width = BITS // blocks
    cuts = [(i * width, (i + 1) * width if i < blocks - 1 else BITS) for i in range(blocks)]
    mask = [((1 << (b - a)) - 1) << (BITS - b) for a, b in cuts]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), agree)):
        m = sum(mask[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(signed(m >> 64)), F.col("f1").bitwiseAND(signed(m & (1 << 64) - 1))))
    return F.array(*keys)


def hamming_search(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(q0, q1, f0, f1, distance) for all distinct fingerprints of `index` within `radius` of each
    distinct fingerprint of `queries` (columns f0, f1); a fingerprint does not find itself. Rows of the
    tables whose key no query has are left out before the shuffle."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    keys = _block_keys(blocks, blocks - radius)
    side = lambda df: df.select("f0", "f1").where(F.col("f0").isNotNull() & F.col("f1").isNotNull()).distinct().select("f0", "f1", F.explode(keys).alias("k"))
    q = stage(side(queries).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), F.col("k").alias("qk")), "asked")
    d = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    met = q.join(sieve(side(index), q.select("qk"), "k"), (F.col("qk") == F.col("k")) & (d > 0) & (d <= radius))
    return met.select("q0", "q1", "f0", "f1", d.cast("int").alias("distance")).distinct()


SUB = 20  # bits of a bucket's number that tell its parts apart


def _placed(docs: DataFrame, id_col: str, text_col: str, per_bucket: int) -> DataFrame:
    """id, text, nk and tie (the order: ids descending, null ids last, rows with equal ids by their texts'
    hashes) and bucket, which ascends with the order. Buckets are cut at approximate percentiles of the
    ids; an id (or null) that holds several of them is cut further by tie."""
    spark = docs.sparkSession
    low = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("k", F.coalesce("id", low))
    rows = base.count()
    n = max(1, min(max(8192, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), rows // per_bucket))
    found = base.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    times = Counter(found)
    cuts = sorted(times)
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    c = listed(cuts) if cuts else F.array().cast("array<bigint>")
    m = listed([times[x] for x in cuts]) if cuts else c
    steps = F.array(*(F.lit(1 << s) for s in range(len(cuts).bit_length() - 1, -1, -1))) if cuts else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(c, at + s - 1), F.lit(2**63 - 1)) < F.col("k"), at + s).otherwise(at))
    tie = F.xxhash64("text")
    placed = base.withColumns({"nk": F.bitwise_not("k"), "tie": tie, "below": below})
    share = F.shiftrightunsigned(F.col("tie").bitwiseXOR(low), 64 - SUB)  # ascends with tie
    part = F.when((F.get(c, F.col("below")) == F.col("k")) & (F.get(m, F.col("below")) > 1), F.shiftright(share * F.least(F.get(m, F.col("below")), F.lit(1 << SUB)), SUB))
    bucket = (F.lit(len(cuts)) - F.col("below")).cast("long") * (1 << (SUB + 1)) + F.coalesce(part, F.lit(1 << SUB))
    return placed.select("id", "text", "nk", "tie", bucket.alias("bucket"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 128) -> DataFrame:
    """Each row with the text of the next one by descending id (after the last: the first), by one
    shuffle of the texts and no single-task window: bucket, rn, ghost, id, text, next_text.

    Rows fall into buckets that follow the order. The first row of each bucket is copied, as a ghost, to
    the end of the bucket before it, so every row finds its successor in its own bucket. The number of
    buckets grows with the table up to 8,192 or four times the cluster's shuffle partitions, so a task's
    share is the cluster's to set as for any shuffle, and what is broadcast (a key for each bucket) is
    bounded by it."""
    spark = docs.sparkSession
    placed = _placed(docs, id_col, text_col, per_bucket)
    heads = stage(placed.groupBy("bucket").agg(F.min(F.struct("nk", "tie")).alias("x")).select("bucket", "x.nk", "x.tie"), "heads")
    order = sorted(r[0] for r in heads.select("bucket").collect())  # as many as buckets
    pairs = F.split(F.lit(",".join(f"{b}:{order[i - 1]}" for i, b in enumerate(order))), ",")
    part = lambda p, i: F.split_part(p, F.lit(":"), F.lit(i)).try_cast("long")
    chain = spark.range(1).select(F.inline(F.transform(pairs, lambda p: F.struct(part(p, 1).alias("bucket"), part(p, 2).alias("into")))))
    first = F.broadcast(heads.join(chain, "bucket"))
    ghosts = placed.join(first, ["bucket", "nk", "tie"]).dropDuplicates(["bucket"])
    ghosts = stage(ghosts.select(F.col("into").alias("bucket"), F.lit(1).alias("ghost"), "nk", "tie", "id", "text"), "ghosts")
    w = Window.partitionBy("bucket").orderBy("ghost", "nk", "tie")
    spread = placed.select("bucket", F.lit(0).alias("ghost"), "nk", "tie", "id", "text").unionByName(ghosts)
    return spread.select("bucket", F.row_number().over(w).alias("rn"), "ghost", "id", "text", F.lead("text").over(w).alias("next_text"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs = with_next(docs, id_col, text_col)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = pairs.select(
        "bucket", "rn", "ghost", "id", n.cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, F.coalesce(edited, F.lit(""))).alias("edited")
    ).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    keys = ["bucket", "rn", "ghost", "id", "n_chars", "sha"]
    kinds = F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.when(F.col("ghost") == 0, F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))))
    both = rows.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.kind", "x.t")
    prints = fingerprint(both, [*keys, "kind"], "t")
    at = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    flat = prints.groupBy(*keys).agg(at("f0", 0).alias("f0"), at("f1", 0).alias("f1"), at("f0", 1).alias("e0"), at("f1", 1).alias("e1"))
    w = Window.partitionBy("bucket").orderBy("rn")
    nexts = flat.withColumns({"g0": F.lead("f0").over(w), "g1": F.lead("f1").over(w)}).where("ghost = 0")
    c = F.col
    return nexts.select(
        "id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(c("f0"), c("f1")).alias("fingerprint"),
        as_text(c("e0"), c("e1")).alias("edited_fingerprint"),
        likeness(c("f0"), c("f1"), c("e0"), c("e1")).alias("near_edited"),
        likeness(c("f0"), c("f1"), c("g0"), c("g1")).alias("near_next"),
    )


def with_hits(prints: DataFrame, queried: Column, radius: int = 3) -> DataFrame:
    """prints (fingerprint as as_text() gives it, ...) plus n_near: for rows that are `queried`, how many
    other rows have a fingerprint at most `radius` bits away; null for the rest. prints is read several
    times, so it should be staged."""
    half = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    halves = {"f0": half(1), "f1": half(17)}
    ask = F.coalesce(queried, F.lit(False))
    with scratch(prints.sparkSession) as keep:
        sizes = prints.select(*(v.alias(c) for c, v in halves.items())).groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n"))
        sizes = stage(sizes, "prints")
        asked = stage(prints.where(ask).select(*(v.alias(c) for c, v in halves.items())).distinct(), "queries")
        hits = hamming_search(asked, sizes, radius).join(sizes, ["f0", "f1"]).groupBy("q0", "q1").agg(F.sum("n").alias("n"))
        own = asked.join(sizes, ["f0", "f1"]).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), (F.col("n") - 1).alias("n"))
        near = keep(stage(own.unionByName(hits).groupBy("q0", "q1").agg(F.sum("n").alias("n_near")), "near"))
    met = prints.where(ask).join(near, (halves["f0"] == F.col("q0")) & (halves["f1"] == F.col("q1")), "left")
    rest = prints.where(~ask).withColumn("n_near", F.lit(None).cast("long"))
    return met.select(*(F.col(f"`{c}`") for c in prints.columns), "n_near").unionByName(rest)
