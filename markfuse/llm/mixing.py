"""Mixing sources to target weights by temperature.

1. Each source's token share p is raised to an exponent a and normalised: weight = p**a / sum p**a.
2. The exponent is bisected in [0, 1]: the largest a whose entropy reaches the target, or, if that would
   repeat a source more than `max_repeats` times, the smallest a that does not. One aggregation over the
   source totals evaluates the midpoints of six bisection levels at once, so five jobs settle 30 levels
   and the source totals never come to the driver.
3. The weights become token budgets. A source is passed over whole as often as its budget allows; the
   last, partial pass takes rows in the pass's own block permutation while their running token sum stays
   within what is left. Blocks (256, of 256 smaller ones each) follow a keyed hash of pass and block,
   rows one of pass and row.

The cut of a partial pass is found level by level: sums over blocks, then over the smaller blocks of the
one block that holds the cut, then over the rows of one smaller block, about 1/65,536 of a source. So
no task ever orders a whole source, however large. Every row then compares its place with its source's
cut.

Defined cases: null text has no tokens; null is a source of its own; rows of a source that has no tokens
at all are repeated once; rows equal in id, source and text share one place and are taken together or not; one
source, or none, gives weight 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage

LEVELS, ROUNDS = 6, 5  # of bisection: midpoints of LEVELS levels in each of ROUNDS jobs
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Exponent:
    """The bisected exponent and what it was bisected for."""

    alpha: float
    natural_entropy: float
    target_entropy: float
    total: int
    norm: float  # sum of p**alpha


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokens: Column | None, seed: str) -> DataFrame:
    """id, source, tokens, place (keyed hash of the row: 32 hexadecimal digits)."""
    n = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n.alias("tokens"), place(id_col, text_col, source_col, seed).alias("place"))


def place(id_col: str, text_col: str, source_col: str, seed: str) -> Column:
    """Keyed hash of a row's id, source and text."""
    given = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), given(id_col), given(source_col), F.md5(given(text_col))))


def _evaluate(totals: DataFrame, total: int, alphas: list[float]) -> list[tuple[float, float]]:
    """(entropy, norm) at each exponent."""
    log = F.log(F.col("t") / F.lit(float(total)))
    sums = []
    for a in alphas:
        power = F.exp(F.lit(a) * log)
        sums += [F.sum(power), F.sum(power * log)]
    row = totals.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return [(math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i], row[2 * i]) for i, a in enumerate(alphas)]


def bisect(totals: DataFrame, evenness: float = 0.5, max_repeats: float | None = 4.0, budget: int | None = None) -> Exponent:
    """Exponent for source totals (source, t). The target entropy lies `evenness` of the way from the
    natural entropy to that of equal weights. max_repeats limits budget / tokens of every source; where
    even the natural shares exceed it, the exponent is 1."""
    full = totals.where("t > 0")
    total, least, n = full.agg(F.sum("t"), F.min("t"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return Exponent(1.0, 0.0, 0.0, total or 0, 1.0)
    natural = _evaluate(full, total, [1.0])[0][0]
    target = natural + evenness * (math.log(n) - natural)
    passes = (budget or total) / total

    def repeats_too_often(alpha: float, norm: float) -> bool:
        return max_repeats is not None and passes * math.exp((alpha - 1) * math.log(least / total)) / norm > max_repeats

    def larger(alpha: float, entropy: float, norm: float) -> bool:
        """Whether the exponent sought is at least this large."""
        return entropy >= target or repeats_too_often(alpha, norm)

    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        parts = 1 << LEVELS
        at = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        found = _evaluate(full, total, at)
        a, b = 0, parts
        while b - a > 1:
            m = (a + b) // 2
            if larger(at[m - 1], *found[m - 1]):
                a = m
            else:
                b = m
        lo, hi = lo + (hi - lo) * a / parts, lo + (hi - lo) * b / parts
    at_lo, at_hi = _evaluate(full, total, [lo, hi])
    # where the repetition limit decides, only the upper end keeps it
    alpha, norm = (lo, at_lo[1]) if at_lo[0] >= target and not repeats_too_often(lo, at_lo[1]) else (hi, at_hi[1])
    return Exponent(alpha, natural, target, total, norm)


def plan(rows: DataFrame, evenness: float = 0.5, max_repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """One row a source: source, t, weight, passes (whole ones) and the cut (c1, c2, c3) of the partial
    pass, after which no row is taken; c1 null: no cut. rows: what counted() gives."""
    with scratch(rows.sparkSession) as keep:
        return keep(stage(_plan(rows, evenness, max_repeats, budget), "cuts"))


def _plan(rows: DataFrame, evenness: float, max_repeats: float | None, budget: int | None) -> DataFrame:
    totals = stage(rows.groupBy("source").agg(F.sum("tokens").alias("t")), "totals")
    e = bisect(totals, evenness, max_repeats, budget)
    share = F.col("t") / F.lit(float(max(e.total, 1)))
    goal = F.round(F.exp(F.lit(e.alpha) * F.log(share)) / F.lit(e.norm) * F.lit(float(budget or e.total))).cast("long")
    some = F.col("t") > 0
    base = totals.select(
        "source",
        "t",
        F.when(some, F.exp(F.lit(e.alpha) * F.log(share)) / F.lit(e.norm)).otherwise(0.0).alias("weight"),
        F.when(some, F.expr("t")).otherwise(1).alias("d"),
        F.when(some, goal).otherwise(1).alias("goal"),
    ).select("source", "t", "weight", "goal", F.expr("goal div d").alias("passes"), F.when(some, F.expr("goal % d")).otherwise(-1).alias("left"))
    base = stage(base, "plan")

    order = Window.partitionBy("source").orderBy("c")
    running = F.sum("t").over(order.rangeBetween(Window.unboundedPreceding, 0))

    def level(inside: DataFrame, key: Column, width: str) -> DataFrame:
        """inside: source, passes, left, key columns and tokens of the rows in question. Gives, for each
        source, the first key whose running sum exceeds `left`, its place, and what is left before it."""
        sums = inside.groupBy("source", "passes", "left", key.alias("k")).agg(F.sum("tokens").alias("t"))
        sums = sums.withColumn("c", place_in_pass(F.col("passes"), F.col("k"))).withColumn("run", running)
        cut = sums.where(F.col("run") > F.col("left")).groupBy("source", "left").agg(F.min_by(F.struct("k", "c", "t", "run"), "c").alias("x"))
        return cut.select("source", F.col("x.k").alias(width), F.col("x.c").alias(f"c_{width}"), (F.col("left") - F.col("x.run") + F.col("x.t")).alias(f"left_{width}"))

    keyed = rows.join(base.where("left >= 0").select("source", "passes", "left"), rows["source"].eqNullSafe(base["source"])).select(rows["source"], "passes", "left", "tokens", "place")
    one = stage(level(keyed, F.substring("place", 1, 2), "k1"), "cut1")
    inside = keyed.join(one.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, 2) == F.col("k1")))
    inside = stage(inside.select("source", "passes", F.col("left_k1").alias("left"), "tokens", "place"), "inside")
    two = stage(level(inside, F.substring("place", 1, 4), "k2"), "cut2")
    last = inside.drop("left").join(two.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, 4) == F.col("k2")))
    three = level(last.select("source", "passes", F.col("left_k2").alias("left"), "tokens", "place"), F.col("place"), "k3")
    cuts = one.select("source", "c_k1").join(two.select(F.col("source").alias("s2"), "c_k2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    cuts = cuts.join(three.select(F.col("source").alias("s3"), "c_k3"), F.col("source").eqNullSafe(F.col("s3")), "left")
    out = base.join(cuts.select(F.col("source").alias("s"), "c_k1", "c_k2", "c_k3"), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("source", "t", "weight", "goal", "passes", "left", F.col("c_k1").alias("c1"), F.col("c_k2").alias("c2"), F.col("c_k3").alias("c3"))


def place_in_pass(passes: Column, key: Column) -> Column:
    """Keyed hash that orders blocks or rows in the pass of that number."""
    return F.md5(F.concat_ws(":", passes.cast("string"), key))


def judge(
    docs: DataFrame,
    evenness: float = 0.5,
    max_repeats: float | None = 4.0,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, tokens, weight and goal (token budget) of its source, repeats
    (how often the mixture holds the row), place. tokens: a column that counts a row's tokens; words by default."""
    rows = stage(counted(docs, id_col, text_col, source_col, tokens, seed), "counted")
    out = repeated(rows, plan(rows, evenness, max_repeats, budget))
    return out.select("id", "source", "tokens", F.col("__weight").alias("weight"), F.col("__goal").alias("goal"), F.col("__repeats").alias("repeats"), "place")


def repeated(rows: DataFrame, p: DataFrame, source: str = "source", place_col: str = "place") -> DataFrame:
    """rows plus __weight, __goal and __repeats by the plan p. The plan has one row a source; Spark
    broadcasts it if its size allows, else the join on the source is split where it is skewed."""
    p = p.select(*(F.col(c).alias(f"__{c}") for c in p.columns))
    met = rows.join(p, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    at = F.col(place_col)
    mine = [place_in_pass(F.col("__passes"), k) for k in (F.substring(at, 1, 2), F.substring(at, 1, 4), at)]
    c = [F.col("__c1"), F.col("__c2"), F.col("__c3")]
    before = (mine[0] < c[0]) | ((mine[0] == c[0]) & ((mine[1] < c[1]) | ((mine[1] == c[1]) & (mine[2] < c[2]))))
    taken = (F.col("__left") >= 0) & (c[0].isNull() | before)
    times = (F.col("__passes") + F.coalesce(taken, F.lit(False)).cast("long")).alias("__repeats")
    return met.select(*(F.col(f"`{x}`") for x in rows.columns), "__weight", "__goal", times)


def mix(
    docs: DataFrame,
    evenness: float = 0.5,
    max_repeats: float | None = 4.0,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixture: each row of docs as often as its source's budget says, with the columns of docs.
    A row's place is a function of the row, so texts stay where they lie and only the plan moves."""
    rows = stage(counted(docs, id_col, text_col, source_col, tokens, seed), "counted")
    placed = docs.withColumn("__place", place(id_col, text_col, source_col, seed))
    met = repeated(placed, plan(rows, evenness, max_repeats, budget), source_col, "__place").where("__repeats > 0")
    copies = met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int"))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))
