"""Table cells across parsers: extraction, conflicts, sums, votes.

cells: doc keys (any number of columns), parser, value. All comparisons are one grouping by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, strip

_TABLE = rf"(?dUm)(?:^[{SPACE}&&[^\n]]*+\|[^\n]*+(?:\n|\z))++"

# Parsers whose cells take part in votes, by kind of document; the first wins a tie. Fixed values.
ELIGIBLE = {
    "table": ["upstage", "llamaparse", "mistral", "opendataloader", "hwpx_local"],
    "scan_handwritten": ["upstage", "mistral"],
}


def parse_tables(docs: DataFrame, *keep: str, markdown: str = "markdown") -> DataFrame:
    """keep, table_no, row_no, col_no, value of every pipe table; rule rows are left out."""
    tables = F.regexp_extract_all(F.col(markdown), F.lit(_TABLE), F.lit(0))
    t = docs.select(*keep, F.posexplode(tables).alias("table_no", "table"))
    rows = F.filter(F.split(strip("table"), "\n"), lambda r: ~r.rlike(rf"(?U)\A[{SPACE}|:\-]*-[{SPACE}|:\-]*\z"))
    r = t.select(*keep, "table_no", F.posexplode(rows).alias("row_no", "row"))
    inner = F.regexp_replace(strip("row"), r"\A\||(?<!\\)\|\z", "")
    cells = F.split(inner, r"(?<!\\)\|", -1)
    return r.select(*keep, "table_no", "row_no", F.posexplode(cells).alias("col_no", "v")).select(*keep, "table_no", "row_no", "col_no", strip("v").alias("value"))


def is_skeleton(table: Column) -> Column:
    """A table of rules and blanks only."""
    return F.length(F.regexp_replace(table, rf"(?U)[|{SPACE}\-]", "")) == 0


def meet(cells: DataFrame, keys: Sequence[str], parsers: Sequence[str]) -> DataFrame:
    """keys and a column of struct<value> a parser, null where it lacks the cell: one grouping by cell. Of
    several values that a parser has for a cell the greatest counts."""
    at = lambda p: F.max(F.when(F.col("parser") == p, F.struct("value"))).alias(p)
    return cells.where(F.col("parser").isin(*parsers)).groupBy(*keys).agg(*(at(p) for p in parsers))


def conflicts(cells: DataFrame, keys: Sequence[str], parsers: Sequence[str]) -> DataFrame:
    """keys, values (parser=value, in the order of `parsers`, missing ones as a dash) of every cell on
    which the parsers do not all agree; a full outer join of all of them in one grouping."""
    return conflicts_met(meet(cells, keys, parsers), keys, parsers)


def conflicts_met(met: DataFrame, keys: Sequence[str], parsers: Sequence[str]) -> DataFrame:
    """`conflicts` of cells that have met already (the form of `meet`): row by row, without a shuffle."""
    got = met.select(*keys, *(F.coalesce(F.col(f"`{p}`.value"), F.lit("-")).alias(p) for p in parsers))
    agree = F.lit(True)
    for p in parsers[1:]:
        agree = agree & (F.col(f"`{p}`") == F.col(f"`{parsers[0]}`"))
    return got.where(~agree).select(*keys, F.concat_ws(";", *(F.concat(F.lit(f"{p}="), F.col(f"`{p}`")) for p in parsers)).alias("values"))


def row_sums(cells: DataFrame, keys: Sequence[str], total_col: int, value: Column | None = None, col_no: str = "col_no") -> DataFrame:
    """keys, parser, sum, total, ok: whether a row's other cells add up to its total cell; cells that
    are no number count as 0, a row without a total cell is not ok."""
    v = F.coalesce(F.col("value").try_cast("decimal(38,4)") if value is None else value, F.lit(0))
    at = F.col(col_no) == total_col
    out = cells.groupBy(*keys, "parser").agg(F.sum(F.when(~at, v).otherwise(0)).alias("sum"), F.max(F.when(at, v)).alias("total"))
    return out.withColumn("ok", F.coalesce(F.col("sum") == F.col("total"), F.lit(False)))


def row_sums_met(rows: DataFrame, keys: Sequence[str], parts: Sequence[Column], total: Column) -> DataFrame:
    """`row_sums` of rows whose cells stand side by side as numbers, null where they are none: row by row,
    without a shuffle."""
    add = F.coalesce(parts[0], F.lit(0))
    for p in parts[1:]:
        add = add + F.coalesce(p, F.lit(0))
    out = rows.select(*keys, "parser", add.alias("sum"), F.coalesce(total, F.lit(0)).alias("total"))
    return out.withColumn("ok", F.col("sum") == F.col("total"))


def majority(cells: DataFrame, keys: Sequence[str], kind: str = "table", least: int = 2) -> DataFrame:
    """keys, value, votes, settled: of the eligible parsers' values the one with most votes, a tie going
    to the earlier parser; settled when at least `least` agree."""
    return majority_met(meet(cells, keys, ELIGIBLE[kind]), keys, kind, least)


def majority_met(met: DataFrame, keys: Sequence[str], kind: str = "table", least: int = 2) -> DataFrame:
    """`majority` of cells that have met already (the form of `meet`): row by row, without a shuffle. A parser
    without a column has no cells; a row without an eligible cell is left out."""
    order = [p for p in ELIGIBLE[kind] if p in met.columns]
    if not order:
        value = F.lit(None).cast("string")
        return met.where("false").select(*keys, value.alias("value"), F.lit(0).cast("long").alias("votes"), F.lit(False).alias("settled"))
    at = {p: F.col(f"`{p}`") for p in order}
    # a missing cell has no votes; equal values of several parsers have as many votes each
    votes = {p: F.when(at[p].isNull(), 0).otherwise(sum((at[q].eqNullSafe(at[p]).cast("int") for q in order if q != p), F.lit(1))) for p in order}
    any_cell = F.coalesce(*(F.when(at[p].isNotNull(), F.lit(True)) for p in order))
    counted = met.where(any_cell).select(*keys, *order, *(v.alias(f"__{p}") for p, v in votes.items()))
    most = F.greatest(*(F.col(f"`__{p}`") for p in order)) if len(order) > 1 else F.col(f"`__{order[0]}`")
    counted = counted.withColumn("__most", most)
    won = F.coalesce(*(F.when(F.col(f"`__{p}`") == F.col("__most"), at[p]) for p in order))
    return counted.select(*keys, won["value"].alias("value"), F.col("__most").cast("long").alias("votes"), (F.col("__most") >= least).alias("settled"))


def fill_merged(cells: DataFrame, keys: Sequence[str], row: str = "row_no", col_no: str = "col_no") -> DataFrame:
    """Cells with blanks filled from above, and a dash where nothing stands above."""
    w = Window.partitionBy(*keys, col_no).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("value", F.coalesce(F.last(F.when(F.col("value") != "", F.col("value")), ignorenulls=True).over(w), F.lit("-")))


def missing_numbers(a: Column, b: Column) -> Column:
    """Numbers of text b that text a lacks."""
    found = lambda t: F.regexp_extract_all(t, F.lit(r"(\d[\d,.]*)"), F.lit(1))
    return F.array_except(found(b), found(a))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Entries of an answer key or roster with the other side's value, and whether they agree."""
    r = right.select(*keys, F.col(value).alias("other"))
    return left.join(r, list(keys), "full_outer").withColumn("same", F.col(value).eqNullSafe(F.col("other")))
