"""Headings that a secondary output has and the primary lacks, and what to do about them.

outputs: one row per document and parser with doc, role ('primary' or 'secondary'), sec_ord, file,
markdown (null: missing file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import headings, profile


def _titles(outputs: DataFrame, *keep: str) -> DataFrame:
    found = F.transform(headings("markdown"), lambda h: h["title"])
    return outputs.where("markdown IS NOT NULL").select(*keep, F.posexplode(found).alias("pos", "title"))


def heading_gaps(outputs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, title, files (one entry for each occurrence, by discovery), found_in. Documents without a
    primary have no gaps. Both sides shuffle by document and title, and the grouping reuses that."""
    primary = outputs.where("role = 'primary'")
    known = _titles(primary, doc).select(doc, "title")
    there = primary.where("markdown IS NOT NULL").select(doc).distinct()
    others = _titles(outputs.where("role = 'secondary'").join(there, doc, "left_semi"), doc, "sec_ord", "file")
    extra = others.join(known, [doc, "title"], "left_anti")
    seen = F.sort_array(F.collect_list(F.struct("sec_ord", "pos", "file")))
    out = extra.groupBy(doc, "title").agg(seen.alias("seen"))
    return out.select(doc, "title", F.transform("seen", lambda s: s["file"]).alias("files"), F.get("seen", F.lit(0)).alias("first_seen"))


def gap_sample(gaps: DataFrame, n: int = 10, doc: str = "doc") -> DataFrame:
    """The first n gaps of each document, in the order of discovery: a report, not a limit."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("first_seen", "title"))), 1, n)
    return gaps.groupBy(doc).agg(F.transform(first, lambda g: g["title"]).alias("gaps_sample"))


def recommend(outputs: DataFrame, gaps: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """doc, gap_count, recommendation. In order: no primary, full_fusion; no secondary, primary_only;
    more gaps than a tenth of the primary's headings, full_fusion; any gap, patch_needed; a secondary
    with more than 1.3 times the lines, patch_needed; else primary_only."""
    gaps = heading_gaps(outputs, doc) if gaps is None else gaps
    p = profile(outputs)
    main, side = F.col("role") == "primary", (F.col("role") == "secondary") & F.col("exists")
    per_doc = p.groupBy(doc).agg(
        F.coalesce(F.max(F.when(main, F.col("exists"))), F.lit(False)).alias("has"),
        F.max(F.when(main, F.col("headings"))).alias("headings"),
        F.max(F.when(main, F.col("lines"))).alias("lines"),
        F.count_if(side).alias("sides"),
        F.max(F.when(side, F.col("lines"))).alias("most_lines"),
    )
    counted = per_doc.join(gaps.groupBy(doc).agg(F.count(F.lit(1)).alias("gaps")), doc, "left").withColumn("gap_count", F.coalesce("gaps", F.lit(0)))
    g = F.col("gap_count")
    advice = (
        F.when(~F.col("has"), "full_fusion")
        .when(F.col("sides") == 0, "primary_only")
        .when((F.col("headings") > 0) & (g * 10 > F.col("headings")), "full_fusion")
        .when(g > 0, "patch_needed")
        .when(F.col("most_lines") * 10 > F.col("lines") * 13, "patch_needed")
        .otherwise("primary_only")
    )
    return counted.select(doc, "gap_count", advice.alias("recommendation"))


def presence_vote(outputs: DataFrame, least: int = 2, doc: str = "doc") -> DataFrame:
    """doc, title, n_parsers, keep: a heading that fewer than `least` parsers have is suspect."""
    votes = _titles(outputs, doc, "parser").groupBy(doc, "title").agg(F.count_distinct("parser").alias("n_parsers"))
    return votes.withColumn("keep", F.col("n_parsers") >= least)
