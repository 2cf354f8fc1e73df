"""Assessment of documents: text layer, table hint, tier, recommended parsers, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import bound, strip
from markfuse.sources import registry

SAMPLE_PAGES, TABLE_PAGES = 3, 10
TIERS = ["small", "medium", "large", "xlarge"]


def tier_index(pages: Column) -> Column:
    return F.when(pages <= 15, 0).when(pages <= 60, 1).when(pages <= 100, 2).otherwise(3)


def assess_pages(documents: DataFrame | None, pages: DataFrame, doc: str = "doc_id", middle: bool = False) -> DataFrame:
    """doc, pages, has_text_layer, table_hint, tier of paged documents; documents (if given) without a
    page count as empty. pages: doc, page_no from 1, text. With `middle`, also text_layer_recheck: the
    same test on up to three pages about the middle, for image covers that hide a text layer."""
    n_chars = F.length(strip("text"))
    text = F.col("text")
    tabular = text.contains("|") | (F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit(""))) > 3)
    pages = pages.select(doc, "page_no", n_chars.alias("__c"), tabular.alias("__t"))  # no text is shuffled
    sums = [
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.when(F.col("page_no") <= SAMPLE_PAGES, F.col("__c"))).alias("chars"),
        F.count_if((F.col("page_no") <= TABLE_PAGES) & F.col("__t")).alias("tabular"),
    ]
    if middle:
        # one count serves the totals and the middle: pages lie together by document already
        pages = pages.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(doc)))
        near = F.abs(F.col("page_no") - F.floor(F.col("__n") / 2) - 1) <= 1
        sums.append((F.sum(F.when(near, F.col("__c"))) > 50 * F.count_if(near)).alias("text_layer_recheck"))
    out = pages.groupBy(doc).agg(*sums)
    if documents is not None:
        out = documents.select(doc).join(out, doc, "left")
    n, chars, tab = (F.coalesce(c, F.lit(0)) for c in ("pages", "chars", "tabular"))
    layer = chars > 50 * F.least(F.lit(SAMPLE_PAGES), n)
    hint = tab * 10 >= F.least(F.lit(TABLE_PAGES), n) * 3
    order = F.array(*(F.lit(t) for t in TIERS))
    tier = F.get(order, F.least(tier_index(n) + F.when(layer, 0).otherwise(1), F.lit(3)))
    more = [F.coalesce("text_layer_recheck", F.lit(False)).alias("text_layer_recheck")] if middle else []
    return out.select(doc, n.cast("long").alias("pages"), layer.alias("has_text_layer"), hint.alias("table_hint"), tier.alias("tier"), *more)


def assess_files(files: DataFrame) -> DataFrame:
    """files (format, size_bytes, ...) that have no pages, plus pages (null), size_mib, has_text_layer,
    table_hint, tier."""
    f = F.col("format")
    tier = F.when(f.isin("hwpx", "hwp"), "hwpx").when(F.col("size_bytes") < 5 * 1024 * 1024, "small").otherwise("medium")
    return files.where(f != "pdf").select(
        "*", F.lit(None).cast("long").alias("pages"), (F.col("size_bytes") / F.lit(1048576.0)).alias("size_mib"), F.lit(True).alias("has_text_layer"), (f == "xlsx").alias("table_hint"), tier.alias("tier")
    )


def recommend(assessed: DataFrame, ruleset: str = "code") -> DataFrame:
    """assessed (format, tier, has_text_layer, lang, ...) plus parsers, in order; a strategy of tier 'any'
    holds for every tier. The strategy table is a constant of this package, so it is broadcast."""
    strategy = registry.strategy(assessed.sparkSession).where(F.col("ruleset") == ruleset)
    by_tier = F.map_from_entries(F.collect_list(F.struct("tier", "parsers"))).alias("__s")
    strategy = strategy.groupBy(F.col("format").alias("__f")).agg(by_tier)
    met = assessed.join(F.broadcast(strategy), F.col("format") == F.col("__f"), "left")
    # a row of the very tier goes before one of any
    met = met.withColumn("__p", F.coalesce(F.col("__s")[F.col("tier")], F.col("__s")["any"]))
    base = F.coalesce("__p", F.array(F.lit("upstage")))
    pdf, none = F.col("format") == "pdf", F.array().cast("array<string>")
    scan = F.when(pdf & ~F.col("has_text_layer") & ~F.array_contains(base, "upstage"), F.array(F.lit("upstage"))).otherwise(none)
    foreign = F.when(pdf & (F.col("lang") != "ko"), F.array(F.lit("mistral"))).otherwise(none)
    return met.select(*(F.col(f"`{c}`") for c in assessed.columns), F.concat(base, scan, foreign).alias("parsers"))


def credits(pages: Column, plan: Column) -> Column:
    """Pages times the plan's price; null for unknown or no pages."""
    price = F.lit(10)
    for name, cost in registry.CREDITS.items():
        price = F.when(plan == name, cost).otherwise(price)
    return F.when(pages > 0, pages * price)


def english_ratio(text: Column) -> Column:
    """Latin letters among all letters; null without a letter."""
    # runs go at once, and the second look is at letters only
    return bound(F.regexp_replace(text, r"\P{L}+", ""), lambda t: F.try_divide(F.length(F.regexp_replace(t, "[^A-Za-z]+", "")), F.length(t)))


def corrections(assessed: DataFrame) -> DataFrame:
    """assessed plus triggers: names of the correction rules that apply. Uses pages, has_text_layer,
    table_hint, tier and, where present, english_ratio, is_exam, numeric_table and cross_table (else taken as
    absent). A cross table that is an image only asks for the plain recogniser first (ruleset doc_cross_table)."""
    have = lambda c, default: F.col(c) if c in assessed.columns else F.lit(default)
    rules = {
        "scan": ~F.col("has_text_layer"),
        "cross_table_image": ~F.col("has_text_layer") & have("cross_table", False),
        "scan_numeric_table": ~F.col("has_text_layer") & (F.col("table_hint") | have("numeric_table", False)),
        "exam": have("is_exam", False),
        "english": have("english_ratio", 0.0) >= 0.5,
        "visual_check": F.coalesce(F.col("pages") <= 20, F.lit(False)),
        "recheck_text_layer": (F.col("tier") == "xlarge") & ~F.col("has_text_layer"),
    }
    return assessed.withColumn("triggers", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))))
