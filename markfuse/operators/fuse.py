"""Primary-plus-patch fusion: missing sections of secondaries go into the primary, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, bound, strip, tokens
from markfuse.operators.normalize import to_lines
from markfuse.operators.profile import line_count, table_count
from markfuse.sources.registry import file_token

_HEADING = rf"(?U)\A#{{1,6}}[{SPACE}]+[^{SPACE}]"


def sections(outputs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, parser, role, sec_ord, section (0 before the first heading), title, text."""
    keys = F.struct(doc, "parser", "role", "sec_ord").alias("__k")
    lines = to_lines(outputs.select(keys, "markdown"), "__k")
    w = Window.partitionBy("__k").orderBy("pos")
    heading = F.col("line").rlike(_HEADING)
    rows = lines.withColumn("section", F.count_if(heading).over(w))
    body = F.sort_array(F.collect_list(F.struct("pos", "line")))
    title = F.min_by(F.when(heading, strip(F.regexp_replace("line", r"\A#+", ""))), "pos")
    out = rows.groupBy("__k", "section").agg(title.alias("title"), F.array_join(F.transform(body, lambda r: r["line"]), "\n").alias("text"))
    return out.select("__k.*", "section", "title", "text")


def fuse(outputs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, markdown, contributors (primary first), inserted. A section whose title the primary lacks
    follows the section that its own document puts before it and the primary has; of several
    secondaries with the same title the first gives the text."""
    s = sections(outputs, doc)
    main = s.where("role = 'primary'")
    known = main.where("title IS NOT NULL").groupBy(doc, "title").agg(F.min("section").alias("anchor"))
    others = s.where("role = 'secondary'").join(known, [doc, "title"], "left")
    w = Window.partitionBy(doc, "parser", "sec_ord").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    others = others.withColumn("after", F.coalesce(F.last("anchor", ignorenulls=True).over(w), F.lit(0)))
    extra = others.where("anchor IS NULL AND title IS NOT NULL").withColumn("__first", F.row_number().over(Window.partitionBy(doc, "title").orderBy("sec_ord", "section"))).where("__first = 1")
    with_main = main.select(doc).distinct()
    extra = extra.join(with_main, doc, "left_semi")
    place = lambda df, at, sec: df.select(doc, "parser", "role", at.alias("at"), sec.alias("ord"), "section", "text")
    both = place(main, F.col("section"), F.lit(-1)).unionByName(place(extra, F.col("after"), F.col("sec_ord")))
    parts = F.sort_array(F.collect_list(F.struct("at", "ord", "section", "text")))
    used = F.sort_array(F.collect_set(F.struct("ord", "parser")))
    out = both.groupBy(doc).agg(parts.alias("p"), used.alias("u"), F.count_if(F.col("role") == "secondary").alias("inserted"))
    return out.select(doc, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("markdown"), F.array_distinct(F.transform("u", lambda x: x["parser"])).alias("contributors"), "inserted")


def fused_name(base: Column, contributors: Column) -> Column:
    return F.concat(base, F.lit("_fused_v3_"), F.array_join(F.transform(contributors, file_token), "+"), F.lit(".md"))


def output_name(base: Column, parser: Column) -> Column:
    return F.concat(base, F.lit("_"), file_token(parser), F.lit(".md"))


def run_status(runs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, parsers_ok, failed, can_continue, single (no cross-check possible) from rows with parser, ok."""
    ok = F.count_if("ok")
    return runs.groupBy(doc).agg(ok.alias("parsers_ok"), F.count_if(~F.col("ok")).alias("failed")).withColumns({"can_continue": F.col("parsers_ok") > 0, "single": F.col("parsers_ok") == 1})


def run_summary(assessed: DataFrame, runs: DataFrame, fused: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a document: pages, tier, parsers, failed_parsers, contributors, inserted, lines, tables.
    All three sides meet on the document; one without runs or without a fused text keeps its row."""
    ran = runs.groupBy(doc).agg(F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("parser")))).alias("parsers"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("parser")))).alias("failed_parsers"))
    made = fused.select(doc, "contributors", "inserted", line_count("markdown").cast("long").alias("lines"), table_count("markdown").cast("long").alias("tables"))
    return assessed.select(doc, "pages", "tier").join(ran, doc, "left").join(made, doc, "left")


def extra_parser_reasons(docs: DataFrame) -> DataFrame:
    """docs plus reasons for one more parser, from boolean columns unresolved, foreign, critical,
    new_type, source_typo and n_parsers."""
    rules = {"unresolved": F.col("unresolved"), "foreign": F.col("foreign"), "critical": F.col("critical") & (F.col("n_parsers") <= 2), "new_type": F.col("new_type"), "source_typo": F.col("source_typo")}
    return docs.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))))


def recall(source: Column, output: Column) -> tuple[Column, Column]:
    """(matched, total) characters of source, as multisets without white space, that output has too.
    Counted within the row, one replacement for each distinct character."""
    bare = lambda t: F.regexp_replace(t, rf"(?U)[{SPACE}]+", "")
    a, b = bare(source), bare(output)
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    # surrogate pairs are one character to split() with an empty pattern guarded by (?s).
    chars = F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)(.)"), F.lit(1)))
    pair = F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n + F.least(times(p["a"], c), times(p["b"], c)))), F.lit(0))
    return pair, F.length(a).cast("long")


def word_recall(pairs: DataFrame, doc: str = "doc", source: str = "source", output: str = "markdown") -> DataFrame:
    """doc, matched, total: words of the source, as multisets, that the output has too. Null texts count as
    empty and a source without words gives zeros; rows that share a doc count as one. Words are counted in
    groups, partly before the shuffle, so the time is linear in a text's length."""
    side = lambda c, n: F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(n).alias("side")))
    own_row = F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("side")))
    rows = pairs.select(F.col(doc).alias("__d"), F.explode(F.concat(own_row, side(source, 1), side(output, 2))).alias("x")).select("__d", "x.w", "x.side")
    counts = rows.groupBy("__d", "w").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b"))
    return counts.groupBy(F.col("__d").alias(doc)).agg(F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("total"))


# The circled numbers that mark the choices of a question.
MARKERS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def lost_markers(source: Column, output: Column, markers: str = MARKERS) -> Column:
    """Choice markers that the output has less often than the source, in the order of `markers`; none lost:
    an empty array. Null texts count as empty."""
    only = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), f"[^{markers}]", "")
    times = lambda t, m: F.length(t) - F.length(F.replace(t, m, F.lit("")))
    every = F.array(*(F.lit(m) for m in markers))
    return bound(F.struct(only(source).alias("a"), only(output).alias("b")), lambda x: F.filter(every, lambda m: times(x["a"], m) > times(x["b"], m)))
