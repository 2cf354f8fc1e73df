"""Where a fluent transcript and a literal one diverge, page by page.

Only the alignment itself, a longest-matching-block recursion, has no DataFrame form; it is one Arrow
function over token arrays and is skipped for pages whose compared tokens are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, anchor_key, col, letters_key, token_key, tokens
from markfuse.operators.ocr import body_of, draft_pages, parse_low
from markfuse.session import ship

PAGE = rf"^##[{SPACE}]*p\.?[{SPACE}]*0*(\d+)"
TITLE = rf"^#[{SPACE}]+[^{SPACE}]"
OPCODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def chunks(text: Column | str, pattern: str) -> Column:
    """The text cut before each match; what precedes the first is dropped. No match: the whole text."""
    t = col(text)
    parts = F.split(t, f"(?Udm)(?={pattern})", -1)
    # the first part precedes every match unless the text starts with one
    cut = F.when(F.get(parts, F.lit(0)).rlike(rf"(?Ud)\A(?:{pattern[1:]})"), parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(t.rlike(f"(?Udm){pattern}"), cut).otherwise(F.array(t))


def transcript_chunks(text: Column | str) -> Column:
    """By page headers if there are two, else by first-level headings if there are two, else whole."""
    by_page, by_title = chunks(text, PAGE), chunks(text, TITLE)
    return F.when(F.size(by_page) >= 2, by_page).when(F.size(by_title) >= 2, by_title).otherwise(F.array(col(text)))


def page_label(chunk: Column | str, index: Column) -> Column:
    found = F.regexp_extract(col(chunk), f"(?Udm){PAGE}", 1)
    return F.concat(F.lit("p."), F.when(found != "", found).otherwise((index + 1).cast("string")))


def _opcodes():
    @F.udf(returnType=OPCODES, useArrow=True)
    def opcodes(a, b):
        from difflib import SequenceMatcher

        if a is None or b is None:
            return []
        found = SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes()
        return [{"tag": t, "i1": i1, "i2": i2, "j1": j1, "j2": j2} for t, i1, i2, j1, j2 in found if t != "equal"]

    return opcodes


def divergences(pairs: DataFrame, llm: str = "llm", ocr: str = "ocr", context: int = 3) -> DataFrame:
    """pairs plus divergences: array<struct<tag, llm array, ocr array, context>>. Differences of
    punctuation only, and of spacing only, are left out. Equal marks may be aligned, different ones not: a
    header's `##` that meets a comma would tear apart the words around them."""
    ship(pairs.sparkSession)
    toks = pairs.withColumns({"__a": tokens(llm), "__b": tokens(ocr)})
    keys = toks.withColumns({"__ka": F.transform("__a", anchor_key), "__kb": F.transform("__b", anchor_key)})
    differ = F.col("__ka") != F.col("__kb")
    coded = keys.withColumn("__ops", _opcodes()(F.when(differ, F.col("__ka")), F.when(differ, F.col("__kb"))))
    part = lambda a, i, j: F.slice(F.col(a), i + 1, j - i)
    real = lambda a: F.filter(a, lambda t: token_key(t) != "")
    before = lambda a, i: F.array_join(F.slice(F.col(a), F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context))), " ")
    segments = F.transform(
        "__ops",
        lambda o: F.struct(
            o["tag"].alias("tag"),
            real(part("__a", o["i1"], o["i2"])).alias("llm"),
            real(part("__b", o["j1"], o["j2"])).alias("ocr"),
            F.when(o["i1"] > 0, before("__a", o["i1"])).otherwise(before("__b", o["j1"])).alias("context"),
        ),
    )
    kept = F.filter(segments, lambda s: (F.size(s["llm"]) + F.size(s["ocr"]) > 0) & (letters_key(s["llm"]) != letters_key(s["ocr"])))
    return coded.withColumn("divergences", kept).drop("__a", "__b", "__ka", "__kb", "__ops")


def pair_pages(docs: DataFrame, doc: str = "doc", llm: str = "llm_markdown", ocr: str = "ocr_markdown") -> DataFrame:
    """doc, idx, page, llm, ocr (body), low, n_llm, n_ocr: pages paired by order, as many as both have."""
    both = docs.select(doc, transcript_chunks(llm).alias("a"), chunks(ocr, PAGE).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    zipped = F.arrays_zip(F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(1), n).alias("b"))
    rows = both.select(doc, F.size("a").alias("n_llm"), F.size("b").alias("n_ocr"), F.posexplode(zipped).alias("idx", "z"))
    return rows.select(doc, "idx", page_label(F.col("z.b"), F.col("idx")).alias("page"), F.col("z.a").alias("llm"), body_of(F.col("z.b")).alias("ocr"), parse_low(F.col("z.b")).alias("low"), "n_llm", "n_ocr")


def targets(docs: DataFrame, doc: str = "doc", context: int = 3) -> DataFrame:
    """Pages with their divergences and low-confidence words: what to look at in the image."""
    return divergences(pair_pages(docs, doc), "llm", "ocr", context)


def target_totals(found: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, page, divergences, low, with a row of page null for each document's total."""
    rows = found.select(doc, "page", F.size("divergences").alias("d"), F.size("low").alias("l"))
    out = rows.rollup(doc, "page").agg(F.sum("d").alias("divergences"), F.sum("l").alias("low"))
    return out.where(F.col(doc).isNotNull())


def cascade(docs: DataFrame, doc: str = "doc", llm: str = "llm_markdown", ocr: str = "ocr_markdown") -> DataFrame:
    """doc, page, draft (literal lines of the recogniser), divergences, low, look: the work list of the
    handwriting cascade. The fluent and the literal text of a page are aligned; pages where they diverge
    or where words are uncertain are to be looked at. Reading those pages again is an outside service's
    work; `score` judges its answers."""
    pages = targets(docs.select(doc, F.col(llm).alias("llm_markdown"), F.col(ocr).alias("ocr_markdown")), doc)
    drafts = draft_pages(docs, doc, ocr).select(doc, F.concat(F.lit("p."), F.col("page_no").cast("string")).alias("page"), F.col("lines").alias("draft"))
    look = (F.size("divergences") > 0) | (F.size("low") > 0)
    return pages.join(drafts, [doc, "page"], "left").select(doc, "page", F.coalesce("draft", F.array().cast("array<string>")).alias("draft"), "divergences", "low", look.alias("look"))
