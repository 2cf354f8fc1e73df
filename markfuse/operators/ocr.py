"""Shaping of recognition results: layout elements, words with confidences, page drafts.

Everything works within a row on arrays; only duplicate pages need a grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markfuse.functions.text import HANGUL, SPACE, col, lines_broken, strip

LOW = 0.90
NOISE = ["header", "footer", "page_number"]
# Marks that page texts carry.
LOW_MARK, SELF_CHECK = "저신뢰", "자기 점검표"
DRAFT_HEAD = "[Google Vision literal 드래프트]"
DRAFT_LOW = "[Vision 저신뢰(<0.90) 단어: 시각 판독 표적]"

WORD_TREE = "array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,symbols:array<struct<text:string>>>>>>>>>>"


def join_elements(elements: Column | str, fallback: Column | str | None = None) -> Column:
    """Markdown of array<struct<category, content:struct<markdown>>> without furniture. Null or no
    elements at all: the fallback; nothing left: empty."""
    e = col(elements)
    kept = F.filter(e, lambda x: ~F.coalesce(x["category"], F.lit("")).isin(NOISE) & (F.coalesce(x["content"]["markdown"], F.lit("")) != ""))
    text = F.array_join(F.transform(kept, lambda x: x["content"]["markdown"]), "\n\n")
    rest = F.coalesce(col(fallback), F.lit("")) if fallback is not None else F.lit("")
    return F.when(F.coalesce(F.size(e), F.lit(0)) > 0, text).otherwise(rest)


def noise_count(elements: Column | str) -> Column:
    return F.size(F.filter(col(elements), lambda x: x["category"].isin(NOISE)))


def words_of(tree: Column | str) -> Column:
    """array<struct<text, confidence>> of a page's word tree; a missing confidence counts as 1."""
    inner = lambda a, name: F.flatten(F.transform(F.coalesce(a, F.array()), lambda x: F.coalesce(x[name], F.array())))
    words = inner(inner(inner(col(tree), "blocks"), "paragraphs"), "words")
    text = lambda w: F.array_join(F.transform(F.coalesce(w["symbols"], F.array()), lambda s: s["text"]), "")
    return F.transform(words, lambda w: F.struct(text(w).alias("text"), F.coalesce(w["confidence"], F.lit(1.0)).alias("confidence")))


def low_words(words: Column | str, low: float = LOW) -> Column:
    """Words below the limit, a missing confidence counting as 1."""
    return F.filter(col(words), lambda w: F.coalesce(w["confidence"], F.lit(1.0)) < low)


def page_text(page_no: Column, text: Column, low: Column, http_error: Column | None = None) -> Column:
    """A page as the recognition report shows it; a failed call becomes a header line of its own."""
    items = F.array_join(F.transform(low, lambda w: F.format_string("%s(%.2f)", w["text"], w["confidence"])), ", ")
    head = F.concat(F.lit("\n## p."), page_no.cast("string"))
    good = F.concat(head, F.lit("\n\n"), strip(text), F.lit("\n"), F.when(F.size(low) > 0, F.concat(F.lit(f"\n{LOW_MARK}: "), items, F.lit("\n"))).otherwise(""))
    if http_error is None:
        return good
    return F.when(http_error.isNotNull(), F.concat(head, F.lit("  [HTTP "), http_error.cast("string"), F.lit("]\n"))).otherwise(good)


def parse_low(chunk: Column | str) -> Column:
    """array<struct<word, confidence>> listed in a page text; figures that are no number are null."""
    listed = rf"(?Ud){LOW_MARK}[:：][{SPACE}]*(.+)"
    item = r"([^,(]+?)\(([0-9.]+)\)"
    tails = F.transform(F.filter(lines_broken(chunk), lambda x: x.rlike(listed)), lambda x: F.regexp_extract(x, listed, 1))
    both = lambda x: F.zip_with(
        F.regexp_extract_all(x, F.lit(item), F.lit(1)), F.regexp_extract_all(x, F.lit(item), F.lit(2)), lambda a, b: F.struct(strip(a).alias("word"), b.try_cast("double").alias("confidence"))
    )
    return F.flatten(F.transform(tails, both))


def body_of(chunk: Column | str) -> Column:
    """A page text without headings and confidence lists."""
    listed = rf"(?Ud){LOW_MARK}[:：].+"
    kept = F.filter(lines_broken(chunk), lambda x: ~x.rlike(listed) & ~x.rlike(rf"(?U)\A[{SPACE}]*#"))
    return F.array_join(kept, "\n")


_PAGE = rf"(?Udm)^## p\.(\d+)[{SPACE}]*$"


def draft_pages(docs: DataFrame, doc: str = "doc", markdown: str = "markdown") -> DataFrame:
    """doc, page_no, ordinal, lines (Latin lines without Hangul, up to the self-check list), low. A page
    number that repeats keeps its last occurrence."""
    numbers = F.regexp_extract_all(F.col(markdown), F.lit(_PAGE), F.lit(1))
    bodies = F.split(F.col(markdown), _PAGE, -1)
    pages = F.zip_with(numbers, F.slice(bodies, 2, F.size(bodies)), lambda n, b: F.struct(n.alias("n"), b.alias("b")))
    rows = docs.where(F.size(numbers) > 0).select(doc, F.posexplode(pages).alias("ordinal", "p"))
    rows = rows.select(doc, F.col("p.n").cast("int").alias("page_no"), "ordinal", F.col("p.b").alias("body"))
    lines = F.transform(lines_broken("body"), strip)
    stop = F.array_position(F.transform(lines, lambda x: x.contains(SELF_CHECK) & ~x.startswith(f"{LOW_MARK}:")), True)
    cut = F.when(stop > 0, F.slice(lines, F.lit(1), stop.cast("int") - 1)).otherwise(lines)
    draft = F.filter(cut, lambda x: ~x.startswith(f"{LOW_MARK}:") & x.rlike("[A-Za-z]") & ~x.rlike(f"[{HANGUL}]"))
    low = strip(F.regexp_extract("body", rf"(?Udm)^{LOW_MARK}:[{SPACE}]*(.*)$", 1))
    rows = rows.select(doc, "page_no", "ordinal", draft.alias("lines"), low.alias("low"))
    last = rows.groupBy(doc, "page_no").agg(F.max_by(F.struct("ordinal", "lines", "low"), "ordinal").alias("p"))
    return last.select(doc, "page_no", "p.ordinal", "p.lines", "p.low")


def draft_files(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, file_name, content of the drafts."""
    low = F.when(F.col("low") != "", F.concat(F.lit(f"\n\n{DRAFT_LOW}\n"), F.col("low"))).otherwise("")
    text = F.concat(F.lit(f"{DRAFT_HEAD}\n"), F.array_join("lines", "\n"), low)
    return pages.select(doc, F.format_string("draft_p%02d.txt", "page_no").alias("file_name"), text.alias("content"))
