"""Clean-up rules for parsed Markdown, as functions of a text column, and rules over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, bound, col, is_blank, strip
from markfuse.operators.alt import IMAGE, LABEL

BLANKS = r"\n{3,}"


def squeeze_blank_lines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), BLANKS, "\n\n")


def strip_page_numbers(c: Column | str) -> Column:
    """Page number tags go with the white space around them."""
    return squeeze_blank_lines(F.regexp_replace(col(c), rf"(?Us)[{SPACE}]*<page_number>.*?</page_number>[{SPACE}]*", ""))


def strip_descriptions(c: Column | str) -> Column:
    """Fenced description blocks go."""
    return F.regexp_replace(col(c), r"(?sm)^```description\b.*?^```[^\S\n]*\n?", "")


def strip_heading_icons(c: Column | str) -> Column:
    """An icon's text in front of a heading's goes."""
    return F.regexp_replace(col(c), rf"(?dm)^(#+) \({LABEL}:[^)\n]*\) (.+)$", "$1 $2")


def strip_degree_lines(c: Column | str) -> Column:
    """Lines of a lone degree sign go."""
    return F.regexp_replace(col(c), r"(?dm)^[^\S\n]*°[^\S\n]*(?:\n|\z)", "")


def strip_part_labels(c: Column | str) -> Column:
    """Cover labels go: alone with a number or numeral, or in front of a repeated heading."""
    return F.regexp_replace(col(c), r"(?dm)^[^\S\n]*P·A·R·T(?: #.*|[^\S\n]+\S+)[^\S\n]*(?:\n|\z)", "")


def strip_placeholders(c: Column | str, keep_alt: bool = True) -> Column:
    """Image placeholders become their text, or nothing; empty-content marks go."""
    bare = F.regexp_replace(col(c), "NO_CONTENT_HERE", "")
    if keep_alt:
        bare = F.regexp_replace(bare, rf"(?U)!\[([^\]\s][^\]]*)\]\(page_\d+_(?:image_\d+_v2\.jpg|layout_\w+\.\w+)\)", rf"({LABEL}: $1)")
    return F.regexp_replace(bare, f"(?U){IMAGE}", "")


def strip_after_diagrams(c: Column | str) -> Column:
    """A placeholder right after a mermaid block repeats it and goes."""
    return F.regexp_replace(col(c), rf"(?sUm)(^```mermaid\b.*?^```[^\S\n]*\n)\s*{IMAGE}[^\S\n]*\n?", "$1")


def final_clean(c: Column | str) -> Column:
    """Check boxes become a square; caption blocks and leftover placeholders go."""
    boxes = F.regexp_replace(col(c), r'(?i)(?:<label>)?\s*<input\s+type="?checkbox"?[^>]*>', "□")
    bare = F.regexp_replace(boxes, r"(?is)<figcaption>.*?</figcaption>|</label>", "")
    return squeeze_blank_lines(F.regexp_replace(bare, r"!\[[^\]]*\]\([^)]*\)", ""))


def flatten_html_table(table: Column | str) -> Column:
    """One HTML table as pipe rows; a cell over several columns repeats."""
    rows = F.regexp_extract_all(col(table), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cell = r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>"

    def as_row(r: Column) -> Column:
        text = F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(2)), lambda v: strip(F.regexp_replace(v, r"(?i)<(?!br)[^>]+>", "")))
        shown = F.transform(text, lambda v: F.when(v == "", "-").otherwise(v))
        span = F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), lambda a: F.coalesce(F.nullif(F.regexp_extract(a, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(1)))
        # most rows span nothing: their cells are not read again for widths
        wide = F.when(r.rlike("(?i)colspan"), F.flatten(F.zip_with(shown, span, lambda v, n: F.array_repeat(v, n)))).otherwise(shown)
        return F.concat(F.lit("| "), F.array_join(wide, " | "), F.lit(" |"))

    def with_rule(body: Column) -> Column:
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.split(F.get(body, F.lit(0)), r" \| ", -1))))
        return F.when(F.size(body) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")).otherwise("")

    return bound(F.transform(rows, as_row), with_rule)


def running_lines(lines: DataFrame, least: int = 3, doc: str = "doc") -> DataFrame:
    """doc, line, n of non-blank lines that a document repeats at least `least` times."""
    rows = lines.select(doc, strip("line").alias("line")).where("line <> ''")
    return rows.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def drop_running_lines(lines: DataFrame, least: int = 3, doc: str = "doc") -> DataFrame:
    """Lines without the later occurrences of running ones."""
    same = Window.partitionBy(doc, "__s")
    rows = lines.withColumn("__s", strip("line"))
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(same), "__k": F.row_number().over(same.orderBy("pos"))})
    return rows.where((F.col("__s") == "") | (F.col("__n") < least) | (F.col("__k") == 1)).drop("__s", "__n", "__k")


def heading_runs(lines: DataFrame, least: int = 3, doc: str = "doc") -> DataFrame:
    """Lines with `listed`: first-level headings of runs, broken by nothing but blank lines, of at least
    `least`: a small table of contents embedded in the text."""
    w = Window.partitionBy(doc).orderBy("pos")
    h1 = F.col("line").rlike(rf"(?U)\A#[{SPACE}]+[^{SPACE}]")
    rows = lines.withColumns({"__h": h1, "__b": is_blank("line")})
    rows = rows.withColumn("__run", F.count_if(~F.col("__h") & ~F.col("__b")).over(w))
    size = F.count_if("__h").over(Window.partitionBy(doc, "__run"))
    return rows.withColumn("listed", F.col("__h") & (size >= least)).drop("__h", "__b", "__run")


# Chapter numerals in either spelling.
NUMERALS = {"Ⅰ": 1, "Ⅱ": 2, "Ⅲ": 3, "Ⅳ": 4, "Ⅴ": 5, "Ⅵ": 6, "Ⅶ": 7, "Ⅷ": 8, "Ⅸ": 9, "Ⅹ": 10, "I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}


def numeral_value(c: Column) -> Column:
    """The number that a numeral, or a text of digits, stands for; else null."""
    known = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    return F.coalesce(known[c], c.try_cast("int"))


def chapter_check(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, ord, numeral, part, same: the n-th chapter heading's number against the n-th part label's.
    A heading that repeats its predecessor's number is the same chapter."""
    w = Window.partitionBy(doc).orderBy("pos")
    value = lambda p: numeral_value(F.regexp_extract("line", p, 1))
    rows = lines.select(doc, "pos", value(r"\A# *([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]|[IVX]+)(?=[. ]|\z)").alias("numeral"), value(r"\AP·A·R·T \**([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]|[IVX]+|\d+)").alias("part"))

    def listed(name: str) -> DataFrame:
        seen = rows.where(F.col(name).isNotNull()).withColumn("__last", F.lag(name).over(w)).where(F.col("__last").isNull() | (F.col("__last") != F.col(name)))
        return seen.select(doc, F.row_number().over(w).alias("ord"), name)

    met = listed("numeral").join(listed("part"), [doc, "ord"], "full_outer")
    return met.withColumn("same", F.col("numeral").eqNullSafe(F.col("part")))


def broken_titles(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Lines with `part_of_title`: two to four plain lines in a row whose texts, joined, are a heading of
    the document: a cover title broken over lines."""
    w = Window.partitionBy(doc).orderBy("pos")
    plain = ~is_blank("line") & ~F.col("line").startswith("#") & ~F.col("line").startswith("|")
    rows = lines.withColumns({"__t": F.when(plain, strip("line")), "__h": F.when(F.col("line").startswith("#"), strip(F.regexp_replace("line", r"\A#+", "")))})
    titles = F.collect_set("__h").over(Window.partitionBy(doc))
    rows = rows.withColumn("__titles", titles)
    size = F.lit(0)
    for n in (2, 3, 4):
        parts = [F.lead("__t", i).over(w) if i else F.col("__t") for i in range(n)]
        whole = F.concat_ws(" ", *parts)
        full = parts[0].isNotNull()
        for part in parts[1:]:
            full = full & part.isNotNull()
        size = F.when(full & F.array_contains(F.col("__titles"), whole), n).otherwise(size)
    rows = rows.withColumn("__size", size)
    flag = F.lit(False)
    for i in range(4):
        flag = flag | ((F.lag("__size", i).over(w) if i else F.col("__size")) > i)
    return rows.withColumn("part_of_title", F.coalesce(flag, F.lit(False))).drop("__t", "__h", "__titles", "__size")


def split_headings(lines: DataFrame, doc: str = "doc", numerals: str = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX") -> DataFrame:
    """Lines with `part_of_heading`: a lone chapter numeral and the lines after it, up to three, whose
    texts, joined, are the text of the heading that follows them. With no line between, the heading
    must have the same number."""
    w = Window.partitionBy(doc).orderBy("pos")
    rows = lines.where(~is_blank("line")).withColumn("__t", strip(F.regexp_replace("line", r"\A#+", "")))
    rows = rows.withColumn("__lone", F.col("line").rlike(rf"\A# *[{numerals}]+ *\z"))
    head = F.col("line").startswith("# ")
    number = lambda c: numeral_value(F.regexp_extract(c, rf"\A([{numerals}]+)(?=[. ]|\z)", 1))
    after = F.lead("__t", 1).over(w)
    size = F.when(F.lead(head, 1).over(w) & (number(after) == number("__t")) & (F.length(after) > F.length("__t")), 1).otherwise(0)
    for n in (3, 2, 1):
        parts = F.concat_ws(" ", *(F.lead("__t", i).over(w) for i in range(1, n + 1)))
        whole, is_head = F.lead("__t", n + 1).over(w), F.lead(head, n + 1).over(w)
        size = F.when(is_head & whole.endswith(parts) & (F.length(whole) <= F.length(parts) + 5), n + 1).otherwise(size)
    rows = rows.withColumn("__size", F.when(F.col("__lone"), size).otherwise(0))
    back = [F.coalesce(F.lag("__size", i).over(w), F.lit(0)) > i for i in range(4)]
    flag = back[0] | back[1] | back[2] | back[3]
    marks = rows.select(doc, "pos", flag.alias("part_of_heading")).where("part_of_heading")
    return lines.join(marks, [doc, "pos"], "left").withColumn("part_of_heading", F.coalesce("part_of_heading", F.lit(False)))


def headings_in_tables(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Lines with `in_table`: a first-level heading between table rows that repeats an earlier one."""
    w = Window.partitionBy(doc).orderBy("pos")
    rows = lines.where(~is_blank("line"))
    bar = F.col("line").startswith("|")
    again = F.row_number().over(Window.partitionBy(doc, "line").orderBy("pos")) > 1
    rows = rows.withColumns({"__near": F.coalesce(F.lag(bar).over(w) & F.lead(bar).over(w), F.lit(False)), "__again": again})
    marks = rows.where(F.col("line").startswith("# ") & F.col("__near") & F.col("__again")).select(doc, "pos", F.lit(True).alias("in_table"))
    return lines.join(marks, [doc, "pos"], "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def repeated_headings(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Lines with `repeated`: a heading that says what the heading before it said."""
    w = Window.partitionBy(doc).orderBy("pos")
    heads = lines.where(F.col("line").startswith("#")).withColumn("__was", F.lag("line").over(w))
    marks = heads.where(strip("line") == strip("__was")).select(doc, "pos", F.lit(True).alias("repeated"))
    return lines.join(marks, [doc, "pos"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


# How the lines of a printed page's footer block begin (printed by, signed by, certified copy).
FOOTERS = ["출력자", "전자서명자", "원본대조필"]


def repeated_footers(lines: DataFrame, labels: list[str] = FOOTERS, doc: str = "doc") -> DataFrame:
    """Lines with `footer`: lines of a footer block, whatever stands behind the label, after the first line
    with that label in the document."""
    label = F.regexp_extract("line", rf"(?U)\A[{SPACE}]*({'|'.join(labels)})", 1)
    rows = lines.select(doc, "pos", label.alias("__label")).where("__label <> ''")
    nth = F.row_number().over(Window.partitionBy(doc, "__label").orderBy("pos"))
    marks = rows.withColumn("__n", nth).where("__n > 1").select(doc, "pos", F.lit(True).alias("footer"))
    return lines.join(marks, [doc, "pos"], "left").withColumn("footer", F.coalesce("footer", F.lit(False)))


def cover_headings(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Lines with `on_cover`: a first-level heading whose text the next first-level heading repeats. The
    chapter's cover and its body have the same heading; dropping the first merges them."""
    w = Window.partitionBy(doc).orderBy("pos")
    heads = lines.where(F.col("line").startswith("# ")).withColumn("__t", strip(F.regexp_replace("line", r"\A#+", "")))
    marks = heads.withColumn("__next", F.lead("__t").over(w)).where("__t = __next").select(doc, "pos", F.lit(True).alias("on_cover"))
    return lines.join(marks, [doc, "pos"], "left").withColumn("on_cover", F.coalesce("on_cover", F.lit(False)))


def needs_enrichment(c: Column | str) -> Column:
    """Whether a text holds figure captions, whose content a reader has to work into the body."""
    return col(c).rlike(r"(?is)<figcaption>.*?</figcaption>")


def clean(c: Column | str) -> Column:
    """All text rules, in order."""
    for rule in (strip_descriptions, strip_after_diagrams, strip_placeholders, strip_part_labels, strip_heading_icons, strip_degree_lines, strip_page_numbers, final_clean):
        c = rule(c)
    return c
