"""Line normaliser for converted Markdown: drops, heading levels, promotions, blank lines.

The rules are sequential in meaning: some look at the line emitted before, some at the raw line after.
Here each becomes a flag from windows over one ordering, so that a single exchange on the document and
a single sort serve all rules, and a line takes the first rule that fits it.

Input lines: doc, pos, line and, optionally, terminated (false for a last line without a line feed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, is_blank, lines_read, strip

# Numerals that mark a chapter, ordinals of lower levels.
CHAPTERS = ["Ⅰ", "Ⅱ", "Ⅲ", "Ⅳ", "Ⅴ", "Ⅵ", "Ⅶ", "Ⅷ", "Ⅸ", "Ⅹ"]
APPENDIX = "부록"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
SYLLABLES = "가나다라마바사아자차카타파하"
LOOK_AHEAD = 49


def to_lines(docs: DataFrame, doc: str = "doc", markdown: str = "markdown") -> DataFrame:
    """doc, pos, line, terminated."""
    lines = lines_read(markdown)
    out = docs.where(F.col(markdown).isNotNull()).select(doc, F.posexplode(lines).alias("pos", "line"), F.size(lines).alias("__n"), F.col(markdown).endswith("\n").alias("__t"))
    return out.select(doc, "pos", "line", (F.col("__t") | (F.col("pos") < F.col("__n") - 1)).alias("terminated"))


def heading_level(content: Column) -> Column:
    """Level of a sixth-level heading by its numbering; null for a line of a table of contents."""
    roman = "|".join(CHAPTERS)
    return (
        F.when(content.contains("·" * 4) | content.contains("…" * 4), F.lit(None).cast("int"))
        .when(content.rlike(rf"(?U)^({roman})[.{SPACE}]"), 1)
        .when(content == "목차", 1)
        .when(content.rlike(rf"^[\[〔]?{APPENDIX}"), 1)
        .when(content.startswith("참고문헌"), 1)
        .when(content.rlike(rf"(?U)^[<〈]?(표|그림)[{SPACE}]*목차"), 2)
        .when(content.rlike(rf"(?U)^\d+\.[{SPACE}]"), 2)
        .when(content.rlike(rf"(?U)^\d+\)[{SPACE}]"), 3)
        .when(content.rlike(rf"(?U)^\(\d+\)[{SPACE}]"), 4)
        .when(content.rlike(f"^[{CIRCLED}]"), 5)
        .when(content.rlike(rf"(?U)^[{SYLLABLES}]\.[{SPACE}]"), 5)
        .otherwise(3)
    )


def promoted_level(text: Column) -> Column:
    """Level of a free-standing numbered line, or null."""
    short = F.length(text) < 60
    level = (
        F.when(text.rlike(rf"(?U)^\d+\)[{SPACE}]+[^{SPACE}]"), 3)
        .when(text.rlike(rf"(?U)^\(\d+\)[{SPACE}]+[^{SPACE}]"), 4)
        .when(text.rlike(rf"(?U)^[{CIRCLED}][{SPACE}]") & short, 5)
        .when(text.rlike(rf"(?U)^[{SYLLABLES}]\.[{SPACE}]") & short, 5)
    )
    return F.when(~text.startswith("#") & ~text.startswith("|") & (F.length(text) < 80), level)


def normalize(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, pos, line, rule, level, text: every input line with the rule it took; text is null for
    lines that are dropped. Rules: page_sep, page_comment, image, cover, cover_body, title_repeat, h6,
    promoted, kept, blank_compressed, leading_blank."""
    c = F.col
    w = Window.partitionBy(doc).orderBy("pos")
    so_far, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, LOOK_AHEAD)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    term = c("terminated") if "terminated" in lines.columns else F.lit(True)
    chapter = "|".join([*CHAPTERS, APPENDIX])

    s = lines.select(doc, "pos", "line", strip("line").alias("s"), is_blank("line").alias("blank"), term.alias("__term"))
    # a bare heading mark at a line end is a heading with an empty text
    second = rf"(?Ud)\A##(?:[{SPACE}]+(.*))?\z"
    is_second = c("line").rlike(rf"(?U)\A##[{SPACE}]") | ((c("line") == "##") & c("__term"))
    is_sixth = c("line").rlike(rf"(?U)\A######[{SPACE}]") | ((c("line") == "######") & c("__term"))
    s = s.withColumns(
        {
            "drop": F.when(c("s") == "---", "page_sep")
            .when(c("s").rlike(rf"(?U)\A<!--[{SPACE}]*Page[{SPACE}]+\d+"), "page_comment")
            .when(c("s").rlike(r"\A!\[") | c("s").rlike(r"\A<fig(ure|caption)"), "image"),
            "numeral": F.regexp_extract("s", rf"(?U)\A#[{SPACE}]+({chapter})\z", 1),
            "starts": F.regexp_extract("s", rf"\A###### ({chapter})\.", 1),
            "border": (c("s") == "---") | c("s").rlike(rf"(?U)\A#{{1,6}}[{SPACE}]"),
            "title": F.when(is_second, strip(F.regexp_extract("line", second, 1))),
            "sixth": F.when(is_sixth, strip(F.regexp_replace("line", r"\A######", ""))),
        }
    )
    s = s.withColumns(
        {
            "doc_title": F.first("title", ignorenulls=True).over(whole),
            "cover": (c("numeral") != "") & F.array_contains(F.collect_list(F.when(c("starts") != "", c("starts"))).over(ahead), c("numeral")),
            "next_blank": F.coalesce(F.lead("blank").over(w), F.lit(True)),
        }
    )
    # a cover takes everything up to the next border with it; a border ends what came before
    s = s.withColumn("in_cover", F.coalesce(F.last(F.when(c("border"), c("cover")), ignorenulls=True).over(so_far), F.lit(False)))
    gone = F.when(c("in_cover"), F.when(c("cover"), "cover").otherwise("cover_body")).otherwise(c("drop"))
    s = s.withColumn("gone", gone)
    s = s.withColumn("prev_blank", F.coalesce(F.last(F.when(c("gone").isNull(), c("blank")), ignorenulls=True).over(earlier), F.lit(True)))
    alone = c("prev_blank") & c("next_blank")
    level6, level7 = heading_level(c("sixth")), promoted_level(c("s"))
    rule = (
        F.when(c("gone").isNotNull(), c("gone"))
        .when((c("doc_title") != "") & (c("s") == c("doc_title")) & alone, "title_repeat")
        .when(c("sixth").isNotNull() & level6.isNotNull(), "h6")
        .when(~c("blank") & alone & level7.isNotNull(), "promoted")
        .otherwise("kept")
    )
    s = s.withColumn("rule", rule).withColumn("level", F.when(c("rule") == "h6", level6).when(c("rule") == "promoted", level7))
    stays = c("rule").isin("h6", "promoted", "kept")
    s = s.withColumn("rn", F.count_if(stays).over(so_far))
    s = s.withColumn("full", F.last(F.when(stays & ~c("blank"), c("rn")), ignorenulls=True).over(so_far))
    empty = stays & c("blank") & (c("rule") == "kept")
    final = F.when(empty & (c("rn") - F.coalesce("full", F.lit(0)) > 2), "blank_compressed").when(empty & c("full").isNull(), "leading_blank").otherwise(c("rule"))
    mark = F.concat(F.repeat(F.lit("#"), c("level")), F.lit(" "))
    text = F.when(c("rule") == "h6", F.concat(mark, c("sixth"))).when(c("rule") == "promoted", F.concat(mark, c("s"))).when(final == "kept", c("line"))
    return s.select(doc, "pos", "line", final.alias("rule"), "level", text.alias("text"))


def statistics(normalized: DataFrame, doc: str = "doc") -> DataFrame:
    """Counters of each document; the exchange of normalize() serves this grouping too."""
    names = ["page_sep", "page_comment", "image", "cover", "title_repeat", "h6", "promoted", "blank_compressed"]
    return normalized.groupBy(doc).agg(
        F.count(F.lit(1)).alias("in_lines"), F.count("text").alias("out_lines"), *(F.count_if(F.col("rule") == n).alias(n) for n in names)
    )


def assemble(normalized: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, markdown from the lines that stay."""
    rows = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))))
    return normalized.groupBy(doc).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), F.when(F.count("text") > 0, "\n").otherwise("")).alias("markdown"))
