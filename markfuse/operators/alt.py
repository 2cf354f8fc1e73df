"""Image placeholders: extraction, numbering, alternative texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.functions.text import HANGUL, col, strip

# Both shapes of placeholder; groups: alt, page, image number (empty for layout images).
IMAGE = r"!\[([^\]]*)\]\(page_(\d+)_(?:image_(\d+)_v2\.jpg|layout_\w+\.\w+)\)"
LAYOUT_FROM = 1000
LABEL = "이미지"  # fixed value


def is_mostly_hangul(text: Column | str) -> Column:
    """At least half of the stripped length; false for an empty text."""
    t = col(text)
    return (t != "") & (F.length(F.regexp_replace(t, f"[^{HANGUL}]", "")) * 2 >= F.length(strip(t)))


def extract_images(docs: DataFrame, doc: str = "doc", markdown: str = "markdown", skip_hangul: bool = False) -> DataFrame:
    """doc, page, image_index, match_pos, alt, placeholder. Layout images have no number of their own
    and count from 1000 within their page, skipped ones included."""
    group = lambda i: F.regexp_extract_all(F.col(markdown), F.lit(f"(?U){IMAGE}"), F.lit(i))
    zipped = F.arrays_zip(group(0).alias("m"), group(1).alias("alt"), group(2).alias("page"), group(3).alias("idx"))
    rows = docs.select(doc, F.posexplode(zipped).alias("match_pos", "z")).select(
        doc, "match_pos", F.col("z.page").cast("int").alias("page"), F.col("z.alt").alias("alt"), F.col("z.m").alias("placeholder"), F.nullif(F.col("z.idx"), F.lit("")).cast("int").alias("idx")
    )
    w = Window.partitionBy(doc, "page").orderBy("match_pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce("idx", F.lit(LAYOUT_FROM - 1) + F.count_if(F.col("idx").isNull()).over(w)).cast("int")
    out = rows.select(doc, "page", number.alias("image_index"), "match_pos", "alt", "placeholder")
    return out.where(~is_mostly_hangul("alt")) if skip_hangul else out


def answer_to_map(answers: DataFrame, images: DataFrame, doc: str = "doc") -> DataFrame:
    """Service answers (doc, page, index from 1, alt) as alt_map rows: doc, placeholder, page,
    image_index, en_alt, ko_alt. Answers without a text, or out of a page's range, are rejected; of
    several for one placeholder the last by page and index counts."""
    w = Window.partitionBy(doc, "page").orderBy("image_index", "match_pos")
    listed = images.withColumn("index", F.row_number().over(w))
    good = answers.select(doc, "page", "index", strip("alt").alias("ko_alt")).where("index IS NOT NULL AND ko_alt <> ''")
    met = listed.join(good, [doc, "page", "index"])
    last = F.max_by(F.struct("page", "image_index", F.col("alt").alias("en_alt"), "ko_alt"), F.struct("page", "index"))
    return met.groupBy(doc, "placeholder").agg(last.alias("x")).select(doc, "placeholder", "x.*")


def json_answers(body: Column | str) -> Column:
    """array<struct<index, alt>> from the JSON array within a free text; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(col(body), r"(?s)\[.*\]", 0), F.lit("")), "array<struct<index:int,alt:string>>")


def inject(docs: DataFrame, alt_map: DataFrame, doc: str = "doc", markdown: str = "markdown", keep_unmapped: bool = True) -> DataFrame:
    """docs with the placeholders replaced, plus replaced and unmapped counts. The map (doc, placeholder,
    ko_alt) is gathered by document, so texts meet it in one join."""
    per_doc = alt_map.groupBy(doc, "placeholder").agg(F.max("ko_alt").alias("ko_alt")).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "ko_alt"))).alias("__m"))
    met = docs.join(per_doc, doc, "left")
    t = F.col(markdown)
    found = F.regexp_extract_all(t, F.lit(f"(?U){IMAGE}"), F.lit(0))
    alts = F.regexp_extract_all(t, F.lit(f"(?U){IMAGE}"), F.lit(1))
    rest = F.split(t, f"(?U){IMAGE}", -1)
    known = lambda m: F.col("__m")[m]
    own = lambda a: F.when(strip(a) != "", F.concat(F.lit(f"({LABEL}: "), strip(a), F.lit(")"))).otherwise("") if keep_unmapped else F.lit("")
    new = F.zip_with(found, alts, lambda m, a: F.when(known(m).isNotNull(), F.concat(F.lit(f"({LABEL}: "), known(m), F.lit(")"))).otherwise(own(a)))
    whole = F.array_join(F.flatten(F.zip_with(rest, F.concat(new, F.array(F.lit(""))), lambda r, n: F.array(r, n))), "")
    hits = F.size(F.filter(found, lambda m: known(m).isNotNull()))
    return met.select(*(whole.alias(c) if c == markdown else F.col(f"`{c}`") for c in docs.columns), hits.alias("replaced"), (F.size(found) - hits).alias("unmapped"))
