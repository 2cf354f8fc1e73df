"""Character and word error of candidate transcripts against a verified one.

Canon and candidates meet in one grouping by document and item, so no label multiplies the canon and
there is one exchange whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, bound, clean_body, edit_scores, error_rate, normalise_transcript
from markfuse.session import ship

ID_PATTERN = rf"^##[{SPACE}]*학번[{SPACE}]*[:：][{SPACE}]*(\d{{5}})"
CANON = "canon"


def parse_items(transcripts: DataFrame, id_pattern: str = ID_PATTERN, doc: str = "doc", markdown: str = "markdown") -> DataFrame:
    """label, doc, item_id, body from Markdown that an item header precedes each item in; of items with
    the same id the last counts. The pattern's first group is the id."""
    p = f"(?Udm){id_pattern}"
    ids = F.regexp_extract_all(F.col(markdown), F.lit(p), F.lit(1))
    # the pattern goes over a text twice; a filter on ids, or parts named twice, would send it again
    groups = bound(F.split(F.col(markdown), p, -1), lambda parts: F.zip_with(ids, F.slice(parts, 2, F.size(parts)), lambda i, b: F.struct(i.alias("id"), b.alias("b"))))
    rows = transcripts.select("label", doc, F.posexplode(groups).alias("n", "g"))
    last = rows.groupBy("label", doc, F.col("g.id").alias("item_id")).agg(F.max_by("g.b", "n").alias("chunk"))
    # the rest of the header line is no body
    rest = F.when(F.col("chunk").contains("\n"), F.substr("chunk", F.instr("chunk", F.lit("\n")) + 1)).otherwise("")
    return last.select("label", doc, "item_id", normalise_transcript(clean_body(rest)).alias("body"))


def paired(items: DataFrame, labels: Sequence[str], doc: str = "doc") -> DataFrame:
    """doc, item_id, label, ref, hyp, of every item and candidate; ref or hyp is null where the item is
    missing there. labels: the candidates, in order of precedence; a parameter, not data."""
    got = F.map_from_entries(F.collect_list(F.struct("label", "body")))
    met = items.groupBy(doc, "item_id").agg(got.alias("m"))
    return met.select(doc, "item_id", F.col("m")[CANON].alias("ref"), F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col("m")[x].alias("hyp")) for x in labels))).alias("c")).select(
        doc, "item_id", "c.label", "ref", "c.hyp"
    )


def score_items(pairs: DataFrame, doc: str = "doc", with_words: bool = True) -> DataFrame:
    """doc, label, item_id, ref_len, dist, dist_folded, cer and, with words, ref_words, word_dist, wer,
    for every item of the canon; a missing hypothesis is empty."""
    ship(pairs.sparkSession)
    hyp = F.coalesce("hyp", F.lit(""))
    rows = pairs.where("ref IS NOT NULL").select(doc, "label", "item_id", "ref", hyp.alias("hyp"))
    n, m = F.length("ref").cast("long"), F.length("hyp").cast("long")
    # distances in a step of their own: the rates take them again
    rows = rows.withColumn("__e", edit_scores("ref", "hyp", with_words))
    e = lambda c: F.col(f"__e.{c}")
    out = [n.alias("ref_len"), e("dist").alias("dist"), e("folded").alias("dist_folded"), error_rate(e("dist"), n, m).alias("cer")]
    if with_words:
        k = e("a_words")
        out += [k.alias("ref_words"), e("word_dist").alias("word_dist"), error_rate(e("word_dist"), k, e("b_words")).alias("wer")]
    return rows.select(doc, "label", "item_id", *out)


def summarise(scores: DataFrame) -> DataFrame:
    """One row a label; items with an empty reference do not count. Accuracies in per cent: micro by
    sums, macro by averages; only the macro word accuracy is floored at 0."""
    full = scores.where("ref_len > 0").groupBy("label")
    sums = full.agg(
        *(F.sum(c).alias(f"sum_{c}") for c in ("dist", "dist_folded", "ref_len", "word_dist", "ref_words")), F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.count(F.lit(1)).alias("items")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, (F.lit(1.0) - F.col(a) / F.col(b)) * 100).otherwise(0.0)
    return sums.select(
        "*",
        ratio("sum_dist", "sum_ref_len").alias("char_acc_micro"),
        ratio("sum_dist_folded", "sum_ref_len").alias("char_acc_micro_folded"),
        ratio("sum_word_dist", "sum_ref_words").alias("word_acc_micro"),
        ((F.lit(1.0) - F.col("mean_cer")) * 100).alias("char_acc_macro"),
        F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("mean_wer")) * 100).alias("word_acc_macro"),
    )


def best(summary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The label of the highest micro character accuracy, the first of equal ones."""
    order = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("label"))
    return summary.agg(F.max_by("label", F.struct("char_acc_micro", -order)).alias("label"), F.max("char_acc_micro").alias("char_acc_micro"))


def mismatched(pairs: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, label, item_id, side: missing in the candidate, or extra there."""
    side = F.when(F.col("hyp").isNull() & F.col("ref").isNotNull(), "missing").when(F.col("ref").isNull() & F.col("hyp").isNotNull(), "extra")
    return pairs.select(doc, "label", "item_id", side.alias("side")).where("side IS NOT NULL")
