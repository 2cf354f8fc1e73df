"""Sinks: outputs by parser, JSON reports, Markdown reports, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_outputs(outputs: DataFrame, path: str, mode: str = "overwrite", stage: str | None = None) -> None:
    """Parquet by parser; one row a document. With a stage (parsed, fused, ...), by stage first: intermediate
    results lie beside the final ones and are never moved."""
    rows = outputs if stage is None else outputs.withColumn("stage", F.lit(stage))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic" if stage else "static").partitionBy(*(["stage"] if stage else []), "parser").parquet(path)


def write_alt_maps(alt_map: DataFrame, path: str, doc: str = "doc", mode: str = "overwrite") -> None:
    """One JSON object a document, placeholder -> page, image_index, en_alt, ko_alt, as lines of doc and map."""
    entry = F.struct("placeholder", F.struct("page", "image_index", "en_alt", "ko_alt"))
    alt_map.groupBy(doc).agg(F.map_from_entries(F.collect_list(entry)).alias("map")).write.mode(mode).json(path)


def write_texts(rows: DataFrame, path: str, text: str = "content", by: str = "file_name", mode: str = "overwrite") -> None:
    """Texts as files below one folder for each name: path/name=<name>/part-*.txt."""
    rows.select(F.col(by).alias("name"), F.col(text).alias("value")).write.mode(mode).partitionBy("name").option("lineSep", "\n").text(path)


def as_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def compare_report(profiles: DataFrame, advice: DataFrame, samples: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, report: JSON with the profiles, the number of gaps, the first ten and the recommendation."""
    side = F.struct("role", "file", "exists", "lines", "chars", "headings", "tables")
    p = profiles.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("sec_ord", side.alias("profile")))).alias("outputs"))
    met = p.join(advice, doc).join(samples, doc, "left")
    return met.select(doc, as_json(F.transform("outputs", lambda o: o["profile"]).alias("outputs"), "gap_count", "gaps_sample", "recommendation").alias("report"))


def score_report(items: DataFrame, summary: DataFrame) -> DataFrame:
    """label, report: a Markdown table of items in order of id, then the totals of the label."""
    row = F.concat(F.lit("| "), F.col("item_id"), F.lit(" | "), F.col("ref_len").cast("string"), F.lit(" | "), F.format_string("%.1f", (1 - F.col("cer")) * 100), F.lit(" | "), F.format_string("%.1f", F.greatest(F.lit(0.0), (1 - F.col("wer")) * 100)), F.lit(" |"))
    rows = items.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = "| item | length | char_acc_pct | word_acc_pct |\n|---|---:|---:|---:|\n"
    total = F.format_string("\n\nmicro: characters %.2f%%, folded %.2f%%, words %.2f%%; macro: characters %.2f%%, words %.2f%%\n", "char_acc_micro", "char_acc_micro_folded", "word_acc_micro", "char_acc_macro", "word_acc_macro")
    return rows.join(summary, "label").select("label", F.concat(F.lit(head), F.array_join("rows", "\n"), total).alias("report"))


def target_report(targets: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, report: the divergences and low-confidence words of each page, in order."""
    some = lambda a: F.when(F.size(a) > 0, F.array_join(a, " ")).otherwise("∅")
    items = F.transform("divergences", lambda d: F.concat(F.lit("- ["), d["tag"], F.lit("] `"), some(d["llm"]), F.lit("` / `"), some(d["ocr"]), F.lit("`"), F.when(d["context"] != "", F.concat(F.lit(" after "), d["context"])).otherwise("")))
    low = F.array_join(F.transform("low", lambda w: F.format_string("%s(%.2f)", w["word"], w["confidence"])), ", ")
    text = F.concat(F.lit("## "), F.col("page"), F.lit("\n"), F.array_join(items, "\n"), F.when(F.size("low") > 0, F.concat(F.lit("\n- low: "), low)).otherwise(""))
    pages = targets.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("idx", text.alias("t")))).alias("p"), F.max(F.col("n_llm") != F.col("n_ocr")).alias("uneven"))
    note = F.when(F.col("uneven"), "> page numbers differ; paired from the front\n\n").otherwise("")
    return pages.select(doc, F.concat(note, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("report"))
