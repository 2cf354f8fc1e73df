"""Readers for Markdown and binary documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfuse.functions.text import extension, stem, universal
from markfuse.sources import registry


def read_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, base, parser (by the file name's last token), markdown with line feeds only."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), universal("value").alias("markdown"))
    name = stem("path")
    tokens = "|".join(registry.FILE_TOKENS.values())
    return raw.select("path", F.regexp_replace(name, f"_({tokens})$", "").alias("base"), F.nullif(F.regexp_extract(name, f"_({tokens})$", 1), F.lit("")).alias("parser"), "markdown")


def read_binary(spark: SparkSession, path: str | list[str], extensions: Sequence[str] | None = None, content: bool = True) -> DataFrame:
    """path, size_bytes, ext, format (null where unknown) and content, of the files right in the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    out = files.select("path", F.col("length").alias("size_bytes"), extension("path").alias("ext"), *(["content"] if content else []))
    if extensions is not None:
        out = out.where(F.col("ext").isin(*[e.lower() for e in extensions]))
    kinds = registry.formats(spark)
    return out.join(F.broadcast(kinds), "ext", "left")


def discover(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """Paths in a folder with one of the extensions, sorted."""
    return read_binary(spark, path, extensions, content=False).select("path").orderBy("path")


def unsupported(files: DataFrame) -> DataFrame:
    return files.where("format IS NULL")


def parsers_for(files: DataFrame) -> DataFrame:
    """files by parser that reads their format."""
    return files.join(F.broadcast(registry.format_support(files.sparkSession)), "format")


def parsers_for_extension(files: DataFrame) -> DataFrame:
    """files (ext) by parser that takes their extension, known format or not."""
    return files.join(F.broadcast(registry.extension_support(files.sparkSession)), "ext")


def readable_by(files: DataFrame, parser: str) -> DataFrame:
    kinds = registry.format_support(files.sparkSession).where(F.col("parser") == parser)
    return files.join(F.broadcast(kinds.select("format")), "format", "left_semi")


def read_alt_maps(spark: SparkSession, path: str, doc_type: str = "string", doc: str = "doc") -> DataFrame:
    """doc, placeholder, page, image_index, en_alt, ko_alt of saved maps, for alt.inject() without a service."""
    entry = "struct<page:int,image_index:int,en_alt:string,ko_alt:string>"
    rows = spark.read.schema(f"`{doc}` {doc_type}, map map<string,{entry}>").json(path)
    return rows.select(doc, F.explode("map").alias("placeholder", "e")).select(doc, "placeholder", "e.*")


def reusable(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose content some earlier run has parsed: done has content_sha256."""
    return files.withColumn("content_sha256", F.sha2("content", 256)).join(done.select("content_sha256"), "content_sha256", "left_semi")
