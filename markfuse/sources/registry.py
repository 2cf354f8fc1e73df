"""Static tables: formats, parsers, strategies, prices. All are constants of a few dozen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> format.
FORMATS = {
    ".pdf": "pdf",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".hwp": "hwp",
    ".hwpx": "hwpx",
    ".docx": "docx",
    ".pptx": "pptx",
    ".xlsx": "xlsx",
}

# Fixed values: (ruleset, format, tier) -> parsers in order.
STRATEGY = [
    ("code", "pdf", "small", ["gemini"]),
    ("code", "pdf", "medium", ["upstage", "gemini"]),
    ("code", "pdf", "large", ["opendataloader", "upstage"]),
    ("code", "pdf", "xlarge", ["opendataloader", "upstage"]),
    ("code", "hwpx", "hwpx", ["hwpx_local"]),
    ("code", "hwp", "hwpx", ["upstage"]),
    ("code", "docx", "small", ["upstage", "llamaparse"]),
    ("code", "docx", "medium", ["upstage", "llamaparse"]),
    ("code", "pptx", "small", ["upstage", "llamaparse"]),
    ("code", "pptx", "medium", ["upstage", "llamaparse"]),
    ("code", "xlsx", "small", ["upstage", "llamaparse"]),
    ("code", "xlsx", "medium", ["upstage", "llamaparse"]),
    ("code", "image", "small", ["upstage", "gemini"]),
    ("code", "image", "medium", ["upstage", "gemini"]),
    ("doc", "pdf", "small", ["gemini"]),
    ("doc", "pdf", "medium", ["llamaparse", "upstage"]),
    ("doc", "pdf", "large", ["llamaparse", "opendataloader"]),
    ("doc", "pdf", "xlarge", ["llamaparse", "opendataloader"]),
    ("doc", "hwpx", "any", ["hwpx_local"]),
    ("doc", "hwp", "any", ["hwpx_local"]),
    ("doc", "docx", "any", ["upstage", "llamaparse"]),
    ("doc", "pptx", "any", ["upstage", "llamaparse"]),
    ("doc", "xlsx", "any", ["upstage", "llamaparse"]),
    ("doc", "image", "any", ["upstage", "gemini"]),
    ("doc_scan", "pdf", "small", ["gemini"]),
    ("doc_scan", "pdf", "medium", ["llamaparse", "upstage"]),
    ("doc_scan", "pdf", "large", ["llamaparse", "upstage", "mistral"]),
    ("doc_scan", "pdf", "xlarge", ["llamaparse", "upstage", "mistral"]),
    ("doc_scan_table", "pdf", "any", ["upstage", "mistral", "llamaparse"]),
    ("doc_cross_table", "pdf", "any", ["gvision", "llamaparse", "upstage"]),
    ("doc_cross_table", "image", "any", ["gvision", "llamaparse", "upstage"]),
    ("doc_exam", "pdf", "any", ["gemini", "upstage", "opendataloader"]),
]

# Parser -> formats it reads.
FORMAT_SUPPORT = {
    "hwpx_local": ["hwpx"],
    "upstage": ["pdf", "image", "hwpx", "hwp", "docx", "pptx", "xlsx"],
    "gemini": ["pdf", "image"],
    "llamaparse": ["pdf", "image", "docx", "pptx", "xlsx"],
    "mistral": ["pdf", "image", "docx", "pptx"],
    "opendataloader": ["pdf"],
    "corepin": ["pdf", "image", "hwp", "hwpx", "docx", "pptx", "xlsx"],
    "gvision": ["pdf", "image"],
}

# Parser -> extensions it takes besides those of its formats.
MORE_EXTENSIONS = {
    "llamaparse": [".gif", ".bmp", ".tiff", ".tif", ".doc", ".ppt", ".xls", ".html", ".htm", ".txt", ".csv", ".rtf", ".epub"],
    "corepin": [".hwpml", ".xls", ".heic", ".tif", ".tiff", ".webp", ".bmp", ".html", ".epub", ".rtf", ".csv", ".tsv", ".md", ".txt"],
}

# Parser -> alternatives, each the environment variables it needs together.
PARSER_KEYS = {
    "hwpx_local": [],
    "opendataloader": [],
    "upstage": [["UPSTAGE_API_KEY"]],
    "gemini": [["GEMINI_API_KEY"]],
    "llamaparse": [["LLAMAPARSE_API_KEY"]],
    "mistral": [["MISTRAL_API_KEY"]],
    "corepin": [["COREPIN_API_KEY"]],
    "gvision": [["GOOGLE_VISION_API_KEY"], ["GV_TOKEN", "GV_PROJECT"]],
}

# Parser -> token in file names.
FILE_TOKENS = {
    "llamaparse": "llamaparse",
    "upstage": "upstage",
    "gemini": "gemini",
    "mistral": "mistral",
    "opendataloader": "opendataloader",
    "hwpx_local": "hwpxlocal",
    "corepin": "corepin",
    "gvision": "gvision",
}

# Plan -> credits a page.
CREDITS = {"fast": 1, "cost_effective": 3, "agentic": 10, "agentic_plus": 45}


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATS.items()), "ext string, format string")


def strategy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGY, "ruleset string, format string, tier string, parsers array<string>")


def format_support(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, f) for p, fs in FORMAT_SUPPORT.items() for f in fs], "parser string, format string")


def extension_support(spark: SparkSession) -> DataFrame:
    """parser, ext: every extension a parser takes."""
    own = [(p, e) for p, fs in FORMAT_SUPPORT.items() for e, f in FORMATS.items() if f in fs]
    return spark.createDataFrame(own + [(p, e) for p, es in MORE_EXTENSIONS.items() for e in es], "parser string, ext string")


def parser_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARSER_KEYS.items()), "parser string, keys array<array<string>>")


def file_token(parser: Column) -> Column:
    """The parser's token in file names; an unknown parser keeps its name."""
    out = parser
    for name, token in FILE_TOKENS.items():
        if name != token:
            out = F.when(parser == name, F.lit(token)).otherwise(out)
    return out


def readiness(spark: SparkSession, names: list[str], installed: list[str] | None = None) -> DataFrame:
    """parser, status (usable, key_needed, install) for the environment variables that are set and the
    parsers whose package is installed (default: all)."""
    env = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    p = parser_registry(spark)
    keyed = (F.size("keys") == 0) | F.exists("keys", lambda k: F.forall(k, lambda x: F.array_contains(env, x)))
    here = F.lit(True) if installed is None else F.col("parser").isin(installed)
    return p.select("parser", F.when(~here, "install").when(keyed, "usable").otherwise("key_needed").alias("status"))


def readiness_summary(ready: DataFrame) -> DataFrame:
    return ready.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
