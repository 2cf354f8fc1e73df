"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. run(spark, sf_dir) applies them to documents. Learned language
models and piece vocabularies have no SQL form, so ORACLE_SQL is None and the tests compare each stage
with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfuse.llm import exact, langid, minhash, mixing, pieces
from markfuse.llm.common import read, stage
from markfuse.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose two nearest codewords are as good as tied (texts in
    two languages by halves); the predicted language fills a missing `lang`."""
    model = langid.learn(docs)
    if not model.langs:  # no labels to learn from: only documents without a letter are rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # the text goes through the workers once; a text that is kept has letters, so it was not null
    own = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c != "text"}
    found = langid.predict(docs, model, extra=own, with_text=True).where((F.col("lang_pred") != langid.NOTHING) & ~F.col("ambiguous"))
    back = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)} | {"text": F.col("judged_text")}
    back["lang"] = F.coalesce(back["lang"], F.col("lang_pred"))
    return found.select(*(v.alias(c) for c, v in back.items()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    return minhash.drop_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: rows of large sources are thinned, those of small ones repeated."""
    return mixing.mix(docs, evenness=0.5, max_repeats=4.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, pieces, round_trip (decoding gives the text back)."""
    out = pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep=("lang", "source"), check=True)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
