"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir) and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, table
from .decontaminate import decontaminate
from .language import UNKNOWN, fit, held_out, identify, lettered
from .ngram_join import without_near_copies
from .packing import pack_documents
from .pii import find_pii

#: The column in which the language stage keeps its prediction before it is used.
PREDICTED = "_predicted_language"
#: Spans of a lower score stay: such as a version number that has the form of an address.
REDACTED = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go: null texts and texts without a letter. The language of the others is
    predicted; it fills lang where that is null, and a given lang stays. Documents without any label teach nothing; then all
    texts with a letter stay, with the lang they have. Repeated rows, null ids and extra columns stay as they are."""
    importable(spark)
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    told = F.coalesce("lang", F.when(F.col(PREDICTED) != UNKNOWN, F.col(PREDICTED))).alias("lang")
    found = identify(docs, model, predicted=PREDICTED, score=f"{PREDICTED}_score")
    kept = found.where(F.col(PREDICTED) != UNKNOWN) if model.languages else docs.where(lettered(F.col("text"))).withColumn(PREDICTED, F.lit(UNKNOWN))
    return kept.select(*[told if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the smallest doc_id. Null and empty texts, and texts without
    a word, are copies of nothing and stay; a null id comes after all others. Extra columns stay."""
    importable(spark)
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null, empty and wordless texts hold none and stay, as does everything
    where the benchmark is empty; repeated rows and extra columns are kept alike."""
    importable(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data and secrets whose score, after the words about them, is REDACTED or more give way to
    their kind in angle brackets, and n_chars follows. Null texts keep their n_chars; extra columns stay."""
    importable(spark)
    found = find_pii(docs, redact=REDACTED)
    new = {"text": F.col("pii_redacted"), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("pii_redacted").cast("long"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. A null or empty text is its end token alone;
    rows of equal or null id are documents of their own."""
    importable(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
