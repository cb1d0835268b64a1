"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all
but the last return the columns they were given.  Texts may be null or empty, rows repeated, ids
null and further columns named like anything; empty tables pass through as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, neardup, packing, substrings
from quillon.llm.queries import vocabulary
from quillon.llm.shared import kept, row_key, ship, table

#: Near duplicates share this percentage of their five-word shingles.
NEAR = 80
#: A text whose score lies below is in none of the languages learned: prose of theirs, however short or noisy,
#: scores some 0.4 and more, other alphabets 0.
IN_NONE = 0.1


def _wrapped(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and the whole document as ``_doc``, so that no column name can clash."""
    return docs.select(row_key().alias("_row"), "doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the languages that the labels name: null texts, texts without a letter, and
    texts that hardly share an n-gram's rank with the nearest profile (a score below ``IN_NONE``).

    Without any labelled text there is nothing to compare with, and only the first two go.
    """
    ship(spark)
    profiles = langid.train(docs)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    found = langid.predict_whole(whole, profiles or {"any": [0]}).where(F.col("lang_pred") != langid.UNKNOWN)
    return (found.where(F.col("score") >= IN_NONE) if profiles else found).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows that share
    id and text, the one whose columns come first as JSON."""
    ship(spark)
    found = neardup.groups(docs, NEAR)
    first = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.coalesce("id", F.lit(neardup.NO_ID)).alias("id"), F.col("row"))).alias("x")).select(F.col("x.row").alias("_row"))
    alone = found.where(F.col("label").isNull()).select(F.col("row").alias("_row")).distinct()
    staying = _wrapped(docs).join(first.union(alone), "_row")
    return staying.groupBy("_row").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has; documents of which
    nothing is left go."""
    ship(spark)
    gone = kept(substrings.cleaned(docs), "cleaned").select(F.col("row").alias("_row"), "kept_text")
    rows = _wrapped(docs).join(gone, "_row", "left")
    changed = F.col("kept_text").isNotNull()
    out = {"text": F.coalesce("kept_text", "_doc.text"), "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("_doc.n_chars"))}
    return rows.where(~changed | (F.col("kept_text") != "")).select(*((out[c] if c in out else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.where("n_hit > 0").select(F.col("row").alias("_row")).distinct()
    return _wrapped(docs).join(leaks, "_row", "left_anti").select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(kept(packing.pieces(docs, vocabulary()), "pieces")).drop("text_sha")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

#: Near-duplicate components and best fit are beyond one SQL statement; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
