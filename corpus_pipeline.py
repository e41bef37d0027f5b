"""The corpus pipeline: documents in, a mix of clean documents out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and is written before the next one reads it. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from flowloom.llm.common import table, text_key
from flowloom.session import materialise

# A document whose most likely language has less mean probability than this is in none of them.
MIN_LANGUAGE_SCORE = 0.5


def _joined(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``row`` (all columns of ``docs``) and the columns of ``other``, by ``doc_id`` and ``k``, the key of the text."""
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), text_key(F.col("row.text")).alias("k")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.k") == F.col("o.k"))
    rest = [F.col(f"o.{c}") for c in other.columns if c not in ("doc_id", "k")] if how != "left_semi" else []
    return rows.join(other.alias("o"), same, how).select("r.row", *rest)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no language explains.

    Learns from ``text`` and ``lang`` of the given documents; without any label to learn from, nothing but texts without letters can be
    told apart and only these go.
    """
    net, languages = language.fit(docs)
    with_key = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("k")).alias("doc_id"), "text")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.filter(letters)
    said = language.predict(with_key, net, languages)
    kept = said.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _joined(docs, kept.select("doc_id.doc_id", "doc_id.k").distinct(), "left_semi").select("row.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier in windows of three; documents that lose all their lines go.

    ``n_chars``, where there is such a column, follows the text.
    """
    cut = line_dedup.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more, smallest doc_id.

    Documents without words are in no group and stay, all of them. Rows of one doc_id in one group leave one row.
    """
    keyed = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("k")).alias("doc_id"), "text")
    groups = jaccard_join.jaccard_groups(keyed, words=5, percent=80)
    # NULL ids sort first within the struct; the smallest known id is kept where there is one.
    stays = groups.filter("n_shingles = 0 or doc_id = component_id").select("doc_id.doc_id", "doc_id.k").distinct()
    kept = _joined(docs, stays, "left_semi").withColumn(
        "n", F.row_number().over(Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.lit(1))))
    words = mixing.word_count(F.col("row.text")) > 0
    return kept.filter((F.col("n") == 1) | ~words).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents that are left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


# The first, third and fourth stage can't be said in SQL. tests/llm hold line dedup and mixing against SQL, near copies and leaks against
# brute force, and language ID against held-out labels.
ORACLE_SQL = None
