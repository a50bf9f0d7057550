"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents scored as toxic go.
2. line_dedup: lines found in many documents are dropped from the texts.
3. near_duplicates: of each group of near copies the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. encode: what is left becomes SentencePiece ids, decoded again as a check.

Defined results: a row without doc_id passes the stages that compare documents;
of rows that repeat doc_id and text one stays; a null or empty text is kept, as
are further columns, whatever their names; n_chars, if there is one, follows the
text; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm import decontamination, line_dedup, ngram_jaccard, sentencepieces, toxicity
from arterion.llm.common import among, stash, table

#: Unless a contract says otherwise, near copies share five-word shingles to at least this percentage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    out = line_dedup.drop_frequent_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies; of equal rows one."""
    groups = ngram_jaccard.near_duplicates(spark, docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    extra = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    again = stash(spark, groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    left = among(docs, extra, "doc_id", "left_anti")
    if not again.take(1):
        return left
    return among(left, again, "doc_id", "left_anti").unionByName(among(left, again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_bytes, round_trip, parity) of each document.

    Written here, as batches of texts are bounded in bytes that way.
    """
    return stash(spark, sentencepieces.encode(docs, sentencepieces.default_model()), "encoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encode", encode),
]

#: The first and last stage can't be expressed in SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
