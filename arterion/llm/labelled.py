"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterion.llm.common import Scratch

#: Labelled documents that are fitted on, at most, and the bytes of their texts.
MOST_LABELLED, MOST_BYTES = 12_000, 64 << 20


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id falls into fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sample(scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str, learns: Column, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text, label, half): labelled documents for which ``learns`` (of doc_id) holds, as a table of ``scratch``.

    They are the first by hash of doc_id: at most ``most``, and together at most ``most_bytes`` long (but one at least),
    so the choice doesn't depend on how rows are dealt.  Equal texts count once, with label 1 if any has it; so do rows
    that repeat a doc_id.  ``half``, 0 or 1, is drawn from the text.  Only ids of the sample are broadcast, no text goes
    to the driver.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = ids.where(learns).groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    ids = ids.orderBy("place", "doc_id").limit(most)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    first = scratch.keep(rows.groupBy("text").agg(F.max("label").alias("label"), F.min(F.struct("place", "doc_id")).alias("place")), "labelled")
    # A window over ``most`` rows of numbers at most.
    before = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cut = first.select("place", F.octet_length("text").alias("size")).withColumn("before", F.coalesce(before, F.lit(0)))
    last = cut.where((F.col("before") == 0) | (F.col("before") + F.col("size") <= most_bytes)).agg(F.max("place").alias("last")).first()["last"]
    place, doc = F.col("place.place"), F.col("place.doc_id")
    taken = (place < last["place"]) | ((place == last["place"]) & (doc <= F.lit(last["doc_id"]))) if last else F.lit(False)
    out = scratch.keep(first.where(taken).select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "sample")
    scratch.drop(first)
    return out
