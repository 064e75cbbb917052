"""Bounded, balanced samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """text, label (0 or 1) and weight (how many rows each stands for) of about ``most`` documents of each label at most, none of them held out.

    ``held_out`` is over ``doc_id``. The choice is by a hash of the id, so it is the same each time; the ids are few
    by that bound, and are sent to the documents rather than the documents shuffled. Rows with a null label, or
    without a document, are left aside.
    """
    rows = labels.where(~held_out & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, most / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, most / max(1, sizes.get(0, 0)))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * share).withColumn("weight", 1 / share)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label", "weight")
