"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

1. Every row becomes (id, SHA-256 of its text); texts don't travel beyond this step.
2. Spark's approx_top_k (a frequent-items sketch of the Misra-Gries family, merged from the partitions) proposes at
   most HEAVY digests. No digest with more than about 3.5 / TRACKED of all rows can be missing.
3. The proposals are verified: one aggregation with map-side combine gives each its exact count and its largest id.
   These winners, HEAVY rows at most whatever the input, are broadcast; the rows of a hot group are settled where they
   lie, without a shuffle, so a group with a third of the corpus makes no large task.
4. Remaining digests are shuffled and settled by a window over each digest.

Nulls count as empty texts; empty texts are equal to each other. Of equal texts the largest id stays; a null id is
smaller than any other. Rows that repeat both id and text are repeats of one document: marks() gives each the same
values, drop() leaves one of them. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm.common import cut, table, text_or_empty, without

#: Digests proposed as heavy, and items that the sketch tracks.
HEAVY, TRACKED = 256, 8192


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    digests = cut(docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col), 256).alias("digest")))
    proposed = digests.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {TRACKED})").alias("top"))
    proposed = proposed.select(F.explode("top.item").alias("digest"))
    best = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = digests.join(F.broadcast(proposed), "digest").groupBy("digest").agg(*best)
    winners = F.broadcast(cut(winners))
    hot = digests.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(winners, "digest", "left_anti")
    rest = rest.withColumn("keep_id", F.max("id").over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    return hot.select("id", "keep_id", "group_size", "digest").unionByName(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its duplicates: of equal texts the row with the largest id. Columns stay as they are."""
    marked = cut(marks(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"), "kept"))
    losers = marked.filter(~F.col("kept")).select("id", "digest").distinct()
    repeats = cut(marked.filter("kept").groupBy("id", "digest").count().filter("count > 1").drop("count"))
    return without(docs, id_col, F.sha2(text_or_empty(text_col), 256), losers, repeats)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
