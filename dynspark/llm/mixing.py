"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

The share of each source is found by water filling: all words are dealt to the sources by weight, no source gets more
than CAP times its own size, and what is above that goes to the others by weight. A document of a source then has
target / source size expected copies. Within a source these are summed up in an order in which sizes grow, one offset
per source is added, and a copy is emitted at each integer boundary that the sum crosses: a document gets the expected
number of copies rounded down or up, and what is owed to documents of one size never waits for much larger ones, so the
words taken miss the target by about the size of one large document at most.

A source can hold a third of all documents, so its sum isn't made in one task. Documents are ordered by (size class,
slice of a hash of the id, size, id); (source, class, slice) is a bucket. Numbering runs in the buckets, and a second,
small sum runs over the counts of a source's buckets: at most CLASSES x 256 rows, however many documents there are.

A null or empty text has size 0 and takes no words; it can still be emitted. A null source is a source of its own. All
sizes 0: all targets 0. Rows that repeat an id and a size are interchangeable. An empty table gives an empty result.
The offset is made from the source's name and the seed: runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm.common import WORD, cut, table, text_or_empty

CAP = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def size_class(size: Column) -> Column:
    """Four classes to each doubling of the size."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))).cast("int")


def targets(by_source: DataFrame) -> DataFrame:
    """by_source: key, source, source_size, a row for each source. Adds the source's target in words.

    Sources are numbered by a range sort and the counts of its partitions. A source is full if its share by weight is above CAP
    times its size; what full sources leave raises the level of the others, so more may be full, until none is: a row of sums each time.
    """
    ordered = cut(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("first") - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("long")
    w = cut(ordered.join(F.broadcast(parts), "part").withColumn("nth", nth).withColumn("weight", weight).select("key", "source_size", "weight"))
    total = w.agg(F.sum("source_size")).first()[0]
    level, before_ = None, -1
    while True:
        share = F.lit(level) * F.col("weight")
        full = F.lit(False) if level is None else share > F.col("source_size") * CAP
        n, held, open_ = w.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * CAP)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == before_ or not open_:
            break
        before_, level = n, float(total - held) / float(open_)
    target = F.when(full, (F.col("source_size") * CAP).cast("double")).otherwise(share)
    return w.select("key", "source_size", target.cast("double").alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """id, source, key, size, class, slice and what else is asked for, for each row of docs."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        *more,
    )
    slice_ = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 2)
    return rows.withColumn("class", size_class(F.col("size"))).withColumn("slice", slice_)


def _taken(rows: DataFrame, small: DataFrame, seed: int) -> DataFrame:
    """rows (a _keyed frame) with source_size, target and copies. small: the same rows without what else they carry."""
    by_source = targets(small.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    bucket = ["key", "class", "slice"]
    counts = small.groupBy(*bucket).agg(F.count(F.lit(1)).alias("in_bucket"))
    running = Window.partitionBy("key").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("in_bucket").over(running), F.lit(0))).drop("in_bucket")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 5), 16, 10).cast("double") / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    counts = counts.join(by_source, "key").withColumn("offset", offset).withColumn("rate", rate)
    ranked = rows.drop("source").withColumn("nth", F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "id")))
    ranked = ranked.join(counts, bucket).withColumn("nth", F.col("nth") + F.col("before"))
    crossed = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    return ranked.withColumn("copies", (crossed(F.col("nth")) - crossed(F.col("nth") - 1)).cast("long"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies."""
    rows = cut(_keyed(docs, id_col, text_col, source_col))
    return _taken(rows, rows, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. Whole rows travel once, to their bucket."""
    small = cut(_keyed(docs, id_col, text_col, source_col))
    whole = _keyed(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _taken(whole, small, seed).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS slice
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> CAST(greatest(length(bin(size)) - 3, 0) AS BIGINT)) AS class FROM sized),
sources AS (
  SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY key, source),
weighted AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
placed AS (
  SELECT *, row_number() OVER f AS place,
         CAST(coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
         CAST(sum(weight) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighted WINDOW f AS (ORDER BY source_size / weight, nth)),
levels AS (SELECT *, CAST(total - full_before AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM placed),
fitting AS (SELECT min(place) AS first_place, arg_min(level, place) AS top_level FROM levels WHERE level * weight <= source_size * 3),
shares AS (
  SELECT key, source_size, CASE WHEN place >= first_place THEN top_level * weight ELSE CAST(source_size * 3 AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('0:' || key), 1, 5) AS INTEGER) AS DOUBLE) / 1048576.0 AS u
  FROM levels, fitting),
ranked AS (
  SELECT c.*, s.source_size, s.target, s.u,
         CASE WHEN s.source_size > 0 THEN s.target / CAST(s.source_size AS DOUBLE) ELSE 0.0 END AS rate,
         CAST(row_number() OVER (PARTITION BY c.key ORDER BY c.class, c.slice, c.size, c.doc_id) AS DOUBLE) AS nth
  FROM classed c JOIN shares s USING (key))
SELECT doc_id, size, source_size, target,
       CAST(floor(rate * nth + u) - floor(rate * (nth - 1) + u) AS BIGINT) * size AS taken
FROM ranked
"""
