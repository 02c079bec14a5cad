"""What the corpus operators share: reading tables, cutting lineage, the definition of a word."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of our own only in local mode."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same by a table in the shared folder, for loops of joins with itself: what is read has the size of its files, while a
    checkpoint keeps the estimate of the plan that made it, which such a loop multiplies every round."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(docs: DataFrame, id_col: str, digest: Column, losers: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs without the rows whose (id, digest) is in losers, and one row for each (id, digest) in repeats. A null id is a value."""
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    same = lambda other: own["id"].eqNullSafe(other["id"]) & (own["digest"] == other["digest"])
    left = own.join(losers, same(losers), "left_anti")
    if not repeats.isEmpty():
        once = left.join(repeats, same(repeats), "left_semi").dropDuplicates(["id", "digest"])
        left = left.join(repeats, same(repeats), "left_anti").unionByName(once)
    return left.select("row.*")


def survivors(docs: DataFrame, id_col: str, digest: Column, named: DataFrame) -> DataFrame:
    """named: id, digest, component of each row of docs. docs with one row of each component, that with the least id."""
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    best = named.groupBy("component").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    named = cut(named.join(best, "component"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("digest") == F.col("best.digest"))
    losers = named.filter(~stays).select("id", "digest").distinct()
    repeats = cut(named.filter(stays).groupBy("id", "digest").count().filter("count > 1").drop("count"))
    return without(docs, id_col, digest, losers, repeats)


# --- numpy inside tasks -----------------------------------------------------------------------------------------------

#: Bytes of a string that a short key holds; the first so many of 16 bytes.
SHORT = 15
MASKS = np.tril(np.full((SHORT + 1, 16), 255, np.uint8), -1).view("<u8")


def short_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each of some strings of at most SHORT bytes in data, that no other string has: its bytes and its length."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    windows = np.ndarray(len(data) + 1, "V16", padded, strides=(1,))
    words = windows[starts].view("<u8").reshape(-1, 2) & MASKS[lengths]
    return words[:, 0].copy(), words[:, 1] | lengths.astype(np.uint64) << np.uint64(56)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... (lengths[0] numbers), starts[1] ..."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
