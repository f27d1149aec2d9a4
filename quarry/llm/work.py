"""Working tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: what a task hands to Python at once.  A single row may be larger.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: it cuts the lineage, survives the loss of executors and gives the planner true sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*saved: DataFrame) -> None:
    """Deletes the folders of saved tables that nothing reads any more."""
    for df in saved:
        remove(df.sparkSession, df.saved_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the session's batches held to BATCH_LIMITS, since whole texts pass through."""
    conf = df.sparkSession.conf
    for key, most in BATCH_LIMITS.items():
        now = conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(f, schema)


class Identified(NamedTuple):
    """rows: row (a struct of the input's columns), uid, id, text; names: uid and id of the rows whose uid is not their id, None if there are none."""

    rows: DataFrame
    names: DataFrame | None

    def named(self, found: DataFrame, uid: str) -> DataFrame:
        """found with its column uid (a uid) turned into the id of its row."""
        if self.names is None:
            return found
        joined = found.join(self.names.select(F.col("uid").alias("_uid"), F.col("id").alias("_id")), F.col(uid) == F.col("_uid"), "left")
        return joined.withColumn(uid, F.when(F.col("_uid").isNotNull(), F.col("_id")).otherwise(F.col(uid))).drop("_uid", "_id")


def identified(docs: DataFrame, text: str, doc_id: str, nulls: bool = False) -> Identified:
    """Rows by texts where ids do not tell them apart: uid is the id, but a hash of id and text (far below zero) where an
    id has several texts, and for null ids if nulls; equal rows share it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select("row", F.col("row")[doc_id].alias("id"), F.col("row")[text].cast("string").alias("text"))
    per = rows.select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = save(per.where("low <> high" if nulls else "low <> high AND id IS NOT NULL").select(F.col("id").alias("of")), "ids-of-several-texts")
    own = F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1) + F.lit(-(1 << 63))
    uid = F.col("id").cast("long")
    if nulls:
        uid = F.when(F.col("id").isNull(), own).otherwise(uid)
    if several.isEmpty():
        named = rows.withColumn("uid", uid)
        other = named.where("id IS NULL").limit(1) if nulls else None
        if other is None or other.isEmpty():
            return Identified(named, None)
    else:
        named = rows.join(several, F.col("id") == F.col("of"), "left").withColumn("uid", F.when(F.col("of").isNotNull(), own).otherwise(uid)).drop("of")
    return Identified(named, save(named.where("NOT (uid <=> cast(id AS long))").select("uid", "id").distinct(), "names"))
