"""Session helpers: shared work folders, cut lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of 32,768 neighbouring ids, with a bit for each id, that are broadcast at most; one takes 4 KB.
BLOCKS = 8_192


def work_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local
    master gets a temporary folder, and a cluster gets the warehouse.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = held.get() if held.isDefined() else None
    if not known:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            known = tempfile.mkdtemp(prefix="docengine-")
        else:
            known = spark.conf.get("spark.sql.warehouse.dir") + "/docengine-work"
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor makes Spark read the files again,
    not recompute what led to them. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/docengine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _reread(spark, path, df.schema)


def _reread(spark: SparkSession, path: str, schema) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(schema).parquet(path)
    out._work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``max_rows`` rows or fewer; else as it is, for a shuffled join.

    ``df`` is counted, so it should be a written table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def holding(df: DataFrame, at: Column, ids: DataFrame, max_rows: int) -> DataFrame:
    """The rows of ``df`` where ``at`` is one of ``ids`` (a written table of one column), without moving them where that is possible.

    Integers that stand close together are broadcast as bitmaps, a bit for each id, so wide rows are not shuffled
    for a table of many ids. Others are broadcast up to ``max_rows``, and joined by a shuffle beyond that.
    """
    name = ids.columns[0]
    if ids.schema[name].dataType.typeName() in ("byte", "short", "integer", "long"):
        id_ = F.col(name).cast("long")
        ids = ids.where(id_.isNotNull())
        block = F.bitmap_bucket_number(id_).alias("__block")
        if ids.select(block).distinct().limit(BLOCKS + 1).count() <= BLOCKS:
            bits = materialize(ids.groupBy(block).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("__bits")), "bits")
            place = F.bitmap_bit_position(at.cast("long"))
            byte = F.conv(F.hex(F.substring(F.col("__bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            lit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
            found = df.join(F.broadcast(bits), F.bitmap_bucket_number(at.cast("long")) == F.col("__block"))
            return found.where(lit).select(*(df[f"`{c}`"] for c in df.columns))
    ids = broadcast_if(ids.select(F.col(name).alias("__id")), max_rows)
    return df.join(ids, at == F.col("__id"), "left_semi")
