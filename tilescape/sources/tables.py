"""Readers and writers of the stored tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tilescape import schema
from tilescape.schema import PARTITIONS


SCHEMAS = {"tile_features": schema.TILE_FEATURES, "tiles": schema.TILES, "assignments": schema.ASSIGNMENTS, "scores": schema.SCORES, "slides": schema.SLIDES, "slide_embeddings": schema.SLIDE_EMBEDDINGS, "analysis_runs": schema.RUNS, "latent_features": schema.LATENT}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: beneath spark.checkpoint.dir, or a temporary one if that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tilescape-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for steps that read it again and again; gone with the process."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the process
        return


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


def read_stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table with its declared schema; an empty partition value comes back as an empty string."""
    ddl = SCHEMAS.get(table)
    df = (spark.read.schema(ddl) if ddl else spark.read).parquet(f"{root.rstrip('/')}/{table}")
    return df.withColumn("filter_path", F.coalesce("filter_path", F.lit(""))) if "filter_path" in df.columns else df


def partition_path(spark: SparkSession, root: str, table: str, at: dict) -> str:
    """Folder of the partition whose columns have these values, the first ones of the table."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([f"{root.rstrip('/')}/{table}", *(escaped(c, str(at[c])) for c in PARTITIONS[table] if c in at)])


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    files, a = _files(spark, source)
    b = _files(spark, target)[1]
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def write(df: DataFrame, root: str, table: str, at: dict | None = None) -> int:
    """Overwrite the partitions that ``df`` has rows of; the number of rows. If they all belong to the one partition
    ``at`` and there are none, it is removed, so that no rows of an earlier run stay."""
    spark, seen = df.sparkSession, Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(*PARTITIONS[table]).parquet(f"{root.rstrip('/')}/{table}")
    n = int(seen.get["n"])
    if not n and at:
        delete(spark, partition_path(spark, root, table, at))
    return n


def commit(spark: SparkSession, root: str, kind: str, model: str, namespace: str, filter_path: str, params: dict[str, str]) -> str:
    """Record a finished run, after its rows are written, so that ``done`` is never true of a broken one. A partition
    is replaced as a whole, so that readers see the rows of the last run that was written."""
    run = uuid.uuid4().hex
    row = spark.createDataFrame([(run, kind, model, namespace, filter_path, params, "DONE")], ", ".join(schema.RUNS.split(", ")[:-1]))
    row.withColumn("created", F.current_timestamp()).write.mode("append").parquet(f"{root.rstrip('/')}/analysis_runs")
    return run


def done(spark: SparkSession, root: str, kind: str, model: str, namespace: str, filter_path: str, params: dict[str, str]) -> bool:
    """Whether the same analysis with the same parameters has been committed."""
    if not exists(spark, f"{root.rstrip('/')}/analysis_runs"):
        return False
    runs = read_stored(spark, root, "analysis_runs")
    same = (F.col("kind") == kind) & (F.col("model") == model) & (F.col("namespace") == namespace) & (F.col("filter_path") == filter_path) & (F.col("status") == "DONE")
    return any(r["params"] == params for r in runs.where(same).select("params").collect())


def change_runs(spark: SparkSession, root: str, change) -> None:
    """Replace the list of runs by ``change`` of it: written beside, then put in its place."""
    path = f"{root.rstrip('/')}/analysis_runs"
    if exists(spark, path):
        beside = f"{path}-{uuid.uuid4().hex}"
        change(read_stored(spark, root, "analysis_runs")).write.parquet(beside)
        delete(spark, path)
        move(spark, beside, path)
