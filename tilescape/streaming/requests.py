"""Folder requests as a stream: a file source instead of polling, foreachBatch instead of a job loop.

A request is a line 'preset[, rotate]' in a folder; status rows replace the status file. A folder that has a status row
is not run again, however late it is asked for once more, and a failed folder is marked instead of left in progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilescape.functions.values import is_status, request

REQUEST = "folder string, line string, ts timestamp"
STATUS = "folder string, status string, preset string, rotate boolean, ts timestamp"


def parsed(requests: DataFrame, default_preset: str = "uni2") -> DataFrame:
    """Rows that ask for work: empty lines and statuses are none."""
    asked = requests.where((F.length(F.trim("line")) > 0) & ~is_status(F.col("line")))
    return asked.withColumn("r", request(F.col("line"), default_preset)).select("folder", "ts", "r.preset", "r.rotate")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each folder; of equally late ones the largest."""
    return events.groupBy("folder").agg(F.max(F.struct("ts", "status")).alias("m")).select("folder", "m.status", "m.ts")


def first_request(requests: DataFrame) -> DataFrame:
    """One request a folder, the earliest."""
    return requests.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("ts", "line"))).where("r = 1").drop("r")


def watch(spark: SparkSession, source: str, checkpoint: str, status_path: str, job: Callable[[SparkSession, str, str, bool], None], *, interval: str | None = None) -> StreamingQuery:
    """Run ``job(spark, folder, preset, rotate)`` once for every folder asked for in the JSON files beneath ``source``.

    With an interval it keeps watching; without, it works off what is there and ends.
    """
    from tilescape.sources.tables import exists

    stream = parsed(spark.readStream.schema(REQUEST).json(source)).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["folder"])

    def run(batch: DataFrame, _: int) -> None:
        session, rows = batch.sparkSession, []
        if exists(session, status_path):
            batch = batch.join(session.read.schema(STATUS).parquet(status_path).select("folder"), "folder", "left_anti")
        for r in first_request(batch.withColumn("line", F.concat_ws(",", "preset", F.col("rotate").cast("string")))).orderBy("folder").toLocalIterator():  # requests of people, a few a batch; the jobs are distributed
            try:
                job(session, r["folder"], r["preset"], r["rotate"])
                status = "DONE"
            except Exception as e:  # noqa: BLE001  one folder's failure must not stop the others
                status = f"ERROR: {e}"[:500]
            rows.append((r["folder"], status, r["preset"], r["rotate"], r["ts"]))
        if rows:
            session.createDataFrame(rows, STATUS).write.mode("append").parquet(status_path)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
