"""Shared plumbing of the corpus operators: scratch tables, batch limits, word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OPEN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OPEN:
        _OPEN[app] = tempfile.mkdtemp(prefix="tilescape-")
    return f"file://{_OPEN[app]}"


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs a reread, not a recomputation.

    Every table gets a fresh path, so that concurrent queries cannot meet. ``drop`` removes tables that
    are no longer read; what is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made: set[str] = set()
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self._made.add(name)
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it back."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._made:
                self._made.discard(name)
                self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session may have ended before the process
            return


def placed(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two more columns that tell its rows apart, and their names: the file and the row's number in it.
    Rows that do not come straight from Parquet files are written first."""
    names = ["_file", "_row"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]

    def with_places(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")  # whatever the columns are called
        return df.select("*", place["file_path"].alias(names[0]), place["row_index"].alias(names[1]))

    try:
        return with_places(docs), (names[0], names[1])
    except AnalysisException:
        return with_places(scratch.table(docs, "rows")), (names[0], names[1])


#: Bytes of an Arrow batch that a Python worker gets.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough that a batch of very long texts still fits a Python worker: by rows and by
    bytes. The session keeps the smaller settings, as plans are made of them when they run, not here."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes. bytes.split() without an argument parts exactly at WORD_PATTERN's white space."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Pack dict rows into record batches."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def n_words(column: str = "text"):
    """Number of words of a text, as a JVM expression; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
