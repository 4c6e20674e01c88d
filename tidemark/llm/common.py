"""Pieces that the text operators share: words, tables, batches and cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Per byte: what a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` keeps after lower-casing A-Z, else a space.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

#: Rows and bytes of one Arrow batch at most; a row that is longer is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def ascii_lower(col: Column) -> Column:
    """A-Z only; lower() would change other letters too."""
    return F.translate(col, UPPER, LOWER)


def utf8(col: Column) -> Column:
    """Text as bytes, null as empty."""
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows, which Python gets in Arrow batches of bounded size.

    Batches are cut when the query runs, so the bounds are settings of the session; they are only ever lowered.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch("([1-9][0-9]*)b?", conf.get(f"spark.sql.execution.arrow.{key}"))  # 0 rows: no bound
        if now is None or int(now[1]) > most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Each row through a Python function, in Arrow batches of bounded size.

    make() runs once a task and returns the function; it gets the row's values and returns a tuple of the schema.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            rows = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], schema=kinds)

    return small_batches(df).mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        # Only a local master can do with a folder of its own.
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no rerun."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, as a table in the shared folder, and the folder that remove() deletes once they're no longer read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files of what's done: Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Ids that are broadcast; more of them are joined by a shuffle.
MOST_IDS = 200_000


def without(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id, null included, isn't among ids."""
    return _by_ids(df, ids, id_col, "left_anti")


def among(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id, null included, is among ids."""
    return _by_ids(df, ids, id_col, "left_semi")


def _by_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    ids = cut(ids.select(F.col(id_col).alias("_id")).distinct())
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(id_col).eqNullSafe(F.col("_id")), how)
