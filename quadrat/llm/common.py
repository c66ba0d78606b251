"""Small helpers the text operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.session import materialise, own_path


#: As many as Spark allows by default.
MOST_BUCKETS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here."""
    if codec is None:
        return materialise(df, label)
    path = own_path(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that joins on it do not shuffle.

    Buckets need a table name; the plan read back holds the files, so the name goes again.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", own_path(spark, name))
    writer.option("compression", codec).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    held = spark.table(name)
    held.schema  # resolved while it has its name
    spark.sql(f"DROP TABLE {name}")
    return held


def crc_fold(column: str, folds: int):
    """crc32 of an id as text, modulo ``folds``; a null id counts as fold null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with result columns, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def extended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])


def add_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [*batch.columns, *columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])


def slices(batch: pa.RecordBatch, text: str, most: int = 16 << 20):
    """Cut an Arrow batch into runs of rows holding about ``most`` bytes of ``text``.

    A single longer text is a run of its own.
    """
    lengths = batch.column(text).cast(pa.large_string()).fill_null("")
    sizes = pc.binary_length(lengths).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    # A Python worker outlives its tasks: what the runs before took goes back to the machine.
    pa.default_memory_pool().release_unused()


_copies: dict[str, object] = {}


def worker_copy(key: str, make: Callable[[], object]):
    """One object per Python worker, kept between its tasks; a new key drops the old one."""
    if key not in _copies:
        _copies.clear()
        _copies[key] = make()
    return _copies[key]


def drop_copies() -> None:
    """For tasks that need no copy: what the steps before kept in this worker goes back to the machine."""
    _copies.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Fixed values: printable bytes stand for themselves, the others are numbered from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(hidden)}
