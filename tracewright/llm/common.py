"""What the corpus operators share: the shared folder, written intermediate tables and byte-bounded Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to a kernel in slices of about this many bytes, so that a task's memory does not follow the
#: number of rows of an Arrow batch. A single longer text is a slice of its own and is still processed whole.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, without a cluster, a folder in the warehouse if that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder. That part is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    path, system = _hadoop_path(spark, own)
    system.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, instead_of: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing already done.

    `instead_of`, a list kept by a caller that writes one state after the other, holds the path of the state before; it is
    deleted and replaced by the new one's."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)  # `by`: a column of few values, of which later reads want one
    if instead_of is not None:
        for old in instead_of:
            old, system = _hadoop_path(spark, old)
            system.delete(old, True)
        instead_of[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text_index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that the texts of each slice hold about `limit` bytes (one row at least)."""
    column = batch.column(text_index)
    start = size = 0
    for row, n in enumerate(_lengths(column)):
        if row > start and size + n > limit:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without decoding; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_texts(df: DataFrame, columns: list, schema: str, kernel: Callable[[], Callable[[pa.RecordBatch], list]], text: int = 1, limit: int = SLICE_BYTES) -> DataFrame:
    """Select `columns`, and turn each slice into the columns of `schema`. `kernel()` runs once in a task and returns the slice function."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = kernel()
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([pa.array(x, out.field(i).type) if not isinstance(x, pa.Array) else x.cast(out.field(i).type) for i, x in enumerate(step(part))], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, kernel: Callable[[], Callable[[list[bytes]], list[bool]]], limit: int = SLICE_BYTES) -> DataFrame:
    """df without the rows for which the kernel says False; all columns pass through in Arrow batches."""
    index = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = kernel()
        for batch in batches:
            for part in slices(batch, index, limit):
                yield part.filter(pa.array(step(bytes_of(part.column(index))), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def text_column(df: DataFrame, name: str = "text"):
    return F.col(f"`{name}`").cast("string").alias("text")
