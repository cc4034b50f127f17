"""What the corpus operators share: reading tables, shared intermediate tables, folds and joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join whose rows are a few numbers each is broadcast (about 10 MB).
BROADCAST_ROWS = 200_000

#: The white space of the contracts, as characters.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a folder of one machine would not do, so there is no other."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors.

    Tables that nothing reads any more are for discard(); the last ones of a result stay, since it reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables, once what was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has been counted and is small enough, else leaves the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
#: Rows of an Arrow batch that are turned into Python's values at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of a few rows, so that a task holds few texts twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def add_columns(df: DataFrame, column: str, make: Callable[[list], list[tuple]], fields: str, drop: bool = False) -> DataFrame:
    """Adds columns made from one string column: make gets a batch of its values and gives a tuple for each.

    The other columns pass through as they are, in Arrow, so that their nulls,
    types and names don't matter; columns named like new ones are replaced.
    With drop, the column read is left out; a new one may take its name.
    """
    new = [tuple(x.split()) for x in fields.split(", ")]
    df = df.drop(*(name for name, _ in new if not (drop and name == column)))
    kept = [f.name for f in df.schema if not (drop and f.name == column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(zip(*make(batch.column(column).to_pylist()), strict=True)) or [()] * len(new)
            arrays = [pa.array(x, ARROW[kind]) for x, (_, kind) in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, *(name for name, _ in new)])

    schema = df.select(*(f"`{x}`" for x in kept)).schema
    for name, kind in new:
        schema = schema.add(name, "integer" if kind == "int" else kind)
    return df.mapInArrow(run, schema)
