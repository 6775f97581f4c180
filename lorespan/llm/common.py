"""What the operators share: written intermediate tables, size checks, expressions."""

from __future__ import annotations

import posixpath
import string
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where a session has none
    (tests), a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "llm-work")


def new_path(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return df[quoted(name)]


def carried(df: DataFrame, made: Iterable[str] = ()) -> tuple[Column, list[Column]]:
    """All columns as one struct `doc`, and how to take them out again. An operator then has only
    names of its own beside it. Columns it makes itself replace input columns of these names, in
    whatever case; they are left out."""
    made = {c.lower() for c in made}
    names = [c for c in df.columns if c.lower() not in made]
    fields = [column(df, c).alias(c) for c in names]
    filler = "-" * (1 + max(map(len, names), default=0))  # a struct has at least one field
    doc = F.struct(F.lit(0).alias(filler), *fields)
    return doc.alias("doc"), [F.col("doc").getField(c).alias(c) for c in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in other lambdas; a plain reference would be evaluated
    again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; no words for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def positions(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def item(array: Column, i: Column | int) -> Column:
    return F.get(array, i if isinstance(i, Column) else F.lit(i))


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text or binary column over the whole table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def blocks_for(spark: SparkSession, size: int, target: int = 16 << 20) -> int:
    """How many shuffle partitions keep each at about `target` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target), 1)


def where_settled(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them again: a filter is not pushed below a
    projection that numbers its rows."""
    return df.withColumn("__settled", F.monotonically_increasing_id()).where(condition & (F.col("__settled") >= 0)).drop("__settled")


def file_system(uri: str):
    """A file system and path for tasks that write or read their own file format."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def spread_files(files: DataFrame) -> DataFrame:
    """A short list of files, dealt evenly to tasks."""
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks)
