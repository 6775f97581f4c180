"""Session helpers: where written intermediate tables go, and how sizes are checked."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
#: What goes to a Python worker at once, where the session leaves Spark's own bound of 64 MB.
BATCH_BYTES = 4 * 1024 * 1024


def local_session(cpus: int | str = 8, app: str = "lorespan", memory: str = "12g") -> SparkSession:
    """A session for tests and timings on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches that whole texts travel in small, on both sides of the worker's socket: a
    worker holds several copies of one. A bound that the session has chosen stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, else one in the
    warehouse. A folder of one machine is refused where executors run on others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    folder = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "lorespan-work")
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    if not local and folder.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame that is read more than once to the shared folder and read it back: lineage
    ends there, and a reader of a few columns decodes only these."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, name: str = "step") -> tuple[DataFrame, int, int]:
    """The same, with the rows and bytes that were written, counted on the way."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), bytes_of(df).alias("bytes"))
    written = materialize(counted, name)
    return written, seen.get["rows"], seen.get["bytes"]


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value; strings, arrays and structs by what they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        inside = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        inside = sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        inside = 8 * F.size(value)
    elif isinstance(kind, T.ArrayType):
        inside = F.aggregate(value, F.lit(0), lambda n, x: n + _width(x, kind.elementType))
    else:
        inside = F.lit(0)
    return F.coalesce(inside, F.lit(0)) + 8


def bytes_of(df: DataFrame) -> Column:
    """The bytes of all rows, as an aggregate."""
    widths = (_width(df[f"`{field.name}`"], field.dataType) for field in df.schema.fields)
    return F.coalesce(F.sum(sum(widths, F.lit(0)).cast("bigint")), F.lit(0))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a narrow frame, counted by one aggregate."""
    return df.agg(bytes_of(df).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a narrow frame for broadcast only when its measured size allows it; beyond
    that the join shuffles and adaptive execution splits its hot keys."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
