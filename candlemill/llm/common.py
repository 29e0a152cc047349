"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate() table that lower-cases A-Z only, as bytes.lower() does.
SPACE = b" \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a local session gets a folder of its own; on a cluster that would be each
    machine's own, so there it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes that a broadcast table may take by the sizes of its columns.
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame):
    """Bytes of a row: strings and binary by their length, arrays by eight or their strings' lengths an element."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            size = F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(inner, T.StringType) else F.size(c) * 16
        else:
            size = F.lit(16)
        parts.append(F.coalesce(size, F.lit(0)) + 16)
    return sum(parts[1:], parts[0])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a written table of at most that many rows and BROADCAST_BYTES; beyond either a shuffled join."""
    n, size = df.limit(rows + 1).select(_width(df).cast("long").alias("w")).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """128-bit digest of a row's id and text; null where the text is null."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x01")), F.lit("\x00"), F.col(text)))


def fresh(columns: list[str], name: str) -> str:
    """name, or name with more underscores, such that no column begins with it in any case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def boxed(df: DataFrame, *more, without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of df, less some, in one struct column row, and more beside it, so that no name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)).alias("row"), *more)


def lower_ascii(col):
    """A-Z to a-z and nothing else; the plain lower() where the text is ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def let(value, body):
    """body(value) with value computed once a row: a lambda's argument is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
