"""Helpers shared by the training-data operators: tables, lineage cuts, row-wise Arrow maps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and drop its lineage.

    The folder is the session's spark.checkpoint.dir; only where that is unset
    (local tests) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerfold-ckpt-"))
    return df.checkpoint(eager=True)


def add_columns(df: DataFrame, read: list[str], fn: Callable[..., Iterator[tuple] | list[tuple]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns computed in Arrow batches, without a shuffle.

    fn gets one Python list for each column of `read` (strings as UTF-8 bytes)
    and returns one tuple for each row. An existing column that has the name of
    a new one is replaced.
    """
    names = {n.lower() for n, _ in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    sent = [c for c in read if c not in keep]  # what is kept is read from there, not sent twice
    inputs = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(sent)])
    places = [keep.index(c) if c in keep else len(keep) + sent.index(c) for c in read]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    arrow = [(n, _ARROW[type(t)]) for n, t in fields]

    def run(batches):
        for b in batches:
            cols = [_bytes(b.column(k)).to_pylist() for k in places]
            got = list(fn(*cols))
            new = [pa.array([r[i] for r in got], type=t) for i, (_, t) in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], names=[*keep, *[n for n, _ in arrow]])

    return inputs.mapInArrow(run, schema)


def _bytes(column: pa.Array) -> pa.Array:
    """Strings as their UTF-8 bytes, which costs no copy; other columns as they are."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary())
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column


_ARROW = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
    T.StringType: pa.string(),
    T.BinaryType: pa.binary(),
}


def id_remainder(doc_id, modulus: int):
    """crc32 of the id's text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
