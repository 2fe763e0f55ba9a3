"""Where queries and the SQL they equal are kept, and where they put their files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from ledgerfold.files import Files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder: spark.checkpoint.dir, or the folder set on its context; a temporary one only where neither is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else tempfile.mkdtemp(prefix="ledgerfold-")


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared one for the logs and folds of one query, removed when the program ends: its result reads it until then."""
    at = f"{shared_folder(spark)}/ledgerfold-{uuid.uuid4().hex}"
    files = Files(spark)

    def remove():
        try:
            files.remove(at)
        except Exception:  # the session or the folder is gone already
            pass

    atexit.register(remove)
    return at
