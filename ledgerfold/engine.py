"""Sessions over a folder of buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ledgerfold.errors import NotConnected
from ledgerfold.sources.log import CAPABILITIES, Bucket, BucketConfig


@dataclass
class Engine:
    """open() and close() are idempotent; a session given by the caller is borrowed and never stopped."""

    root: str
    spark: SparkSession | None = None
    _open: bool = False
    _borrowed: bool = False

    def open(self) -> Engine:
        if not self._open:
            self._borrowed = self.spark is not None
            self.spark = self.spark or SparkSession.builder.getOrCreate()
            self._open = True
        return self

    def close(self) -> None:
        if self._open and not self._borrowed:
            self.spark.stop()
            self.spark = None
        self._open = False

    def is_healthy(self) -> bool:
        return self._open and not self.spark.sparkContext._jsc.sc().isStopped()

    @staticmethod
    def capabilities() -> dict[str, bool]:
        return dict(CAPABILITIES)

    def store(self, name: str, config: BucketConfig | None = None, **how) -> Bucket:
        """Get or create a bucket; one that exists keeps its configuration."""
        if not self.is_healthy():
            raise NotConnected("open the engine first")
        return Bucket(self.spark, f"{self.root}/{name}", config, **how)
