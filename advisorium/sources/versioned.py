"""A table as immutable Parquet versions with one pointer; writers swap the pointer last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from advisorium.sources.shared import Pointer, SharedFolder, StaleState

__all__ = ["StaleState", "VersionedTable"]


class VersionedTable:
    """``folder/v=<token>`` holds the versions; the last numbered state names the one that counts.

    A swap names the state it was drawn up against: of two writers that began from one state the second is refused.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = SharedFolder(spark, self.folder)
        self.pointer = Pointer(spark, self.folder)

    def number(self) -> int:
        """Number of the state that counts, 0 before the first."""
        return self.pointer.read()[0]

    def current(self) -> str | None:
        """Name of the version that counts, or None before the first."""
        return self.pointer.read()[1].get("version")

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError(f"{self.folder} has no version yet")
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def stage(self, df: DataFrame, token: str | None = None) -> str:
        """Write a version that does not count yet; the same token overwrites its own earlier attempt."""
        version = f"v={token or uuid.uuid4().hex[:16]}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{version}")
        return version

    def swap(self, version: str, expected: int | None = None) -> int:
        """Let ``version`` count, after state ``expected`` (None: whatever counts now)."""
        return self.pointer.swap(self.number() if expected is None else expected, {"version": version})

    def replace(self, df: DataFrame) -> DataFrame:
        """Write a version, let it count and read it; refused if another writer swapped in between."""
        expected = self.number()
        self.swap(self.stage(df), expected)
        return self.read()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions that none of the last ``keep`` states names; staged ones of running writers are such too."""
        states = self.pointer.files.names("")[-keep:]
        named = {(self.pointer.files.load(n) or {}).get("version") for n in states}
        gone = [n for n in self.files.names("") if n.startswith("v=") and n not in named]
        for n in gone:
            self.files.delete(n)
        return gone
