"""State of incremental jobs as named tables of the shared folder, one version per batch.

A version is written whole and then marked as done, so a run that breaks off leaves the last
version as it was, and its batch is written anew. A batch number that is done already is
ignored: whatever repeats batches (a restarted stream) changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from galley.session import file_system, shared_dir

DONE = "_DONE"


class StateTable:
    """Versions `v=N` below one folder; each holds named parts.

    A part is either the whole state as of its version (`read`) or what the version added
    (`log`). Without a name the state lives as long as the session.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/galley-state/{name or uuid.uuid4().hex}"
        if name is None:
            fs, path = file_system(spark, self.at)
            fs.deleteOnExit(path)

    def versions(self) -> list[int]:
        """The numbers of the batches that are done, in order."""
        fs, path = file_system(self.spark, self.at)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
        return [n for n in numbers if fs.exists(file_system(self.spark, f"{self.at}/v={n}/{DONE}")[1])]

    def last(self) -> int | None:
        return max(self.versions(), default=None)

    def done(self, number: int) -> bool:
        last = self.last()
        return last is not None and number <= last

    def commit(self, number: int, parts: dict[str, DataFrame], whole: tuple[str, ...] = ()) -> bool:
        """Writes the parts of a batch; of the parts in `whole` older versions are dropped. False if the batch is done already."""
        before = self.versions()
        if before and number <= before[-1]:
            return False
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.at}/v={number}/{name}")
        fs, mark = file_system(self.spark, f"{self.at}/v={number}/{DONE}")
        fs.create(mark, True).close()
        for n in before[:-1]:  # the last but one stays, as readers may be at it
            for name in whole:
                fs.delete(file_system(self.spark, f"{self.at}/v={n}/{name}")[1], True)
        return True

    def read(self, part: str, schema: str) -> DataFrame:
        """The part as of the last batch."""
        last = self.last()
        return self.spark.createDataFrame([], schema) if last is None else self.spark.read.schema(schema).parquet(f"{self.at}/v={last}/{part}")

    def log(self, part: str, schema: str) -> DataFrame:
        """The part of all batches."""
        paths = [f"{self.at}/v={n}/{part}" for n in self.versions()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
