"""Tables that are replaced as a whole: a version is built beside the old one, then one pointer moves."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


@dataclass(frozen=True)
class Published:
    """Versions of a table under ``path``; the file ``CURRENT`` names the one that readers see.

    A version that fails half-way was never named, so the old one stays readable. Readers that pinned a version go on
    reading it; old versions are left to whoever cleans the folder.
    """

    path: str

    def _files(self, spark: SparkSession):
        hadoop = spark._jvm.org.apache.hadoop.fs
        pointer = hadoop.Path(f"{self.path}/{POINTER}")
        return hadoop, pointer, hadoop.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())

    def current(self, spark: SparkSession) -> str | None:
        """Name of the published version; None before the first."""
        hadoop, pointer, _ = self._files(spark)
        if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
            return None
        return spark.read.text(f"{self.path}/{POINTER}").first()[0]

    def read(self, spark: SparkSession, version: str | None = None) -> DataFrame | None:
        """The published version or a pinned one; None before the first."""
        name = version or self.current(spark)
        return None if name is None else spark.read.parquet(f"{self.path}/{name}")

    def publish(self, rows: DataFrame) -> str:
        """Write ``rows`` as a new version, then let the pointer name it; returns its name.

        The pointer is written aside and renamed over the old one, which file systems do in one step.
        """
        spark = rows.sparkSession
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        hadoop, pointer, context = self._files(spark)
        aside = hadoop.Path(f"{self.path}/.{name}.pointer")
        out = aside.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, False)
        try:
            out.write(bytearray(name.encode()))
        finally:
            out.close()
        options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, pointer, options)
        return name
