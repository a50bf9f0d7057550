"""Tables that are written as versions of keyed rows, and committed by one rename.

A table is a folder of parts (Parquet) and a manifest that names those which
count.  An upsert writes a part with the new rows alone and then a manifest with
one more name, which takes the old one's place by one atomic rename: whoever
reads meanwhile, or after a crash between the two steps, sees the table as it was.
Reading takes the highest version of each key; so the same rows put twice, or a
batch that a stream repeats, change nothing.  compact() writes the parts as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


class VersionedTable:
    """A table under ``path``: rows with ``keys`` and a ``version``, of which the highest counts; ``deleted``, if the
    table has such a column, says that a key is gone from that version on."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], version: str = "version"):
        self.spark, self.path, self.schema, self.keys, self.version = spark, path.rstrip("/"), schema, keys, version

    # --- the store

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self):
        at = self._hadoop(MANIFEST)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The parts that count, and the batches that are in them, by their stream."""
        store, at = self._store(), self._hadoop(MANIFEST)
        if not store.exists(at):
            return {"parts": [], "batches": {}}
        stream = store.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Puts ``manifest`` in the old one's place."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        new, at = self._hadoop(f"_manifest-{uuid.uuid4().hex}"), self._hadoop(MANIFEST)
        out = self._store().create(new, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        overwrite[0] = getattr(jvm, "Options$Rename").OVERWRITE
        jvm.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, at, overwrite)

    def _part(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    # --- rows

    def every(self) -> DataFrame:
        """All versions of all keys."""
        parts = self.manifest()["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        """The highest version of each key that isn't deleted."""
        latest = _latest(self.every(), self.keys, self.version)
        return latest.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in latest.columns else latest

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds versions of rows; False if ``batch``, (stream, number), is in the table already."""
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        part = self._part(_latest(rows.select(*names), self.keys, self.version))
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"parts": [*manifest["parts"], part], "batches": batches})
        return True

    def writer(self, stream: str) -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` takes: each batch of ``stream`` is added once, however often it is tried."""
        return lambda rows, number: self.upsert(rows, (stream, number)) and None

    def replace(self, rows: DataFrame) -> None:
        """The table is ``rows`` from now on; they may come from the table itself."""
        before = self.manifest()
        self._commit(before | {"parts": [self._part(rows)]})
        for name in before["parts"]:
            self._store().delete(self._hadoop(name), True)

    def compact(self) -> None:
        """Writes the highest version of each key as one part, and lets go of the others once that counts."""
        before = self.manifest()
        part = self._part(_latest(self.every(), self.keys, self.version))
        self._commit(before | {"parts": [part]})
        for name in before["parts"]:
            self._store().delete(self._hadoop(name), True)


def _latest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the greatest row, so that it is always the same."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    order = F.struct(F.col(version), F.to_json(row))
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")
