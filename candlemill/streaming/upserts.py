"""Rows that later ones replace, written by a stream: a log of batches, merged now and then into a base that a manifest names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "base string, upto long, seq long"


class UpsertLog:
    """One row a key under path: log/batch=N is what batch N wrote, base/<id> a merge of all before, manifest/seq=K names the live base and the last batch in it.

    Reading takes the newest manifest's base and the batches after it, so it costs the live rows and not the
    history. A merge writes a new base first and its manifest last: until that is there the old base
    and batches are read, and a merge that failed in between left only files that no manifest names. A
    batch that runs again replaces what it wrote. One writer at a time, as a stream is; a batch that comes
    again after it was merged changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("symbol", "start"), every: int = 0, parts: int = 8):
        self.spark, self.path, self.schema, self.keys, self.every, self.parts = spark, path, schema, list(keys), every, parts

    def _parquet(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def manifests(self) -> DataFrame:
        return self._parquet("manifest", MANIFEST)

    def manifest(self) -> tuple[str | None, int, int]:
        """(base, last batch in it, number) of the newest manifest."""
        row = self.manifests().orderBy(F.desc("seq")).first()
        return (row["base"], row["upto"], row["seq"]) if row else (None, -1, -1)

    def _log(self, after: int) -> DataFrame:
        return self._parquet("log", f"{self.schema}, batch long").where(F.col("batch") > after)

    def write(self, batch: DataFrame, number: int) -> None:
        """foreachBatch sink. Of a batch's rows of one key the largest stays; null keys go. Merges every so many batches, if told so."""
        rows = batch.dropna(subset=self.keys)
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("x")).select(*self.keys, "x.*").select(batch.columns)
        one.write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        if self.every and number % self.every == self.every - 1:
            self.compact()

    def read(self) -> DataFrame:
        """The live rows. Base rows meet only the few later ones of their keys."""
        base, upto, _ = self.manifest()
        return self._merged(base, self._log(upto))

    def _merged(self, base: str | None, log: DataFrame) -> DataFrame:
        rest = [c for c in log.columns if c not in (*self.keys, "batch")]
        new = log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*self.keys, "x.*")
        if base is None:
            return new
        old = self._parquet(f"base/{base}", self.schema)
        return old.join(new.select(self.keys), self.keys, "left_anti").select(new.columns).unionByName(new)

    def merge(self) -> tuple[str, int] | None:
        """Write a base of all live rows; (its name, the last batch in it), or None if no batch has come since."""
        base, upto, _ = self.manifest()
        log = self._log(upto)
        last = log.agg(F.max("batch")).first()[0]
        if last is None:
            return None
        name = uuid.uuid4().hex
        merged = self._merged(base, log.where(F.col("batch") <= last))
        merged.repartition(self.parts, *self.keys[:1]).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/base/{name}")
        return name, last

    def commit(self, name: str, last: int) -> None:
        """Name a base as the live one."""
        _, _, seq = self.manifest()
        row = self.spark.createDataFrame([(name, last)], "base string, upto long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/seq={seq + 1}")

    def compact(self) -> None:
        merged = self.merge()
        if merged:
            self.commit(*merged)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete batches and bases that none of the newest manifests needs, and those manifests' forerunners; what was deleted. Readers that began on a kept manifest go on."""
        rows = self.manifests().orderBy(F.desc("seq")).limit(keep).collect()
        if not rows:
            return []
        named, oldest = {r["base"] for r in rows}, min(rows, key=lambda r: r["seq"])
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

        def children(name: str) -> list[str]:
            at = hadoop.Path(f"{self.path}/{name}")
            return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

        number = lambda x: int(x.partition("=")[2]) if x.partition("=")[2].isdigit() else -1
        gone = [f"base/{x}" for x in children("base") if x not in named]
        gone += [f"log/{x}" for x in children("log") if x.startswith("batch=") and number(x) <= oldest["upto"]]
        gone += [f"manifest/{x}" for x in children("manifest") if x.startswith("seq=") and number(x) < oldest["seq"]]
        for x in gone:
            fs.delete(hadoop.Path(f"{self.path}/{x}"), True)
        return gone
