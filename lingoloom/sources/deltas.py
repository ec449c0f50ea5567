"""Keyed tables that change often, kept in a shared folder as bases and deltas.

A commit writes the changed rows of some tables, each as a delta with the commit's number, and then one record; what has no record
doesn't count, so the tables of a commit change together. Readers take the newest row of each key. Every FOLD commits, deltas are folded into
the bases: a base is cut into buckets by a hash of some key columns, and only buckets that have changes are written anew.

A commit belongs to a writer's batch (a stream's batch number, a run's number). A batch that was committed before is skipped, so a batch
that is repeated after a failure, whole or half written, counts once. There is one writer at a time.

    folder/commits/000000000007        the record
    folder/<table>/delta/7             changed rows, and keys that went (column _gone)
    folder/<table>/base/3/_bucket=5    a bucket as of commit 3
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, FOLD = 16, 10


class Store:
    """tables: name to (rows to start with, key columns, the key columns that deal rows to buckets). The start counts only where the
    folder holds nothing yet."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str], list[str]]], buckets: int = BUCKETS, fold: int = FOLD) -> None:
        self.spark, self.folder, self.buckets, self.fold = spark, folder.rstrip("/"), buckets, fold
        self.schemas = {name: T.StructType([T.StructField(f.name, f.dataType) for f in start.schema]) for name, (start, _, _) in tables.items()}
        self.keys = {name: keys for name, (_, keys, _) in tables.items()}
        self.by = {name: by for name, (_, _, by) in tables.items()}
        if any(set(by) - set(keys) for _, keys, by in tables.values()):
            raise ValueError("what deals rows to buckets must be of the key, as keys that go have nothing else")
        self._work: list[str] = []
        if self._record() is None:
            bases = {name: self._based(name, start, 0) for name, (start, _, _) in tables.items()}
            self._write({"commit": 0, "done": {}, "deltas": {name: [] for name in tables}, "bases": bases, "old": []})

    def _at(self, path: str):  # noqa: ANN202
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _record(self) -> dict | None:
        """The last complete record."""
        files, place = self._at(f"{self.folder}/commits")
        if not files.exists(place):
            return None
        numbers = sorted((x.getPath().getName() for x in files.listStatus(place)), reverse=True)
        for n in numbers:
            if files.exists(self._at(f"{self.folder}/commits/{n}/_SUCCESS")[1]):
                return json.loads(self.spark.read.text(f"{self.folder}/commits/{n}").first()[0])
        return None

    def _write(self, record: dict) -> None:
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/commits/{record['commit']:012}")

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.by[table]), F.lit(self.buckets)).cast("int")

    def _based(self, table: str, rows: DataFrame, number: int) -> dict[str, int]:
        """Write rows as buckets of a commit; the buckets that have some."""
        path = f"{self.folder}/{table}/base/{number}"
        own = rows.select(*self.schemas[table].names).withColumn("_bucket", self._bucket(table))
        own.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        files, place = self._at(path)
        names = [x.getPath().getName() for x in files.listStatus(place)]
        return {n.removeprefix("_bucket="): number for n in names if n.startswith("_bucket=")}

    def last(self, writer: str) -> int | None:
        """A writer's last committed batch."""
        return self._record()["done"].get(writer)

    def read(self, table: str, near: DataFrame | None = None) -> DataFrame:
        """The table as of the last commit. near: rows with the columns that deal rows to buckets; only buckets that hold some of these are read."""
        wanted = None if near is None else {str(b) for (b,) in near.select(self._bucket(table)).distinct().collect()}  # BUCKETS at most
        return self._read(table, self._record(), wanted)

    def _read(self, table: str, record: dict, wanted: set[str] | None = None) -> DataFrame:
        schema, keys = self.schemas[table], self.keys[table]
        paths = [f"{self.folder}/{table}/base/{n}/_bucket={b}" for b, n in record["bases"][table].items() if wanted is None or b in wanted]
        base = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        changed = self._changed(table, record)
        if changed is None:
            return base
        if wanted is not None:
            changed = changed.where(self._bucket(table).isin([int(b) for b in wanted]))
        return base.join(changed.select(*keys), keys, "left_anti").select(*schema.names).unionByName(changed.where("not _gone").select(*schema.names))

    def _changed(self, table: str, record: dict) -> DataFrame | None:
        """The newest row of each key that has changed since the last fold."""
        schema, out = T.StructType([*self.schemas[table], T.StructField("_gone", T.BooleanType())]), None
        for n in record["deltas"][table]:
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/delta/{n}").withColumn("_n", F.lit(n))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return None
        newest = out.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys[table]]).agg(F.max_by(F.struct(*schema.names), "_n").alias("_x"))
        return newest.select("_x.*")

    def held(self, df: DataFrame) -> DataFrame:
        """A step on the way to a commit, written to the folder and read back; it goes with the commit."""
        path = f"{self.folder}/work/{uuid.uuid4().hex}"
        self._work.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, writer: str, batch: int, changes: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> int:
        """Write a batch's changes: for each table the rows that are new or replace others, and the keys that go. Each key comes once."""
        record = self._record()
        if record["done"].get(writer, -1) >= batch:
            return record["commit"]
        n = record["commit"] + 1
        for table, (rows, gone) in changes.items():
            schema, own = self.schemas[table], None
            if rows is not None:
                own = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(False).alias("_gone"))
            if gone is not None:
                keys = self.keys[table]
                out = gone.select(*keys).distinct().select(*[(F.col(f.name) if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias("_gone"))
                own = out if own is None else own.unionByName(out)
            if own is not None:
                own.write.mode("overwrite").parquet(f"{self.folder}/{table}/delta/{n}")
                record["deltas"][table].append(n)
        record |= {"commit": n, "done": record["done"] | {writer: batch}}
        if any(len(d) >= self.fold for d in record["deltas"].values()):
            record = self._folded(record)
        self._write(record)
        while self._work:
            files, place = self._at(self._work.pop())
            files.delete(place, True)
        return n

    def _folded(self, record: dict) -> dict:
        """Deltas become parts of the bases. Files that the last fold replaced go, those that this one replaces with the next one, as they may still
        be read."""
        for path in record["old"]:
            files, place = self._at(path)
            files.delete(place, True)
        n, old, bases = record["commit"], [], {}
        for table, deltas in record["deltas"].items():
            bases[table] = dict(record["bases"][table])
            changed = self._changed(table, record)
            if changed is None:
                continue
            touched = {str(b) for (b,) in changed.select(self._bucket(table)).distinct().collect()}  # BUCKETS at most
            new = self._based(table, self._read(table, record, touched), n)
            for b in touched:
                if b in bases[table]:
                    old.append(f"{self.folder}/{table}/base/{bases[table].pop(b)}/_bucket={b}")
            bases[table] |= new
            old += [f"{self.folder}/{table}/delta/{d}" for d in deltas]
        return record | {"bases": bases, "deltas": {t: [] for t in record["deltas"]}, "old": old}
