"""A versioned key-value store over Parquet: log, sorted tables in levels, manifest versions.

Layout: ``log/batch=N`` holds appended mutations, ``tables/<id>`` sorted tables clustered by
key, ``manifest/v<N>`` the tables of version N, ``retired/v<N>.batch=<M>`` an empty marker of a log
batch that version N has in its tables.  A version is complete once its directory has Spark's
success marker; it is written after the tables it names, so readers never see a table that
isn't whole, and a marker counts only from its version on.  Batches are retired by name, not
by sequence, so a batch may hold sequences older than those of tables.  What a version no
longer needs is deleted one version later: frames that were made on the version before still
read.  One writer at a time; any number of readers.

Compaction merges the tables of a level (all of level 0, else the one with the oldest entries)
with those tables of the next level that overlap their keys.  Tombstones go where no deeper
table overlaps; a mutation older than such a tombstone must not be appended after that.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import schema
from lamina.operators import tables, versions

_TRUE = ("true", "1", "yes", "on")


def _retired_by(marker: str) -> int:
    """The version that retired a batch, from its marker's name."""
    return int(marker[1:].split(".", 1)[0])


@dataclass(frozen=True)
class StoreConfig:
    memory_bytes: int = 64 << 20
    bloom_rate: float = 0.01
    base_bytes: int = tables.BASE_BYTES
    level_multiplier: int = tables.MULTIPLIER
    level0_tables: int = tables.LEVEL0_TABLES
    compaction: bool = True
    file_bytes: int = 128 << 20
    commit_timeout_ms: int = 5000
    stale_reads: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "LAMINA_") -> StoreConfig:
        """Settings from variables; what can't be read keeps its default."""
        env, out = dict(os.environ) if env is None else env, {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is None:
                continue
            if isinstance(f.default, bool):
                out[f.name] = text in _TRUE
            else:
                try:
                    out[f.name] = type(f.default)(text)
                except ValueError:
                    continue
        return cls(**out)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or StoreConfig()
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _whole(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{folder}/_SUCCESS"))

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    # manifest

    def _version(self) -> int:
        return max([int(n[1:]) for n in self._names("manifest") if self._whole(f"manifest/{n}")], default=0)

    def manifest(self) -> DataFrame:
        v = self._version()
        return self.spark.read.schema(schema.MANIFEST).parquet(f"{self.path}/manifest/v{v:08d}") if v else self.spark.createDataFrame([], schema.MANIFEST)

    def _install(self, rows: DataFrame, retire: list[str] = []) -> None:  # noqa: B006
        """The next manifest version, which has the batches of ``retire`` in its tables.

        The version before it stays for readers with all that it needs; older ones go.
        """
        v = self._version()
        for n in self._names("retired"):  # of a version that never came
            if _retired_by(n) > v:
                self._drop(f"retired/{n}")
        for n in retire:
            self._fs.mkdirs(self._path(f"retired/v{v + 1:08d}.{n}"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{v + 1:08d}")
        for n in self._names("manifest"):
            if int(n[1:]) < v:
                self._drop(f"manifest/{n}")
        for n in self._names("retired"):
            if _retired_by(n) <= v:
                self._drop(f"log/{n.split('.', 1)[1]}")
                self._drop(f"retired/{n}")
        named = [f"{self.path}/manifest/{n}" for n in self._names("manifest") if self._whole(f"manifest/{n}")]
        needed = {r.table_id for r in self.spark.read.schema(schema.MANIFEST).parquet(*named).select("table_id").distinct().collect()}
        for n in self._names("tables"):
            if int(n) not in needed:
                self._drop(f"tables/{n}")

    # writing

    def last_seq(self) -> int:
        """The greatest sequence of tables and log together."""
        a = self.manifest().agg(F.max("max_seq")).first()[0] or 0
        return max(a, self._log().agg(F.max("seq")).first()[0] or 0)

    def _batches(self) -> list[str]:
        """Whole log batches that no table of the newest version holds yet."""
        v = self._version()
        gone = {n.split(".", 1)[1] for n in self._names("retired") if _retired_by(n) <= v}
        return [n for n in self._names("log") if n not in gone and self._whole(f"log/{n}")]

    def _log(self, names: list[str] | None = None) -> DataFrame:
        names = self._batches() if names is None else names
        return self.spark.read.schema(schema.OPS).parquet(*(f"{self.path}/log/{n}" for n in names)) if names else self.spark.createDataFrame([], schema.OPS)

    def apply(self, ops: DataFrame, batch: int | None = None) -> int:
        """Append mutations (key, deleted, value and perhaps seq) as one durable batch; how many.

        With ``batch``, a batch of this number is replaced: a step that runs again appends nothing twice.

        Without ``seq``, rows are numbered in partition order: the batch is written once, its
        partitions are counted, and the offsets (a number for each partition) complete the sequences.
        """
        if batch is None:
            taken = [*self._names("log"), *self._names("retired")]
            batch = max([int(n.split("=")[1]) for n in taken], default=0) + 1
        target = f"{self.path}/log/batch={batch:08d}"
        if "seq" in ops.columns:
            ops.select("seq", "key", "deleted", "value").write.mode("overwrite").parquet(target)
            return self.spark.read.parquet(target).count()
        base, staged = self.last_seq(), f"{self.path}/staged"
        ops.select("key", "deleted", "value", F.monotonically_increasing_id().alias("n")).write.mode("overwrite").parquet(staged)
        rows = self.spark.read.parquet(staged)
        part = F.shiftrightunsigned("n", 33).cast("int")
        counts = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
        before, offsets = base + 1, []
        for p in sorted(counts):
            offsets.append((p, before))
            before += counts[p]
        at = self.spark.createDataFrame(offsets, "p int, base bigint")
        rows.withColumn("p", part).join(at, "p").select((F.col("base") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"), "key", "deleted", "value").write.mode("overwrite").parquet(target)
        self._drop("staged")
        return before - base - 1

    def put(self, rows: DataFrame) -> int:
        return self.apply(rows.select("key", F.lit(False).alias("deleted"), "value"))

    def delete(self, keys: DataFrame) -> int:
        """Tombstones, whether or not the keys exist."""
        return self.apply(keys.select("key", F.lit(True).alias("deleted"), F.lit("").alias("value")))

    # reading

    def memory(self) -> DataFrame:
        """Log records that no table holds yet."""
        return self._log()

    def entries(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """All versions; tables whose key range lies outside [start, end] aren't read."""
        rows = self.memory().withColumn("source_rank", F.lit(0))
        keep = self.manifest()
        if start is not None:
            keep = keep.where(F.col("last_key") >= start)
        if end is not None:
            keep = keep.where(F.col("first_key") <= end)
        order = [r.table_id for r in tables.read_order(keep.withColumn("run", F.col("table_id"))).orderBy("level", "place").select("table_id").collect()]
        for rank, t in enumerate(order, 1):
            rows = rows.unionByName(self.spark.read.schema(schema.OPS).parquet(f"{self.path}/tables/{t:08d}").withColumn("source_rank", F.lit(rank)))
        return rows

    def snapshot(self) -> DataFrame:
        return versions.snapshot(self.entries(), -F.col("source_rank"))

    def get(self, key: str) -> DataFrame:
        return versions.get(self.entries(key, key), key)

    def multi_get(self, asked: DataFrame) -> DataFrame:
        lo, hi = asked.agg(F.min("key"), F.max("key")).first()
        return versions.multi_get(self.entries(lo, hi), asked)

    def scan(self, start: str, end: str, limit: int | None = None) -> DataFrame:
        return versions.scan(self.entries(start, end), start, end, limit)

    # maintenance

    def _write_table(self, rows: DataFrame, level: int) -> DataFrame | None:
        """A table clustered and sorted by key, with a bloom filter on it; its manifest row, or None if it is empty."""
        names = self._names("tables")
        t = max([int(n) for n in names], default=0) + 1
        path = f"{self.path}/tables/{t:08d}"
        n, size = rows.agg(F.count("*"), F.sum(tables.entry_bytes())).first()
        if not n:
            return None
        files = max(1, -(-size // self.config.file_bytes))
        writer = rows.select("key", "seq", "deleted", "value").repartitionByRange(files, "key").sortWithinPartitions("key").write
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, n // files))).option("parquet.bloom.filter.fpp#key", str(self.config.bloom_rate)).parquet(path)
        stats = tables.manifest(self.spark.read.schema(schema.OPS).parquet(path).withColumn("run", F.lit(t)).withColumn("level", F.lit(level)))
        return stats.select(F.col("run").cast("bigint").alias("table_id"), "level", F.lit(path).alias("path"), "n_entries", "n_deletes", "min_seq", "max_seq", "first_key", "last_key", "bytes")

    def flush(self) -> bool:
        """Memory becomes a table of level 0; its log batches retire with the version that has the table."""
        batches = self._batches()
        new = self._write_table(versions.latest(self._log(batches)), 0)
        if new is None:
            return False
        self._install(self.manifest().unionByName(new), batches)
        return True

    def maybe_flush(self) -> bool:
        """Flush if memory has reached its budget."""
        return bool(versions.memory_stats(self.memory(), self.config.memory_bytes).first().should_flush) and self.flush()

    def compact(self) -> int | None:
        """One cycle: the first level that asks for it merges with the next one; the level, or None."""
        have = self.manifest().withColumn("run", F.col("table_id"))
        level = tables.pick_level(have, base=self.config.base_bytes, multiplier=self.config.level_multiplier, trigger=self.config.level0_tables).first()[0]
        if level is None:
            return None
        inputs = tables.overlapping(have, level)
        first, last = inputs.agg(F.min("first_key"), F.max("last_key")).first()
        deeper = have.where((F.col("level") > level + 1) & (F.col("last_key") >= first) & (F.col("first_key") <= last)).limit(1).count() > 0
        order = [r.table_id for r in tables.read_order(inputs).orderBy("level", "place").select("table_id").collect()]
        rows = None
        for rank, t in enumerate(order):
            one = self.spark.read.schema(schema.OPS).parquet(f"{self.path}/tables/{t:08d}").withColumn("source_rank", F.lit(rank))
            rows = one if rows is None else rows.unionByName(one)
        new = self._write_table(tables.merge(rows, drop_tombstones=not deeper), level + 1)
        left = have.join(inputs.select("run"), "run", "left_anti").drop("run")
        self._install(left if new is None else left.unionByName(new))
        return level

    def stats(self) -> DataFrame:
        """Tables, bytes, budget and pressure of each level."""
        return tables.level_stats(self.manifest(), self.config.base_bytes, self.config.level_multiplier, self.config.level0_tables)

