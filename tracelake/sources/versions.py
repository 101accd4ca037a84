"""Tables that are replaced whole or by the key, so that a reader sees the old state or the new one and nothing between."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.names import unused


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


class Pointer:
    """A small file that names the state of a table; it is replaced by one rename over the old one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> dict | None:
        if not _fs(self.spark, self.path).exists(_path(self.spark, self.path)):
            return None
        return json.loads(self.spark.read.text(self.path, wholetext=True).first().value)

    def write(self, state: dict) -> None:
        draft = f"{self.path}.{uuid.uuid4().hex}"
        out = _fs(self.spark, self.path).create(_path(self.spark, draft), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        uri = _path(self.spark, self.path).toUri()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration())
        context.rename(_path(self.spark, draft), _path(self.spark, self.path), options)


class Versioned:
    """A table that is rewritten whole, perhaps from itself; the version before stays readable until it is dropped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._current = Pointer(spark, f"{self.folder}/current.json")

    def read(self) -> DataFrame:
        state = self._current.read()
        if state is None:
            raise ValueError(f"nothing was written to {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{state['version']}")

    def write(self, df: DataFrame) -> None:
        """Replace the table; a failure before the end leaves the old one."""
        before, version = self._current.read(), f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{version}")
        self._current.write({"version": version, "before": before and before["version"]})

    def vacuum(self) -> int:
        """Delete every version but the current one and the one before; returns how many."""
        state, fs, n = self._current.read() or {}, _fs(self.spark, self.folder), 0
        for status in fs.listStatus(_path(self.spark, self.folder)):
            name = status.getPath().getName()
            if name.startswith("version-") and name not in (state.get("version"), state.get("before")):
                fs.delete(status.getPath(), True)
                n += 1
        return n


class KeyedCache:
    """Rows by key, of which the last one written counts: a base with one row for each key, and deltas on top.

    Both are laid out in ``buckets`` by a hash of the key.  A lookup joins the base as it is and groups only the
    deltas; compaction rewrites only buckets that deltas touch.  A state file names the base folder of each bucket
    and the deltas that count, so a lookup or compaction that dies changes nothing.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self._state = Pointer(spark, f"{self.folder}/state.json")

    def _now(self) -> dict:
        return self._state.read() or {"base": {}, "deltas": [], "writes": 0, "schema": None}

    def put(self, rows: DataFrame) -> None:
        """Add or replace rows, one for each key; of several rows with a key that of the greatest other columns counts, null keys are left out."""
        state, folder = self._now(), f"delta-{uuid.uuid4().hex}"
        others = [c for c in rows.columns if c != self.key]
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*others)).alias("v")).select(self.key, "v.*").select(*rows.columns)
        one.withColumn("bucket_of", self._bucket()).write.partitionBy("bucket_of").parquet(f"{self.folder}/{folder}")
        state["deltas"].append(folder)
        state["schema"] = state["schema"] or one.schema.jsonValue()
        self._state.write(state | {"writes": state["writes"] + 1})

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _schema(self, state: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(state["schema"])

    def _deltas(self, state: dict) -> DataFrame | None:
        """The last row of each key among the deltas."""
        if not state["deltas"]:
            return None
        kinds = self._schema(state).add("bucket_of", "integer")
        parts = [self.spark.read.schema(kinds).parquet(f"{self.folder}/{d}").withColumn("write_of", F.lit(i)) for i, d in enumerate(state["deltas"])]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("write_of")))
        return every.withColumn("nth_of", last).where("nth_of = 1").drop("nth_of", "write_of")

    def _base(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = sorted({(f, int(b)) for b, f in state["base"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return None
        kinds = self._schema(state)
        return self.spark.read.schema(kinds).parquet(*[f"{self.folder}/{f}/bucket_of={b}" for f, b in folders])

    def get(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``cached``, the struct that the cache has for their key, or null."""
        state = self._now()
        if state["schema"] is None:
            return rows.withColumn("cached", F.lit(None))
        others = [c for c in self._schema(state).names if c != self.key]
        out, names = rows, []
        for name, table in (("delta", self._deltas(state)), ("base", self._base(state))):
            if table is not None:
                names.append(unused(out, f"of_{name}"))
                held = table.select(self.key, F.struct(*others).alias(names[-1]))
                out = out.join(held, self.key, "left")
        return out.withColumn("cached", F.coalesce(*names)).drop(*names)

    def compact(self) -> list[int]:
        """Work the deltas into the base; returns the buckets that were rewritten."""
        state = self._now()
        deltas = self._deltas(state)
        if deltas is None:
            return []
        touched = sorted(r.b for r in deltas.select(F.col("bucket_of").alias("b")).distinct().collect())  # at most ``buckets`` rows
        base, folder = self._base(state, touched), f"base-{uuid.uuid4().hex}"
        whole = deltas.drop("bucket_of")
        if base is not None:
            whole = whole.unionByName(base.join(deltas.select(self.key), self.key, "left_anti"))
        # A bucket is one file of the base for each task that wrote to it.
        whole.withColumn("bucket_of", self._bucket()).repartition("bucket_of").write.partitionBy("bucket_of").parquet(f"{self.folder}/{folder}")
        self._state.write(state | {"base": state["base"] | {str(b): folder for b in touched}, "deltas": []})
        return touched


def run_folders(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, tuple[str, ...]]]:
    """(path, groups) of the folders directly under ``folder`` whose names match ``pattern``, by rising groups; one entry a run, not a row."""
    found = []
    for status in _fs(spark, folder).listStatus(_path(spark, folder)):
        match = re.fullmatch(pattern, status.getPath().getName())
        if status.isDirectory() and match:
            found.append((status.getPath().toString(), match.groups()))
    return sorted(found, key=lambda f: (f[1], f[0]))


def latest_run(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the last run by the groups of ``pattern``; null without one."""
    runs = run_folders(spark, folder, pattern)
    return runs[-1][0] if runs else None
