"""Accepting candidates as they come: running caps, an exactly-once log, and a loop that learns and stops.

The rules are those of one walk over the candidates of a stage, so a stage is one key of the state.  What
crosses to it are the columns that rules look at; what it keeps are counts, in a map that is checkpointed, can be
read in from an earlier run and can be forgotten after a while.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tracelake.storage import new_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """Why a candidate is refused: ``reason``, if one of these holds once ``after`` candidates were accepted.

    share: with it, its value of ``column`` would be more than that share of the accepted; limit: so many of its value
    were accepted; floor: it does not have ``value``, and fewer than that share of the accepted would.  With
    ``value``, share and limit hold for that value alone.
    """

    reason: str
    column: str
    share: float | None = None
    limit: int | None = None
    value: str | None = None
    floor: float | None = None
    after: int = 0

    def refuses(self, value: str, counts: dict[tuple[str, str], int], total: int) -> bool:
        if total < self.after:
            return False
        if self.floor is not None:
            return value != self.value and counts.get((self.column, self.value), 0) / (total + 1) < self.floor
        if self.value is not None and value != self.value:
            return False
        n = counts.get((self.column, value), 0)
        return (self.share is not None and (n + 1) / (total + 1) > self.share) or (self.limit is not None and n >= self.limit)


def as_bucket(value: object) -> str:
    """What a rule counts a value as: scores to two places, nothing as unknown."""
    if value is None or value != value or value == "":
        return "unknown"
    return f"{value:.2f}" if isinstance(value, float) else str(value)


def walk(rows: Iterator[tuple], columns: list[str], rules: list[Rule], counts: dict[tuple[str, str], int], total: int) -> tuple[list[str | None], int]:
    """The reason or None for each row, one after the other; ``counts`` grows with what is accepted.

    A row is (reason that it came with, values of ``columns``).
    """
    out = []
    for reason, *values in rows:
        buckets = {c: as_bucket(v) for c, v in zip(columns, values, strict=True)}
        if reason is None:
            reason = next((r.reason for r in rules if r.refuses(buckets[r.column], counts, total)), None)
            if reason is None:
                total += 1
                for key in buckets.items():
                    counts[key] = counts.get(key, 0) + 1
        out.append(reason)
    return out, total


class _Caps(StatefulProcessor):
    def __init__(self, order: str, columns: list[str], rules: list[Rule], ttl: int | None):
        self.order, self.columns, self.rules, self.ttl = order, columns, rules, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("counts", "name string, value string", "n long", self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        for name, value, n in zip(initialState["name"], initialState["value"], initialState["n"], strict=True):
            self.held.updateValue((name, value), (int(n),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = {(k[0], k[1]): v[0] for k, v in self.held.iterator()}
        before, total = dict(counts), counts.pop(("", ""), 0)
        frame = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        plain = lambda c: [None if v is None or v != v else v for v in frame[c]]
        reasons, total = walk(zip(plain("reason"), *(plain(c) for c in self.columns), strict=True), self.columns, self.rules, counts, total)
        for name, n in (counts | {("", ""): total}).items():
            if before.get(name) != n:
                self.held.updateValue(name, (n,))
        yield frame.assign(reason=pd.Series(reasons, dtype=object))

    def close(self) -> None:
        pass


def seeds(accepted: DataFrame, by: str, rules: list[Rule]) -> DataFrame:
    """(by, name, value, n): what ``running_verdicts`` starts from, counted over what an earlier run accepted."""
    columns = sorted({r.column for r in rules})
    bucket = F.udf(lambda v: as_bucket(v), "string")
    # One row for each value that occurs, before Python sees any.
    every = [F.struct(F.lit("").alias("name"), F.lit("").alias("value"))]
    found = accepted.groupBy(by).agg(F.count("*").alias("n")).select(by, every[0].alias("key"), "n")
    for c in columns:
        some = accepted.groupBy(by, c).agg(F.count("*").alias("n")).select(by, F.struct(F.lit(c).alias("name"), bucket(F.col(c)).alias("value")).alias("key"), "n")
        found = found.unionByName(some)
    return found.groupBy(by, "key").agg(F.sum("n").alias("n")).select(by, "key.name", "key.value", "n")


def running_verdicts(candidates: DataFrame, by: str, order: str, rules: list[Rule], seed: DataFrame | None = None, forget_ms: int | None = None) -> DataFrame:
    """(by, order, columns of the rules, reason) of a stream of candidates; ``reason`` is null for those accepted.

    Candidates of a ``by`` are judged one after the other, those of one micro-batch in ``order``, which is not
    null; if earlier batches hold smaller ones, the verdicts do not depend on how the stream was cut.  A
    candidate may come with a ``reason``: it is refused and counts for nothing.  Of several rules that refuse, the first
    gives the reason.  Null and empty values are ``unknown``; a null ``by`` is a stage of its own.
    ``seed`` is what ``seeds`` returns; counts that did not change for ``forget_ms`` are forgotten.
    """
    columns = sorted({r.column for r in rules})
    rows = candidates.select(by, order, *columns, "reason" if "reason" in candidates.columns else F.lit(None).cast("string").alias("reason"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    processor = _Caps(order, columns, rules, forget_ms)
    mode = "ProcessingTime" if forget_ms else "None"
    return rows.groupBy(by).transformWithStateInPandas(processor, kinds, "Append", mode, seed.groupBy(by) if seed is not None else None)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as state maps need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Ledger:
    """A table that batches are appended to exactly once, and the record of which were.

    A batch is written to a folder of its own attempt; a small file that names (run, batch, attempt) makes it
    part of the table, by one rename.  A batch that is in the record is not written again, an attempt that is not
    is never read, so a stream that dies between the two, or is run again, leaves no row twice and loses none.
    The file also holds what the batch counted, for whatever decides on the next one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self, run: str | None = None) -> list[dict]:
        """The record, a row for each batch, in order."""
        rows = self.spark.read.text(f"{self.folder}/ledger/*.json", wholetext=True).collect() if self._fs.globStatus(self._path("ledger/*.json")) else []
        found = [json.loads(r.value) for r in rows]
        return sorted((e for e in found if run in (None, e["run"])), key=lambda e: (e["run"], e["batch"]))

    def holds(self, name: str) -> bool:
        """Whether there is a file of that name under the folder."""
        return self._fs.exists(self._path(name))

    def has(self, run: str, batch: int) -> bool:
        return self.holds(f"ledger/{run}-{batch}.json")

    def arrive(self, made: str, name: str) -> bool:
        """Rename a folder to where a stream looks for it; whether there is one."""
        if not self.holds(made):
            return False
        self._fs.mkdirs(self._path(name).getParent())
        if not self._fs.rename(self._path(made), self._path(name)):
            raise OSError(f"{name} is there already")
        return True

    def commit(self, entry: dict) -> None:
        """Add a batch to the record."""
        self._fs.mkdirs(self._path("ledger"))
        draft, final = self._path(f"ledger/.{uuid.uuid4().hex}"), self._path(f"ledger/{entry['run']}-{entry['batch']}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"{final} is there already")

    def append(self, batch: DataFrame, run: str, number: int, counts: Callable[[DataFrame], dict] | None = None) -> dict | None:
        """Write ``batch`` unless it is in the record; returns the entry, or None."""
        if self.has(run, number):
            return None
        attempt = f"rows/{run}/{number}/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.folder}/{attempt}")
        entry = {"run": run, "batch": number, "attempt": attempt}
        if counts:
            entry |= counts(self.spark.read.schema(batch.schema).parquet(f"{self.folder}/{attempt}"))
        self.commit(entry)
        return entry

    def table(self, schema=None) -> DataFrame:
        """The rows of every batch in the record."""
        paths = [f"{self.folder}/{e['attempt']}" for e in self.entries()]
        if not paths:
            if schema is None:
                raise ValueError("an empty ledger has no schema of its own")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*paths)

    def vacuum(self) -> int:
        """Delete the attempts that are not in the record, of batches that are; returns how many."""
        known, n = {(e["run"], e["batch"]): e["attempt"].rsplit("/", 1)[1] for e in self.entries()}, 0
        for (run, batch), attempt in known.items():
            for status in self._fs.listStatus(self._path(f"rows/{run}/{batch}")):
                if status.getPath().getName() != attempt:
                    self._fs.delete(status.getPath(), True)
                    n += 1
        return n


def append_once(stream: DataFrame, ledger: Ledger, run: str, marks: str, counts: Callable[[DataFrame], dict] | None = None) -> StreamingQuery:
    """Start a query that appends ``stream`` to ``ledger``; ``marks`` is its checkpoint, ``run`` the name that goes with it.  The caller awaits it."""
    writer = stream.writeStream.foreachBatch(lambda df, number: (ledger.append(df, run, number, counts), None)[1])
    with keyed_state(stream.sparkSession):
        return writer.option("checkpointLocation", marks).trigger(availableNow=True).start()


def batch_counts(batch: DataFrame) -> dict:
    """accepted and, for each reason, how many candidates of a batch were refused."""
    rows = batch.groupBy("reason").agg(F.count("*").alias("n")).collect()  # one row for each reason that a rule names
    return {"accepted": sum(r.n for r in rows if r.reason is None), "refused": {r.reason: r.n for r in rows if r.reason is not None}}


@dataclass
class Control:
    """What a run knows after its batches: the next batch is made from it."""

    batches: int = 0
    accepted: int = 0
    refused: dict[str, int] = field(default_factory=dict)
    learnings: list[str] = field(default_factory=list)

    def after(self, entry: dict, top: int, remembered: int) -> Control:
        total = {r: self.refused.get(r, 0) + n for r, n in entry["refused"].items()}
        worst = sorted(entry["refused"], key=lambda r: (-entry["refused"][r], r))[:top]
        return Control(self.batches + 1, self.accepted + entry["accepted"], self.refused | total, (worst + self.learnings)[:remembered])

    @property
    def rate(self) -> float:
        """Share of this run's candidates that were accepted."""
        return self.accepted / max(1, self.accepted + sum(self.refused.values()))


def control_of(ledger: Ledger, run: str, top: int = 3, remembered: int = 6) -> Control:
    """Where a run stands, from its record alone; the commonest reasons of a batch come first, newest batch first."""
    control = Control()
    for entry in ledger.entries(run):
        control = control.after(entry, top, remembered)
    return control


def generate_until(
    spark: SparkSession, generate: Callable[[int, list[str]], DataFrame], by: str, order: str, rules: list[Rule], folder: str, run: str, target: int, most_batches: int,
    warm_up: int, least_rate: float, seed: DataFrame | None = None, top: int = 3, remembered: int = 6,
) -> tuple[str, Control]:
    """Candidates batch by batch until ``target`` are accepted; returns why it ended, and where it stands.

    ``generate(number, learnings)`` makes a batch, knowing the commonest reasons for which the last ones were refused.
    One stream judges each by ``rules`` and appends it to the ledger in ``folder``, from which the next batch's
    learnings come; its state goes from batch to batch in its checkpoint.  It ends with ``target`` reached, ``budget`` (``most_batches`` made) or ``rate``: from
    the ``warm_up``-th batch on, fewer than ``least_rate`` of all candidates accepted.  Run again with the same
    ``folder`` it goes on after the last batch in the record; a batch that was made but not judged is judged then.
    """
    ledger = Ledger(spark, f"{folder}/log")
    while True:
        control = control_of(ledger, run, top, remembered)
        if control.accepted >= target:
            return "target", control
        if control.batches >= warm_up and control.rate < least_rate:
            return "rate", control
        if control.batches >= most_batches:
            return "budget", control
        place = f"{folder}/inbox/{control.batches:06d}"
        if not ledger.holds(f"../inbox/{control.batches:06d}/_SUCCESS"):
            generate(control.batches, control.learnings).write.mode("overwrite").parquet(place)
        judge_new(spark, spark.read.parquet(place).schema, f"{folder}/inbox", by, order, rules, ledger, run, f"{folder}/marks", seed)
        if control_of(ledger, run).batches != control.batches + 1:
            raise RuntimeError(f"batch {control.batches} was not judged")


def judge_new(spark: SparkSession, schema, inbox: str, by: str, order: str, rules: list[Rule], ledger: Ledger, run: str, marks: str, seed: DataFrame | None = None) -> DataFrame:
    """One micro-batch over what came to ``inbox`` since the last one; returns the judged stream, whose schema is the log's."""
    judged = running_verdicts(spark.readStream.schema(schema).parquet(f"{inbox}/*"), by, order, rules, seed)
    append_once(judged, ledger, run, marks, batch_counts).awaitTermination()
    return judged


#: Candidates of a stage that one micro-batch judges, about: they are walked over in one task, whose Python holds them all.
AT_ONCE = 1_000_000


def parts_of(table: DataFrame, by: str, order: str, batches: int = 1, at_once: int | None = None) -> tuple[Column, DataFrame, int]:
    """(part, table, parts): the number of the batch that a row of ``table`` comes in, rising with ``order`` inside each ``by``.

    Batches share the table evenly; a stage that has more than ``at_once`` rows for each is dealt out by itself to as many more as
    it takes.  Rows of equal ``order`` stay together.
    """
    at_once = at_once or AT_ONCE
    cuts = table.approxQuantile(order, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(order) > cut).cast("int")
    large = table.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")).where(F.col("__n") > batches * at_once)
    most = large.agg(F.max("__n")).first()[0]
    if most is None:
        return part, table, batches
    parts = math.ceil(most / at_once)
    own = F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts).alias("__cuts")
    # There are fewer large stages than rows / at_once, and a stage has as many cuts as parts.
    meets = F.col(by).eqNullSafe(F.col("__by"))
    held = table.join(F.broadcast(large.select("__by")), meets).groupBy("__by").agg(own)
    placed = table.join(F.broadcast(held), meets, "left")
    return F.when(F.col("__cuts").isNotNull(), F.size(F.filter("__cuts", lambda c: c < F.col(order)))).otherwise(part), placed, parts


def judged_in_batches(table: DataFrame, by: str, order: str, rules: list[Rule], batches: int, seed: DataFrame | None = None) -> DataFrame:
    """Run ``running_verdicts`` over a table that comes in ``batches`` of rising ``order``, or more if stages are large; returns the log.

    The query ends after every batch and starts again from its checkpoint.
    """
    spark, folder = table.sparkSession, new_path(table.sparkSession, "judged")
    part, placed, parts = parts_of(table, by, order, batches)
    # The table is read once, and each part comes in by a rename.
    placed.select(part.alias("__part"), *table.columns).write.partitionBy("__part").parquet(f"{folder}/made")
    ledger, judged = Ledger(spark, f"{folder}/log"), None
    for number in range(parts):
        if not ledger.arrive(f"../made/__part={number}", f"../in/{number:06d}"):
            table.limit(0).write.parquet(f"{folder}/in/{number:06d}")
        judged = judge_new(spark, table.schema, f"{folder}/in", by, order, rules, ledger, "run", f"{folder}/marks", seed)
    return ledger.table(judged.schema)
