"""Streams over the tables, run to the end and compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.registry import Tables, query
from tracelake.storage import new_path
from tracelake.streaming import acceptance as acc
from tracelake.streaming import incremental as inc


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """The keys that a running dedup lets through once each."""
    return inc.drain(inc.running_dedup(inc.stream_of(t.spark, t.folder, "events").select("user_id", "event_type"), "user_id", "event_type"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(t: Tables) -> DataFrame:
    """Counts by day and type."""
    out = inc.drain(inc.tumbling_counts(inc.stream_of(t.spark, t.folder, "events"), "ts", "1 day", "event_type"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query()
def stream_diversity_cap(t: Tables) -> DataFrame:
    """Events accepted under a cap of types for each user; tests hold it against a loop."""
    return inc.drain(inc.diversity_cap(inc.stream_of(t.spark, t.folder, "events"), "user_id", "event_type", "event_id", 0.3, 10))


#: A stage's caps, in the order in which they are asked.
STAGE_RULES = [
    acc.Rule("diversity_cap_weak_score", "weak_score", share=0.2, after=30), acc.Rule("diversity_cap_failure_type", "failure_type", share=0.3, after=30),
    acc.Rule("tier_quota_easy_anchor", "tier", share=0.15, value="easy_anchor", after=20), acc.Rule("tier_quota_partial_frontier", "tier", share=0.5, value="partial_frontier", after=20),
    acc.Rule("tier_quota_need_frontier", "tier", floor=0.3, value="frontier", after=20),
]


def candidates(t: Tables) -> DataFrame:
    """Events as candidates of three stages, with a score, a kind of failure and a tier."""
    tier = F.when(F.col("event_id") % 4 == 0, "easy_anchor").when(F.col("event_id") % 3 == 0, "partial_frontier").otherwise("frontier")
    score = F.when(F.col("user_id") % 11 != 0, F.floor(F.col("value") / 12.5) / 16)
    return t.events.select("event_id", (F.col("user_id") % 3).alias("stage"), score.alias("weak_score"), F.col("event_type").alias("failure_type"), tier.alias("tier"))


@query()
def stream_stage_caps(t: Tables) -> DataFrame:
    """Every candidate of a stage with the reason that refuses it, if any; tests hold it against one walk."""
    return acc.judged_in_batches(candidates(t), "stage", "event_id", STAGE_RULES, batches=3)


@query()
def stream_several_caps(t: Tables) -> DataFrame:
    """Three caps at once over the stream of events; tests hold it against the walk."""
    trace = F.concat_ws(":", "user_id", "event_type")
    rows = t.events.select("event_id", F.lit("all").alias("stage"), trace.alias("trace"), (F.col("event_id") % 31).alias("template"), F.col("event_type").alias("tools"))
    caps = {"trace": 2, "template": 8, "tools": 60}
    out = acc.judged_in_batches(rows, "stage", "event_id", [acc.Rule(f"{c}_full", c, limit=n) for c, n in caps.items()], batches=2)
    return out.where("reason is null").select("event_id")


@query("""SELECT event_id, step FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS step, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY event_id) AS r FROM events) WHERE r <= 2""")
def stream_step_samples(t: Tables) -> DataFrame:
    """The first two events of each hour, appended to a log as they come; an hour is a key of the state."""
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH").alias("step"), F.lit("s").alias("sample"))
    out = acc.judged_in_batches(rows, "step", "event_id", [acc.Rule("step_full", "sample", limit=2)], batches=2)
    return out.where("reason is null").select("event_id", "step")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_exactly_once(t: Tables) -> DataFrame:
    """Events appended to a ledger, and a second run over the same input, which adds nothing."""
    folder = new_path(t.spark, "once")
    ledger = acc.Ledger(t.spark, folder)
    stream = inc.stream_of(t.spark, t.folder, "events").select("event_id", "user_id", "event_type")
    for marks in ("one", "two"):
        acc.append_once(stream, ledger, "run", f"{folder}/{marks}").awaitTermination()
    return ledger.table(stream.schema)


@query()
def stream_generation_loop(t: Tables) -> DataFrame:
    """A quarter of the users a batch, those of refused failure types left out of the next ones, until too few are accepted; tests hold it against a loop."""
    rows = candidates(t).where("stage = 0")
    folder = new_path(t.spark, "generation")

    def generate(number: int, learnings: list[str]) -> DataFrame:
        made = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == number % 4)
        return made.where(F.col("failure_type") != "error") if "diversity_cap_failure_type" in learnings else made

    acc.generate_until(t.spark, generate, "stage", "event_id", STAGE_RULES, folder, "stage0", target=10**9, most_batches=4, warm_up=2, least_rate=0.02)
    return acc.Ledger(t.spark, f"{folder}/log").table()
