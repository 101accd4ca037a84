"""URL filters as they stood when a page was fetched.

Dated list entries say that a pattern joined or left a list.  Per list and pattern they become validity
intervals, and every capture is joined, as of its fetch time, to the entries active then.  Patterns are
hosts, which hold for all their subdomains, and URL prefixes, which end at a path segment.  A capture
asks for the few patterns that could hold for it, so the join is on equal keys; the intervals of one
pattern and list never overlap, so it meets one of them at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.storage import materialize


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    rest = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^.*@|:\d*$", ""), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, as it is written."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """All patterns that hold for a URL: its host and every domain above it, and its path's beginnings by segment, at any depth."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    m = F.size(segments)
    prefixes = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) from entries (list, pattern, action, effective_at); valid_to is open if null.

    An entry 'add' starts an interval that the next entry of the same list and pattern ends, if that is
    'remove'; a further 'add' continues it.  Of entries at the same moment, 'remove' counts last, so the
    pattern is off.  Entries with a null in any column or another action do not count; repeated ones
    count once.
    """
    usable = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "pattern", "effective_at"])
    own = Window.partitionBy("list", "pattern").orderBy("effective_at")
    # The last word at each moment, then only where it changes.
    moments = usable.groupBy("list", "pattern", "effective_at").agg(F.max("action").alias("action"))
    changes = moments.withColumn("before", F.lag("action").over(own)).where(~F.col("action").eqNullSafe(F.col("before")))
    spans = changes.withColumn("valid_to", F.lead("effective_at").over(own))
    return spans.where(F.col("action") == "add").select("list", "pattern", F.col("effective_at").alias("valid_from"), "valid_to")


def listed_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (id, url, fetched_at): id, host, blocked, n_entries and lists.

    An entry is active if valid_from <= fetched_at < valid_to.  n_entries counts the distinct (list,
    pattern) active for the URL, lists names the lists, sorted.  A capture with a null or hostless URL
    or a null time is not blocked.  Repeated captures give repeated rows that agree; an empty table on
    either side is no error.
    """
    intervals = materialize(validity_intervals(entries), "url_intervals")
    rows = captures.select("id", "url", "fetched_at")
    asked = rows.distinct().select("id", "url", "fetched_at", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    # Both sides are plain shuffles on the pattern, so one host with a third of all captures is split.
    active = asked.join(intervals, "pattern").where(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    met = active.groupBy("id", "url", "fetched_at").agg(
        F.countDistinct("list", "pattern").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    met = met.select(F.col("id").alias("mid"), F.col("url").alias("murl"), F.col("fetched_at").alias("mat"), "n_entries", "lists")
    same = F.col("id").eqNullSafe(F.col("mid")) & (F.col("url") == F.col("murl")) & (F.col("fetched_at") == F.col("mat"))
    n = F.coalesce("n_entries", F.lit(0)).cast("long")
    return rows.join(met, same, "left").select(
        "id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), (n > 0).alias("blocked"), n.alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists")
    )
