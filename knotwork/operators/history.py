"""History of changing attributes: consecutive snapshots are differenced, their events get a period.

A snapshot is one row per key. diff() compares two of them by a null-safe full outer join that classifies
inserted, changed, deleted and same keys; histories are unions of such events, closed by the begin of the
next one. Version rows become daily snapshots, the last state of each key and day. Each is differenced with
the key's snapshot before it; only the days in which a key has several states are differenced again by
second, and the seconds with several states by instant.

One key may hold a third of all rows, on one day if it must be: no window has more rows than a key has days,
a day seconds or a second instants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.scratch import Scratch


def diff(before: DataFrame, after: DataFrame, keys: list[str], attrs: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, change ('inserted', 'changed', 'deleted', 'same'), both values of each attribute as a_old and a_new, and the columns carry of after.

    Nulls are values: a null key matches a null key, and null equals null in an attribute. Other columns of
    the inputs are left out, so clashing names do no harm. Keys must be unique within a side; an empty side
    gives only insertions or deletions.
    """
    b = before.select(*[F.col(k).alias(f"__b_{k}") for k in keys], *[F.col(a).alias(f"{a}_old") for a in attrs], F.lit(True).alias("__in_b"))
    a = after.select(*[F.col(k).alias(f"__a_{k}") for k in keys], *[F.col(x).alias(f"{x}_new") for x in attrs], *carry, F.lit(True).alias("__in_a"))
    on = reduce(lambda x, y: x & y, [F.col(f"__b_{k}").eqNullSafe(F.col(f"__a_{k}")) for k in keys])
    same = reduce(lambda x, y: x & y, [F.col(f"{x}_old").eqNullSafe(F.col(f"{x}_new")) for x in attrs], F.lit(True))
    change = F.when(F.col("__in_b").isNull(), "inserted").when(F.col("__in_a").isNull(), "deleted").when(same, "same").otherwise("changed")
    return b.join(a, on, "full_outer").select(
        *[F.when(F.col("__in_a").isNull(), F.col(f"__b_{k}")).otherwise(F.col(f"__a_{k}")).alias(k) for k in keys],
        change.alias("change"),
        *[c for x in attrs for c in (F.col(f"{x}_old"), F.col(f"{x}_new"))],
        *carry,
    )


def next_in_key(alone: DataFrame, others: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """The rows of both with out = the next larger value of order, a time, in the key, null for the last. Both have a column day, that of order.

    alone: rows that are the only one of their key and day; others: the rest, of other days. Of each day one row goes through a
    window of the key's days; rows of shared days look in their second, then in their day, then at the next day.
    """
    names = [c for c in alone.columns if c not in (key, "day", order)]
    heads = others.groupBy(key, "day").agg(F.min(order).alias(order)).select(key, "day", order, F.lit(None).cast(alone.select(F.struct(*names)).schema[0].dataType).alias("__r"), F.lit(False).alias("__alone"))
    days = alone.select(key, "day", order, F.struct(*names).alias("__r"), F.lit(True).alias("__alone")).unionByName(heads)
    days = days.withColumn(out, F.lead(order).over(Window.partitionBy(key).orderBy("day")))
    first = days.where("__alone").select(key, "day", order, "__r.*", out)
    later = days.where(~F.col("__alone")).select(F.col(key).alias("__dk"), F.col("day").alias("__dd"), F.col(out).alias("__later"))
    rest = others.withColumn("__s", F.date_trunc("second", order))
    near = rest.withColumn("__near", F.lead(order).over(Window.partitionBy(key, "__s").orderBy(order)))
    seconds = rest.groupBy(key, "day", "__s").agg(F.min(order).alias("__head")).withColumn("__far", F.lead("__head").over(Window.partitionBy(key, "day").orderBy("__s")))
    seconds = seconds.join(later, (F.col(key) == F.col("__dk")) & (F.col("day") == F.col("__dd"))).select(F.col(key).alias("__k"), F.col("__s").alias("__u"), F.coalesce("__far", "__later").alias("__far"))
    second = near.join(seconds, (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__u"))).withColumn(out, F.coalesce("__near", "__far"))
    return first.unionByName(second.select(*first.columns))


def history_of_snapshots(snapshots: list[tuple[object, DataFrame]], keys: list[str], attrs: list[str]) -> DataFrame:
    """keys, attrs, valid_from, valid_to (null: still valid) from (time, snapshot) in order of time.

    A key that is missing in a snapshot ends there; it may come back. No snapshot: not allowed; an empty one
    ends every key. Each pair of neighbours costs one join of the two snapshots; the history is never read again.
    """
    if not snapshots:
        raise ValueError("at least one snapshot is needed")
    first = snapshots[0][1].limit(0)
    events: list[DataFrame] = []
    for (t, now), before in zip(snapshots, [first, *[s for _, s in snapshots[:-1]]]):
        d = diff(before, now, keys, attrs).where("change <> 'same'")
        events.append(d.select(*keys, *[F.col(f"{a}_new").alias(a) for a in attrs], F.lit(t).alias("valid_from"), (F.col("change") == "deleted").alias("__gone")))
    w = Window.partitionBy(*keys).orderBy("valid_from")  # one key has at most one event a snapshot
    return reduce(DataFrame.unionByName, events).withColumn("valid_to", F.lead("valid_from").over(w)).where(~F.col("__gone")).drop("__gone")


def history_of_versions(versions: DataFrame, key: str, version: str, at: str, seq: str, attrs: dict[str, Column]) -> DataFrame:
    """key, version, the attributes, valid_from, valid_to from append-only version rows.

    Of rows sharing a version only the one with the highest seq counts; of several of a key at one instant
    only the one with the highest seq. A period begins where an attribute differs from the row before, nulls
    being values. Rows without a key or an instant have no place in a history and are left out; a row
    without a version counts by itself; a null seq is lower than any other. An empty table gives no rows.
    """
    rows = versions.select(F.col(key).alias("k"), F.col(version).alias("v"), F.col(at).alias("t"), F.coalesce(F.col(seq), F.lit(-(2**62))).alias("s"), *[c.alias(a) for a, c in attrs.items()])
    unnamed = F.col("v").isNull()
    counted = rows.groupBy("v", F.when(unnamed, F.col("s")).alias("us"), F.when(unnamed, F.coalesce("k", F.lit(""))).alias("uk")).agg(F.max_by(F.struct("k", "t", "s", *attrs), "s").alias("r")).select("v", "r.*")
    counted = counted.where(F.col("k").isNotNull() & F.col("t").isNotNull()).withColumn("day", F.to_date("t"))
    # divided by key and day once: the states and their number in the day follow without another shuffle
    states = counted.repartition("k", "day").groupBy("k", "day", "t").agg(F.max_by(F.struct("v", *attrs), "s").alias("r")).select("k", "day", "t", "r.*")
    tmp = Scratch(versions.sparkSession)
    states = tmp.cut(states.withColumn("n", F.count("*").over(Window.partitionBy("k", "day"))))
    alone, others = _events(tmp, states, list(attrs))
    return next_in_key(alone, others, "k", "t", "valid_to").select(F.col("k").alias(key), F.col("v").alias(version), *attrs, F.col("t").alias("valid_from"), "valid_to")


def _events(tmp: Scratch, states: DataFrame, attrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """k, day, t, v, attrs of the states that are their key's first or differ from the one before: those alone on their day, and the others.

    states: k, day, t, v, attrs, n: one a key and instant; n is the number of the key's states that day.
    """
    last = F.max(F.struct("t", "v", *attrs)).alias("r")
    found, group, seeds, left = [], ["k"], None, states.where("n > 1").drop("n").withColumn("second", F.date_trunc("second", "t")).withColumn("instant", F.col("t"))
    for period in ("day", "second", "instant"):
        snaps = left.groupBy(*group, period).agg(last, F.count("*").alias("n")).select(*group, period, "n", "r.*")
        if period == "day":
            snaps = states.where("n = 1").select(*snaps.columns).unionByName(snaps)
        snaps = snaps.withColumn("j", F.row_number().over(Window.partitionBy(*group).orderBy(period)))
        before = snaps.select(*group, (F.col("j") + 1).alias("j"), *attrs)
        before = before if seeds is None else before.unionByName(seeds)
        d = tmp.cut(diff(before, snaps, [*group, "j"], attrs, (period, "n", "t", "v")))
        found.append(d.where((F.col("n") == 1) & F.col("change").isin("inserted", "changed")).select("k", "day", "t", "v", *[F.col(f"{a}_new").alias(a) for a in attrs]))
        several = d.where("n > 1")
        if not several.limit(1).count():  # each snapshot is the one state of its period
            break
        group = [*group, period]
        left = left if period == "day" else left.join(several.select(*group), group, "left_semi")
        seeds = several.where("change <> 'inserted'").select(*group, F.lit(1).alias("j"), *[F.col(f"{a}_old").alias(a) for a in attrs])
    rest = found[1:] or [found[0].limit(0)]
    return found[0], reduce(DataFrame.unionByName, rest)
