"""Incremental loads: what is still to do, latest states, attempts, and joins to the last state before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.operators.dedupe import numbered


def latest(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key, ties by all columns; an aggregate, so that a busy key shrinks before the shuffle."""
    others = [c for c in df.columns if c != key]
    row = F.struct(pos, *(c for c in others if c != pos))
    return df.groupBy(key).agg(F.max(row).alias("__row")).select(key, *(F.col(f"__row.{c}") for c in others))


def pending(wanted: DataFrame, outcomes: DataFrame, key: str, pos: str, success: Column) -> DataFrame:
    """Wanted keys whose latest outcome isn't a success, or that have none."""
    return wanted.join(latest(outcomes, key, pos).filter(success), key, "left_anti")


def attempts(df: DataFrame, key: str, pos: str, success: Column, most: int) -> DataFrame:
    """Per key: attempts made until the first success or the limit, and whether it is done, gave_up or open.

    Aggregates only: the first success, then the rows up to it, so a busy key shrinks before each shuffle.
    """
    rows = df.select(key, F.col(pos).alias("__pos"), F.coalesce(success, F.lit(False)).alias("__ok"))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("__ok"), F.col("__pos"))).alias("__first"), F.count("*").alias("c"))
    upto = rows.join(first.select(key, "__first").filter("__first is not null"), key).groupBy(key).agg(F.count_if(F.col("__pos") <= F.col("__first")).alias("first_ok"))
    out = first.join(upto, key, "left")
    outcome = F.when(F.col("first_ok") <= most, "done").when(F.col("c") >= most, "gave_up").otherwise("open")
    return out.select(key, F.least(F.coalesce("first_ok", "c"), F.lit(most), "c").cast("long").alias("n_attempts"), outcome.alias("outcome"))


def spaced(requests: DataFrame, source: str, pos: str, seconds: dict[str, float], out: str = "start_at") -> DataFrame:
    """When each request may start, in seconds, so that those of one source keep its interval: the place among them times the
    interval (none for sources that aren't named)."""
    interval = F.coalesce(*(F.when(F.col(source) == name, F.lit(float(s))) for name, s in seconds.items()), F.lit(0.0))
    return numbered(requests, [source], pos, "__k").withColumn(out, (F.col("__k") - 1) * interval).drop("__k")


def earliest_starts(requests: DataFrame, source: str, pos: str, arrival: str, seconds: dict[str, float], out: str = "start_at", chunk: int = 100_000) -> DataFrame:
    """When each request starts if it waits until its source's interval has passed since the start of the one before it (in the
    order of the numeric ``pos``): a timestamp, not before its own ``arrival``. Sources without an interval never wait.

    The k-th start is the latest of all earlier arrivals plus the steps since them, so it is a running maximum of arrival minus
    k intervals. That maximum is taken within chunks of a source's requests and carried over from one row per chunk, so one
    busy source is spread over tasks.
    """
    step = F.coalesce(*(F.when(F.col(source) == name, F.lit(round(s * 1_000_000))) for name, s in seconds.items()), F.lit(0))
    rows = numbered(requests, [source], pos, "__k").withColumns({"__step": step, "__chunk": F.floor((F.col("__k") - 1) / chunk)})
    rows = rows.withColumn("__free", F.unix_micros(F.col(arrival).cast("timestamp")) - F.col("__k") * F.col("__step"))
    per = rows.groupBy(source, "__chunk").agg(F.max("__free").alias("m"))
    before = F.max("m").over(Window.partitionBy(source).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = per.select(F.struct(source, "__chunk").alias("__at"), before.alias("__before"))
    inside = F.max("__free").over(Window.partitionBy(source, "__chunk").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__inside": inside, "__key": F.struct(source, "__chunk")})
    both = rows.join(carried, F.col("__key").eqNullSafe(F.col("__at")))
    start = F.timestamp_micros(F.greatest("__inside", "__before") + F.col("__k") * F.col("__step"))
    return both.select(*requests.columns, F.when(F.col("__step") > 0, start).otherwise(F.col(arrival).cast("timestamp")).alias(out))


def running(df: DataFrame, key: str, ts: str, tie: str, value: str, label: str, bucket: str = "day") -> DataFrame:
    """Every row with the running sum of ``value`` in its key's order (time, then ``tie``), the labels before and after it, and
    the key's first tie: running, before, after, first.

    Rows are ordered within a key's time buckets; what comes from other buckets is carried over from one row per bucket, so a
    key's history is spread over tasks.
    """
    order = F.struct(ts, tie)
    rows = df.withColumn("__bucket", F.date_trunc(bucket, F.col(ts)))
    per = rows.groupBy(key, "__bucket").agg(F.sum(value).alias("s"), F.min_by(label, order).alias("head"), F.max_by(label, order).alias("tail"), F.min(order).alias("least"))
    along = Window.partitionBy(key).orderBy("__bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = per.select(
        F.struct(key, "__bucket").alias("__at"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__sum"), F.lag("tail").over(along).alias("__tail"), F.lead("head").over(along).alias("__head"),
        F.first("least").over(whole).getField(tie).alias("first"))
    w = Window.partitionBy(key, "__bucket").orderBy(ts, tie)
    inside = rows.withColumns({
        "__own": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__nth": F.row_number().over(w), "__left": F.count("*").over(w.rowsBetween(1, Window.unboundedFollowing)),
        "__before": F.lag(label).over(w), "__after": F.lead(label).over(w), "__key": F.struct(key, "__bucket")})
    out = inside.join(carried, F.col("__key").eqNullSafe(F.col("__at")))
    return out.select(
        *df.columns, (F.col("__sum") + F.coalesce("__own", F.lit(0))).alias("running"), F.when(F.col("__nth") > 1, F.col("__before")).otherwise(F.col("__tail")).alias("before"),
        F.when(F.col("__left") > 0, F.col("__after")).otherwise(F.col("__head")).alias("after"), "first")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], bucket: str = "day") -> DataFrame:
    """Left rows with the values of the last right row of the key at or before their time (the greatest values, where
    several have that time).

    Both sides go through sorted windows of one key and one time bucket instead of a range join; what a bucket begins with
    is the last state of the buckets before, one row each. So a key's history is spread over tasks.
    """
    state = F.struct(*values)
    kind = right.select(state.alias("s")).schema["s"].dataType
    cut = F.date_trunc(bucket, F.col(ts))
    asked = left.withColumns({"__r": F.lit(1), "__state": F.lit(None).cast(kind), "__bucket": cut})
    events = right.select(F.col(key), F.col(ts), F.lit(0).alias("__r"), state.alias("__state"), cut.alias("__bucket"))
    # The state after each bucket, then the one before it.
    ends = events.groupBy(key, "__bucket").agg(F.max(F.struct(ts, "__state")).alias("__end"))
    needed = ends.unionByName(asked.select(key, "__bucket").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)))
    per = needed.groupBy(key, "__bucket").agg(F.max("__end").alias("__end"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(F.col(key).alias("__k"), F.col("__bucket").alias("__b"), F.last("__end.__state", ignorenulls=True).over(earlier).alias("__carried"))
    within = Window.partitionBy(key, "__bucket").orderBy(ts, "__r", "__state").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(events, allowMissingColumns=True).withColumn("__last", F.last("__state", ignorenulls=True).over(within))
    out = both.filter("__r = 1").join(carried, F.col(key).eqNullSafe(F.col("__k")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left")
    return out.select(*left.columns, *(F.coalesce(F.col("__last"), F.col("__carried")).getField(v).alias(v) for v in values))
