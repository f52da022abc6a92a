"""Evaluation of labels and scores, and grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import verdicts
from loomsieve.operators import evaluate
from loomsieve.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of documents, with the documents' language as the run."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 0).alias("predicted"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two first-round scores and a senior score for line items."""
    li = table(spark, sf_dir, "lineitem")
    first, second = (F.col("l_orderkey") % 5 + 1).cast("int"), (F.col("l_partkey") % 5 + 1).cast("int")
    senior = F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 5 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") != 7, first).alias("first"), second.alias("second"), senior.alias("senior"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_ratios(evaluate.confusion(_judged(spark, sf_dir), F.col("predicted"), F.col("gold"), ["lang"]))


def macro_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_micro(evaluate.confusion(_judged(spark, sf_dir), F.col("predicted"), F.col("gold"), ["lang"]))


def metric_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return evaluate.mean_spread(o, F.col("o_totalprice") / 1000, ["c_nationkey"], 4)


def prediction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") > 50).alias("positive"))
    return evaluate.stability(e, ["user_id", "event_type"], F.col("positive"))


def top3_reasons_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("team"), "event_type").agg(F.count("*").alias("n"))
    return evaluate.reasons_line(e, ["team"], "event_type", "n")


def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return evaluate.top_per_group(o, ["o_orderpriority"], [F.asc("o_orderkey")], 3)


def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per flag and status, per flag, and in all."""
    li = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def panel_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    both = {name: verdicts.panel_verdict(F.col("first"), F.col("second"), F.col("senior"), flag) for name, flag in (("senior_first", True), ("junior_first", False))}
    return s.select("l_orderkey", "l_linenumber", *(v.alias(n) for n, v in both.items()))


def verdict_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive counts of panel verdicts under two modes, with the verdicts that give no prediction."""
    v = panel_verdict(spark, sf_dir).select(verdicts.label(F.col("senior_first")).alias("label"), verdicts.predicted(F.col("senior_first")).alias("wide"), verdicts.predicted(F.col("senior_first"), "include_only").alias("strict"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.sum("wide").cast("long").alias("wide"), F.sum("strict").cast("long").alias("strict"))


def verdict_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's own verdict word, else the score that its length stands for."""
    c = table(spark, sf_dir, "conversations")
    verdict = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  Include ("), "role", F.lit(")"))).when(F.col("turn") % 3 == 1, F.lit("?"))
    own = verdicts.label(verdict)
    return c.select("conv_id", "turn", F.coalesce(own, verdicts.score_label((F.length("text") % 5 + 1))).alias("label"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    v = F.col("first")
    return evaluate.histogram(s, v, {"low": v.between(1, 2), "middle": v == 3, "high": v.between(4, 5)}, ["l_returnflag"])


def panel_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often both juniors agree on high or low, disagree, and the senior is asked."""
    a, b, s = F.col("first"), F.col("second"), F.col("senior")
    tests = {"double_high": (a >= 4) & (b >= 4), "double_low": (a <= 2) & (b <= 2), "differ": a != b, "senior": s.isNotNull(), "senior_overrules": s.isNotNull() & (verdicts.score_label(s) != verdicts.score_label(a))}
    return _scores(spark, sf_dir).groupBy("l_returnflag").agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


def safe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of large line items per ship year and mode, null where a group has none to divide by."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_linestatus").agg(F.count_if(F.col("l_quantity") > 40).alias("large"), F.count_if((F.col("l_discount") < 0.02) & (F.col("l_tax") > 0.07)).alias("base"))
    return li.select("year", "l_linestatus", "large", "base", F.round(F.try_divide("base", "large"), 6).alias("share"), verdicts.ratio(F.col("base"), F.lit(0)).alias("none"))


def delta_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of each nation's orders in two halves of time, and which way it moved."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    late = F.col("o_orderdate") >= "1998-06-01"
    a, b = F.avg(F.when(~late, F.col("o_totalprice"))), F.avg(F.when(late, F.col("o_totalprice")))
    return o.groupBy("c_nationkey").agg(F.round(b / a - 1, 6).alias("delta")).withColumn("bucket", verdicts.delta_bucket(F.col("delta")))


def distinct_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_linenumber").alias("pairs"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"))


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent values, by count and then by value."""
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return p.orderBy(F.desc("n"), F.asc("p_type")).limit(20)


QUERIES = {f.__name__: f for f in (
    confusion_metrics, macro_micro_f1, metric_mean_std, prediction_stability, top3_reasons_per_group, status_samples, rollup_totals, panel_verdict, verdict_predictions,
    verdict_label_fallback, score_histogram, panel_usage, safe_rates, delta_buckets, distinct_aggregates, frequent_values)}

_COUNTS = """(select lang, count(*) filter (p and g) as tp, count(*) filter (p and not g) as fp, count(*) filter (not p and not g) as tn, count(*) filter (not p and g) as fn
 from (select lang, quality = 1 as g, toxic = 0 as p from labels join documents using (doc_id)) group by 1)"""
_R = lambda d: f"coalesce(tp / nullif(tp + fp, 0), 0.0) as {d}precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as {d}recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as {d}f1, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0) as {d}accuracy"
_SCORES = """(select l_orderkey, l_linenumber, l_returnflag, case when l_linenumber <> 7 then (l_orderkey % 5 + 1)::int end as a, (l_partkey % 5 + 1)::int as b, case when l_suppkey % 3 = 0 then (l_suppkey % 5 + 1)::int end as s from lineitem)"""
_LABEL = lambda x: f"case when {x} >= 4 then 'include' when {x} = 3 then 'maybe' when {x} <= 2 then 'exclude' end"
_PAIR = "case when a >= 4 and b >= 4 then 'include' when a <= 2 and b <= 2 then 'exclude' else 'maybe' end"
_PANEL = f"""(select l_orderkey, l_linenumber, case when s is not null then {_LABEL('s')} || ' (senior:' || s || ')' when a is not null then {_PAIR} || ' (junior:' || a || ',' || b || ')' end as senior_first,
 case when a is not null and {_PAIR} <> 'maybe' then {_PAIR} || ' (junior:' || a || ',' || b || ')' when s is not null then {_LABEL('s')} || ' (senior:' || s || ')' when a is not null then {_PAIR} || ' (junior:' || a || ',' || b || ')' end as junior_first from {_SCORES})"""
ORACLE = {
    "confusion_metrics": f"select lang, tp, fp, tn, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(accuracy, 6) as accuracy from (select *, {_R('')} from {_COUNTS})",
    "macro_micro_f1": f"""with e as (select *, {_R('')} from {_COUNTS}), t as (select sum(tp) as tp, sum(fp) as fp, sum(tn) as tn, sum(fn) as fn, avg(precision) as mp, avg(recall) as mr, avg(f1) as mf from e), m as (select mp, mr, mf, {_R('micro_')} from t)
select round(mp, 6) as macro_precision, round(mr, 6) as macro_recall, round(mf, 6) as macro_f1, round(micro_precision, 6) as micro_precision, round(micro_recall, 6) as micro_recall, round(micro_f1, 6) as micro_f1, round(micro_accuracy, 6) as micro_accuracy from m""",
    "metric_mean_std": "select c_nationkey, round(avg(o_totalprice / 1000), 4) as mean, round(stddev_pop(o_totalprice / 1000), 4) as spread from orders join customer on c_custkey = o_custkey group by 1",
    "prediction_stability": "select user_id, event_type, count(value) as n_runs, round(avg((value > 50)::int), 6) as positive_rate, count(distinct value > 50) > 1 as unstable from events group by 1, 2",
    "top3_reasons_per_group": "with c as (select user_id % 10 as team, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by team order by n desc, event_type) as k from c) select team, string_agg(event_type || ':' || n, ' | ' order by k) as reasons from r where k <= 3 group by 1",
    "status_samples": "select * from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey)::int as rank from orders) where rank <= 3",
    "rollup_totals": "select l_returnflag, l_linestatus, count(*) as n, grouping_id(l_returnflag, l_linestatus)::int as level, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)",
    "panel_verdict": f"select * from {_PANEL}",
    "verdict_predictions": f"with v as (select split_part(senior_first, ' ', 1) as label from {_PANEL}) select label, count(*) as n, sum(case label when 'include' then 1 when 'maybe' then 1 when 'exclude' then 0 end)::bigint as wide, sum(case label when 'include' then 1 when 'maybe' then 0 when 'exclude' then 0 end)::bigint as strict from v group by 1",
    "verdict_label_fallback": f"select conv_id, turn, case when turn % 3 = 0 then 'include' else {_LABEL('(length(text) % 5 + 1)')} end as label from conversations",
    "score_histogram": f"select l_returnflag, count(*) filter (a between 1 and 2) as low, count(*) filter (a = 3) as middle, count(*) filter (a between 4 and 5) as high, count(*) filter (a is null) as missing, count(*) as total from {_SCORES} group by 1",
    "panel_usage": f"select l_returnflag, count(*) filter (a >= 4 and b >= 4) as double_high, count(*) filter (a <= 2 and b <= 2) as double_low, count(*) filter (a <> b) as differ, count(s) as senior, count(*) filter (s is not null and {_LABEL('s')} <> {_LABEL('a')}) as senior_overrules from {_SCORES} group by 1",
    "safe_rates": "with c as (select year(l_shipdate)::int as year, l_linestatus, count(*) filter (l_quantity > 40) as large, count(*) filter (l_discount < 0.02 and l_tax > 0.07) as base from lineitem group by 1, 2) select *, round(base / nullif(large, 0), 6) as share, 0.0::double as none from c",
    "delta_buckets": "with d as (select c_nationkey, round(avg(o_totalprice) filter (o_orderdate >= '1998-06-01') / avg(o_totalprice) filter (o_orderdate < '1998-06-01') - 1, 6) as delta from orders join customer on c_custkey = o_custkey group by 1) select *, case when delta > 0.01 then 'better' when delta < -0.01 then 'worse' else 'same' end as bucket from d",
    "distinct_aggregates": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct (l_suppkey, l_linenumber)) as pairs, string_agg(distinct l_linestatus, ',' order by l_linestatus) as statuses from lineitem group by 1",
    "frequent_values": "select p_type, count(*) as n from part group by 1 order by n desc, p_type limit 20",
}
