"""Date-window screening of candidates, and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import dates
from loomsieve.operators import cutoff, evaluate, link
from loomsieve.tables import table

WINDOW = cutoff.Policy(start="1996-01-01", end="1998-12-31", end_inclusive=True)
#: Four policies that differ in the inclusiveness of their bounds; both bounds are days with orders.
VARIANTS = [(f"p{i}{j}", i == 1, j == 1) for i in (0, 1) for j in (0, 1)]


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records whose date is text, as scanned records have it."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"))


#: Dates of orders spelled in mixed ways, and spoiled, by the order key; the SQL below says the same.
def _mixed_date(key: Column, day: Column) -> Column:
    spelled = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T03:04:05Z")), F.lit("  "), F.lit("null"), F.concat(F.date_format(day, "yyyy"), F.lit("-13")), F.concat(F.date_format(day, "MMMM"), F.lit(" "), F.date_format(day, "yyyy")),
    ]
    return F.element_at(F.array(*spelled), ((key % len(spelled)) + 1).cast("int"))


MIXED_SQL = """(case o_orderkey % 10 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%m/%d')
 when 2 then strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') when 3 then strftime(o_orderdate, '%Y-%m') when 4 then strftime(o_orderdate, '%Y')
 when 5 then strftime(o_orderdate, '%Y-%m-%d') || 'T03:04:05Z' when 6 then '  ' when 7 then 'null' when 8 then strftime(o_orderdate, '%Y') || '-13'
 else strftime(o_orderdate, '%B %Y') end)"""
#: First and last day that each spelling stands for.
SPAN_SQL = """(case when o_orderkey % 10 in (0, 1, 2, 5) then cast(o_orderdate as date) when o_orderkey % 10 = 3 then cast(date_trunc('month', o_orderdate) as date)
 when o_orderkey % 10 = 4 then cast(date_trunc('year', o_orderdate) as date) end) as s,
 (case when o_orderkey % 10 in (0, 1, 2, 5) then cast(o_orderdate as date) when o_orderkey % 10 = 3 then last_day(o_orderdate)
 when o_orderkey % 10 = 4 then make_date(year(o_orderdate), 12, 31) end) as e"""


def cutoff_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window verdict per order, joined with a gold label per customer, as one row of confusion and ratios."""
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("gold"))
    decided = cutoff.decide(_published(spark, sf_dir), WINDOW).select("o_custkey", F.col("cutoff.pass").alias("kept"))
    return evaluate.with_ratios(evaluate.confusion(decided.join(gold, "o_custkey"), F.col("kept"), F.col("gold")))


def cutoff_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.split(cutoff.decide(_published(spark, sf_dir), WINDOW))[2]


def cutoff_inclusive_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy over every record in one pass: the policies are an array of the record, not a join."""
    bound = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    records = _published(spark, sf_dir).join(F.broadcast(bound))  # one row
    policies = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.lit(i).alias("start_inclusive"), F.lit(j).alias("end_inclusive")) for n, i, j in VARIANTS)))
    rows = dates.with_interval(records, F.col("published_date"), "iv").select("published_date", "iv", "start", "end", policies.alias("p"))
    status = cutoff.window_status(F.col("published_date"), F.col("iv"), {"start": F.col("start"), "end": F.col("end"), "start_inclusive": F.col("p.start_inclusive"), "end_inclusive": F.col("p.end_inclusive")})
    return rows.groupBy(F.col("p.policy").alias("policy"), status.alias("status")).agg(F.count("*").alias("n"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval decisions on partial dates: only an interval wholly outside fails."""
    rows = dates.with_interval(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), _mixed_date(F.col("o_orderkey"), F.col("o_orderdate")), "iv")
    status = dates.overlap_status(F.col("iv"), WINDOW.columns(), "missing_published_date")
    return rows.select("o_orderkey", F.col("iv.start").alias("first_day"), F.col("iv.end").alias("last_day"), status.alias("status"))


def policy_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each supplier (orders with partial dates) against all of its policies (what it shipped in a quarter, some
    without a start or an end): how many each policy lets in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    quarter = F.date_trunc("quarter", "day").cast("date")
    policies = lines.groupBy("l_suppkey", quarter.alias("quarter")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    month = F.month("quarter")
    policies = policies.select("l_suppkey", "quarter", F.struct(F.when(month != 4, F.col("a")).alias("start"), F.when(month != 10, F.col("b")).alias("end")).alias("window"))
    orders = dates.with_interval(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), _mixed_date(F.col("o_orderkey"), F.col("o_orderdate")), "iv").select("o_orderkey", "iv")
    records = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct().join(orders, "o_orderkey")
    return cutoff.meetings(records, policies, ["l_suppkey"], "iv", "window").groupBy("l_suppkey", "quarter").agg(F.count("*").alias("n"))


def date_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _mixed_date(F.col("o_orderkey"), F.col("o_orderdate"))
    rows = dates.with_interval(table(spark, sf_dir, "orders").withColumn("raw", raw), F.col("raw"), "iv")
    rows = rows.select("o_orderstatus", dates.parse_status(F.col("raw"), F.col("iv")).alias("status"), F.col("iv.start").alias("day"))
    return rows.groupBy("o_orderstatus", "status").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def split_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-dependent date bases: orders as records of an archive with comments and references derived from them."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    records = o.select(
        "o_orderkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "ArXiv").otherwise("crossref").alias("source"),
        F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 5, "0")).alias("source_id"), F.date_format("o_orderdate", "yyyy").alias("published_date"),
        F.struct(F.when(F.col("o_orderkey") % 2 == 0, day).alias("published"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Accepted at a conference in "), (F.year("o_orderdate") + 1).cast("string"))).alias("comment"), F.lit(None).cast("string").alias("doi"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("J. Data "), F.date_format("o_orderdate", "yyyy"))).alias("journal_ref")).alias("source_metadata"))
    policy = cutoff.Policy(start="1996-06-15", end="1999-03-01", end_inclusive=True, split_preprints=True)
    out = cutoff.decide(records, policy)
    return out.select("o_orderkey", *(F.col(f"cutoff.{c}").alias(n) for c, n in (("status", "status"), ("basis", "basis"), ("role", "role"), ("start", "first_day"), ("end", "last_day"))))


def policy_clause_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses per region from its nations: every third is a fallback, every fourth isn't projectable."""
    n = table(spark, sf_dir, "nation").select(
        "n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, "fallback").otherwise("hard").alias("hardness"), (F.col("n_nationkey") % 4 != 0).alias("project"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 10).alias("start"), F.date_sub(F.lit("2001-01-01").cast("date"), F.col("n_nationkey") * 7).alias("end"))
    out = cutoff.intersect_clauses(n, ["n_regionkey"])
    return out.select("n_regionkey", F.col("start").alias("first_day"), F.col("end").alias("last_day"), "fallback_applied", "n_clauses")


def year_extraction_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest year that a text names, over texts into which an order year is written."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", F.col("p_name"), F.lit("in"), (1900 + F.col("p_size") * 2).cast("string"), F.lit("or"), (F.col("p_partkey") % 3000).cast("string"), F.lit("id 120199"))
    return p.select("p_partkey", F.array_max(dates.years_in(text)).alias("latest"), F.size(dates.years_in(text)).cast("long").alias("n_years"))


def wildcard_policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rule per nation; a null in a rule matches anything."""
    rules = spark.createDataFrame([(1, 0, None, "regional"), (2, None, 7, "national"), (3, 2, 8, "both"), (4, None, None, "general")], "pos int, n_regionkey int, n_nationkey int, policy string")
    return link.wildcard_rules(table(spark, sf_dir, "nation"), rules, ["n_regionkey", "n_nationkey"], "pos", "policy")


def exclude_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows excluded by one window and judged again by a wider one: what passes gets its verdict back."""
    rows = _published(spark, sf_dir).select(
        "o_orderkey", "published_date", F.concat(F.lit("include (senior:"), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(")")).alias("final_verdict"), F.lit("reviewed").alias("review_state"),
        F.lit(None).cast("string").alias("discard_reason"), F.lit(None).cast("string").alias("pre_cutoff_final_verdict"), F.lit(None).cast("string").alias("pre_cutoff_review_state"))
    first = cutoff.decide(rows, WINDOW)
    gone = cutoff.exclude_row(F.col("final_verdict"), F.col("review_state"), F.col("cutoff.status"))
    rows = first.withColumns({c: F.when(F.col("cutoff.pass"), F.col(c)).otherwise(v) for c, v in gone.items()}).drop("cutoff")
    again = cutoff.decide(rows, cutoff.Policy(start="1995-06-01", end="2000-12-31", end_inclusive=True))
    back = cutoff.restore_row(F.col("final_verdict"), F.col("review_state"), F.col("discard_reason"), F.lit(None).cast("string"))
    out = again.withColumns({c: F.when(F.col("cutoff.pass"), v).otherwise(F.col(c)) for c, v in back.items()})
    return out.select("o_orderkey", "final_verdict", "review_state", "discard_reason")


QUERIES = {f.__name__: f for f in (cutoff_eval, cutoff_status_counts, cutoff_inclusive_variants, interval_overlap, policy_meetings, date_parse_status, split_mode, policy_clause_intersection, year_extraction_max, wildcard_policy_lookup, exclude_restore)}

_RATIOS = """coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) as recall,
 coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) as f1, coalesce(round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6), 0.0) as accuracy"""
_STATUS = lambda s, e, a, b, i="true", j="true": f"case when {i} and {e} < {a} then 'before_start' when not {i} and {e} <= {a} then 'before_or_equal_start' when {j} and {s} > {b} then 'after_end' when not {j} and {s} >= {b} then 'after_or_equal_end' else 'passed' end"
_A, _B = f"date '{WINDOW.start}'", f"date '{WINDOW.end}'"
ORACLE = {
    "cutoff_eval": f"""with s as (select cast(o_orderdate as date) between {_A} and {_B} as kept, c_acctbal > 0 as gold from orders join customer on o_custkey = c_custkey),
c as (select count(*) filter (kept and gold) as tp, count(*) filter (kept and not gold) as fp, count(*) filter (not kept and not gold) as tn, count(*) filter (not kept and gold) as fn from s)
select *, {_RATIOS} from c""",
    "cutoff_status_counts": f"select {_STATUS('d', 'd', _A, _B)} as status, count(*) as n from (select cast(o_orderdate as date) as d from orders) group by 1",
    "cutoff_inclusive_variants": f"""with b as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders),
p(policy, i, j) as (values {', '.join(f"('{n}', {str(i).lower()}, {str(j).lower()})" for n, i, j in VARIANTS)})
select policy, {_STATUS('d', 'd', 'lo', 'hi', 'i', 'j')} as status, count(*) as n from (select cast(o_orderdate as date) as d from orders), b, p group by 1, 2""",
    "interval_overlap": f"""with r as (select o_orderkey, {SPAN_SQL} from orders)
select o_orderkey, s as first_day, e as last_day, case when s is null then 'missing_published_date' else {_STATUS('s', 'e', _A, _B)} end as status from r""",
    "policy_meetings": f"""with l as (select l_orderkey, l_suppkey, cast(l_shipdate as date) as d from lineitem), p as (select l_suppkey, date_trunc('quarter', d)::date as quarter, min(d) as a, max(d) as b from l group by 1, 2),
r as (select distinct l_suppkey, o_orderkey, s, e from l join (select o_orderkey, {SPAN_SQL} from orders) on o_orderkey = l_orderkey where s is not null)
select p.l_suppkey, quarter, count(*) as n from p join r on r.l_suppkey = p.l_suppkey and (month(quarter) = 4 or r.e >= a) and (month(quarter) = 10 or r.s <= b) group by 1, 2""",
    "date_parse_status": f"""with r as (select o_orderstatus, trim({MIXED_SQL}) as t, {SPAN_SQL} from orders)
select o_orderstatus, case when t in ('', 'null') then 'missing_empty' when s is null then 'unparseable' else 'parsed' end as status, count(*) as n, min(s) as first_day, max(s) as last_day from r group by 1, 2""",
    "split_mode": f"""with r as (select o_orderkey as k, o_orderkey % 3 = 0 as arxiv, cast(o_orderdate as date) as d, year(o_orderdate) as y from orders),
r2 as (select *, case when k % 7 = 0 then 'journal_ref' when k % 5 = 0 then 'comment' else 'preprint' end as rv,
  case when k % 2 = 0 then d else (case when d >= date '2000-01-01' then cast(date_trunc('month', d) as date) else make_date(year(d) + 100, month(d), 1) end) end as ss,
  case when k % 2 = 0 then d else last_day(case when d >= date '2000-01-01' then d else make_date(year(d) + 100, month(d), 1) end) end as se,
  list_max(list_filter([case when k % 7 = 0 then y end, case when k % 5 = 0 then y + 1 end, case when k between 1900 and 2099 then k end], lambda x: x is not null)) as named from r),
r3 as (select *, make_date((case when arxiv then coalesce(named, y) else y end)::int, 1, 1) as ps, make_date((case when arxiv then coalesce(named, y) else y end)::int, 12, 31) as pe from r2),
r4 as (select *, {_STATUS('ss', 'se', "date '1996-06-15'", "date '1999-03-01'")} as st, {_STATUS('ps', 'pe', "date '1996-06-15'", "date '1999-03-01'")} as pt from r3)
select k as o_orderkey, case when arxiv and rv = 'preprint' then st when arxiv and pt <> 'passed' and st = 'passed' then st else pt end as status,
 case when arxiv and rv = 'preprint' then 'submitted_date' when arxiv and pt <> 'passed' and st = 'passed' then 'submitted_date_fallback' else 'published_date' end as basis,
 case when arxiv and rv = 'preprint' then 'preprint' when arxiv then 'peer_reviewed' else 'published_default' end as role,
 case when arxiv and (rv = 'preprint' or (pt <> 'passed' and st = 'passed')) then ss when arxiv then ps else make_date(y, 1, 1) end as first_day,
 case when arxiv and (rv = 'preprint' or (pt <> 'passed' and st = 'passed')) then se when arxiv then pe else make_date(y, 12, 31) end as last_day from r4""",
    "policy_clause_intersection": """with c as (select n_regionkey, n_nationkey % 3 <> 0 as hard, date '1995-01-01' + n_nationkey * 10 as s, date '2001-01-01' - n_nationkey * 7 as e from nation where n_nationkey % 4 <> 0),
h as (select *, bool_or(hard) over (partition by n_regionkey) as has_hard from c)
select n_regionkey, max(s)::date as first_day, min(e)::date as last_day, not bool_or(has_hard) as fallback_applied, count(*) as n_clauses from h where hard or not has_hard group by 1""",
    "year_extraction_max": """with t as (select p_partkey, list_filter([1900 + p_size * 2, p_partkey % 3000], lambda x: x between 1900 and 2099) as ys from part)
select p_partkey, list_max(ys)::int as latest, len(ys)::bigint as n_years from t""",
    "wildcard_policy_lookup": "select *, case when n_regionkey = 0 then 'regional' when n_nationkey = 7 then 'national' when n_regionkey = 2 and n_nationkey = 8 then 'both' else 'general' end as policy from nation",
    "exclude_restore": f"""with r as (select o_orderkey, cast(o_orderdate as date) as d, 'include (senior:' || (o_orderkey % 5 + 1) || ')' as v from orders),
s as (select *, {_STATUS('d', 'd', _A, _B)} as st, d between date '1995-06-01' and date '2000-12-31' as wide from r)
select o_orderkey, case when st = 'passed' or wide then v else '{cutoff.EXCLUDED}' end as final_verdict, case when st = 'passed' or wide then 'reviewed' else 'cutoff_filtered' end as review_state,
 case when st = 'passed' or wide then null else 'cutoff_time_window:' || st end as discard_reason from s""",
}
