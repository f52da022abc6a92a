"""Keyed records: de-duplication, linkage, merges, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import text
from loomsieve.operators import dedupe, evaluate, link, route
from loomsieve.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as candidates keyed by their role and conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.by_key(_turns(spark, sf_dir), ["conv_id", "role"], "turn", "first")


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.by_key(_turns(spark, sf_dir), ["conv_id", "role"], "turn", "last")


def dedupe_first_pos_last_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), "event_type", "value")
    return dedupe.by_key(e, ["user_id"], "pos", "first_pos_last_val")


def duplicate_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return dedupe.disagreement(e, ["user_id", "day"], "event_type").filter("n_rows > 1")


def label_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose rows carry two labels."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("label"))
    return dedupe.disagreement(e, ["user_id"], "label").filter("disagrees").select("user_id", "n_rows", "n_values")


def exact_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts agree up to case and white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("copies > 1")


def collision_free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", text.key_slug(F.col("p_name")).alias("base"))
    return dedupe.collision_free(p, "base", "p_partkey", "name").select("p_partkey", "name")


def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = dedupe.batches(o, "o_orderkey", 100, ["o_orderstatus", "o_orderpriority"])
    return out.groupBy("o_orderstatus", "o_orderpriority", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def _matched(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    left = p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "left_key")
    right = p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "right_key")
    out = link.best_jaccard(left, right, "left_key", "right_key", "title", least, short=3)
    return out.select("left_key", "right_key", F.round("similarity", 6).alias("similarity"), "same_title")


def jaccard_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title by words for each part of even number among the odd ones."""
    return _matched(spark, sf_dir, 0.6)


def weak_match_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many best matches a strict gate on similarity lets through, and how many a weak one."""
    out = _matched(spark, sf_dir, 0.5)
    return out.agg(F.count("right_key").alias("weak"), F.count_if(F.col("right_key").isNotNull() & (F.col("same_title") | (F.col("similarity") >= 0.75))).alias("strict"), F.count_if("same_title").alias("same_title"))


def jaccard_best_match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best benchmark item by words for each document, with its similarity; under the threshold without the item."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_key"), F.col("text").alias("title"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("right_key"), F.col("text").alias("title"))
    return link.best_jaccard_of_all(d, b, "left_key", "right_key", "title").withColumn("similarity", F.round("similarity", 6))


def weak_match_gate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many best matches of documents there are without a gate (any similarity above 0), and with it."""
    out = jaccard_best_match_texts(spark, sf_dir)
    return out.agg(F.count_if(F.col("similarity") > 0).alias("ungated"), F.count("right_key").alias("gated"), F.count_if("same_title").alias("same_title"))


def cascade_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked to suppliers by number, else by a unique nation, else by a unique name ending."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("num"), F.col("c_nationkey").alias("nation"), F.right("c_name", F.lit(3)).alias("ending"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("s_nation"), F.right("s_name", F.lit(3)).alias("s_ending"), F.col("s_suppkey").alias("s_num"))
    return link.cascade(c, s, [("number", "num", "s_num"), ("nation", "nation", "s_nation"), ("ending", "ending", "s_ending")], "s_suppkey").select("c_custkey", "s_suppkey", "method")


def normalized_key_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of parts, respelled, resolved exactly, by their normalized form, ambiguously, or not at all."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    known = p.select(F.concat_ws("-", "p_brand", F.expr("cast(p_partkey % 700 as string)")).alias("key")).union(p.filter("p_partkey % 5 = 0").select(F.lower(F.concat_ws("_", "p_brand", F.expr("cast(p_partkey % 700 as string)"))).alias("key")))
    wanted = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat_ws("-", "p_brand", F.expr("cast(p_partkey % 700 as string)"))).when(F.col("p_partkey") % 4 == 1, F.upper(F.concat_ws(" ", "p_brand", F.expr("cast(p_partkey % 700 as string)")))).when(F.col("p_partkey") % 4 == 2, F.concat("p_brand", F.lit("/none"))).alias("key"))
    return link.resolve(wanted, known, "key").select("p_partkey", "status", "resolved")


def combine_with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the first half merged with later rows for a third of all: overriding rows win, nulls included."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    base = o.filter("o_orderkey % 2 = 0")
    over = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return link.override(base, over, "o_orderkey", ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": "base_status"})


def upsert_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("pos"), "c_mktsegment")
    base = c.filter("c_custkey <= 1000")
    changes = c.filter("c_custkey > 900").select("c_custkey", (F.col("c_custkey") - 901).alias("pos"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return link.upsert(base, changes, "c_custkey", "pos", F.col("c_custkey") % 2 == 0)


def anti_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.both_sided_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def missing_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank priorities of orders filled from the customer's segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("note"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(" ").alias("note"))
    return link.fill_blanks(o, c, "key", ["note"]).select("o_orderkey", "note")


def source_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several sources that knows a balance for each nation and rank, with its trace."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(F.when(F.col("c_acctbal") > 9900, F.round("c_acctbal", 2))).alias("a"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max(F.when(F.col("s_acctbal") > 5000, F.round("s_acctbal", 2))).alias("b"))
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    out = link.waterfall(n, [("customer", F.col("a")), ("supplier", F.col("b")), ("default", F.when(F.col("n_regionkey") < 3, 0.0))], "balance")
    return out.select("n_nationkey", "balance", "balance_source", F.array_join("balance_trace", " ").alias("trace"))


def batch_result_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their outputs and errors by id: an error beats an output, a missing one and an invalid one show."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id"))
    outputs = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("custom_id"), F.concat(F.lit('{"score": '), F.when(F.col("l_quantity") > 45, '"high"').otherwise(F.col("l_quantity").cast("int").cast("string")), F.lit("}")).alias("content"))
    outputs = outputs.groupBy("custom_id").agg(F.min("content").alias("content"))
    errors = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.095").select(F.col("l_orderkey").alias("custom_id")).distinct().withColumn("error", F.lit("rejected"))
    return route.batch_results(requests, outputs, errors, "custom_id", "score int", "score between 1 and 40").groupBy("status").agg(F.count("*").alias("n"), F.sum("result.score").cast("long").alias("total"))


def routing_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review stages over orders with an ordered precedence of stopping reasons."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.max("l_linenumber").alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    steps = [("cutoff_filtered", F.to_date("o_orderdate") < F.lit("1996-01-01").cast("date")), ("stage1_missing", F.col("qty").isNull()), ("stage1_excluded", F.col("qty") < 40), ("fulltext_missing", F.col("lines") < 2), ("stage2_failed", F.col("disc") < 0.05), ("stage2_excluded", F.col("c_acctbal") < 0)]
    return route.first_state(o, steps, "reviewed").groupBy("state").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def before_after_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    half = lambda test, name: o.filter(test).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return evaluate.before_after(half("o_orderdate < '1998-01-01'", "b"), half("o_orderdate >= '1998-01-01'", "a"), ["o_custkey"], "n")


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe comparison of two snapshots of suppliers, field by field."""
    s = table(spark, sf_dir, "supplier")
    old = s.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("bal"))
    new = s.filter("s_suppkey % 10 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.round("s_acctbal", 2)).alias("bal"))
    return route.changes(old, new, "s_suppkey", ["s_nationkey", "bal"]).select("s_suppkey", "status", F.array_join("changed", ",").alias("changed"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side, on both, and their ordered union."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).filter("c_acctbal > 9000")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).filter("s_acctbal > 4000")
    tag = lambda df, name: df.distinct().select("k", F.lit(name).alias("part"))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left")).unionByName(tag(b.subtract(a), "right"))


QUERIES = {f.__name__: f for f in (
    dedupe_first, dedupe_last, dedupe_first_pos_last_val, duplicate_disagreement, label_conflict_check, exact_copy_groups, collision_free_names, fixed_batches, jaccard_best_match,
    weak_match_gate, jaccard_best_match_texts, weak_match_gate_texts, cascade_link, normalized_key_resolve, combine_with_base, upsert_ordered, anti_join_report, missing_backfill, source_waterfall, batch_result_join,
    routing_state_machine, before_after_diff, changed_rows, set_operations)}

_JACCARD = """with p as (select p_partkey as k, trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) as t from part),
w as (select k, t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) as ws from p),
u as (select k, len(ws) as n, unnest(ws) as x from w),
s as (select a.k as l, b.k as r, any_value(a.n) as ln, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as sim from u a join u b on a.x = b.x where a.k % 2 = 0 and b.k % 2 = 1 group by 1, 2),
f as (select s.*, a.t = b.t as same from s join w a on a.k = l join w b on b.k = r),
m as (select *, row_number() over (partition by l order by same desc, sim desc, r) as rn from f where same or sim >= LEAST)
select l as left_key, case when same or ln >= 3 then r end as right_key, round(sim, 6) as similarity, same as same_title from m where rn = 1"""
_JACCARD_TEXTS = """with d as (select 'd' as s, doc_id as k, text from documents union all select 'b', item_id, text from benchmark),
t as (select s, k, trim(regexp_replace(lower(replace(replace(coalesce(text, ''), '&', ' and '), '@', ' at ')), '[^a-z0-9]+', ' ', 'g')) as t from d),
w as (select s, k, t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) as ws from t),
u as (select s, k, len(ws) as n, unnest(ws) as x from w),
m as (select a.k as l, b.k as r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as sim from u a join u b on a.x = b.x where a.s = 'd' and b.s = 'b' group by 1, 2),
e as (select a.k as l, min(b.k) as r from w a join w b on a.t = b.t where a.s = 'd' and b.s = 'b' and a.t <> '' group by 1),
f as (select *, row_number() over (partition by l order by sim desc, r) as rn from m)
select w.k as left_key, case when e.r is not null then e.r when len(w.ws) >= 7 and f.sim >= 0.9 then f.r end as right_key, round(coalesce(f.sim, 0), 6) as similarity, e.r is not null as same_title
from w left join (select * from f where rn = 1) f on f.l = w.k left join e on e.l = w.k where w.s = 'd'"""
_TURNS = "select conv_id, role, turn, length(text)::bigint as n from conversations"
_PKEY = "p_brand || '-' || (p_partkey % 700)"
ORACLE = {
    "dedupe_first": f"select * from ({_TURNS}) qualify row_number() over (partition by conv_id, role order by turn) = 1",
    "dedupe_last": f"select * from ({_TURNS}) qualify row_number() over (partition by conv_id, role order by turn desc) = 1",
    "dedupe_first_pos_last_val": "select user_id, min(event_id) as pos, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1",
    "duplicate_disagreement": "select user_id, cast(ts as date) as day, count(*) as n_rows, count(distinct event_type) as n_values, count(distinct event_type) > 1 as disagrees from events group by 1, 2 having count(*) > 1",
    "label_conflict_check": "select user_id, count(*) as n_rows, count(distinct value > 50) as n_values from events group by 1 having count(distinct value > 50) > 1",
    "exact_copy_groups": r"select md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) as digest, count(*) as copies, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) > 1",
    "collision_free_names": "with p as (select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as base from part), n as (select *, row_number() over (partition by base order by p_partkey) as rn from p) select p_partkey, case when rn = 1 then base else base || '__dup' || (rn - 1) end as name from n",
    "fixed_batches": "with n as (select *, (row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) - 1) // 100 as batch from orders) select o_orderstatus, o_orderpriority, batch::bigint as batch, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from n group by 1, 2, 3",
    "jaccard_best_match": _JACCARD.replace("LEAST", "0.6"),
    "weak_match_gate": f"select count(right_key) as weak, count(*) filter (right_key is not null and (same_title or similarity >= 0.75)) as strict, count(*) filter (same_title) as same_title from ({_JACCARD.replace('LEAST', '0.5')})",
    "jaccard_best_match_texts": _JACCARD_TEXTS,
    "weak_match_gate_texts": f"select count(*) filter (similarity > 0) as ungated, count(right_key) as gated, count(*) filter (same_title) as same_title from ({_JACCARD_TEXTS})",
    "cascade_link": """with c as (select c_custkey, case when c_custkey % 3 = 0 then c_custkey end as num, c_nationkey, right(c_name, 3) as e from customer),
n as (select s_nationkey, min(s_suppkey) as k from supplier group by 1 having count(distinct s_suppkey) = 1), x as (select right(s_name, 3) as e, min(s_suppkey) as k from supplier group by 1 having count(distinct s_suppkey) = 1)
select c_custkey, coalesce(a.s_suppkey, n.k, x.k) as s_suppkey, case when a.s_suppkey is not null then 'number' when n.k is not null then 'nation' when x.k is not null then 'ending' end as method
from c left join supplier a on a.s_suppkey = num left join n on n.s_nationkey = c_nationkey left join x on x.e = c.e""",
    "normalized_key_resolve": f"""with known as (select {_PKEY} as key from part union all select lower(p_brand || '_' || (p_partkey % 700)) from part where p_partkey % 5 = 0),
loose as (select regexp_replace(lower(key), '[^a-z0-9]+', '', 'g') as n, count(distinct key) as c, min(key) as k from known group by 1),
w as (select p_partkey, case p_partkey % 4 when 0 then {_PKEY} when 1 then upper(p_brand || ' ' || (p_partkey % 700)) when 2 then p_brand || '/none' end as key from part)
select p_partkey, case when e.key is not null then 'exact' when c = 1 then 'normalized' when c > 1 then 'retrieval_ambiguous' else 'retrieval_failed' end as status, case when e.key is not null then w.key when c = 1 then k end as resolved
from w left join (select distinct key from known) e on e.key = w.key left join loose on n = regexp_replace(lower(w.key), '[^a-z0-9]+', '', 'g')""",
    "combine_with_base": """with b as (select * from orders where o_orderkey % 2 = 0), v as (select * from orders where o_orderkey % 3 = 0)
select coalesce(b.o_orderkey, v.o_orderkey) as o_orderkey, b.o_orderstatus as base_status, case when v.o_orderkey is not null then 'X' else b.o_orderstatus end as o_orderstatus,
case when v.o_orderkey is not null then (case when v.o_orderkey % 5 <> 0 then v.o_orderpriority end) else b.o_orderpriority end as o_orderpriority,
case when v.o_orderkey is null then 'base' when b.o_orderkey is null then 'appended' else 'override' end as origin from b full outer join v on b.o_orderkey = v.o_orderkey""",
    "upsert_ordered": """with m as (select max(c_custkey) as last from customer where c_custkey <= 1000)
select c_custkey, case when c_custkey <= 1000 then c_custkey else last + 1 + c_custkey - 901 end as pos, case when c_custkey > 900 and c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment,
case when c_custkey > 1000 then 'appended' when c_custkey > 900 and c_custkey % 2 = 0 then 'replaced' else 'kept' end as action from customer, m where c_custkey <= 1000 or c_custkey % 2 = 0""",
    "anti_join_report": "select count(*) filter (d.doc_id is not null and l.doc_id is not null) as both, count(*) filter (l.doc_id is null) as left_only, count(*) filter (d.doc_id is null) as right_only from (select distinct doc_id from documents) d full outer join (select distinct doc_id from labels) l on d.doc_id = l.doc_id",
    "missing_backfill": "select o_orderkey, case when c_custkey % 4 <> 0 then c_mktsegment when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then o_orderpriority end as note from orders left join customer on c_custkey = o_custkey",
    "source_waterfall": """with c as (select c_nationkey as k, max(case when c_acctbal > 9900 then round(c_acctbal, 2) end) as a from customer group by 1), s as (select s_nationkey as k, max(case when s_acctbal > 5000 then round(s_acctbal, 2) end) as b from supplier group by 1)
select n_nationkey, coalesce(a, b, case when n_regionkey < 3 then 0.0 end) as balance, case when a is not null then 'customer' when b is not null then 'supplier' when n_regionkey < 3 then 'default' end as balance_source,
case when a is not null then 'customer:match' when b is not null then 'customer:miss supplier:match' when n_regionkey < 3 then 'customer:miss supplier:miss default:match' else 'customer:miss supplier:miss default:miss' end as trace
from nation left join c on c.k = n_nationkey left join s on s.k = n_nationkey""",
    "batch_result_join": """with o as (select l_orderkey as k, rtrim(min(case when l_quantity > 45 then '"high"}' else cast(trunc(l_quantity)::int as varchar) || '}' end), '}') as v from lineitem where l_linenumber = 1 group by 1),
e as (select distinct l_orderkey as k from lineitem where l_discount >= 0.095),
r as (select case when e.k is not null then 'error' when o.k is null then 'missing' when try_cast(v as int) between 1 and 40 then 'ok' else 'parse_or_validation_failed' end as status, try_cast(v as int) as v from orders left join o on o.k = o_orderkey left join e on e.k = o_orderkey)
select status, count(*) as n, sum(case when status = 'ok' then v end)::bigint as total from r group by 1""",
    "routing_state_machine": """with l as (select l_orderkey, sum(l_quantity) as q, max(l_discount) as d, max(l_linenumber) as n from lineitem group by 1),
r as (select o_orderkey, case when cast(o_orderdate as date) < date '1996-01-01' then 'cutoff_filtered' when q is null then 'stage1_missing' when q < 40 then 'stage1_excluded' when n < 2 then 'fulltext_missing' when d < 0.05 then 'stage2_failed' when c_acctbal < 0 then 'stage2_excluded' else 'reviewed' end as state
from orders left join l on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey) select state, count(*) as n, min(o_orderkey) as first_key from r group by 1""",
    "before_after_diff": """with b as (select o_custkey as k, count(*) as n from orders where o_orderdate < '1998-01-01' group by 1), a as (select o_custkey as k, count(*) as n from orders where o_orderdate >= '1998-01-01' group by 1),
j as (select coalesce(b.k, a.k) as o_custkey, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after from b full outer join a on a.k = b.k)
select *, n_after - n_before as delta, case when n_before = 0 then 'new' when n_after = 0 then 'resolved' when n_after < n_before then 'partial' else 'remaining' end as state from j""",
    "changed_rows": """with c as (select s_suppkey, s_suppkey % 10 = 0 as gone, s_suppkey % 4 = 0 as a, s_suppkey % 3 = 0 and round(s_acctbal, 2) <> 0 as b from supplier)
select s_suppkey, case when gone then 'removed' when a or b then 'changed' else 'no_material_change' end as status, case when gone then '' else concat_ws(',', case when a then 's_nationkey' end, case when b then 'bal' end) end as changed from c""",
    "set_operations": """with a as (select distinct c_nationkey as k from customer where c_acctbal > 9000), b as (select distinct s_nationkey as k from supplier where s_acctbal > 4000)
select k, 'both' as part from (select k from a intersect select k from b) union all select k, 'left' from (select k from a except select k from b) union all select k, 'right' from (select k from b except select k from a)""",
}
