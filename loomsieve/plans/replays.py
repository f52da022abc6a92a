"""Replays of review rounds, stage gates, stored results judged anew, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import verdicts
from loomsieve.operators import cutoff, replay
from loomsieve.tables import table

OLD = cutoff.Policy(start="1996-01-01", end="1998-12-31", end_inclusive=True)
NEW = cutoff.Policy(start="1995-06-01", end="1999-06-30", end_inclusive=True)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed rows: two first-round scores, for a third of them a senior score (some of them invalid)."""
    k = F.col("o_orderkey")
    first, second = k % 5 + 1, F.floor(k / 5) % 5 + 1
    senior = F.when(k % 3 == 0, k % 6)
    scored = table(spark, sf_dir, "orders").select(
        F.when(k % 50 != 0, F.concat(F.lit(" "), k.cast("string"))).alias("key"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").alias("paper"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        first.cast("int").alias("first"), second.cast("int").alias("second"), senior.cast("int").alias("senior"), F.col("o_orderstatus").alias("status"))
    rows = scored.withColumn("key", F.trim("key"))
    return rows.withColumn("final_verdict", verdicts.panel_verdict(F.col("first"), F.col("second"), verdicts.score(F.col("senior"))))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 10 == 0, "unknown").when(k % 3 == 0, " Yes").when(k % 3 == 1, "FALSE").otherwise("0")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("key"), k.alias("pos"), raw.alias("label"))


def key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is their own or a nested record's; the first of each key stays."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(F.when(k % 4 == 0, "  ").when(k % 4 != 1, k.cast("string")).alias("key"), F.struct(F.when(k % 8 != 0, F.concat(F.lit(" m"), k.cast("string"))).alias("key")).alias("metadata"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"))
    return replay.keyed_rows(rows, "pos", nested=F.col("metadata.key")).select("key", "pos")


def gold_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.gold_labels(_gold(spark, sf_dir), "pos", "label")


def senior_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reached the senior round, and how its scores are spread by paper."""
    cases = replay.frozen_cases(_rows(spark, sf_dir), "senior")
    return replay.score_spread(cases, "senior", ["paper"])


def _replayed(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    rows = _rows(spark, sf_dir)
    again = rows.filter("pos % 2 = 0").select("key", ((F.col("pos") + shift) % 5 + 1).cast("int").alias("senior"))
    return replay.overlay(rows, again, ("first", "second"), "senior", "final_verdict")


def replay_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senior scores of a replay put over the rows that had one."""
    return _replayed(spark, sf_dir, 1).select("pos", "senior", "replayed", "final_verdict")


def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants against gold labels, by paper and in all."""
    variants = {"baseline": _rows(spark, sf_dir), "replay_a": _replayed(spark, sf_dir, 1), "replay_b": _replayed(spark, sf_dir, 3)}
    out = replay.compared(variants, replay.gold_labels(_gold(spark, sf_dir), "pos", "label"), "final_verdict", "paper")
    return out.select("variant", "paper", "tp", "fp", "tn", "fn", "f1")


def key_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named keys with their senior score in every variant."""
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).cast("string").alias("key"))
    replays = _rows(spark, sf_dir).filter("pos % 2 = 0").select("key", (F.col("pos") % 5 + 1).alias("senior"))
    return replay.probed(names, {"baseline": _rows(spark, sf_dir), "replay": replays}, "senior")


def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that go on to the next stage, by paper."""
    rows = _rows(spark, sf_dir)
    return replay.gated(rows.select("key", "paper"), rows, "final_verdict").groupBy("paper").agg(F.count("*").alias("n"))


def two_round_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' scores by three reviewers as the flow of two first-round reviewers and a senior one."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    reviewer = F.element_at(F.array(*map(F.lit, ("first", "second", "senior"))), F.col("l_linenumber"))
    scores = li.groupBy(F.col("l_orderkey").alias("key"), reviewer.alias("reviewer")).agg((F.max("l_partkey") % 5 + 1).alias("score"))
    return replay.two_round_review(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), scores)


def answer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that call a missing signal absent, and an output whose key and title the record knows better."""
    k = F.col("s_suppkey")
    answer = lambda i: F.struct(F.lit(i).alias("qid"), F.when((k + i) % 2 == 0, "absent").otherwise("present").alias("state"), F.when((k + i) % 3 == 0, "insufficient_signal").otherwise("direct").alias("basis"))
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array(*(answer(i) for i in range(4))).alias("answers"), F.lit("  ").alias("title"), F.col("s_name").alias("query_title"), k.cast("string").alias("key"), F.lit("dblp").alias("source"), F.lit("").alias("source_id"),
        F.when(k % 2 == 0, F.struct(F.lit("wrong").alias("candidate_key"), F.lit(4).alias("score"))).alias("output"))
    s = replay.authoritative(s, "output", {"candidate_key": F.col("key"), "stage": F.lit("stage1")})
    s = replay.provenance(s, k % 3 == 0, F.concat(F.lit("md/"), F.col("key")))
    states = F.array_join(F.transform(replay.normalized_answers(F.col("answers")), lambda a: a["state"]), ",")
    return s.select("s_suppkey", states.alias("states"), F.to_json("output").alias("output"), F.to_json("provenance").alias("provenance"))


def result_row_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a window excluded, that failed and that were reviewed, in one shape."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), "o_orderstatus")
    key, title = F.col("o_orderkey").cast("string"), F.col("title")
    cut = o.filter("o_orderstatus = 'F'").select(*replay.result_rows("cutoff", key, title, F.lit("before_start")))
    failed = o.filter("o_orderstatus = 'P'").select(*replay.result_rows("error", key, title, F.lit("retrieval_failed")))
    done = o.filter("o_orderstatus = 'O'").select(*replay.result_rows("reviewed", key, title, F.lit(""), F.lit(None).cast("string"), F.lit("include (single:5)")))
    return cut.unionByName(failed).unionByName(done)


def cutoff_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results judged by another window: exclusions undone and made, missing rows added, rows without a key kept."""
    saved = F.col("pos") % 4 == 1
    rows = _rows(spark, sf_dir).filter("pos % 10 <> 7")
    rows = rows.withColumns({
        "pre_cutoff_final_verdict": F.when(saved, "include (saved)"), "pre_cutoff_review_state": F.when(saved, "reviewed"), "final_verdict": F.when(F.col("pos") % 4 < 2, cutoff.EXCLUDED).otherwise("maybe (junior:3,3)"),
        "review_state": F.when(F.col("pos") % 4 < 2, "cutoff_filtered").otherwise("reviewed"), "discard_reason": F.lit(None).cast("string")})
    metadata = _rows(spark, sf_dir).filter("key is not null").select("key", "published_date", "pos")
    fallback = metadata.filter("pos % 8 = 0").select("key", F.lit("exclude (junior:1,1)").alias("final_verdict"))
    out = replay.rewritten(rows.select("key", "pos", "final_verdict", "review_state", "discard_reason", "pre_cutoff_final_verdict", "pre_cutoff_review_state"), metadata, NEW, fallback, synthesize=True)
    return out.select("key", F.col("pos.pos").alias("pos"), F.col("pos.__order").alias("part"), "origin", "cutoff_status", "final_verdict", "review_state", "discard_reason", "pre_cutoff_final_verdict")


def policy_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that only the new window passes, and those of them whose row wasn't restored."""
    records = _rows(spark, sf_dir).filter("key is not null").select("key", "published_date", "pos")
    adjusted = records.filter("pos % 6 <> 1").select("key", F.when(F.col("pos") % 6 == 2, cutoff.EXCLUDED).when(F.col("pos") % 6 == 3, " ").otherwise("include").alias("final_verdict"))
    return replay.rescued(records, adjusted, OLD, NEW)


def sibling_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage files of each nation with their first-stage files."""
    n = F.col("n_nationkey")
    names = F.array(
        F.concat(F.lit("second_stage_results.v"), (n % 3).cast("string"), F.lit(".json")), F.lit("second_stage_first_run.json"),
        F.when(n % 2 == 0, F.concat(F.lit("first_stage_results.v"), (n % 3).cast("string"), F.lit(".json"))), F.when(n % 5 == 0, F.lit("first_stage_results.other.json")), F.lit("notes.txt"))
    files = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array_compact(names)).alias("name"))
    return replay.with_sibling(files, "n_nationkey", "name", {"second_stage_results": "first_stage_results", "second_stage_first_run": "first_stage_results"})


def recomputed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the results of every paper and run at once."""
    rows = _rows(spark, sf_dir).withColumn("run", F.col("pos") % 3)
    return replay.recomputed(rows, replay.gold_labels(_gold(spark, sf_dir), "pos", "label"), ["paper", "run"])


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By paper: first-stage and combined F1, selected, reviewed and missing rows."""
    rows = _rows(spark, sf_dir).filter("key is not null")
    stage2 = replay.gated(rows, rows, "final_verdict").select("key", "paper", F.when(F.col("pos") % 4 == 0, "missing").otherwise("reviewed").alias("review_state"), F.when(F.col("pos") % 4 == 0, "maybe (missing)").when(F.col("pos") % 4 == 1, "exclude (full)").otherwise("include (full)").alias("final_verdict"))
    return replay.run_summary(rows.select("key", "paper", "final_verdict"), stage2, ["paper"], replay.gold_labels(_gold(spark, sf_dir), "pos", "label"))


def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each wanted user and type."""
    history = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    wanted = table(spark, sf_dir, "events").filter("value > 90").select("user_id", "event_type")
    return replay.latest_summary(history, wanted, ["user_id", "event_type"], "event_id")


def availability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables know each document."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    parts = {"has_label": table(spark, sf_dir, "labels"), "has_vector": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "has_page": table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))}
    return replay.availability(d, parts, "doc_id")


def audit_with_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every requested paper, zeros where it has no input."""
    wanted = spark.range(1990, 2005).select(F.col("id").cast("int").alias("paper"))
    counts = _rows(spark, sf_dir).groupBy("paper").agg(F.count("*").alias("n"), F.count("senior").alias("n_senior"))
    return replay.with_counts(wanted, counts, "paper")


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    policy = F.struct(
        F.when(n % 4 != 0, n % 2 == 0).alias("enabled"), F.when(n % 3 != 0, F.concat((2000 + n).cast("string"), F.lit("-01-05"))).alias("start_date"), F.lit(True).alias("start_inclusive"), F.lit("2024-08-30").alias("end_date"), F.lit(None).cast("boolean").alias("end_inclusive"),
        F.when(n % 5 == 0, F.array(F.lit("c1"), F.lit("c2"))).alias("binding_clause_ids"), F.lit(None).cast("boolean").alias("fallback_applied"))
    evidence = F.when(n % 6 != 0, F.array(F.concat(F.lit("Papers PUBLISHED from 1998 to "), (2000 + n).cast("string")), F.when(n % 2 == 0, "the cut-off of the search").otherwise("all")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(n % 7 != 0, policy).alias("policy"), evidence.alias("evidence"))


def policy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _policies(spark, sf_dir).select("n_nationkey", *replay.policy_columns(F.col("policy")))
    return out.withColumn("binding_clause_ids", F.array_join("binding_clause_ids", ","))


def hint_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policies(spark, sf_dir)
    return p.select("n_nationkey", F.array_join(replay.hint_terms(F.col("evidence"), F.col("policy.start_date"), F.col("policy.end_date")), ",").alias("terms"))


def composite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation with its availability, policy and counts as structs."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    out = replay.composite("n_nationkey", {"nation": n, "customers": customers, "suppliers": suppliers})
    return out.select("n_nationkey", "nation.n_name", F.col("customers.n").alias("n_customers"), F.col("customers.least").alias("least"), F.col("suppliers").isNull().alias("no_suppliers"))


QUERIES = {f.__name__: f for f in (key_resolution, gold_lenient, senior_cases, replay_overlay, variant_comparison, key_probes, stage_gate, two_round_flow, answer_repair, result_row_shapes, cutoff_rewrite, policy_rescue, sibling_results, recomputed_reports, run_summaries, history_lookup, availability_matrix, audit_with_missing_inputs, policy_projection, hint_terms, composite_audit)}

_LABEL = lambda s: f"case when {s} >= 4 then 'include' when {s} = 3 then 'maybe' when {s} <= 2 then 'exclude' end"
_VERDICT = lambda a, b, s: f"""coalesce({_LABEL(s)} || ' (senior:' || {s} || ')', (case when {a} >= 4 and {b} >= 4 then 'include' when {a} <= 2 and {b} <= 2 then 'exclude' else 'maybe' end) || ' (junior:' || {a} || ',' || {b} || ')')"""
_R = f"""r0 as (select o_orderkey as pos, case when o_orderkey % 50 <> 0 then o_orderkey::varchar end as key, year(o_orderdate)::int as paper, cast(o_orderdate as date) as d, (o_orderkey % 5 + 1)::int as a, (o_orderkey // 5 % 5 + 1)::int as b,
 case when o_orderkey % 3 = 0 then (o_orderkey % 6)::int end as s0, nullif(case when o_orderkey % 3 = 0 then (o_orderkey % 6)::int end, 0) as s from orders), r as (select *, {_VERDICT('a', 'b', 's')} as v from r0),
g as (select o_orderkey::varchar as key, o_orderkey % 3 = 0 as gold from orders where o_orderkey % 10 <> 0)"""
_RATIO = "coalesce(round({0} / nullif({1}, 0), 6), 0.0)"
_REPLAY = lambda shift: f"select pos, key, paper, case when h then s1 else s0 end as senior, h as replayed, case when h then {_VERDICT('a', 'b', 's1')} else v end as v from (select *, key is not null and pos % 2 = 0 and s is not null as h, ((pos + {shift}) % 5 + 1)::int as s1 from r)"
_CELLS = "count(*) filter (p and gold) as tp, count(*) filter (p and not gold) as fp, count(*) filter (not p and not gold) as tn, count(*) filter (not p and gold) as fn"
_P = "not starts_with(v, 'exclude')"
_ST = lambda a, b: f"case when d < date '{a.start}' then 'before_start' when d > date '{b.end}' then 'after_end' else 'passed' end"
ORACLE = {
    "key_resolution": """with r as (select case when l_orderkey % 4 in (2, 3) then l_orderkey::varchar when l_orderkey % 8 <> 0 then 'm' || l_orderkey end as key, l_linenumber::bigint * 1000000000 + l_partkey * 1000 + l_suppkey as pos from lineitem) select key, min(pos) as pos from r where key is not null group by 1""",
    "gold_lenient": "select o_orderkey::varchar as key, o_orderkey % 3 = 0 as gold from orders where o_orderkey % 10 <> 0",
    "senior_cases": f"with {_R} select paper, count(*) filter (s <= 2) as low, count(*) filter (s = 3) as mid, count(*) filter (s >= 4) as high, 0::bigint as missing, count(*) as total from r where key is not null and s is not null group by 1",
    "replay_overlay": f"with {_R} select pos, senior, replayed, v as final_verdict from ({_REPLAY(1)})",
    "variant_comparison": f"""with {_R}, u as (select 'baseline' as variant, key, paper, v from r union all select 'replay_a', key, paper, v from ({_REPLAY(1)}) union all select 'replay_b', key, paper, v from ({_REPLAY(3)})),
j as (select *, {_P} as p from u join g using (key)), c as (select variant, paper, {_CELLS} from j group by grouping sets ((variant, paper), (variant)))
select *, {_RATIO.format('2 * tp', '2 * tp + fp + fn')} as f1 from c""",
    "key_probes": f"""with {_R} select c.key, r.s as baseline_score, case when r2.key is not null then (r2.pos % 5 + 1)::int end as replay_score from (select (c_custkey * 7)::varchar as key from customer) c left join r on r.key = c.key left join r r2 on r2.key = c.key and r2.pos % 2 = 0""",
    "stage_gate": f"with {_R} select paper, count(*) as n from r where key is not null and {_P} group by 1",
    "two_round_flow": f"""with s as (select l_orderkey as k, l_linenumber as n, (max(l_partkey) % 5 + 1)::int as sc from lineitem where l_linenumber <= 3 group by 1, 2),
w as (select o_orderkey as key, max(sc) filter (n = 1) as first, max(sc) filter (n = 2) as second, max(sc) filter (n = 3) as s3 from orders left join s on k = o_orderkey group by 1),
x as (select *, coalesce(not ((first >= 4 and second >= 4) or (first <= 2 and second <= 2)), false) as needs_senior from w), y as (select key, first, second, needs_senior, case when needs_senior then s3 end as senior from x)
select *, {_VERDICT('first', 'second', 'senior')} as final_verdict from y""",
    "answer_repair": """select s_suppkey, array_to_string([case when (s_suppkey + i) % 2 = 0 then (case when (s_suppkey + i) % 3 = 0 then 'unclear' else 'absent' end) else 'present' end for i in range(4)], ',') as states,
 case when s_suppkey % 2 = 0 then '{"candidate_key":"' || s_suppkey || '","score":4,"stage":"stage1"}' end as output,
 '{"record_key":"' || s_suppkey || '","record_title":"' || s_name || '","source":"dblp","fulltext_path":"' || (case when s_suppkey % 3 = 0 then 'md/' || s_suppkey else '' end) || '","fulltext_available":' || (s_suppkey % 3 = 0) || '}' as provenance from supplier""",
    "result_row_shapes": """select o_orderkey::varchar as key, o_orderpriority as title, case o_orderstatus when 'F' then 'cutoff_filtered' when 'P' then 'retrieval_failed' else 'reviewed' end as review_state, o_orderstatus = 'F' as review_skipped,
 case o_orderstatus when 'F' then 'cutoff_time_window:before_start' when 'P' then 'retrieval_failed' end as discard_reason, case o_orderstatus when 'F' then 'exclude (cutoff_time_window)' when 'P' then 'maybe (review_state:retrieval_failed)' else 'include (single:5)' end as final_verdict
 from orders where o_orderstatus in ('F', 'P', 'O')""",
    "cutoff_rewrite": f"""with {_R}, x as (select *, {_ST(NEW, NEW)} as st, pos % 4 < 2 as cut, pos % 4 = 1 as saved, case when pos % 8 = 0 then 'exclude (junior:1,1)' end as back from r)
select key, pos, 0 as part, 'adjusted' as origin, st as cutoff_status,
 case when st <> 'passed' then '{cutoff.EXCLUDED}' when not cut then 'maybe (junior:3,3)' when saved then 'include (saved)' else coalesce(back, '{cutoff.EXCLUDED}') end as final_verdict,
 case when st <> 'passed' or (cut and not saved) then 'cutoff_filtered' else 'reviewed' end as review_state, case when st <> 'passed' then 'cutoff_time_window:' || st end as discard_reason,
 case when st = 'passed' or cut then (case when saved then 'include (saved)' end) else 'maybe (junior:3,3)' end as pre_cutoff_final_verdict from x where key is not null and pos % 10 <> 7
union all select key, pos, 1, 'synthesized', st, '{cutoff.EXCLUDED}', 'cutoff_filtered', 'cutoff_time_window:' || st, null from x where key is not null and pos % 10 = 7 and st <> 'passed'
union all select key, pos, 2, 'untouched', null, case when cut then '{cutoff.EXCLUDED}' else 'maybe (junior:3,3)' end, case when cut then 'cutoff_filtered' else 'reviewed' end, null, case when saved then 'include (saved)' end from x where key is null""",
    "policy_rescue": f"""with {_R} select key, case pos % 6 when 1 then 'missing_adjusted_row' when 2 then 'still_cutoff' when 3 then 'missing_final_verdict' end as fault from r where key is not null and {_ST(OLD, OLD)} <> 'passed' and {_ST(NEW, NEW)} = 'passed'""",
    "sibling_results": """with n as (select n_nationkey as k, n_nationkey % 2 = 0 as v, n_nationkey % 5 = 0 as o from nation), lone as (select k, case when v and not o then 'first_stage_results.v' || (k % 3) || '.json' when o and not v then 'first_stage_results.other.json' end as one from n)
select k as n_nationkey, 'second_stage_results.v' || (k % 3) || '.json' as name, case when k % 2 = 0 then 'first_stage_results.v' || (k % 3) || '.json' else one end as sibling from lone union all select k, 'second_stage_first_run.json', one from lone""",
    "recomputed_reports": f"""with {_R}, j as (select *, {_P} as p, pos % 3 as run from r join g using (key)), c as (select paper, run, {_CELLS} from j group by 1, 2)
select *, {_RATIO.format('tp', 'tp + fp')} as precision, {_RATIO.format('tp', 'tp + fn')} as recall, {_RATIO.format('2 * tp', '2 * tp + fp + fn')} as f1, {_RATIO.format('(tp + tn)', '(tp + fp + tn + fn)')} as accuracy from c""",
    "run_summaries": f"""with {_R}, q as (select * from r where key is not null), z as (select paper, key, v, {_P} as p, case when not ({_P}) then v when pos % 4 = 1 then 'exclude' else 'include' end as v2, pos from q),
j as (select paper, p, not starts_with(v2, 'exclude') as p2, gold from z join g using (key)),
f as (select paper, coalesce(round(2 * count(*) filter (p and gold) / nullif(2 * count(*) filter (p and gold) + count(*) filter (p <> gold), 0), 6), 0.0) as stage1_f1, coalesce(round(2 * count(*) filter (p2 and gold) / nullif(2 * count(*) filter (p2 and gold) + count(*) filter (p2 <> gold), 0), 6), 0.0) as combined_f1 from j group by 1)
select f.*, (select count(*) from z where z.paper = f.paper and p) as n_selected, (select count(*) from z where z.paper = f.paper and p and pos % 4 > 0) as n_reviewed, (select count(*) from z where z.paper = f.paper and p and pos % 4 = 0) as n_missing from f""",
    "history_lookup": "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2 having max(value) > 90",
    "availability_matrix": "select distinct doc_id, doc_id in (select doc_id from labels) as has_label, doc_id in (select vec_id from embeddings) as has_vector, doc_id in (select page_id from pages) as has_page from documents",
    "audit_with_missing_inputs": "select y::int as paper, count(o_orderkey) as n, count(o_orderkey) filter (o_orderkey % 3 = 0) as n_senior from range(1990, 2005) t(y) left join orders on year(o_orderdate) = y group by 1",
    "policy_projection": """select n_nationkey, coalesce(n_nationkey % 7 <> 0 and n_nationkey % 4 <> 0 and n_nationkey % 2 = 0, false) as enabled, case when n_nationkey % 7 <> 0 and n_nationkey % 3 <> 0 then (2000 + n_nationkey) || '-01-05' end as start_date, case when n_nationkey % 7 <> 0 then true end as start_inclusive,
 case when n_nationkey % 7 <> 0 then '2024-08-30' end as end_date, null::boolean as end_inclusive, case when n_nationkey % 7 <> 0 and n_nationkey % 5 = 0 then 'c1,c2' else '' end as binding_clause_ids, false as fallback_applied from nation""",
    "hint_terms": """with t as (select n_nationkey as n, n_nationkey % 6 <> 0 as e, n_nationkey % 7 <> 0 as p from nation)
select n as n_nationkey, array_to_string(list_sort(list_distinct(list_filter([case when e then '1998' end, case when e then (2000 + n)::varchar end, case when e then 'published' end, case when e and n % 2 = 0 then 'search' end, case when e and n % 2 = 0 then 'cutoff' end,
 case when p and n % 3 <> 0 then (2000 + n) || '-01-05' end, case when p and n % 3 <> 0 then (2000 + n)::varchar end, case when p then '2024-08-30' end, case when p then '2024' end], lambda x: x is not null))), ',') as terms from t""",
    "composite_audit": """select n_nationkey, n_name, c.n as n_customers, c.least, s.k is null as no_suppliers from nation left join (select c_nationkey as k, count(*) as n, min(c_custkey) as least from customer where c_acctbal < 0 group by 1) c on c.k = n_nationkey
 left join (select distinct s_nationkey as k from supplier where s_acctbal > 9000) s on s.k = n_nationkey""",
}
