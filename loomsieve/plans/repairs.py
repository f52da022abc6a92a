"""Repair of candidate metadata, and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import dynamic, records
from loomsieve.operators import dedupe, evaluate, link, repair
from loomsieve.sources.collection import Collection
from loomsieve.tables import scratch, table

K = "o_orderkey"


def _oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as wanted records; some have a raw entry that states a title."""
    k = F.col(K)
    raw = F.when(k % 4 == 0, F.concat(F.lit("author = {A},\n  title = {Raw {T}itle "), k.cast("string"), F.lit("},\nyear = 1999"))).when(k % 4 == 1, F.concat(F.lit(r"x \showarticletitle{Shown "), k.cast("string"), F.lit("} y")))
    return table(spark, sf_dir, "orders").select(K, F.concat(F.lit(r"{Query} \emph title "), k.cast("string"), F.lit(", 2019")).alias("query_title"), raw.alias("raw"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of them: absent for some, missing by state or source for others."""
    k = F.col(K)
    return table(spark, sf_dir, "orders").filter(k % 7 != 0).select(
        K, F.concat(F.lit("Query title "), k.cast("string")).alias("query_title"), F.when(k % 3 == 0, F.lit("T")).otherwise(F.concat(F.lit("Title "), k.cast("string"))).alias("title"),
        F.when(k % 2 == 0, F.lit("An abstract")).alias("abstract"), F.when(k % 5 == 0, " None ").when(k % 5 == 1, "arxiv").when(k % 5 == 2, "zenodo").otherwise("crossref").alias("source"), F.lit(None).cast("string").alias("source_id"),
        F.when(k % 11 == 0, "Missing").otherwise("exact_title").alias("match_status"), F.lit(None).cast("string").alias("missing_reason"), F.when(k % 3 == 1, "2001").alias("published_date"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    return table(spark, sf_dir, "orders").filter(k % 6 < 4).select(K, F.concat(F.lit("Context "), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("10.9/"), k.cast("string"))).alias("source_id"), F.date_format("o_orderdate", "yyyy").alias("year"))


def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted records whose metadata is missing, with cleaned query titles."""
    return repair.targets(_oracle(spark, sf_dir), _metadata(spark, sf_dir), [K])


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year of the order: how many wanted records a collection resolved."""
    states = repair.validated(_oracle(spark, sf_dir), _metadata(spark, sf_dir), [K])
    years = table(spark, sf_dir, "orders").select(K, F.year("o_orderdate").alias("year"))
    return repair.validation_counts(states.join(years, K), ["year"])


def resolved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are sound and present in all tables of a collection."""
    o = table(spark, sf_dir, "orders").select(K)
    others = {"sources": o.filter(f"{K} % 9 <> 0"), "trace": o.filter(f"{K} % 8 <> 0"), "full": o.filter(f"{K} % 10 <> 0")}
    return repair.resolved_keys(o, _metadata(spark, sf_dir), others, [K])


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.resolved_by_hand(_metadata(spark, sf_dir), _context(spark, sf_dir), [K])


def manual_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rows filled by hand, and what that changes in the table of their sources and steps."""
    fixed = _fixed(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(K, F.lit("old").alias("title"), F.array(F.lit("asked"), F.lit("manual:resolved")).alias("steps"), F.lit(False).alias("abstract_present"))
    fixes = fixed.filter("fixed").select(K, F.col("title").alias("t"), F.col("abstract").alias("a"))
    other = repair.propagated(o, fixes, [K], {"title": F.col("fix.t"), "steps": records.with_steps(F.col("steps"), ["manual:resolved", "manual_mark"]), "abstract_present": F.col("fix.a").isNotNull()})
    both = fixed.join(other.select(K, F.col("title").alias("other_title"), F.array_join("steps", ",").alias("steps"), "abstract_present"), K)
    return both.select(K, "fixed", "title", "source", "source_id", "match_status", "missing_reason", "published_date", "other_title", "steps", "abstract_present")


def _denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias(K))


def _full_text(year: Column) -> Column:
    """What sources say of a record, in shapes of their own; a sixth of the records have none."""
    y, k = year.cast("string"), F.col(K)
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(k % 6 == 0, say('{"year":', y, ',"title":"Fetched"}')).when(k % 6 == 1, say('{"year":"n.d.","published":{"date-parts":[[', y, ",2]]}}"))
        .when(k % 6 == 2, say('{"published":{"date-parts":[["x"]]},"date":"in ', y, '!"}')).when(k % 6 == 3, say('{"year":null,"updated":["a","', y, '"]}')).when(k % 6 == 4, '{"title":"t"}'))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "orders").select(K, _full_text(1980 + F.col(K) % 20).alias("text"))
    return full.filter("text is not null").select(K, F.parse_json("text").alias("source_metadata"))


def _collection(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables of a collection."""
    o = table(spark, sf_dir, "orders")
    return {
        "metadata": _metadata(spark, sf_dir).withColumns({"query_title": F.concat(F.lit(r"{Query} \emph{title} "), F.col(K).cast("string")), "normalized_title": F.lit("old")}),
        "sources": o.select(K, F.lit("old").alias("title"), F.lit("crossref").alias("source"), F.lit("x").alias("source_id"), F.lit("fuzzy_title").alias("match_status"), F.lit(True).alias("abstract_present"), F.lit("crossref").alias("abstract_source"), F.lit(None).cast("string").alias("abstract_source_reason")),
        "trace": o.select(K, F.array(F.lit("asked"), F.lit("manual:resolved_no_abstract")).alias("lookup_steps")),
        "full": _full(spark, sf_dir),
    }


def denied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on a list of wrong matches: their metadata set right, whatever was fetched."""
    denied = _denied(spark, sf_dir)
    fixed = repair.forced_fix(_collection(spark, sf_dir), _context(spark, sf_dir), denied, [K])
    return repair.forced(fixed["metadata"], denied, [K]).select(K, "query_title", "title", "normalized_title", "abstract", "source", "source_id", "match_status", "missing_reason", "published_date")


def forced_fix_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same fix leaves in the other three tables, for all records."""
    fixed = repair.forced_fix(_collection(spark, sf_dir), _context(spark, sf_dir), _denied(spark, sf_dir), [K])
    sources = fixed["sources"].select(K, "title", "source", "source_id", "match_status", "abstract_present", "abstract_source", "abstract_source_reason")
    meta = F.col("source_metadata")
    full = fixed["full"].select(K, dynamic.field(meta, "$.title").alias("full_title"), (dynamic.kind_of(dynamic.field(meta, "$.abstract", "variant")) == "VOID").alias("abstract_gone"), dynamic.first_year(meta).alias("full_year"))
    return sources.join(fixed["trace"].select(K, F.array_join("lookup_steps", ",").alias("steps")), K).join(full, K, "left")


def collection_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's four tables committed, fixed and committed again, and rolled back: what each version shows."""
    tables = _collection(spark, sf_dir)
    kept = Collection(spark, scratch(spark))
    first = kept.commit(tables)
    fixed = repair.forced_fix({n: kept.read(n, first) for n in tables}, _context(spark, sf_dir), _denied(spark, sf_dir), [K])
    kept.commit(fixed, first, "wrong matches")
    kept.rollback(first)
    shown = None
    for version in kept.versions():
        m = kept.read("metadata", version).agg(F.lit(version).alias("version"), F.count_if(F.col("source") == "manual").alias("n_manual"), F.count("*").alias("n_metadata"))
        s = kept.read("sources", version).agg(F.count_if(F.col("abstract_source") == "missing").alias("n_missing"))
        t = kept.read("trace", version).agg(F.count_if(F.array_contains("lookup_steps", repair.FORCED_STEPS[0])).alias("n_traced"))
        row = m.join(F.broadcast(s)).join(F.broadcast(t))  # one row each
        shown = row if shown is None else shown.unionByName(row)
    return shown


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published dates of all kinds; arXiv records have a month in their identifier."""
    k = F.col(K)
    date = F.element_at(F.array(F.lit("soon"), F.lit("March 17, 2024"), F.lit("20240317"), F.lit("0999"), F.lit("2013-13"), F.lit("2001-02-30"), F.lit(None).cast("string"), (2010 + k % 10).cast("string"), F.lit("  ")), (k % 9 + 1).cast("int"))
    identifier = F.when(k % 5 == 1, F.concat(F.date_format(F.make_date((F.lit(2010) + k % 10).cast("int"), (k % 12 + 1).cast("int"), F.lit(1)), "yyMM"), F.lit(".12345v2")))
    return _metadata(spark, sf_dir).withColumns({"source_id": identifier, "published_date": date})


def published_date_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates filled in and mended from sources and context, by kind of source."""
    return repair.dated(_dates(spark, sf_dir), _full(spark, sf_dir), _context(spark, sf_dir), [K], 2030).select(K, "published_date", "date_action", "source_year")


def full_year_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that full metadata say after arXiv records got theirs."""
    full = _full(spark, sf_dir)
    dated = repair.dated(_dates(spark, sf_dir), full, _context(spark, sf_dir), [K], 2030)
    out = repair.with_source_years(full, dated, [K])
    return out.select(K, dynamic.field(F.col("source_metadata"), "$.year").alias("year"), dynamic.first_year(F.col("source_metadata")).alias("first_year"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records whose shape isn't declared, with reference lists at several depths."""
    k = F.col("s_suppkey").cast("string")
    say = F.concat(
        F.lit('{"id":'), k, F.lit(',"name":"'), F.col("s_name"), F.lit('","reference":[{"doi":"10.1/'), k, F.lit('"}],"deep":{"reference":"kept","items":[{"n":'), k, F.lit(',"reference":['), k, F.lit(']},"t",null,true]}'),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(',"more":{"a":{"b":{"reference":[],"c":1.5}}}')).otherwise(""), F.lit("}"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.parse_json(say).alias("record"))


def dynamic_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of records without a schema, wherever they stand."""
    return dynamic.leaves(_nested(spark, sf_dir), ["s_suppkey"], "record").select("s_suppkey", "path", "value")


def dynamic_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without reference lists."""
    rows = _nested(spark, sf_dir).withColumn("record", dynamic.pruned(F.col("record")))
    return dynamic.leaves(rows, ["s_suppkey"], "record").select("s_suppkey", "path", "value")


def repair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: how many rows were fixed, and how many of them lack an abstract."""
    rows = _fixed(spark, sf_dir)
    return repair.repair_counts(rows, ["match_status"], {"n_fixed": F.col("fixed"), "n_without_abstract": F.col("fixed") & F.col("abstract").isNull(), "n_dated": F.col("published_date").isNotNull()})


def repair_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole repair, not as a dry run: the metadata by source afterwards."""
    k = F.col(K)
    collected = _metadata(spark, sf_dir).withColumns({"source": F.when(k % 2 == 0, "pubmed").otherwise(F.col("source")), "match_status": F.lit("exact_doi")})
    o = table(spark, sf_dir, "orders").select(K)
    _, merged = repair.repaired(_oracle(spark, sf_dir), _metadata(spark, sf_dir), collected, {"sources": o.filter(f"{K} % 9 <> 0")}, [K], dry_run=False)
    return merged.groupBy("source", "match_status").agg(F.count("*").alias("n"))


def topic_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested definition set by topic; patching again changes nothing."""
    definitions = {"ring": "round things", "widget": "small machines"}
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct(F.concat(F.lit("On "), "p_name").alias("topic"), F.when(F.col("p_partkey") % 2 == 0, "round things").otherwise("?").alias("topic_definition")).alias("payload")).alias("doc"))
    inner = p.select("p_partkey", F.col("doc.payload").alias("payload"))
    once = repair.patched(inner, "payload", "topic", "topic_definition", definitions)
    twice = repair.patched(once.withColumnRenamed("changed", "first"), "payload", "topic", "topic_definition", definitions)
    return twice.select("p_partkey", F.col("payload.topic_definition").alias("definition"), F.col("first").alias("changed"), F.col("changed").alias("changed_again"))


def source_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources are read without being told to, with a list and without."""
    s = F.when(F.col("p_partkey") % 6 == 0, " PubMed-Central ").when(F.col("p_partkey") % 6 == 1, "manual").when(F.col("p_partkey") % 6 == 2, "").when(F.col("p_partkey") % 6 == 3, "arxiv").when(F.col("p_partkey") % 6 == 4, "dblp")
    rows = table(spark, sf_dir, "part").select(s.alias("s"))
    return rows.groupBy(records.source_token(F.col("s")).alias("source")).agg(F.count_if(records.allowed_source(F.col("s"), "arxiv, pubmed_central")).alias("n_listed"), F.count_if(records.allowed_source(F.col("s"), "arxiv,manual")).alias("n_with_manual"), F.count_if(records.allowed_source(F.col("s"), None)).alias("n_any"))


def completed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that still have to be fetched: those without a large enough file."""
    files = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("key"), F.octet_length("text").alias("length"))
    wanted = table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("key")).distinct()
    return wanted.join(repair.complete(files, "key"), "key", "left_anti")


def pending_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (" Downloaded", "existing", "FAILED", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    report = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), status.alias("status"))
    return repair.pending_counts(report, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key")), "key")


def stale_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return repair.stale(rows.filter("o_orderpriority < '4' and not (o_orderpriority like '2%' and o_orderkey % 10 = 0)"), rows, "o_orderpriority")


def nested_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without reference lists at any depth, and without their source's heavy fields."""
    k = F.col("s_suppkey")
    inner = lambda n: F.struct(F.lit(n).alias("id"), F.array(F.lit("r")).alias("reference"))
    meta = F.struct(F.col("s_name").alias("title"), F.array(F.lit("x"), F.lit("y")).alias("reference"), F.array(inner(1), inner(2)).alias("parts"), F.struct(F.lit("kept").alias("reference"), F.array(F.lit(1)).alias("link")).alias("deep"), F.array(F.lit("l")).alias("link"), F.array(F.lit("w")).alias("referenced_works"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, " Crossref").when(k % 3 == 1, "openalex").alias("source"), meta.alias("m"))
    return rows.select("s_suppkey", F.to_json(records.light(F.col("source"), F.col("m"), rows.schema["m"].dataType)).alias("metadata"))


CONTRACT = ["paper_id", "stage", "guardrails", "review"]


def fixed_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents projected to a fixed contract, and the forbidden keys that the raw ones hold."""
    k = F.col("n_nationkey")
    raw = F.concat(F.lit('{"paper_id":'), k.cast("string"), F.when(k % 2 == 0, ',"review":{"a":1}').otherwise(""), F.when(k % 3 == 0, ',"source_basis":"x"').otherwise(""), F.lit("}"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw"), F.lit("stage1").alias("stage"))
    kept = records.contract({"paper_id": F.get_json_object("raw", "$.paper_id"), "stage": F.col("stage"), "review": F.get_json_object("raw", "$.review")}, CONTRACT)
    return n.select("n_nationkey", *kept, F.array_join(records.forbidden(F.col("raw"), ["review", "source_basis", "source_markdown"]), ",").alias("forbidden"))


def sorted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by falling count and then by value, with their place; and the sorted keys of each."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 50).alias("k"))
    return evaluate.value_counts(o, "o_orderpriority", "k")


def input_order_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that arrived in any order, at the places of their requests; requests without a result are left out."""
    requests = table(spark, sf_dir, "customer").select((F.lit(100000) - F.col("c_custkey")).alias("pos"), F.col("c_custkey").alias("key"))
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return link.in_order(requests, results, "key", "pos")


def allow_list_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the keys on a list, at most so many, with how often each key occurs."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"))
    allow = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key"))
    return dedupe.first_with_counts(rows, "key", "pos", allow, 300)


QUERIES = {f.__name__: f for f in (repair_targets, manifest_validation, resolved_parts, manual_resolution, denied_keys, forced_fix_parts, collection_versions, published_date_repair, full_year_repair, dynamic_leaves, dynamic_pruning, repair_counters, repair_pipeline, topic_patch, source_allow_list, completed_files, pending_report_counts, stale_subsets, nested_pruning, fixed_contract, sorted_reports, input_order_restored, allow_list_limit)}

_M = """m as (select o_orderkey, o_orderkey as k, o_orderdate, case when o_orderkey % 3 = 0 then 'T' else 'Title ' || o_orderkey end as title, case when o_orderkey % 2 = 0 then 'An abstract' end as abstract,
 case o_orderkey % 5 when 0 then ' None ' when 1 then 'arxiv' when 2 then 'zenodo' else 'crossref' end as source, case when o_orderkey % 11 = 0 then 'Missing' else 'exact_title' end as match_status,
 o_orderkey % 11 = 0 or o_orderkey % 5 = 0 as bad, case when o_orderkey % 3 = 1 then '2001' end as published_date from orders where o_orderkey % 7 <> 0)"""
_F = f"""{_M}, x as (select m.*, k % 6 < 4 as ctx, 'Query title ' || k as picked from m),
f as (select o_orderkey, k, bad as fixed, case when bad then picked else title end as title, abstract, case when bad then 'manual' else source end as source, case when bad then (case when ctx and k % 2 = 0 then '10.9/' || k else 'local:' || k end) end as source_id,
 case when bad then 'exact_title' else match_status end as match_status, case when bad and abstract is null then 'no_abstract_available' end as missing_reason, case when bad then coalesce(published_date, case when ctx then year(o_orderdate)::varchar end) else published_date end as published_date from x)"""
_YEAR_FIELD = """case when json_type(j, '$.NAME') = 'OBJECT' then nullif(regexp_extract(coalesce(json_extract_string(j, '$.NAME."date-parts"[0][0]'), ''), '^((19|20)[0-9]{2})$', 1), '')
 else nullif(regexp_extract(coalesce(json_extract_string(j, '$.NAME'), ''), '((19|20)[0-9]{2})', 1), '') end"""
_FULL = f"""t0 as (select *, o_orderkey as k, (1980 + o_orderkey % 20)::varchar as y from orders),
t1 as (select *, case k % 6 when 0 then '{{"year":' || y || ',"title":"Fetched"}}' when 1 then '{{"year":"n.d.","published":{{"date-parts":[[' || y || ',2]]}}}}' when 2 then '{{"published":{{"date-parts":[["x"]]}},"date":"in ' || y || '!"}}'
 when 3 then '{{"year":null,"updated":["a","' || y || '"]}}' when 4 then '{{"title":"t"}}' end::json as j from t0),
f as (select *, coalesce({", ".join(_YEAR_FIELD.replace("NAME", n) for n in ("year", "publicationYear", "published", "publicationDate", "date", "updated"))}) as own from t1)"""
_DATED = """d as (select *, case k % 5 when 1 then 'arxiv' when 2 then 'zenodo' else '' end as src, case k % 9 when 0 then 'soon' when 1 then 'March 17, 2024' when 2 then '20240317' when 3 then '0999' when 4 then '2013-13' when 5 then '2001-02-30' when 7 then (2010 + k % 10)::varchar when 8 then '  ' end as pd0,
 case when k % 5 = 1 then (2010 + k % 10) || '-' || lpad((k % 12 + 1)::varchar, 2, '0') end as mon, case when k % 6 < 4 then year(o_orderdate)::varchar end as told from f where k % 7 <> 0),
e as (select * exclude (own), nullif(trim(pd0), '') as pd, coalesce(own, substr(mon, 1, 4)) as own from d),
g as (select *, case when regexp_full_match(pd, '[0-9]{4}(-[0-9]{2})?(-[0-9]{2})?') and try_cast(substr(pd, 1, 4) as int) between 1800 and 2030 and coalesce(try_cast(nullif(substr(pd, 6, 2), '') as int) between 1 and 12, true)
 and coalesce(try_cast(nullif(substr(pd, 9, 2), '') as int) between 1 and 31, true) then substr(pd, 1, 4) end as yr from e),
h as (select *, case src when 'arxiv' then coalesce(mon, own, told) when 'zenodo' then coalesce(told, own) else coalesce(own, told) end as cand, case src when 'arxiv' then coalesce(substr(mon, 1, 4), own, told) when 'zenodo' then told else own end as held from g),
i as (select *, case when yr is null or src = 'arxiv' then cand else held end as better from h),
z as (select *, case when pd is null then cand when (yr is null or coalesce(held <> yr, false)) and better <> pd then better end as new from i)"""
_LEAVES = """with r as (select s_suppkey, ('{"id":' || s_suppkey || ',"name":"' || s_name || '","reference":[{"doi":"10.1/' || s_suppkey || '"}],"deep":{"reference":"kept","items":[{"n":' || s_suppkey || ',"reference":[' || s_suppkey || ']},"t",null,true]}'
 || (case when s_suppkey % 3 = 0 then ',"more":{"a":{"b":{"reference":[],"c":1.5}}}' else '' end) || '}')::json as j from supplier)
select s_suppkey, t.fullkey as path, case when t.type <> 'NULL' then trim(t.atom::varchar, '"') end as value from r, json_tree(r.j) t where t.type not in ('OBJECT', 'ARRAY')"""
ORACLE = {
    "repair_targets": """with t as (select o_orderkey, o_orderkey as k, case when o_orderkey % 7 = 0 then 'metadata_key_absent' else 'metadata_missing_status' end as reason from orders where o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 5 = 0)
select o_orderkey, reason, '{Query} \\emph title ' || k || ', 2019' as query_title_original, case k % 4 when 0 then regexp_replace('Raw Title ' || k, '[\\s,]*(19|20)\\d{2}\\s*$', '') when 1 then regexp_replace('Shown ' || k, '[\\s,]*(19|20)\\d{2}\\s*$', '') else 'Query title ' || k end as query_title, case when k % 4 < 2 then 'raw_local' else 'original' end as title_source from t""",
    "manifest_validation": """select year(o_orderdate)::int as year, count(*) as n_target, count(*) filter (not b) as n_resolved, count(*) filter (b) as n_missing from (select *, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 5 = 0 as b from orders) group by 1""",
    "resolved_parts": """with r as (select o_orderkey, o_orderkey as k, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 5 = 0 as b, concat_ws(',', case when o_orderkey % 9 = 0 then 'sources_missing' end, case when o_orderkey % 8 = 0 then 'trace_missing' end, case when o_orderkey % 10 = 0 then 'full_missing' end) as w from orders)
select o_orderkey, case when b then 'unresolved' when w <> '' then 'incomplete' else 'resolved' end as state, case when not b and w <> '' then w end as reason from r""",
    "manual_resolution": f"""with {_F} select o_orderkey, fixed, title, source, source_id, match_status, missing_reason, published_date, case when fixed then title else 'old' end as other_title,
 case when fixed then 'asked,manual:resolved,manual_mark' else 'asked,manual:resolved' end as steps, fixed and abstract is not null as abstract_present from f""",
    "denied_keys": f"""with {_M}, t as (select m.*, k % 6 < 4 as ctx, coalesce(case when k % 6 < 4 then 'Context ' || k end, k::varchar) as picked from m where k in (select l_orderkey from lineitem where l_quantity = 50))
select o_orderkey, 'Query title ' || k as query_title, picked as title, lower(picked) as normalized_title, null::varchar as abstract, 'manual' as source, case when ctx and k % 2 = 0 then '10.9/' || k else 'local:' || k end as source_id,
 'exact_title' as match_status, 'no_abstract_available' as missing_reason, coalesce(case when ctx then year(o_orderdate)::varchar end, published_date) as published_date from t""",
    "forced_fix_parts": f"""with {_FULL}, t as (select f.*, o_orderkey % 7 <> 0 and o_orderkey in (select l_orderkey from lineitem where l_quantity = 50) as hit, k % 6 < 4 as ctx, coalesce(case when k % 6 < 4 then 'Context ' || k end, k::varchar) as picked from f)
select o_orderkey, case when hit then picked else 'old' end as title, case when hit then 'manual' else 'crossref' end as source, case when not hit then 'x' when ctx and k % 2 = 0 then '10.9/' || k else 'local:' || k end as source_id, case when hit then 'exact_title' else 'fuzzy_title' end as match_status,
 not hit as abstract_present, case when hit then 'missing' else 'crossref' end as abstract_source, case when hit then 'missing:no_abstract_available' end as abstract_source_reason,
 case when hit then 'asked,manual:resolved_no_abstract,manual_fix:suspicious_source_mismatch,manual_mark:no_abstract_available' else 'asked,manual:resolved_no_abstract' end as steps,
 case when j is not null and hit then picked else json_extract_string(j, '$.title') end as full_title, case when j is not null and hit then true end as abstract_gone, case when j is not null and hit and ctx then year(o_orderdate)::varchar else own end as full_year from t""",
    "collection_versions": f"""with {_M}, b as (select k from m where k in (select l_orderkey from lineitem where l_quantity = 50)), n as (select count(*) as n_metadata, (select count(*) from b) as n from m)
select v as version, case when v = 2 then n else 0 end as n_manual, n_metadata, case when v = 2 then n else 0 end as n_missing, case when v = 2 then n else 0 end as n_traced from n, (values (1), (2), (3)) x(v)""",
    "published_date_repair": f"""with {_FULL}, {_DATED} select o_orderkey, coalesce(new, pd0) as published_date, case when new is null then 'none' when pd is null then 'backfill' else 'overwrite' end as date_action,
 case when coalesce(trim(json_extract_string(j, '$.year')), '') <> substr(mon, 1, 4) then substr(mon, 1, 4) end as source_year from z""",
    "full_year_repair": f"""with {_FULL}, {_DATED}, y as (select o_orderkey, j, own, case when k % 7 <> 0 and k % 5 = 1 then (2010 + k % 10)::varchar end as ay from f where j is not null)
select o_orderkey, coalesce(ay, json_extract_string(j, '$.year')) as year, coalesce(ay, own) as first_year from y""",
    "dynamic_leaves": _LEAVES,
    "dynamic_pruning": f"""select * from ({_LEAVES}) where path not like '%.reference[%'""",
    "repair_counters": f"with {_F} select match_status, count(*) filter (fixed) as n_fixed, count(*) filter (fixed and abstract is null) as n_without_abstract, count(*) filter (published_date is not null) as n_dated from f group by 1",
    "repair_pipeline": f"""with {_M}, n as (select k, bad and k % 9 <> 0 and (k % 2 = 0 or k % 5 <> 0) as merged, source, match_status from m)
select case when merged and k % 2 = 0 then 'pubmed' else source end as source, case when merged then 'exact_doi' else match_status end as match_status, count(*) as n from n group by 1, 2""",
    "topic_patch": """with p as (select p_partkey, case when contains(p_name, 'ring') then 'round things' when contains(p_name, 'widget') then 'small machines' end as d, case when p_partkey % 2 = 0 then 'round things' else '?' end as was from part)
select p_partkey, coalesce(d, was) as definition, coalesce(d <> was, false) as changed, false as changed_again from p""",
    "source_allow_list": """with s as (select case p_partkey % 6 when 0 then 'pubmed_central' when 1 then 'manual' when 3 then 'arxiv' when 4 then 'dblp' else '' end as source from part)
select source, count(*) filter (source in ('', 'arxiv', 'pubmed_central')) as n_listed, count(*) filter (source in ('', 'arxiv', 'manual')) as n_with_manual, count(*) as n_any from s group by 1""",
    "completed_files": "select distinct doc_id % 700 as key from documents where doc_id % 700 not in (select doc_id % 500 from documents where strlen(text) >= 8000)",
    "pending_report_counts": """select count(*) filter (l_linenumber % 4 = 0) as n_downloaded, count(*) filter (l_linenumber % 4 = 1) as n_existing, count(distinct l_orderkey) filter (l_linenumber % 4 = 2) as n_failed from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')""",
    "stale_subsets": """select o_orderpriority, count(*) as n_total, count(*) filter (o_orderpriority < '4' and not (o_orderpriority like '2%' and o_orderkey % 10 = 0)) as n_subset, count(*) filter (o_orderpriority < '4' and not (o_orderpriority like '2%' and o_orderkey % 10 = 0)) < count(*) as rebuild from orders group by 1""",
    "nested_pruning": """select s_suppkey, '{"title":"' || s_name || '","parts":[{"id":1},{"id":2}],"deep":{"reference":"kept","link":[1]}' || (case when s_suppkey % 3 = 0 then '' else ',"link":["l"]' end) || (case when s_suppkey % 3 = 1 then '' else ',"referenced_works":["w"]' end) || '}' as metadata from supplier""",
    "fixed_contract": """select n_nationkey, n_nationkey::varchar as paper_id, 'stage1' as stage, null::varchar as guardrails, case when n_nationkey % 2 = 0 then '{"a":1}' end as review,
 concat_ws(',', case when n_nationkey % 2 = 0 then 'review' end, case when n_nationkey % 3 = 0 then 'source_basis' end) as forbidden from nation""",
    "sorted_reports": """with c as (select o_orderpriority as value, count(*) as n, array_to_string(list_sort(list(distinct o_orderkey % 50)), ',') as keys from orders group by 1) select value, n, row_number() over (order by n desc, value)::int as place, keys from c""",
    "input_order_restored": "select 100000 - c_custkey as pos, c_custkey as key, n from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey",
    "allow_list_limit": """with r as (select l_orderkey::varchar as key, min(l_linenumber::bigint * 1000000000 + l_partkey * 1000 + l_suppkey) as pos, count(*) as n_rows from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1) select * from r order by pos, key limit 300""",
}
