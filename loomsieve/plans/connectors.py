"""Sources and sinks, as round trips: rows are written in a format and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsieve.functions import text
from loomsieve.operators import link, replay, route
from loomsieve.sources import bibtex, documents, files
from loomsieve.streaming import events, jobs
from loomsieve.tables import scratch, table

RECORD = "key string, title string, year int"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("key"), F.concat("s_name", F.lit(' "q" ä, ')).alias("title"), F.when(k % 3 > 0, (2000 + k % 20).cast("int")).alias("year"), F.col("s_nationkey"))


def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines, nulls kept, and read strictly."""
    path = scratch(spark)
    files.write_json(_records(spark, sf_dir).drop("s_nationkey"), path)
    return files.json_lines(spark, path, RECORD).select("key", "title", "year")


def json_lines_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every fifth is broken, read leniently."""
    path = scratch(spark)
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.concat(F.lit('{"key": '), k.cast("string"))).otherwise(F.to_json(F.struct(k.cast("string").alias("key"))))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return files.json_lines(spark, path, "key string", "lenient").select("key")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of the non-blank lines of each file; every file's lines say which they are."""
    path = scratch(spark)
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), 20 + F.col("n_nationkey"))).alias("i"))
    lines = n.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.when(i % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit('{"i":'), i.cast("string"), F.lit("}")))), "\n").alias("value"))
    lines.repartition(5, "n_nationkey").sortWithinPartitions("n_nationkey").select("n_nationkey", "value").write.partitionBy("n_nationkey").text(path)
    rows = files.numbered_json_lines(spark, f"{path}/*", "i int")
    return rows.select(F.regexp_extract("source_path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "line_no", F.col("row.i").alias("i"))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a list, and documents that wrap one under several names."""
    path = scratch(spark)
    r = _records(spark, sf_dir).groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("key", "title", "year"))).alias("list"))
    name = F.element_at(F.array(*map(F.lit, ("records", "items", "data"))), (F.col("s_nationkey") % 3 + 1).cast("int"))
    whole = F.when(F.col("s_nationkey") % 4 == 0, F.col("list")).otherwise(F.concat(F.lit('{"'), name, F.lit('": '), "list", F.lit(', "n": 1}')))
    r.select("s_nationkey", whole.alias("value")).write.partitionBy("s_nationkey").text(path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("title", T.StringType()), T.StructField("year", T.DecimalType(5, 0))])
    return files.json_records(spark, f"{path}/*", schema).select("key", "title", F.col("year").cast("int").alias("year"))


def folders_as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in a folder for each paper, restricted to an allow list of papers."""
    path = scratch(spark)
    rows = _records(spark, sf_dir).select("key", "title", "year", F.col("s_nationkey").alias("paper"))
    files.write_json(rows, path, ["paper"])
    found = files.by_folder(spark, f"{path}/*", RECORD, r"paper=([^/]+)/[^/]+$")
    return found.filter(F.col("paper_id").isin("1", "2", "3")).select("paper_id", "key")


def csv_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in a fixed column order: two digits, true and false, no commas in texts."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(", Ltd")).alias("name"), (F.col("c_acctbal") > 0).alias("positive"), (F.col("c_custkey") / 8).alias("share"))
    files.write_report(rows, path, ["share", "name", "positive", "c_custkey"])
    return files.csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", "positive", "share")


def key_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys with comments, blanks and repeats, as a semi-join's right side."""
    path = scratch(spark)
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.lit("# a comment")).when(k % 7 == 1, F.lit("   ")).otherwise(F.concat(F.lit(" "), (k % 400).cast("string"), F.lit(" ")))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return table(spark, sf_dir, "orders").join(files.key_list(spark, path), F.col("o_custkey").cast("string") == F.col("key"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy documents written for every nation and read as policies."""
    path = scratch(spark)
    n = F.col("n_nationkey")
    doc = F.concat(F.lit('{"paper_id":"x","time_policy":{"enabled":'), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(',"start_date":'), F.when(n % 3 == 0, "null").otherwise(F.concat(F.lit('"'), (2000 + n).cast("string"), F.lit('-02-01"'))), F.lit(',"end_date":"2023-02-01","end_inclusive":true}}'))
    table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("value")).write.partitionBy("n_nationkey").text(path)
    rows = documents.policies(spark, f"{path}/*", r"n_nationkey=([0-9]+)/")
    return rows.select("paper_id", "enabled", F.col("start").alias("first_day"), F.col("end").alias("last_day"), "end_inclusive", "timezone")


def bibtex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialized entries in files, read by the data source."""
    path = scratch(spark)
    s = table(spark, sf_dir, "supplier")
    entry = bibtex.entry_text(F.lit("article"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")), F.create_map(F.lit("title"), F.concat(F.lit("{On} "), "s_name"), F.lit("year"), (1990 + F.col("s_suppkey") % 30).cast("string")))
    s.select("s_nationkey", entry.alias("value")).repartition(3).select("value").write.text(path)
    return bibtex.read(spark, path).select("entry_type", "key", F.col("fields")["year"].alias("year"))


def bibtex_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written by the data source's own writer, in several tasks, replaced once, and read again."""
    path = scratch(spark)
    bibtex.register(spark)
    s = table(spark, sf_dir, "supplier").select(F.lit("article").alias("entry_type"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"), F.create_map(F.lit("title"), F.concat(F.lit("On "), "s_name"), F.lit("publisher"), F.col("s_nationkey").cast("string"), F.lit("note"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("n")).alias("fields"))
    s.filter("key = 'k1'").write.format("bibtex").mode("append").save(path)
    s.repartition(3).write.format("bibtex").mode("overwrite").save(path)
    out = spark.read.format("bibtex").load(path)
    return out.select("entry_type", "key", F.col("fields")["title"].alias("title"), F.col("fields")["organization"].alias("organization"), F.col("fields")["note"].alias("note"))


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the polls of a job that has ten days."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", " In_Progress").when(F.col("event_type") == "click", "validating").when(F.col("event_type") == "signup", "finalizing").when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "cancelling").otherwise("cancelled")
    out = jobs.outcomes(e.select(F.col("user_id").alias("job"), "ts", status.alias("status")), "240 hours")
    return out.withColumn("ended_at", F.col("ended_at").cast("timestamp_ntz"))


def cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by DOI, each asked once however many rows have it, with answers kept in a table."""
    path = scratch(spark)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("10.1/"), (F.col("l_suppkey") % 40).cast("string")).alias("doi"))
    answers = li.select("doi").distinct().select("doi", F.when(F.length("doi") % 2 == 0, F.concat(F.lit("answer "), "doi")).alias("answer"))
    answers.write.parquet(path)
    out = link.waterfall(li.join(spark.read.parquet(path), "doi", "left"), [("memo", F.col("answer")), ("none", F.lit("-"))], "found")
    return out.groupBy("found", "found_source").agg(F.count("*").alias("n"))


def versioned_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of orders upserted by customer; the newest version is the table, and repeating a batch changes nothing."""
    folder = scratch(spark)
    write = events.upsert_sink(spark, folder, "o_custkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    for batch in (0, 1, 2, 1):
        write(orders.filter(F.col("o_orderkey") % 3 == batch), batch)
    return events.current(spark, folder)


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable shares, blank lines and fences of texts made from parts."""
    k = F.col("p_partkey")
    t = F.concat(F.lit("```json\n"), "p_name", F.lit("  \r\n"), F.repeat(F.lit("\n"), F.col("p_size").cast("int") % 5), F.lit("end"), F.when(k % 2 == 0, "\u0001\u0002").otherwise(""), F.lit("\n```"))
    rows = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    clean = text.collapsed_blank_lines(text.without_fences(F.col("t")))
    return rows.select("p_partkey", F.round(text.printable_share(F.regexp_replace("t", r"[\r\n]", "")), 6).alias("printable"), F.md5(clean).alias("digest"))


def binary_listing(spark: SparkSession, path_of: str) -> DataFrame:
    """Files of every nation as they lie in a folder, without those that begin with a dot and an underscore; and which of
    them have no converted file yet."""
    path = scratch(spark)
    n = table(spark, path_of, "nation").select("n_nationkey", F.rpad(F.lit("x"), 5, "y").alias("value"))
    n.repartition(4, "n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/in")
    n.filter("n_nationkey % 3 = 0").repartition(2, "n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/out")
    folder = lambda df: df.withColumn("stem", F.regexp_extract("path", "n_nationkey=([0-9]+)", 1))
    sources, done = folder(files.binary_listing(spark, f"{path}/in", ".txt")), folder(files.binary_listing(spark, f"{path}/out", ".txt"))
    return files.to_convert(sources, done, 6).select(F.col("stem").cast("int").alias("n_nationkey"), "length")


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table as lines of Markdown."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("|x")).alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") / 8).alias("share"))
    return files.markdown_lines(n, ["n_nationkey", "name", "share"], "n_nationkey")


def bulk_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings replaced over all texts, and how many texts that changes."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    new = text.substituted(F.col("t"), {"ring": "bracket", "ECONOMY": "ring", "red ": ""})
    return p.select("p_partkey", new.alias("text"), (new != F.col("t")).alias("changed"))


def validator_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's own check says of nested records."""

    def small(record: dict) -> None:
        if record["size"] > 30:
            raise ValueError(f"size {record['size']} is above 30")

    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, F.struct(F.col("p_size").alias("size"))).alias("record"))
    return route.hooked(p, "record", small).select("p_partkey", "error")


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.matrix(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", ["operational", "faithful"], 3)


QUERIES = {f.__name__: f for f in (binary_listing, markdown_report, bulk_substitution, validator_hook, run_matrix, json_lines_round_trip, json_lines_lenient, numbered_lines, json_documents, folders_as_papers, csv_report_round_trip, key_list_scan, policy_documents, bibtex_files, bibtex_sink, job_outcomes, cached_lookups, versioned_upserts, text_quality)}

_LEGAL = "(" + " or ".join(f"(f.status = '{a}' and c.s in ({', '.join(repr(x) for x in b)}))" for a, b in jobs.NEXT.items() if a) + ")"
_REC = """select s_suppkey::varchar as key, s_name || ' "q" ä, ' as title, case when s_suppkey % 3 > 0 then (2000 + s_suppkey % 20)::int end as year from supplier"""
ORACLE = {
    "binary_listing": "select n_nationkey, 6::bigint as length from nation where n_nationkey % 3 <> 0",
    "markdown_report": """select -2::bigint as pos, '| n_nationkey | name | share |' as line union all select -1, '| --- | --- | --- |' union all
select n_nationkey, '| ' || n_nationkey || ' | ' || n_name || '\\|x | ' || coalesce(case when n_nationkey % 4 > 0 then format('{:.4f}', n_nationkey / 8) end, '') || ' |' from nation""",
    "bulk_substitution": """select p_partkey, replace(replace(replace(t, 'ring', 'bracket'), 'ECONOMY', 'ring'), 'red ', '') as text, replace(replace(replace(t, 'ring', 'bracket'), 'ECONOMY', 'ring'), 'red ', '') <> t as changed from (select p_partkey, p_name || ' ' || p_type as t from part)""",
    "validator_hook": "select p_partkey, case when p_partkey % 9 > 0 and p_size > 30 then 'size ' || p_size || ' is above 30' end as error from part",
    "run_matrix": "select n_nationkey, v as variant, r::int as run from nation, (values ('operational'), ('faithful')) a(v), range(1, 4) b(r)",
    "json_lines_round_trip": _REC,
    "json_lines_lenient": "select o_orderkey::varchar as key from orders where o_orderkey % 5 <> 0",
    "numbered_lines": "select n_nationkey, i::int as line_no, i::int as i from nation, range(1, 46) t(i) where i <= 20 + n_nationkey and i % 4 <> 0",
    "json_documents": _REC,
    "folders_as_papers": "select s_nationkey::varchar as paper_id, s_suppkey::varchar as key from supplier where s_nationkey in (1, 2, 3)",
    "csv_report_round_trip": "select c_custkey, c_name || '; Ltd' as name, (c_acctbal > 0)::varchar as positive, format('{:.2f}', round(c_custkey / 8 + 1e-9, 2)) as share from customer",
    "key_list_scan": "select o_orderstatus, count(*) as n from orders where o_custkey in (select c_custkey % 400 from customer where c_custkey % 7 > 1) group by 1",
    "policy_documents": """select n_nationkey::varchar as paper_id, n_nationkey % 2 = 0 as enabled, case when n_nationkey % 3 > 0 then make_date(2000 + n_nationkey, 2, 1) end as first_day, date '2023-02-01' as last_day, true as end_inclusive, 'UTC' as timezone from nation""",
    "bibtex_files": "select 'article' as entry_type, 'k' || s_suppkey as key, (1990 + s_suppkey % 30)::varchar as year from supplier",
    "bibtex_sink": "select 'article' as entry_type, 'k' || s_suppkey as key, 'On ' || s_name as title, s_nationkey::varchar as organization, case when s_suppkey % 2 = 1 then 'n' end as note from supplier",
    "job_outcomes": f"""with recursive p as (select user_id::varchar as job, ts, case event_type when 'view' then 'in_progress' when 'click' then 'validating' when 'signup' then 'finalizing' else (case event_id % 3 when 0 then 'completed' when 1 then 'cancelling' else 'cancelled' end) end as s,
 min(ts) over (partition by user_id) + interval 240 hour as dl from events where user_id is not null), c as (select *, row_number() over (partition by job order by ts, s) as rn from p where ts <= dl),
f as (select job, dl, rn, s as status, ts as moment, 0 as bad from c where rn = 1 union all
 select f.job, f.dl, c.rn, case when {_LEGAL} then c.s else f.status end, case when {_LEGAL} then c.ts else f.moment end, f.bad + (case when c.s = f.status or {_LEGAL} then 0 else 1 end)
 from f join c on c.job = f.job and c.rn = f.rn + 1 where f.status not in ('completed', 'failed', 'expired', 'cancelled')),
l as (select *, row_number() over (partition by job order by rn desc) as last from f)
select job, case when status in ('completed', 'failed', 'expired', 'cancelled') then status else 'expired' end as status, case when status in ('completed', 'failed', 'expired', 'cancelled') then moment else dl end as ended_at, rn::int as n_polls, bad::int as n_illegal
 from l where last = 1 and (status in ('completed', 'failed', 'expired', 'cancelled') or dl < (select max(ts) from events))""",
    "cached_lookups": """with l as (select '10.1/' || (l_suppkey % 40) as doi from lineitem) select case when length(doi) % 2 = 0 then 'answer ' || doi else '-' end as found, case when length(doi) % 2 = 0 then 'memo' else 'none' end as found_source, count(*) as n from l group by 1, 2""",
    "versioned_upserts": "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1",
    "text_quality": """with t as (select p_partkey, p_name, p_size % 5 as k, p_partkey % 2 = 0 as odd from part)
select p_partkey, round(1 - (case when odd then 2 else 0 end) / (7 + length(p_name) + 2 + 3 + (case when odd then 2 else 0 end) + 3), 6) as printable, md5(p_name || (case when k = 0 then chr(10) else chr(10) || chr(10) end) || 'end' || (case when odd then chr(1) || chr(2) else '' end)) as digest from t""",
}
