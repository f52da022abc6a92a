"""Candidate pools: verification, fallbacks over sources, fan-out, alignment with pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import alignment, records
from loomsieve.operators import candidates, incremental, layout
from loomsieve.tables import table


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a work list: titles in braces, DOIs as addresses, arXiv identifiers with versions."""
    k = F.col("p_partkey")
    number = F.lpad((k % 100000).cast("string"), 5, "0")
    return candidates.work_list(table(spark, sf_dir, "part").select(
        k.alias("record_index"), F.concat(F.lit("dir/pool."), (k % 3).cast("string"), F.lit(".bib")).alias("source_file"), F.concat("p_brand", F.lit("/"), k.cast("string")).alias("key"),
        F.concat(F.lit("{"), F.initcap("p_name"), F.lit("}")).alias("title"), F.concat(F.lit("c. "), (1990 + F.col("p_size") % 30).cast("string")).alias("year"), F.lit("Doe, Jane and Roe, Richard").alias("authors"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/P"), k.cast("string"), F.lit("."))).alias("doi"), F.when(k % 3 == 1, F.concat(F.lit("http://arxiv.org/abs/1906."), number, F.lit("v2"))).alias("url"), F.lit("").alias("eprint")))


def _record_columns():
    """What the records say: some titles, years, authors and identifiers differ, or are absent."""
    k = F.col("record_index")
    number = F.lpad((k % 100000).cast("string"), 5, "0")
    title = F.when(k % 4 == 3, F.concat("pool_norm", F.lit(" revisited"))).otherwise(F.upper("pool_title"))
    year = F.when(k % 5 != 0, (F.col("pool_year").cast("int") + F.when(k % 5 == 1, 1).otherwise(0)).cast("string"))
    author = F.when(k % 7 == 0, "roe").when(k % 7 != 1, "doe")
    dois = F.when(k % 2 == 0, F.array(F.concat(F.lit("10.1000/p"), k.cast("string"))))
    arxivs = F.when(k % 4 != 0, F.array(F.concat(F.lit("1906."), number)))
    return title, year, author, candidates.identifiers_agree(dois, arxivs)


def candidate_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate against its record; years may differ where identifiers agree."""
    out = candidates.verify(_pool(spark, sf_dir), *_record_columns(), candidates.Rules(least=0.66, ids_over_year=True))
    c = F.col("check")
    return out.select("record_index", "emitted_key", "pool_year", "pool_author", "pool_doi", "pool_arxiv", c["title_ok"].alias("title_ok"), F.round(c["overlap"], 6).alias("overlap"), c["year_ok"].alias("year_ok"), c["author_ok"].alias("author_ok"), c["ids_ok"].alias("ids_ok"), c["ok"].alias("ok"), c["note"].alias("note"))


#: The sources' rules: of records that are at hand, of arXiv, of Crossref, and of sources looked up by hand.
RULES = {"main": candidates.Rules(ids_over_year=True), "arxiv": candidates.Rules(least=0.92, year_needed=True, author_needed=True), "crossref": candidates.Rules(least=1.0), "manual": candidates.Rules()}


def verification_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each source's rules accept."""
    pool = _pool(spark, sf_dir)
    out = None
    for name, rules in RULES.items():
        counts = candidates.verify(pool, *_record_columns(), rules).groupBy(F.lit(name).alias("source")).agg(F.count_if(F.col("check.ok")).alias("n_ok"), F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def record_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs and arXiv identifiers of nested records, wherever they stand."""
    k = F.col("o_orderkey")
    number = F.lpad((k % 100000).cast("string"), 5, "0")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("doi: 10.5555/A"), k.cast("string"))).otherwise(F.concat(F.lit("arXiv:2001."), number, F.lit("v3"))).alias("source_id"),
        F.struct(F.when(k % 3 == 0, F.concat(F.lit("(10.5555/a"), k.cast("string"), F.lit(")"))).alias("DOI"), F.when(k % 5 == 0, F.concat(F.lit("2001."), number)).alias("ArXiv")).alias("externalIds"),
        F.when(k % 7 == 0, F.concat(F.lit("https://arxiv.org/pdf/1912."), number, F.lit(".pdf"))).alias("pdf_url")).alias("r"))
    dois = records.ids_of([F.col("r.source_id"), F.col("r.externalIds.DOI")], records.doi_of)
    arxivs = records.ids_of([F.col("r.source_id"), F.col("r.externalIds.ArXiv"), F.col("r.pdf_url")], records.arxiv_of)
    return rows.select("o_orderkey", F.array_join(dois, ",").alias("dois"), F.array_join(arxivs, ",").alias("arxivs"))


def _record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records are found by: DOIs (some stated twice, some by two records), arXiv identifiers and titles."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("r"), k.cast("string")).alias("key"), "p_name")
    doi = F.concat(F.lit("10.1000/p"), k.cast("string"))
    rows = [
        p.filter(k % 2 == 0).select("key", F.lit("doi").alias("kind"), doi.alias("value")), p.filter(k % 4 == 0).select("key", F.lit("doi"), doi), p.filter(k % 18 == 0).select(F.concat("key", F.lit("b")), F.lit("doi"), doi),
        p.filter(k % 4 != 0).select("key", F.lit("arxiv"), F.concat(F.lit("1906."), F.lpad((k % 100000).cast("string"), 5, "0"))), p.filter(k % 5 != 0).select("key", F.lit("title"), F.col("p_name"))]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k % 10 == 3).select(k.alias("record_index"), F.concat(F.lit("r"), (k - 1 + F.when(k % 20 == 3, 0).otherwise(10_000_000)).cast("string")).alias("key"))


def record_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each candidate, by alias, DOI, arXiv identifier or title; and with repeated statements counted."""
    pool, index, aliases = _pool(spark, sf_dir), _record_index(spark, sf_dir), _aliases(spark, sf_dir)
    both = [candidates.match_records(pool, index, aliases, c).select("record_index", F.col("key").alias(f"key{n}"), F.col("matched_by").alias(f"matched_by{n}")) for c, n in ((False, ""), (True, "_by_entry"))]
    return both[0].join(both[1], "record_index")


def alias_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that were named by hand pass with titles that overlap less."""
    k = F.col("record_index")
    title, _, author, _ = _record_columns()
    ids = candidates.identifiers_agree(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = candidates.verify(_pool(spark, sf_dir), title, F.when(k % 5 > 1, F.col("pool_year")), author, ids, candidates.Rules(ids_over_year=True, least=0.9, aliased=0.6), k % 2 == 0)
    return out.select("record_index", "check.ok", "check.override", F.round("check.overlap", 6).alias("overlap"))


def doi_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of each order's lines in turn: as they were coded, where later failures replace successes, and as intended."""
    k = F.col("l_partkey")
    status = F.when(k % 7 == 0, "crossref:match").when(k % 7 < 3, "crossref:doi_match").when(k % 7 < 5, "openalex:doi_landing_match").otherwise("doi:no_match")
    value = F.when(k % 7 < 5, F.concat(F.lit("abstract "), k.cast("string")))
    tries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), value.alias("value"), status.alias("status"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    coded = candidates.ordered_attempts(items, tries, "k", "at", "value").select("k", F.col("winner").alias("coded"), F.col("status").alias("coded_status"), F.col("n_tries").alias("coded_tries"), F.array_join("trace", " ").alias("coded_trace"))
    meant = candidates.ordered_attempts(items, tries, "k", "at", "value", None).select("k", F.col("winner").alias("intended"), F.col("status").alias("intended_status"), F.col("n_tries").alias("intended_tries"))
    return coded.join(meant, "k")


def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts by three sources in order; one has DOIs as hints for the others."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    crossref = c.filter(k % 2 == 0).select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("crossref abstract "), k.cast("string"))).alias("abstract"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"))
    openalex = c.filter(k % 3 == 0).select("c_custkey", F.concat(F.lit("openalex abstract "), k.cast("string")).alias("abstract"))
    semantic = c.filter(k % 5 == 0).select("c_custkey", F.concat(F.lit("semantic abstract "), k.cast("string")).alias("abstract"), F.concat(F.lit("10.2/"), k.cast("string")).alias("doi"))
    out = candidates.fetched(c, {"crossref": crossref, "openalex": openalex, "semantic_scholar": semantic}, "c_custkey", "abstract", ("doi",))
    return out.select("c_custkey", "source", F.col("value").alias("abstract"), "status", F.array_join("trace", " ").alias("trace"), "doi")


def first_accepted_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the first of its lines that was returned, and how many were looked at."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = candidates.first_accepted(orders, lines, "l_orderkey", "l_linenumber", F.col("flag") == "R")
    return out.select("l_orderkey", F.col("hit.l_linenumber").alias("line"), F.col("hit.part").alias("part"), F.col("tries").cast("long").alias("tries"))


def pool_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as the rows of five tables."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("title"), F.lit("manual").alias("source"), F.concat(F.lit("local:"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit(None).cast("string").alias("abstract"), F.array(F.lit("a"), F.lit("b")).alias("steps"))
    return candidates.fan_out(s, "s_suppkey", {"metadata": ["title", "abstract"], "sources": ["source", "source_id"], "trace": ["steps"], "full": ["title", "source", "source_id"], "log": ["source_id"]})


def routing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates are arXiv's, which have a file's address, and which are among the included."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "arxiv").otherwise("bib").alias("family"), F.when(F.col("p_size") % 5 == 0, "arxiv_clip").alias("segment"), F.concat(F.lit("http://x.org/"), F.when(F.col("p_partkey") % 3 == 0, "a.PDF").when(F.col("p_partkey") % 3 == 1, "pdf/7").otherwise("page")).alias("url"))
    included = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select("l_partkey")
    out = candidates.labelled(p, "p_partkey", included, "l_partkey", "included")
    return out.select("p_partkey", candidates.is_arxiv_item(F.col("family"), F.col("segment")).alias("arxiv"), candidates.has_pdf_address(F.col("url")).alias("pdf"), "included")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = lambda c: F.element_at(F.array(*map(F.lit, ("copied", "downloaded", "failed", "skipped"))), (F.col(c) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 2 == 0, "arxiv").otherwise("non_arxiv_manual").alias("source_type"), action("l_partkey").alias("metadata_action"), action("l_orderkey").alias("pdf_action"),
        F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit(" reason "), F.col("l_linenumber").cast("string"))).alias("status_reason"))


def pool_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pool_summary(_log(spark, sf_dir))


def pool_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.failure_reasons(_log(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as metadata, and as pages whose title or text is sometimes another."""
    c = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    k = F.col("conv_id") + F.col("turn")
    metadata = c.filter(k % 11 != 0).select("conv_id", "turn", F.when(k % 13 != 0, F.concat(F.lit("On turn "), F.col("turn").cast("string"))).alias("title"), F.when(k % 17 != 0, F.col("text")).alias("abstract"))
    other = F.when(k % 5 == 0, F.concat("text", F.lit(" 0123456789"))).when(k % 7 == 0, F.repeat(F.lit("other words "), 20)).when(k % 19 == 0, F.lit("short")).otherwise(F.col("text"))
    pages = c.filter(k % 3 != 0).select("conv_id", "turn", F.when(k % 4 == 0, F.lit("Off turn")).when(k % 4 == 1, F.concat(F.lit("On turn: "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit(" ON\u00a0 turn "), F.col("turn").cast("string"))).alias("page_title"), other.alias("page_abstract"), (k % 23 != 0).alias("readable"), F.when(k % 29 == 0, F.lit("front")).alias("page_text"))
    return candidates.aligned(metadata, pages, ["conv_id", "turn"])


def metadata_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.regexp_replace("reason", "similarity=.*<", "similarity<")
    return _aligned(spark, sf_dir).select("conv_id", "turn", "status", reason.alias("reason"))


def alignment_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and failures by turn."""
    rows = _aligned(spark, sf_dir).withColumn("reason", F.regexp_replace("reason", "similarity=.*<", "similarity<"))
    return candidates.alignment_summary(rows, "turn", ["conv_id", "turn"])


def metadata_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' titles and first letters in the texts of pages made from them."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 != 0, F.col("p_name")).alias("title"), F.when(k % 13 != 0, F.concat(F.lit("Made by "), F.col("p_brand"), F.lit(", of type "), F.col("p_type"))).alias("abstract"))
    page = F.concat_ws("\n", F.when(k % 3 != 0, F.upper("p_name")), F.lit("abstract:"), F.when(k % 5 != 0, F.concat(F.lit("made BY "), F.col("p_brand"), F.lit(", of\ntype "), F.col("p_type"))))
    pages = table(spark, sf_dir, "part").filter(k % 7 != 0).select("p_partkey", F.when(k % 17 != 0, page).alias("page_text"))
    return candidates.contained(m, pages, ["p_partkey"]).select("p_partkey", "status")


def export_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported rows of orders against the keys that were wanted."""
    exports = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"))
    wanted = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"))
    return candidates.export_report(exports, wanted, "k", "pos").groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"))


def page_title_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether first pages belong to records, by their titles alone."""
    k = F.col("p_partkey")
    main = F.concat(F.lit("The making of "), "p_name")
    title = F.concat(main, F.lit(": a study of "), "p_type")
    page = F.when(k % 5 == 0, F.concat(F.lit("Preprint. "), F.upper(title), F.lit(". Abstract, of a length that is enough to read"))).when(k % 5 == 1, F.concat(main, F.lit(" and other words until the page is long enough to read"))).otherwise("short")
    head = F.when(k % 5 == 2, F.lower(title)).when(k % 5 == 3, F.concat(F.lit("On: "), main)).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("t"), F.when(k % 3 == 0, "An abstract").alias("a"), head.alias("h"), page.alias("p"))
    j = alignment.judge_match()("t", "a", "h", "p")
    return rows.select("p_partkey", j.alias("j")).select("p_partkey", "j.verdict", "j.reason")


def entry_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of entries, and the fields that may hold identifiers."""
    k = F.col("s_suppkey")
    local = F.struct(F.when(k % 2 == 0, F.col("s_name")).alias("title"), *(F.when(k % (i + 2) == 0, F.lit(n)).alias(n) for i, n in enumerate(records.CANDIDATE_FIELDS)))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, "Query").when(k % 3 == 1, "").alias("q"), local.alias("local"))
    return rows.select("s_suppkey", records.entry_title(F.col("q"), F.col("local.title")).alias("title"), F.array_join(records.candidate_strings(F.col("local")), ",").alias("strings"))


def request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times of requests that keep each source's interval."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return incremental.spaced(e, "event_type", "event_id", {"view": 1.0, "click": 0.5, "signup": 3.0})


def layout_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages by the sizes of their lines, which are made from the pages' markup."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "<[^>]+>", "\n"), "\n")).alias("line", "text"))
    n = F.length("text")
    half = (n / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("span"), F.substring(F.col("text"), F.lit(1), half).alias("text"), (8 + n % 5).cast("double").alias("size")),
        F.struct(F.lit(2).alias("span"), F.substring(F.col("text"), half + 1, n).alias("text"), (8 + (n + 2) % 7).cast("double").alias("size")))
    spans = p.select("page_id", F.lit(1).alias("page"), "line", (F.col("line") * 10.0).alias("y"), F.inline(parts))
    return layout.titles(spans, "page_id")


def front_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts on front pages that are made from the pages' texts, with and without a heading and an end."""
    k, t = F.col("page_id"), F.regexp_replace("html", "<[^>]+>", " ")
    first = F.concat(F.lit("Front "), k.cast("string"), F.when(k % 4 == 0, " no heading ").otherwise("\n ABSTRACT - :\n"), F.substring(t, 1, 400))
    pages = F.array(first, F.when(k % 3 != 0, F.concat(F.lit("more\n"), F.when(k % 2 == 0, "  1. Introduction\n").otherwise("Key words\n"), F.substring(t, 401, 2500))), F.concat(F.lit("\nIndex Terms: a"), F.substring(t, 1, 50)), F.lit("\nmethods"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return layout.abstracts(rows, "page_id").select("page_id", "abstract", F.length("front").alias("n_front"))


INTERVALS = {"view": 900.0, "click": 1500.5, "signup": 300.0}


def request_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When requests that arrive at their own times may start, so that each source's interval is kept."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    pos = F.unix_micros("ts").cast("decimal(20,0)") * 1_000_000 + F.col("event_id")
    out = incremental.earliest_starts(e.withColumn("pos", pos), "event_type", "pos", "ts", INTERVALS, chunk=500)
    return out.select("event_id", "event_type", (F.unix_micros("start_at") - F.unix_micros("ts")).alias("wait_us"))


QUERIES = {f.__name__: f for f in (page_title_verdicts, entry_titles, layout_titles, front_abstracts, request_schedule, request_starts, record_matches, alias_override, doi_attempts, candidate_verification, verification_rules, record_identifiers, source_cascade, first_accepted_try, pool_fan_out, routing_flags, pool_log_summary, pool_failure_reasons, metadata_alignment, alignment_pass_rates, metadata_containment, export_alignment)}

_POOL = """pool as (select p_partkey as k, p_name as norm, string_split(p_name, ' ') as words, 1990 + p_size % 30 as y, p_brand as brand,
 case when p_partkey % 3 = 0 then '10.1000/p' || p_partkey end as doi, case when p_partkey % 3 = 1 then '1906.' || lpad((p_partkey % 100000)::varchar, 5, '0') end as arxiv,
 case when p_partkey % 3 = 1 then 'http://arxiv.org/abs/1906.' || lpad((p_partkey % 100000)::varchar, 5, '0') || 'v2' end as url from part),
rec as (select *, case when k % 4 = 3 then norm || ' revisited' else norm end as rnorm, case when k % 5 <> 0 then y + (case when k % 5 = 1 then 1 else 0 end) end as ry, case when k % 7 = 0 then 'roe' when k % 7 <> 1 then 'doe' end as ra,
 case when k % 2 = 0 then '10.1000/p' || k end as rdoi, case when k % 4 <> 0 then '1906.' || lpad((k % 100000)::varchar, 5, '0') end as rarxiv from pool),
chk as (select *, case when norm = rnorm then 0.0 else len(list_distinct(words))::double / (len(list_distinct(words)) + 1) end as overlap,
 (ry is null or ry = y) as year_ok, (ra is null or ra = 'doe') as author_ok, coalesce(doi = rdoi, false) or coalesce(arxiv = rarxiv, false) or (doi is null and url is null) as ids_ok, doi is not null or arxiv is not null as has_ids from rec)"""
_ALIGNED = """c as (select conv_id, turn, conv_id + turn as k, text from conversations where text is not null),
p as (select *, case when k % 5 = 0 then text || ' 0123456789' when k % 7 = 0 then repeat('other words ', 20) when k % 19 = 0 then 'short' else text end as page from c),
a as (select conv_id, turn, case when k % 11 = 0 then 'orphan_page' when k % 3 = 0 then 'orphan_metadata' when k % 13 = 0 then 'fail_missing_title' when k % 17 = 0 or trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 'fail_missing_abstract'
 when k % 23 = 0 then 'fail_unreadable' when length(trim(page, chr(32) || chr(9) || chr(10) || chr(13))) < 120 then 'uncertain_extraction' when k % 4 < 2 then 'fail_title_mismatch' when k % 5 > 0 and k % 7 = 0 then 'fail_abstract_mismatch' else 'pass_strict' end as status
 from p where not (k % 11 = 0 and k % 3 = 0))"""
_REASON = """case status when 'orphan_page' then 'no_metadata_key_match' when 'orphan_metadata' then 'no_page_for_metadata_key' when 'fail_missing_title' then 'missing_metadata_title' when 'fail_missing_abstract' then 'missing_metadata_abstract' when 'fail_unreadable' then 'page_open_error'
 when 'uncertain_extraction' then 'low_text_quality_or_short_extraction' when 'fail_title_mismatch' then 'title_norm_not_exact' when 'pass_strict' then 'strict_three_layer_pass' else 'abstract_prefix_exact=False;abstract_similarity<threshold=0.90' end"""
ORACLE = {
    "page_title_verdicts": """with v as (select p_partkey, p_partkey % 5 as c, p_partkey % 3 = 0 as a from part)
select p_partkey, case when c = 4 then 'mismatch' when a and c > 1 then 'uncertain' else 'match' end as verdict, case when c = 4 then 'title_not_consistent_with_metadata' when a and c > 1 then 'first_page_text_too_short_for_topic_check'
 when c = 0 then 'full_title_found_in_first_page' when c = 1 then 'main_title_found_in_first_page' when c = 2 then 'title_header_consistent' else 'main_title_header_consistent' end as reason from v""",
    "entry_titles": """select s_suppkey, case when s_suppkey % 3 = 0 then 'Query' when s_suppkey % 2 = 0 then s_name else '' end as title,
 concat_ws(',', case when s_suppkey % 2 = 0 then 'journal' end, case when s_suppkey % 3 = 0 then 'note' end, case when s_suppkey % 4 = 0 then 'howpublished' end, case when s_suppkey % 5 = 0 then 'url' end, case when s_suppkey % 6 = 0 then 'doi' end) as strings from supplier""",
    "request_schedule": """select event_id, event_type, ((row_number() over (partition by event_type order by event_id) - 1) * case event_type when 'view' then 1.0 when 'click' then 0.5 when 'signup' then 3.0 else 0.0 end)::double as start_at from events""",
    "layout_titles": """with l as (select page_id, unnest(string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10))) as x, generate_subscripts(string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10)), 1) as i from pages),
t as (select page_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as t, greatest(8 + length(x) % 5, 8 + (length(x) + 2) % 7) as sz from l),
r as (select *, lower(regexp_replace(t, '\\s+', ' ', 'g')) in ('abstract', 'keywords', 'index terms') as h from t where length(t) >= 8)
select page_id, coalesce(arg_max(t, (sz, -i)) filter (not h), arg_min(t, i)) as title from r group by 1""",
    "front_abstracts": """with p as (select page_id as k, regexp_replace(html, '<[^>]+>', ' ', 'g') as t from pages),
f as (select k, regexp_replace(concat_ws(chr(10), 'Front ' || k || (case when k % 4 = 0 then ' no heading ' else chr(10) || ' ABSTRACT - :' || chr(10) end) || substr(t, 1, 400), coalesce(case when k % 3 <> 0 then 'more' || chr(10) || (case when k % 2 = 0 then '  1. Introduction' || chr(10) else 'Key words' || chr(10) end) || substr(t, 401, 2500) end, ''),
 chr(10) || 'Index Terms: a' || substr(t, 1, 50)), '^\\s+|\\s+$', '', 'g') as f from p),
a as (select k, f, case when k % 4 > 0 then regexp_replace(regexp_extract(f, '(?is)\\babstract\\b[\\s:.\\-]*(.*)$', 1), '^\\s+|\\s+$', '', 'g') end as a from f),
c as (select *, string_split_regex(a, '(?im)^\\s*(?:keywords?|index terms?|1\\.?\\s+introduction|i\\.?\\s+introduction|introduction|background|materials?\\s+and\\s+methods?|methods)\\b') as s from a)
select k as page_id, regexp_replace(case when a is null then substr(f, 1, 2200) when len(s) > 1 then s[1] else substr(a, 1, 3000) end, '^\\s+|\\s+$', '', 'g') as abstract, length(f)::int as n_front from c""",
    "request_starts": """with k as (select event_id, event_type, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as k, case event_type when 'view' then 900000000 when 'click' then 1500500000 when 'signup' then 300000000 else 0 end as d from events)
select event_id, event_type, case when d > 0 then max(t - k * d) over (partition by event_type order by k) + k * d - t else 0 end as wait_us from k""",
    "record_matches": """with i as (select p_partkey as k, 'r' || p_partkey as key, 'doi' as kind, '10.1000/p' || p_partkey as value from part where p_partkey % 2 = 0 union all select p_partkey, 'r' || p_partkey, 'doi', '10.1000/p' || p_partkey from part where p_partkey % 4 = 0
 union all select p_partkey, 'r' || p_partkey || 'b', 'doi', '10.1000/p' || p_partkey from part where p_partkey % 18 = 0 union all select p_partkey, 'r' || p_partkey, 'arxiv', '1906.' || lpad((p_partkey % 100000)::varchar, 5, '0') from part where p_partkey % 4 <> 0
 union all select p_partkey, 'r' || p_partkey, 'title', p_name from part where p_partkey % 5 <> 0),
u as (select kind, value, min(key) as key, count(distinct key) = 1 as one, count(*) = 1 as once from i group by 1, 2),
w as (select p_partkey as k, p_name as t, case when p_partkey % 3 = 0 then '10.1000/p' || p_partkey end as d, case when p_partkey % 3 = 1 then '1906.' || lpad((p_partkey % 100000)::varchar, 5, '0') end as a,
 case when p_partkey % 20 = 3 and 'r' || (p_partkey - 1) in (select key from i) then 'r' || (p_partkey - 1) end as l from part),
m as (select k, l, (select key from u where kind = 'doi' and value = d and one) as d1, (select key from u where kind = 'arxiv' and value = a and one) as a1, (select key from u where kind = 'title' and value = t and one) as t1,
 (select key from u where kind = 'doi' and value = d and once) as d2, (select key from u where kind = 'arxiv' and value = a and once) as a2, (select key from u where kind = 'title' and value = t and once) as t2 from w)
select k as record_index, coalesce(l, d1, a1, t1) as key, case when l is not null then 'manual_alias' when d1 is not null then 'doi' when a1 is not null then 'arxiv_id' when t1 is not null then 'normalized_title' end as matched_by,
 coalesce(l, d2, a2, t2) as key_by_entry, case when l is not null then 'manual_alias' when d2 is not null then 'doi' when a2 is not null then 'arxiv_id' when t2 is not null then 'normalized_title' end as matched_by_by_entry from m""",
    "alias_override": f"""with {_POOL}, v as (select *, case when k % 5 > 1 then y end as my, norm = rnorm or overlap >= 0.9 as tok, k % 3 < 2 as has from chk),
o as (select *, tok and author_ok and (my is null or my = y or k % 3 = 2 or not has) as fine, (my is null or my = y) as yok from v)
select k as record_index, fine or (k % 2 = 0 and author_ok and yok and (tok or overlap >= 0.6)) as ok, not fine and k % 2 = 0 and author_ok and yok and (tok or overlap >= 0.6) as override, round(overlap, 6) as overlap from o""",
    "doi_attempts": """with t as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, case when l_partkey % 7 < 5 then 'abstract ' || l_partkey end as v,
 case when l_partkey % 7 = 0 then 'crossref:match' when l_partkey % 7 < 3 then 'crossref:doi_match' when l_partkey % 7 < 5 then 'openalex:doi_landing_match' else 'doi:no_match' end as s from lineitem),
c as (select k, coalesce(min(n) filter (s like '%:match'), max(n)) as c, coalesce(min(n) filter (v is not null), max(n)) as i from t group by 1)
select o_orderkey as k, a.v as coded, a.s as coded_status, coalesce(c.c, 0)::int as coded_tries, coalesce((select string_agg(s, ' ' order by n) from t where t.k = o_orderkey and t.n <= c.c), '') as coded_trace, b.v as intended, b.s as intended_status, coalesce(c.i, 0)::int as intended_tries
from orders left join c on c.k = o_orderkey left join t a on a.k = c.k and a.n = c.c left join t b on b.k = c.k and b.n = c.i""",
    "candidate_verification": f"""with {_POOL}, v as (select *, norm = rnorm or overlap >= 0.66 as title_ok from chk)
select k as record_index, 'pool.' || (k % 3) || '__' || regexp_replace(brand, '[^A-Za-z0-9._-]+', '_') || '_' || k as emitted_key, y::varchar as pool_year, 'doe' as pool_author, doi as pool_doi, arxiv as pool_arxiv, title_ok, round(overlap, 6) as overlap, year_ok, author_ok, ids_ok,
 title_ok and author_ok and (year_ok or ids_ok or not has_ids) as ok,
 'title_ok=' || title_ok || '; title_overlap=' || format('{{:.3f}}', overlap) || '; pool_year=' || y || '; main_year=' || coalesce(ry::varchar, 'n/a') || '; pool_first_author=doe; main_first_author=' || coalesce(ra, 'n/a')
 || '; pool_identifiers=' || coalesce(nullif(concat_ws(', ', 'doi=' || doi, 'arxiv=' || arxiv, 'url=' || url), ''), 'none') || '; main_identifiers=' || coalesce(rdoi, 'none') || '; main_arxiv=' || coalesce(rarxiv, 'none') as note from v""",
    "verification_rules": f"""with {_POOL}
select 'main' as source, count(*) filter ((norm = rnorm or overlap >= 0.88) and author_ok and (year_ok or ids_ok or not has_ids)) as n_ok, count(*) as n from chk union all
select 'arxiv', count(*) filter ((norm = rnorm or overlap >= 0.92) and coalesce(ra = 'doe', false) and coalesce(ry = y, false) and (ids_ok or not has_ids)), count(*) from chk union all
select 'crossref', count(*) filter (norm = rnorm and author_ok and year_ok and (ids_ok or not has_ids)), count(*) from chk union all
select 'manual', count(*) filter ((norm = rnorm or overlap >= 0.88) and author_ok and year_ok and (ids_ok or not has_ids)), count(*) from chk""",
    "record_identifiers": """select o_orderkey, case when o_orderkey % 2 = 0 or o_orderkey % 3 = 0 then '10.5555/a' || o_orderkey else '' end as dois,
 array_to_string(list_filter([case when o_orderkey % 7 = 0 then '1912.' || lpad((o_orderkey % 100000)::varchar, 5, '0') end, case when o_orderkey % 2 = 1 or o_orderkey % 5 = 0 then '2001.' || lpad((o_orderkey % 100000)::varchar, 5, '0') end], lambda x: x is not null), ',') as arxivs from orders""",
    "source_cascade": """with s as (select c_custkey as k, case when c_custkey % 2 > 0 then 'no_match' when c_custkey % 4 > 0 then 'no_value' else 'match' end as a, case when c_custkey % 3 = 0 then 'match' else 'no_match' end as b, case when c_custkey % 5 = 0 then 'match' else 'no_match' end as c from customer),
t as (select *, case when a = 'match' then 'crossref' when b = 'match' then 'openalex' when c = 'match' then 'semantic_scholar' end as source from s)
select k as c_custkey, source, case source when 'crossref' then 'crossref abstract ' when 'openalex' then 'openalex abstract ' when 'semantic_scholar' then 'semantic abstract ' end || k as abstract, coalesce(source || ':match', 'crossref:' || a) as status,
 'crossref:' || a || (case when a <> 'match' then ' openalex:' || b || (case when b <> 'match' then ' semantic_scholar:' || c else '' end) else '' end) as trace, case when k % 2 = 0 then '10.1/' || k when k % 5 = 0 then '10.2/' || k end as doi from t""",
    "first_accepted_try": """with l as (select l_orderkey as k, l_linenumber as n, max(l_returnflag) as flag, max(l_partkey) as part from lineitem group by 1, 2), f as (select k, min(n) filter (flag = 'R') as first from l group by 1)
select o_orderkey as l_orderkey, first as line, (select part from l where l.k = o_orderkey and l.n = first) as part, (select count(*) from l where l.k = o_orderkey and (first is null or l.n <= first)) as tries from orders left join f on f.k = o_orderkey""",
    "pool_fan_out": """with p(part) as (values ('metadata'), ('sources'), ('trace'), ('full'), ('log'))
select s_suppkey, part, case part when 'metadata' then '{"title":"' || s_name || '","abstract":null}' when 'sources' then '{"source":"manual","source_id":"local:' || s_suppkey || '"}' when 'trace' then '{"steps":["a","b"]}'
 when 'full' then '{"title":"' || s_name || '","source":"manual","source_id":"local:' || s_suppkey || '"}' else '{"source_id":"local:' || s_suppkey || '"}' end as payload from supplier, p""",
    "routing_flags": "select p_partkey, p_size % 2 = 0 or p_size % 5 = 0 as arxiv, p_partkey % 3 < 2 as pdf, p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 49) as included from part",
    "pool_log_summary": """select case when l_suppkey % 2 = 0 then 'arxiv' else 'non_arxiv_manual' end as source_type, count(*) as n_rows, count(*) filter (l_partkey % 4 < 2 and l_orderkey % 4 < 2) as n_success, count(*) filter (l_partkey % 4 = 0) as n_copied_metadata,
 count(*) filter (l_orderkey % 4 = 0) as n_copied_pdf, count(*) filter (l_partkey % 4 = 2 or l_orderkey % 4 = 2) as n_failed from lineitem group by 1""",
    "pool_failure_reasons": "select case when l_linenumber % 3 > 0 then 'reason ' || l_linenumber else 'unspecified_failure' end as reason, count(*) as n from lineitem where l_partkey % 4 = 2 or l_orderkey % 4 = 2 group by 1",
    "metadata_containment": """select p_partkey, case when p_partkey % 7 = 0 then 'missing_page' when p_partkey % 11 = 0 then 'missing_title' when p_partkey % 13 = 0 then 'missing_abstract' when p_partkey % 17 = 0 then 'unreadable'
 when p_partkey % 3 > 0 and p_partkey % 5 > 0 then 'pass' when p_partkey % 3 = 0 and p_partkey % 5 = 0 then 'both_mismatch' when p_partkey % 3 = 0 then 'title_mismatch' else 'abstract_mismatch' end as status from part""",
    "metadata_alignment": f"with {_ALIGNED} select *, {_REASON} as reason from a",
    "alignment_pass_rates": f"""with {_ALIGNED}, w as (select *, {_REASON} as reason from a), g as (select turn, reason, count(*) as n, min(conv_id) as first from w group by 1, 2),
t as (select turn, string_agg(reason || ':' || n, ' | ' order by n desc, first) as reason_top3 from (select *, row_number() over (partition by turn order by n desc, first) as r from g) where r <= 3 group by 1)
select turn, any_value(reason_top3) as reason_top3, count(*) filter (status <> 'pass_strict') as n_non_pass, count(*) as n_rows, count(*) filter (status = 'pass_strict') as n_pass, count(*) filter (status like 'fail%' or status like 'orphan%') as n_fail,
 count(*) filter (status like 'uncertain%') as n_uncertain, round(count(*) filter (status = 'pass_strict') / count(*), 6) as pass_rate from a join t using (turn) group by 1""",
    "export_alignment": """with e as (select l_orderkey as k from lineitem where l_linenumber <= 2), w as (select o_orderkey as k from orders where o_orderkey % 2 = 0),
a as (select case when k in (select k from w) then 'matched' else 'extra' end as status, k from e union all select 'missing', k from w where k not in (select k from e)) select status, count(*) as n, count(distinct k) as n_keys from a group by 1""",
}
