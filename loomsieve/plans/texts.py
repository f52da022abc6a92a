"""Texts, pages and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.functions import text, verdicts
from loomsieve.operators import dedupe, evaluate, passages, route, synthesize
from loomsieve.tables import table


def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("{"), "p_name", F.lit(r" \& \emph{"), "p_brand", F.lit("} ~ "), "p_type", F.lit(" 50\\%}"))
    return p.select("p_partkey", text.normalized_title(raw).alias("title"), text.key_slug(raw).alias("slug"))


def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.head_tail(F.col("text"), 600, 300)).alias("digest"), F.length(text.head_tail(F.col("text"), 600, 300)).cast("long").alias("n"))


def reference_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a references heading put after every third one's first line."""
    line = F.regexp_extract("text", r"^([^\n]*)", 1)
    d = table(spark, sf_dir, "documents").withColumn("full", F.when(F.col("doc_id") % 3 == 0, F.concat(line, F.lit("\n  References:\n"), "text")).otherwise(F.col("text")))
    cut = text.before_references(F.col("full"))
    return d.select("doc_id", F.length("full").cast("long").alias("total_chars"), F.length(cut).cast("long").alias("kept_chars"), F.md5(cut).alias("digest"))


def context_window_pm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that holds a digit with the non-blank lines up to two before and after it."""
    out = passages.with_context(table(spark, sf_dir, "documents"), "doc_id", "text", 2)
    return out.filter(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", F.md5("context").alias("digest"))


def keyword_score_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best lines of each text by weighted cues."""
    cues = {"licen[sc]e|copyright": 5, "@[a-z]": 4, "[0-9]": 2, "password|token|key": 3, "[|]": -1}
    scored = passages.scored_lines(table(spark, sf_dir, "documents"), "doc_id", "text", cues)
    return evaluate.top_per_group(scored.filter("score >= 2"), ["doc_id"], [F.desc("score"), F.asc("line_no")], 5).select("doc_id", "line_no", "score", "rank")


def diversified_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five lines of each text: the best of each cue first, then the best others, none within three lines."""
    cues = {"licen[sc]e|copyright": 5, "@[a-z]": 4, "[0-9]": 2, "password|token|key": 3}
    return passages.diversified(table(spark, sf_dir, "documents"), "doc_id", "text", cues, 5)


def html_title_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and first long paragraph of pages."""
    p = table(spark, sf_dir, "pages")
    title = text.first_match(F.col("html"), [r"(?is)<meta[^>]+citation_title[^>]+content=\"([^\"]+)\"", r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"])
    body = text.first_match(F.col("html"), [r"(?is)<meta[^>]+description[^>]+content=\"([^\"]{30,})\"", r"(?is)<p[^>]*>([^<]{30,})"])
    return p.select("page_id", text.stripped_tags(title).alias("title"), F.md5(text.squeeze(body)).alias("digest"))


def url_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several addresses to try for each page, in order and without repeats."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "[?#].*$", "")
    tries = F.array_distinct(F.array(F.col("url"), bare, F.concat(F.regexp_replace(bare, "/$", ""), F.lit(".pdf")), F.regexp_replace(bare, "^http:", "https:")))
    return p.select("page_id", F.posexplode(tries).alias("pos", "address"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    out = text.filled("Title: {{TITLE}}\nBy {{BRAND}}, {{SIZE}} cm ({{NOTE}})", {"TITLE": F.col("p_name"), "BRAND": F.col("p_brand"), "SIZE": F.col("p_size")})
    return p.select("p_partkey", out.alias("prompt"), F.array_join(text.missing_placeholders(out), ",").alias("missing"))


def identifier_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs and archive ids from notes written around part numbers."""
    p = table(spark, sf_dir, "part")
    note = F.concat(F.lit("See https://doi.org/10.1000/ABC."), "p_partkey", F.lit("; arXiv:2101."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("v2, "), "p_name", F.lit(" 2019, 1998."))
    plain = F.when(F.col("p_partkey") % 4 != 0, note).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.doi(plain).alias("doi"), text.arxiv_id(plain).alias("arxiv"), text.last_year(plain).alias("year"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-set similarity of each part's name to its type and to its successor's name."""
    p = table(spark, sf_dir, "part").select("p_partkey", text.tokens(F.col("p_name")).alias("a"), text.tokens(F.concat_ws(" ", "p_type", "p_name")).alias("b"))
    return p.select("p_partkey", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"), text.tokens_agree(F.col("a"), F.col("b")).alias("agree"))


def risk_classifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of texts by rules, and the first of them in order of precedence."""
    flags = {"secret": r"(?i)(password|token|api[_-]?key)\s*[=:]", "license": r"(?i)licensed under|copyright", "contact": "@[a-z0-9]+[.]", "table": "[|] ", "number": "[0-9]{4}"}
    d = table(spark, sf_dir, "documents")
    tests = {n: F.col("text").rlike(p) for n, p in flags.items()}
    return route.first_state(d.select("doc_id", *(t.alias(n) for n, t in tests.items())), [(n, F.col(n)) for n in flags], "clean", "verdict")


def manifest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest texts of each source that have a language, with their place."""
    d = table(spark, sf_dir, "documents").filter("lang is not null and length(trim(text)) > 0").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return evaluate.top_per_group(d, ["source"], [F.desc("n"), F.asc("doc_id")], 10)


def blank_line_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.collapsed_blank_lines(F.regexp_replace("text", r"\. ", ".  \r\n\r\n\r\n"))).alias("digest"))


def inverted_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles taken apart into word positions and put together again."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    index = p.groupBy("p_partkey", "word").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    maps = index.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return maps.select("p_partkey", text.from_inverted_index(F.col("index")).alias("title"))


def qa_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of conversations merged by field: state, distinct quotes, sources in order."""
    c = table(spark, sf_dir, "conversations")
    answers = c.select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("q"), (F.col("turn") % 3).cast("string")).alias("qid"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("topic"), F.col("role"))).otherwise(F.array().cast("array<string>")).alias("fields"), F.element_at(F.array(F.lit("present"), F.lit("absent"), F.lit("unclear")), (F.length("text") % 3 + 1).cast("int")).alias("state"), F.array(F.substring("text", 1, 5)).alias("quotes"))
    out = synthesize.by_field(answers, ["conv_id"])
    return out.select("conv_id", "field", "state", F.array_join("quotes", "|").alias("quotes"), F.array_join("qids", ",").alias("qids"), "n_answers")


def violations_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rules = {"value_range": F.col("value").between(1, 95), "known_type": F.col("event_type").isin("view", "signup", "purchase", "click"), "props": F.get_json_object("props", "$.k").isNotNull(), "user": F.col("user_id") % 17 != 0}
    bad = route.quarantine(e, rules)[1]
    return bad.select("event_id", F.array_join("violations", ",").alias("violations"))


def nested_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from JSON text with fallbacks."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"))
    return e.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in order of first appearance."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    out = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return out.select("user_id", F.array_join(F.transform("x", lambda s: s["event_type"]), ">").alias("path"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("digest"), F.round(text.printable_share(F.col("text")), 6).alias("printable"))


QUERIES = {f.__name__: f for f in (
    normalize_title, head_tail_truncate, reference_cut, context_window_pm2, keyword_score_top5, diversified_passages, html_title_abstract, url_expand, template_render, identifier_extraction,
    token_jaccard, risk_classifier_flags, manifest_topk, blank_line_collapse, inverted_index_text, qa_synthesis, violations_quarantine, nested_extraction, ordered_distinct, content_hashes)}

_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)"
_SCORE = r"(case when regexp_matches(line, '(?i)licen[sc]e|copyright') then 5 else 0 end + case when regexp_matches(line, '(?i)@[a-z]') then 4 else 0 end + case when regexp_matches(line, '(?i)[0-9]') then 2 else 0 end + case when regexp_matches(line, '(?i)password|token|key') then 3 else 0 end + case when regexp_matches(line, '(?i)[|]') then -1 else 0 end)"
_TITLE = r"'{' || p_name || ' \& \emph{' || p_brand || '} ~ ' || p_type || ' 50\%}'"
ORACLE = {
    "normalize_title": rf"""select p_partkey, trim(regexp_replace(lower(p_name || ' and  ' || p_brand || '   ' || p_type || ' 50 percent '), '[^a-z0-9]+', ' ', 'g')) as title,
regexp_replace(regexp_replace(lower({_TITLE}), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from part""",
    "head_tail_truncate": r"with t as (select doc_id, case when length(text) > 900 then left(text, 600) || chr(10) || '...' || chr(10) || right(text, 300) else text end as x from documents) select doc_id, md5(x) as digest, length(x)::bigint as n from t",
    "reference_cut": r"""with t as (select doc_id, string_split(text, chr(10))[1] as l, text from documents), f as (select doc_id, case when doc_id % 3 = 0 then l || chr(10) || '  References:' || chr(10) || text else text end as f, case when doc_id % 3 = 0 then l || chr(10) else text end as c from t)
select doc_id, length(f)::bigint as total_chars, length(c)::bigint as kept_chars, md5(c) as digest from f""",
    "context_window_pm2": f"with w as (select doc_id, line_no, line, string_agg(case when trim(line) <> '' then line end, chr(10)) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as c from {_LINES}) select doc_id, line_no::int as line_no, md5(coalesce(c, '')) as digest from w where regexp_matches(line, '[0-9]')",
    "keyword_score_top5": f"with s as (select doc_id, line_no, {_SCORE}::int as score from {_LINES}), r as (select *, row_number() over (partition by doc_id order by score desc, line_no)::int as rank from s where score >= 2) select doc_id, line_no::int as line_no, score, rank from r where rank <= 5",
    "html_title_abstract": r"""with t as (select page_id, coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '')) as t, nullif(regexp_extract(html, '(?is)<p[^>]*>([^<]{30,})', 1), '') as b from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as title, md5(trim(regexp_replace(b, '\s+', ' ', 'g'))) as digest from t""",
    "url_expand": r"""with b as (select page_id, url, regexp_replace(url, '[?#].*$', '') as b from pages), l as (select page_id, unnest([url, b, regexp_replace(b, '/$', '') || '.pdf', regexp_replace(b, '^http:', 'https:')]) as address, unnest([1, 2, 3, 4]) as p from b),
d as (select page_id, address, min(p) as p from l group by 1, 2) select page_id, (row_number() over (partition by page_id order by p) - 1)::int as pos, address from d""",
    "template_render": "select p_partkey, 'Title: ' || p_name || chr(10) || 'By ' || p_brand || ', ' || p_size || ' cm ({{NOTE}})' as prompt, 'NOTE' as missing from part",
    "identifier_extraction": "select p_partkey, case when p_partkey % 4 <> 0 then '10.1000/abc.' || p_partkey end as doi, case when p_partkey % 4 <> 0 then '2101.' || lpad((p_partkey % 100000)::varchar, 5, '0') end as arxiv, case when p_partkey % 4 <> 0 then 1998 else try_cast(list_last(regexp_extract_all(p_name, '(?:19|20)[0-9][0-9]')) as int) end as year from part",
    "token_jaccard": r"""with t as (select p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity, len(a) < 3 or len(list_intersect(a, b)) >= 2 as agree from t""",
    "risk_classifier_flags": r"""with f as (select doc_id, regexp_matches(text, '(?i)(password|token|api[_-]?key)\s*[=:]') as secret, regexp_matches(text, '(?i)licensed under|copyright') as license, regexp_matches(text, '@[a-z0-9]+[.]') as contact, regexp_matches(text, '[|] ') as "table", regexp_matches(text, '[0-9]{4}') as number from documents)
select *, case when secret then 'secret' when license then 'license' when contact then 'contact' when "table" then 'table' when number then 'number' else 'clean' end as verdict from f""",
    "manifest_topk": "select * from (select source, doc_id, length(text)::bigint as n, row_number() over (partition by source order by length(text) desc, doc_id)::int as rank from documents where lang is not null and length(trim(text)) > 0) where rank <= 10",
    "blank_line_collapse": r"select doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, '. ', '.' || '  ' || chr(10) || chr(10) || chr(10)), chr(13), ''), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as digest from documents",
    "inverted_index_text": "select p_partkey, p_name as title from part",
    "qa_synthesis": r"""with a as (select conv_id, turn as pos, 'q' || (turn % 3) as qid, case when turn % 2 = 0 then ['topic', role] else ['q' || (turn % 3)] end as fs, ['present', 'absent', 'unclear'][length(text) % 3 + 1] as state, left(text, 5) as quote from conversations),
e as (select conv_id, pos, qid, unnest(fs) as field, state, quote from a), q as (select conv_id, field, quote, min(pos) as p from e group by 1, 2, 3), i as (select conv_id, field, qid, min(pos) as p from e group by 1, 2, 3),
qs as (select conv_id, field, string_agg(quote, '|' order by p, quote) as quotes from q group by 1, 2), qi as (select conv_id, field, string_agg(qid, ',' order by p, qid) as qids from i group by 1, 2),
s as (select conv_id, field, case when bool_or(state = 'present') and bool_or(state = 'absent') then 'mixed' when bool_or(state = 'present') then 'present' when bool_or(state = 'absent') then 'absent' else 'insufficient' end as state, count(*) as n_answers from e group by 1, 2)
select * from s join qs using (conv_id, field) join qi using (conv_id, field)""",
    "violations_quarantine": """with v as (select event_id, concat_ws(',', case when not coalesce(value between 1 and 95, false) then 'value_range' end, case when event_type not in ('view', 'signup', 'purchase', 'click') then 'known_type' end, case when json_extract_string(props, '$.k') is null then 'props' end, case when user_id % 17 = 0 then 'user' end) as violations from events) select * from v where violations <> ''""",
    "nested_extraction": "select event_type, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) as k, count(*) as n from events group by 1, 2",
    "ordered_distinct": "with f as (select user_id, event_type, min((ts, event_id)) as first from events group by 1, 2) select user_id, string_agg(event_type, '>' order by first) as path from f group by 1",
    "content_hashes": r"select item_id, sha256(text) as digest, round(length(regexp_replace(text, '[\x00-\x1f]', '', 'g')) / length(text), 6) as printable from benchmark",
}
