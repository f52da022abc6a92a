"""Parsing of loosely structured inputs, over texts built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.functions import notes, text
from loomsieve.operators import link, passages
from loomsieve.sources import bibtex, documents
from loomsieve.tables import table


def note_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography notes written from parts, in four styles, parsed back."""
    p = table(spark, sf_dir, "part")
    num = F.col("p_partkey")
    title = F.concat(F.lit("The study of "), "p_name", F.lit(" number "), num.cast("string"))
    tail = F.concat(F.lit(". Journal of Things "), F.col("p_size").cast("string"), F.lit("("), (num % 9 + 1).cast("string"), F.lit("): "), (num % 90).cast("string"), F.lit("–"), (num % 90 + 9).cast("string"), F.lit(", "), (1990 + num % 30).cast("string"), F.lit("."))
    note = F.when(num % 4 == 0, F.concat(F.lit("Smith J., Doe A. and Roe B. "), title, tail)).when(num % 4 == 1, F.concat(F.lit("Smith et al. "), title, tail)).when(num % 4 == 2, F.concat(title, F.lit(" ("), (1990 + num % 30).cast("string"), F.lit("). https://x.org/a [online]")))
    out = p.select("p_partkey", notes.parsed(note).alias("n")).select("p_partkey", "n.*")
    c = notes.confidence(F.col("title"), F.col("author"), F.col("reason"), F.col("p_partkey") % 10 == 0)
    return out.select("p_partkey", "title", "reason", "volume", "number", "pages", "year", c["title"].alias("title_confidence"), c["author"].alias("author_confidence"), c["review"].alias("review"))


def latex_item_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an enumeration written from each nation's suppliers."""
    s = table(spark, sf_dir, "supplier")
    item = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('  \\item A. Author,\n "Work of '), "s_name", F.lit('", 2020.\n'))).otherwise(F.concat(F.lit("\\item Author list. On "), "s_name", F.lit(". May 2020.\n")))
    body = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("t")))), lambda x: x["t"]), "").alias("body"))
    tex = F.concat(F.lit("\\section{Intro}\n\\begin{enumerate}\n\\item no\n\\end{enumerate}\n\\section{ Included works }\ntext\n\\begin{enumerate}[a]\n"), "body", F.lit("\\end{enumerate}\n"))
    rows = passages.latex_items(body.select("s_nationkey", tex.alias("tex")), "s_nationkey", "tex", "Included works")
    t = passages.item_title(F.col("item"))
    return rows.select("s_nationkey", "item_no", t["title"].alias("title"), t["mode"].alias("mode"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta tags put into pages, read back as a map of lists; and the abstract chosen from them."""
    p = table(spark, sf_dir, "pages")
    head = F.concat(F.lit('<meta name="author" content="A &amp; B"><meta  name="author" content=" C  D ">'), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<META property="og:description" content="A description that is long enough, of page '), F.col("page_id").cast("string"), F.lit('">'))).otherwise(F.lit('<meta name="description" content="short"><div class="the abstract">From a marked &lt;element&gt; of the page</div>')))
    html = F.concat(head, F.lit("<p>rest</p>"))
    tags = text.meta_tags(html)
    return p.select("page_id", F.array_join(F.array_sort(F.map_keys(tags)), ",").alias("names"), F.array_join(tags["author"], "|").alias("authors"), text.page_abstract(html).alias("abstract"))


def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries serialized from parts and parsed again."""
    p = table(spark, sf_dir, "part")
    fields = F.create_map(F.lit("title"), F.col("p_name"), F.lit("publisher"), F.col("p_brand"), F.lit("year"), F.col("p_size").cast("string"), F.lit("note"), F.lit(" "))
    entry = bibtex.entry_text(F.lit("misc"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")), fields)
    return p.select(F.explode(bibtex.entries()(entry)).alias("e")).select("e.key", F.array_join(F.transform(F.array_sort(F.map_entries("e.fields")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("fields"))


def feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feeds of each nation's suppliers."""
    s = table(spark, sf_dir, "supplier")
    e = F.concat(F.lit("<entry><id>"), F.col("s_suppkey").cast("string"), F.lit("</id><title>Work of\n  "), "s_name", F.lit("</title><author><name>A"), F.col("s_suppkey").cast("string"), F.lit("</name></author><author><name>B</name></author><arxiv:doi>10.1/"), F.col("s_suppkey").cast("string"), F.lit("</arxiv:doi></entry>"))
    feeds = s.groupBy("s_nationkey").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'), F.array_join(F.array_sort(F.collect_list(e)), ""), F.lit("</feed>")).alias("xml"))
    rows = feeds.select("s_nationkey", F.explode(documents.feed_entries(F.col("xml"))).alias("e"))
    return rows.select("s_nationkey", F.col("e.id").cast("long").alias("id"), "e.title", "e.doi", F.col("e.summary").isNull().alias("no_summary"), F.array_join("e.authors", "+").alias("authors"))


def fuzzy_ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of benchmark items, spoiled a little, matched to all of them by longest matching blocks."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    spoiled = b.select(F.col("item_id").alias("left_id"), F.when(F.col("item_id") % 3 == 0, F.col("title")).when(F.col("item_id") % 3 == 1, F.concat(F.substring("title", 1, 40), F.lit("x"), F.expr("substring(title, 41)"))).otherwise(F.reverse("title")).alias("title"))
    out = link.best_ratio(spoiled, b, "left_id", "item_id", "title", by_word=False)
    return out.select("left_id", "item_id", F.round("score", 6).alias("score"), "confidence")


QUERIES = {f.__name__: f for f in (note_parse, latex_item_titles, page_meta, bibtex_round_trip, feed_parse, fuzzy_ratio_match)}
ORACLE = {
    "note_parse": """with p as (select p_partkey as k, regexp_replace('The study of ' || p_name || ' number ' || p_partkey, case when p_partkey % 4 < 2 then ' (19|20)[0-9][0-9]$' else '$^' end, '') as t, p_size, p_partkey % 4 as m from part)
select k as p_partkey, case when m = 3 then '' else t end as title, case m when 0 then 'from_after_authors' when 1 then 'from_after_authors' when 2 then 'from_first_segment' else 'missing_note' end as reason,
case when m < 2 then p_size::varchar else '' end as volume, case when m < 2 then (k % 9 + 1)::varchar else '' end as number, case when m < 2 then (k % 90) || '-' || (k % 90 + 9) else '' end as pages, case when m < 3 then (1990 + k % 30)::varchar else '' end as year,
(case when m = 3 then 0.0 when m < 2 then (case when k % 10 = 0 then 0.9 else 0.75 end) else 0.6 end)::double as title_confidence, (case when m > 1 then 0.2 when k % 10 = 0 then 0.85 else 0.55 end)::double as author_confidence, (m > 1 and k % 10 <> 0) or m = 3 as review from p""",
    "latex_item_titles": "select s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey)::int as item_no, case when s_suppkey % 2 = 0 then 'Work of ' || s_name else 'On ' || s_name end as title, case when s_suppkey % 2 = 0 then 'quoted' else 'unquoted' end as mode from supplier",
    "page_meta": "select page_id, case when page_id % 2 = 0 then 'author,og:description' else 'author,description' end as names, 'A & B|C D' as authors, case when page_id % 2 = 0 then 'A description that is long enough, of page ' || page_id else 'From a marked <element> of the page' end as abstract from pages",
    "bibtex_round_trip": "select 'k' || p_partkey as key, 'organization=' || p_brand || ';title=' || p_name || ';year=' || p_size as fields from part",
    "feed_parse": "select s_nationkey, s_suppkey as id, 'Work of ' || s_name as title, '10.1/' || s_suppkey as doi, true as no_summary, 'A' || s_suppkey || '+B' as authors from supplier",
}
