"""Candidates of a pool against records: work lists, verification, fallbacks over sources, routing, alignment with pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.functions import alignment, records, text


def work_list(pool: DataFrame) -> DataFrame:
    """Normalized columns of a pool (record_index, source_file, key, title, year, authors, doi, url, eprint)."""
    title = text.squeeze(F.col("title"))
    return pool.select(
        "record_index", records.emitted_key(F.col("source_file"), F.col("key")).alias("emitted_key"), text.squeeze(F.col("key")).alias("pool_key"), title.alias("pool_title"),
        text.normalized_title(title).alias("pool_norm"), records.year_of(F.col("year")).alias("pool_year"), records.first_surname(F.col("authors")).alias("pool_author"),
        records.doi_of(F.col("doi")).alias("pool_doi"), records.arxiv_of(F.col("eprint"), F.col("url")).alias("pool_arxiv"), records.filled(F.col("url")).alias("pool_url"))


@dataclass(frozen=True)
class Rules:
    """How far a record may differ from its candidate."""

    least: float = 0.88  # overlap of title words, where titles aren't equal
    year_needed: bool = False  # a record without a year fails
    author_needed: bool = False
    ids_over_year: bool = False  # years may differ where identifiers agree, or the candidate has none
    aliased: float = 0.8  # overlap that is enough for a record that was named by hand, where year and author agree


def identifiers_agree(dois: Column, arxivs: Column) -> Column:
    """struct(matched, has_ids, note): whether a work list row's identifiers are among a record's; a row without any
    identifier or address matches."""
    doi, arxiv, url = (F.col(c) for c in ("pool_doi", "pool_arxiv", "pool_url"))
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    own = F.concat_ws(", ", F.concat(F.lit("doi="), doi), F.concat(F.lit("arxiv="), arxiv), F.concat(F.lit("url="), url))
    held = lambda value, among: F.coalesce(F.array_contains(F.coalesce(among, F.array().cast("array<string>")), value), F.lit(False))
    matched = held(doi, dois) | held(arxiv, arxivs) | (own == "")
    listed = lambda c: none(F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "))
    note = F.concat(F.lit("pool_identifiers="), none(own), F.lit("; main_identifiers="), listed(dois), F.lit("; main_arxiv="), listed(arxivs))
    return F.struct(matched.alias("matched"), (doi.isNotNull() | arxiv.isNotNull()).alias("has_ids"), note.alias("note"))


def match_records(items: DataFrame, index: DataFrame, aliases: DataFrame | None = None, count_entries: bool = False) -> DataFrame:
    """Work list rows with the record that they stand for (``key``) and how it was found (``matched_by``): by an alias
    (record_index, key) that names a record, else by the DOI, the arXiv identifier or the normalized title that one record has.

    ``index`` has a row (key, kind, value) for each identifier or title (kinds doi, arxiv, title) of each record; rows may
    repeat. A value that several records have finds none, and the next kind is tried; with ``count_entries`` one that the
    same record states twice finds none either, as where its entry and its source both have it.
    """
    known = index.select("key").distinct()
    out = items
    if aliases is not None:
        named = aliases.select("record_index", F.col("key").alias("__alias")).join(known.withColumnRenamed("key", "__alias"), "__alias", "left_semi")
        out = out.join(named, "record_index", "left")
    else:
        out = out.withColumn("__alias", F.lit(None).cast(index.schema["key"].dataType))
    single = (F.count("*") if count_entries else F.count_distinct("key")) == 1
    found = index.filter(F.coalesce("value", F.lit("")) != "").groupBy("kind", "value").agg(F.min("key").alias("key"), single.alias("single")).filter("single").drop("single")
    for kind, column in (("doi", "pool_doi"), ("arxiv", "pool_arxiv"), ("title", "pool_norm")):
        side = found.filter(F.col("kind") == kind).select(F.col("value").alias(f"__v_{kind}"), F.col("key").alias(f"__{kind}"))
        out = out.join(side, F.col(column) == F.col(f"__v_{kind}"), "left").drop(f"__v_{kind}")
    ways = {"__alias": "manual_alias", "__doi": "doi", "__arxiv": "arxiv_id", "__title": "normalized_title"}
    by = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in ways.items()))
    return out.withColumns({"key": F.coalesce(*ways), "matched_by": by}).drop(*ways)


def verify(rows: DataFrame, title: Column, year: Column, author: Column, ids: Column, rules: Rules = Rules(), alias: Column | None = None) -> DataFrame:
    """Work list rows with a record's title, year and first surname, and identifiers as above: adds struct ``check`` (title_ok,
    overlap, year_ok, author_ok, ids_ok, ok, override, note). ``alias`` says which rows were named by hand: those pass where year
    and author agree and the titles overlap enough (``override``, if nothing else lets them pass)."""
    rows = rows.withColumns({"__norm": text.normalized_title(title), "__year": year, "__author": author, "__ids": ids})
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    same = F.col("pool_norm") == F.col("__norm")
    overlap = F.when(same | (F.col("pool_norm") == "") | (F.col("__norm") == ""), F.lit(0.0)).otherwise(text.jaccard(F.array_distinct(words("pool_norm")), F.array_distinct(words("__norm"))))
    rows = rows.withColumn("__overlap", overlap)
    agree = lambda own, other, needed: F.col(own).isNull() | (F.lit(False) if needed else F.col(other).isNull()) | F.coalesce(F.col(own) == F.col(other), F.lit(False))
    rows = rows.withColumns({
        "__title_ok": same | (F.col("__overlap") >= rules.least), "__year_ok": agree("pool_year", "__year", rules.year_needed), "__author_ok": agree("pool_author", "__author", rules.author_needed)})
    ids_ok = F.col("__ids.matched")
    third = F.col("__year_ok") | ids_ok | ~F.col("__ids.has_ids") if rules.ids_over_year else F.col("__year_ok") & (ids_ok | ~F.col("__ids.has_ids"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("n/a"))
    note = F.concat(
        F.lit("title_ok="), F.col("__title_ok"), F.lit("; title_overlap="), F.format_string("%.3f", "__overlap"), F.lit("; pool_year="), shown("pool_year"), F.lit("; main_year="), shown("__year"),
        F.lit("; pool_first_author="), shown("pool_author"), F.lit("; main_first_author="), shown("__author"), F.lit("; "), F.col("__ids.note"))
    ok = F.col("__title_ok") & F.col("__author_ok") & third
    override = F.lit(False) if alias is None else ~ok & F.coalesce(alias, F.lit(False)) & F.col("__author_ok") & F.col("__year_ok") & (F.col("__title_ok") | (F.col("__overlap") >= rules.aliased))
    check = F.struct(
        F.col("__title_ok").alias("title_ok"), F.col("__overlap").alias("overlap"), F.col("__year_ok").alias("year_ok"), F.col("__author_ok").alias("author_ok"), ids_ok.alias("ids_ok"),
        (ok | override).alias("ok"), override.alias("override"), note.alias("note"))
    return rows.withColumn("check", check).drop("__norm", "__year", "__author", "__ids", "__overlap", "__title_ok", "__year_ok", "__author_ok")


def first_accepted(items: DataFrame, tries: DataFrame, key: str, order: str, accepted: Column) -> DataFrame:
    """Every item with its first accepted try as struct ``hit`` and the number of tries made up to it (all, where none is
    accepted). An aggregate by key, so that many tries of one item shrink before the shuffle."""
    row = F.struct(*(c for c in tries.columns if c != key))
    good = F.coalesce(accepted, F.lit(False))
    found = tries.groupBy(key).agg(F.min_by(F.when(good, row), F.when(good, F.col(order))).alias("hit"), F.min(F.when(good, F.col(order))).alias("__first"), F.array_agg(order).alias("__orders"))
    out = items.join(found, key, "left")
    made = F.coalesce(F.size(F.filter("__orders", lambda o: F.col("__first").isNull() | (o <= F.col("__first")))), F.lit(0))
    return out.withColumn("tries", made).drop("__first", "__orders")


def fetched(items: DataFrame, sources: dict[str, DataFrame], key: str, value: str, hints: tuple[str, ...] = ()) -> DataFrame:
    """Items with the first source's answer, in the order given: adds ``source``, ``value``, ``status`` (of the first source
    that was asked in vain, where none answers) and the ``trace`` of all that were asked.

    A source table has the key, the value (null: known there, but without one) and any of the hint columns, which are kept
    from whatever source has them first.
    """
    out = items
    for name, answers in sources.items():
        kept = [F.col(c).alias(f"__{name}_{c}") for c in hints if c in answers.columns]
        out = out.join(answers.select(F.col(key), F.lit(True).alias(f"__{name}_known"), F.col(value).alias(f"__{name}_value"), *kept), key, "left")
    states = {n: F.when(F.col(f"__{n}_value").isNotNull(), "match").when(F.col(f"__{n}_known"), "no_value").otherwise("no_match") for n in sources}
    names = list(sources)
    asked = [F.lit(True) if not i else F.coalesce(*(F.col(f"__{n}_value") for n in names[:i])).isNull() for i in range(len(names))]
    trace = F.array_compact(F.array(*(F.when(a, F.concat(F.lit(f"{n}:"), states[n])) for n, a in zip(names, asked, strict=True))))
    got = F.coalesce(*(F.col(f"__{n}_value") for n in names))
    source = F.coalesce(*(F.when(F.col(f"__{n}_value").isNotNull(), F.lit(n)) for n in names))
    status = F.when(source.isNotNull(), F.concat(source, F.lit(":match"))).otherwise(F.get(trace, F.lit(0)))
    hint = {c: F.coalesce(*(F.col(f"__{n}_{c}") for n, a in sources.items() if c in a.columns)) for c in hints}
    return out.withColumns({"source": source, "value": got, "status": status, "trace": trace, **hint}).drop(*(c for c in out.columns if c.startswith("__")))


def ordered_attempts(items: DataFrame, tries: DataFrame, key: str, order: str, value: str, stop_at: str | None = ":match") -> DataFrame:
    """Every item with the outcome of its ordered tries (``value``: null where a try found nothing; ``status``): adds ``winner``,
    ``status``, ``trace`` (the statuses of the tries made) and ``n_tries``.

    A fold over an item's tries, which are the few identifiers that a record states. With ``stop_at`` tries end at the first
    status that ends so, and every try before it replaces what an earlier one found, be it by nothing; that is how attempts
    whose successes are called otherwise go on and lose them. Without it the first value found ends them.
    """
    one = F.struct(F.col(order).alias("o"), F.col(value).alias("value"), F.col("status").alias("status"))
    found = tries.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("__tries"))
    kind = tries.schema[value].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("status"), F.array().cast("array<string>").alias("trace"), F.lit(False).alias("done"))

    def step(state: Column, x: Column) -> Column:
        done = F.coalesce(x["status"].endswith(stop_at), F.lit(False)) if stop_at is not None else x["value"].isNotNull()
        after = F.struct(x["value"].alias("value"), x["status"].alias("status"), F.concat(state["trace"], F.array(x["status"])).alias("trace"), done.alias("done"))
        return F.when(state["done"], state).otherwise(after)

    out = items.join(found, key, "left").withColumn("__s", F.aggregate(F.coalesce("__tries", F.array().cast(f"array<struct<o:{tries.schema[order].dataType.simpleString()},value:{kind},status:string>>")), start, step))
    return out.select(*items.columns, F.col("__s.value").alias("winner"), F.col("__s.status").alias("status"), F.col("__s.trace").alias("trace"), F.size("__s.trace").alias("n_tries"))


def fan_out(rows: DataFrame, key: str, parts: dict[str, list[str]]) -> DataFrame:
    """Each row as one row per part: (key, part, payload), the payload being the part's columns as JSON."""
    each = F.array(*(F.struct(F.lit(name).alias("part"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload")) for name, columns in parts.items()))
    return rows.select(key, F.explode(each).alias("p")).select(key, "p.*")


def is_arxiv_item(family: Column, segment: Column) -> Column:
    return F.coalesce(family == "arxiv", F.lit(False)) | F.coalesce(segment == "arxiv_clip", F.lit(False))


def has_pdf_address(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.endswith(".pdf") | low.contains("/pdf")


def labelled(rows: DataFrame, key: str, true_keys: DataFrame, true_key: str, out: str) -> DataFrame:
    """Whether a row's key is among the true ones; rows without a key aren't."""
    known = true_keys.select(F.col(true_key).alias("__k")).dropna().distinct().withColumn("__hit", F.lit(True))
    return rows.join(known, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def pool_summary(log: DataFrame) -> DataFrame:
    """Per source type: rows, successes (both actions done), copies, failed rows; in one aggregate."""
    done = lambda c: F.col(c).isin("copied", "downloaded")
    failed = (F.col("metadata_action") == "failed") | (F.col("pdf_action") == "failed")
    return log.groupBy("source_type").agg(
        F.count("*").alias("n_rows"), F.count_if(done("metadata_action") & done("pdf_action")).alias("n_success"), F.count_if(F.col("metadata_action") == "copied").alias("n_copied_metadata"),
        F.count_if(F.col("pdf_action") == "copied").alias("n_copied_pdf"), F.count_if(failed).alias("n_failed"))


def failure_reasons(log: DataFrame) -> DataFrame:
    failed = log.filter((F.col("metadata_action") == "failed") | (F.col("pdf_action") == "failed"))
    return failed.groupBy(records.first_filled(F.col("status_reason"), F.lit("unspecified_failure")).alias("reason")).agg(F.count("*").alias("n"))


def aligned(metadata: DataFrame, pages: DataFrame, keys: list[str], least: float = 0.9, prefix: int = 220, readable: int = 120) -> DataFrame:
    """Full outer alignment of metadata (title, abstract) with what was read from pages (page_title, page_abstract; readable,
    false where it couldn't be opened; page_text, what its front says, where there is such a column): ``status``, ``reason`` and
    the ``similarity`` of the abstracts.

    A page passes where its title is equal but for case, spaces and compatibility forms, and it holds the beginning of the
    abstract and is similar enough. One whose abstract (or front, where it has none) is shorter than ``readable`` letters, or
    mostly unprintable, is uncertain.
    """
    m = metadata.select(*keys, F.lit(True).alias("__m"), "title", "abstract")
    front = F.col("page_text") if "page_text" in pages.columns else F.lit(None).cast("string")
    p = pages.select(*keys, F.lit(True).alias("__p"), "page_title", "page_abstract", "readable", front.alias("__front"))
    both = m.join(p, keys, "full_outer").withColumn("__probe", F.coalesce(F.nullif(F.col("page_abstract"), F.lit("")), "__front", F.lit("")))
    poor = (F.length(F.regexp_replace("__probe", r"(?U)^\s+|\s+$", "")) < readable) | (F.coalesce(text.printable_share(F.col("__probe")), F.lit(0.0)) < 0.75)
    early = (
        F.when(F.col("__m").isNull(), "orphan_page").when(F.col("__p").isNull(), "orphan_metadata")
        .when(records.filled(F.col("title")).isNull(), "fail_missing_title").when(records.filled(F.col("abstract")).isNull(), "fail_missing_abstract")
        .when(~F.coalesce("readable", F.lit(True)), "fail_unreadable").when(poor, "uncertain_extraction"))
    both = both.withColumn("__early", early)
    # Only texts that are open still are compared.
    open_ = lambda c: F.when(F.col("__early").isNull(), F.col(c))
    both = both.withColumn("__c", alignment.compared(prefix)(open_("title"), open_("abstract"), open_("page_title"), open_("page_abstract")))
    alike, near = F.col("__c.prefix"), F.col("__c.similarity") >= least
    late = F.when(~F.col("__c.title"), "fail_title_mismatch").when(~alike | ~near, "fail_abstract_mismatch").otherwise("pass_strict")
    both = both.withColumns({"status": F.coalesce("__early", late), "similarity": F.round(F.coalesce("__c.similarity", F.lit(0.0)), 6)})
    far = F.concat(F.lit("abstract_prefix_exact="), F.initcap(alike.cast("string")), F.lit(";abstract_similarity="), F.format_string("%.4f", F.col("__c.similarity")), F.lit(f"<threshold={least:.2f}"))
    known = {
        "orphan_page": "no_metadata_key_match", "orphan_metadata": "no_page_for_metadata_key", "fail_missing_title": "missing_metadata_title", "fail_missing_abstract": "missing_metadata_abstract",
        "fail_unreadable": "page_open_error", "uncertain_extraction": "low_text_quality_or_short_extraction", "fail_title_mismatch": "title_norm_not_exact", "pass_strict": "strict_three_layer_pass"}
    reason = F.coalesce(*(F.when(F.col("status") == s, r) for s, r in known.items()), F.when(near, "abstract_prefix_not_found").otherwise(far))
    return both.withColumn("reason", reason).drop("__m", "__p", "__early", "__front", "__probe", "__c")


def contained(metadata: DataFrame, pages: DataFrame, keys: list[str], prefix: int = 220) -> DataFrame:
    """Metadata with the status of their titles' and abstracts' first letters in the text of their pages (page_text), equal but
    for case, spaces and compatibility forms."""
    p = pages.select(*keys, F.lit(True).alias("__p"), "page_text")
    out = metadata.join(p, keys, "left")
    plain = alignment.compatible_text()
    out = out.withColumns({"__text": plain("page_text"), "__title": plain("title"), "__abstract": F.substring(plain("abstract"), 1, prefix)})
    title_hit = F.contains(F.col("__text"), F.col("__title"))
    abstract_hit = (F.col("__abstract") != "") & F.contains(F.col("__text"), F.col("__abstract"))
    status = (
        F.when(F.col("__p").isNull(), "missing_page").when(records.filled(F.col("title")).isNull(), "missing_title").when(records.filled(F.col("abstract")).isNull(), "missing_abstract")
        .when(F.col("page_text").isNull(), "unreadable").when(title_hit & abstract_hit, "pass").when(~title_hit & ~abstract_hit, "both_mismatch")
        .when(~title_hit, "title_mismatch").otherwise("abstract_mismatch"))
    return out.withColumn("status", status).drop("__p", "__text", "__title", "__abstract")


def alignment_summary(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Per group: rows, passes, rows that don't pass, failures (with orphans), uncertain ones, the share of passes, and the three
    most frequent reasons (of equal ones that of the least key)."""
    s = F.col("status")
    per = rows.groupBy(by, "reason").agg(
        F.count("*").alias("n"), F.count_if(s == "pass_strict").alias("p"), F.count_if(s.startswith("fail_") | s.startswith("orphan_")).alias("f"), F.count_if(s.startswith("uncertain")).alias("u"), F.min(F.struct(*keys)).alias("first"))
    # A group has few kinds of reasons but for similarities, whose texts differ; only the first three are kept in order.
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first")))
    line = F.when(F.col("rank") <= 3, F.struct("rank", F.concat_ws(":", "reason", F.col("n").cast("string")).alias("t")))
    out = ranked.groupBy(by).agg(F.sum("n").alias("n_rows"), F.sum("p").alias("n_pass"), F.sum(F.col("n") - F.col("p")).alias("n_non_pass"), F.sum("f").alias("n_fail"), F.sum("u").alias("n_uncertain"), F.array_sort(F.collect_list(line)).alias("top"))
    return out.select(
        by, "n_rows", "n_pass", "n_non_pass", "n_fail", "n_uncertain", F.round(F.col("n_pass") / F.col("n_rows"), 6).alias("pass_rate"), F.array_join(F.transform("top", lambda x: x["t"]), " | ").alias("reason_top3"))


def export_report(exports: DataFrame, wanted: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per exported row (copies of a key are kept, numbered) and one per wanted key without any: matched, extra or
    missing."""
    known = wanted.select(key).distinct().withColumn("__w", F.lit(True))
    have = exports.select(key, pos).withColumn("__e", F.lit(True))
    out = have.join(known, key, "full_outer")
    status = F.when(F.col("__e").isNull(), "missing").when(F.col("__w").isNull(), "extra").otherwise("matched")
    return out.select(key, pos, status.alias("status"))
