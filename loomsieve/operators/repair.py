"""Repair of candidate metadata: what is missing, how it was resolved, and its merge over the tables of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import dynamic, records, text


def _missing(present: Column, prefix: str = "__m_") -> Column:
    return records.is_missing(present, F.col(f"{prefix}source"), F.col(f"{prefix}match_status"))


def _with_metadata(wanted: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    m = metadata.select(*keys, F.lit(True).alias("__m"), F.col("source").alias("__m_source"), F.col("match_status").alias("__m_match_status"))
    return wanted.join(m, keys, "left").withColumn("__present", F.coalesce("__m", F.lit(False)))


def targets(oracle: DataFrame, metadata: DataFrame, keys: list[str], include_absent: bool = True) -> DataFrame:
    """Wanted records (query_title, raw) whose metadata is missing by its state, or absent altogether: with the reason, the
    query title from the raw entry where that has one, and that title cleaned."""
    rows = _with_metadata(oracle, metadata, keys).filter(_missing(F.col("__present")))
    rows = rows if include_absent else rows.filter("__present")
    raw = records.raw_title(F.col("raw"))
    reason = F.when(F.col("__present"), "metadata_missing_status").otherwise("metadata_key_absent")
    title = F.coalesce(raw, F.col("query_title"))
    cleaned = text.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\\[a-zA-Z]+\*?", ""), r'[{}\\"]', " "), r"[\s,]*(19|20)\d{2}\s*$", ""))
    return rows.select(
        *keys, reason.alias("reason"), F.col("query_title").alias("query_title_original"), F.coalesce(F.nullif(cleaned, F.lit("")), title).alias("query_title"),
        F.when(raw.isNotNull(), "raw_local").otherwise("original").alias("title_source"))


def validated(manifest: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """Every wanted key once, with ``state``: resolved, or missing."""
    rows = _with_metadata(manifest.select(*keys).dropna().distinct(), collected, keys)
    return rows.select(*keys, F.when(_missing(F.col("__present")), "missing").otherwise("resolved").alias("state"))


def validation_counts(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(F.count("*").alias("n_target"), F.count_if(F.col("state") == "resolved").alias("n_resolved"), F.count_if(F.col("state") == "missing").alias("n_missing"))


def resolved_keys(manifest: DataFrame, metadata: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Wanted keys with ``state`` (resolved, unresolved, incomplete) and the tables that lack them.

    A resolved one has sound metadata and is in every other table. Each table is reduced to its keys before it is joined.
    """
    rows = _with_metadata(manifest.select(*keys).distinct(), metadata, keys)
    for name, table in others.items():
        rows = rows.join(table.select(*keys).distinct().withColumn(f"__in_{name}", F.lit(True)), keys, "left")
    lacking = F.array_compact(F.array(*(F.when(F.col(f"__in_{n}").isNull(), F.lit(f"{n}_missing")) for n in others)))
    state = F.when(_missing(F.col("__present")), "unresolved").when(F.size(lacking) > 0, "incomplete").otherwise("resolved")
    return rows.select(*keys, state.alias("state"), F.when(state == "incomplete", F.array_join(lacking, ",")).alias("reason"))


def forced(metadata: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on a list of known bad keys; the list is reduced to distinct keys, so no row is repeated."""
    return metadata.join(denied.select(*keys).dropna().distinct(), keys, "left_semi")


def resolved_by_hand(metadata: DataFrame, context: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """Missing rows (or those that ``only`` names) filled from a context (title, source_id, year) and marked manual; what they
    have stays, as others do. Adds ``fixed``. Rows whose match is wrong are for ``forced_fix``."""
    c = context.select(*keys, *(F.col(n).alias(f"__c_{n}") for n in ("title", "source_id", "year")))
    rows = metadata.join(c, keys, "left")
    hit = F.coalesce(records.is_missing(F.lit(True), F.col("source"), F.col("match_status")) if only is None else only, F.lit(False))
    title = records.pick_title([F.col("query_title"), F.col("title"), F.col("__c_title")], F.col(keys[-1]).cast("string"))
    abstract = records.filled(F.col("abstract"))
    new = {
        "query_title": records.first_filled(F.col("query_title"), title), "title": title, "abstract": abstract, "source": F.lit("manual"),
        "source_id": F.coalesce(records.filled(F.col("__c_source_id")), F.concat(F.lit("local:"), F.col(keys[-1]).cast("string"))), "match_status": F.lit("exact_title"),
        "missing_reason": F.when(abstract.isNull(), "no_abstract_available"), "published_date": records.first_filled(F.col("published_date"), F.col("__c_year"))}
    rows = rows.withColumn("fixed", hit)
    return rows.withColumns({n: F.when(F.col("fixed"), v).otherwise(F.col(n)) for n, v in new.items() if n in metadata.columns}).select(*metadata.columns, "fixed")


def propagated(table: DataFrame, fixes: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of another table of the collection whose record was fixed, with new values (expressions over the fix's columns,
    as ``fix.title``, and the row's own)."""
    f = fixes.select(*keys, F.struct(*(c for c in fixes.columns if c not in keys)).alias("fix"))
    rows = table.join(f, keys, "left").withColumn("__hit", F.col("fix").isNotNull())
    return rows.withColumns({n: F.when(F.col("__hit"), v).otherwise(F.col(n)) for n, v in values.items()}).select(*table.columns)


def dated(metadata: DataFrame, full: DataFrame, context: DataFrame, keys: list[str], latest: int | None = None) -> DataFrame:
    """Published dates filled in or mended from the full record (``source_metadata``, a VARIANT: its first year), the month of an
    arXiv identifier and a context's year.

    A blank date takes, of an arXiv record its month, else the source's year, else the context's; of a zenodo record the
    context's first. A date that isn't a year, month or day up to ``latest`` (two years from now) is overwritten the same way,
    and so is one of another year: than an arXiv record's month, source or context, than a zenodo record's context, than
    another record's source. Adds ``date_action`` (none, backfill or overwrite) and ``source_year``, the year that an arXiv
    record's full metadata should say and doesn't.
    """
    top = F.year(F.current_date()) + 2 if latest is None else F.lit(latest)
    rows = metadata.join(full.select(*keys, F.col("source_metadata").alias("__full")), keys, "left").join(context.select(*keys, F.col("year").alias("__context")), keys, "left")
    source = F.lower(F.coalesce(records.filled(F.col("source")), F.lit("")))
    digits = F.regexp_extract(F.coalesce(F.col("source_id"), F.lit("")), r"(\d{4})\.\d{4,5}", 1)
    known = (source == "arxiv") & (digits != "") & F.substring(digits, 3, 2).try_cast("int").between(1, 12) & (F.substring(digits, 1, 2).try_cast("int") + 2000 <= top)
    month = F.when(known, F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2)))
    rows = rows.withColumns({"__source": source, "__date": records.filled(F.col("published_date")), "__month": month, "__told": records.filled(F.col("__context")), "__own": dynamic.first_year(F.col("__full"))})
    rows = rows.withColumns({"__own": F.coalesce("__own", F.substring("__month", 1, 4)), "__year": records.published_year(F.col("__date"), top)})
    arxiv, zenodo = F.col("__source") == "arxiv", F.col("__source") == "zenodo"
    candidate = F.when(arxiv, F.coalesce("__month", "__own", "__told")).when(zenodo, F.coalesce("__told", "__own")).otherwise(F.coalesce("__own", "__told"))
    # Which year a sound date is held against, and what takes its place where it is another.
    held = F.when(arxiv, F.coalesce(F.substring("__month", 1, 4), "__own", "__told")).when(zenodo, F.col("__told")).otherwise(F.col("__own"))
    better = F.when(F.col("__year").isNull() | arxiv, candidate).otherwise(held)
    wrong = F.col("__year").isNull() | F.coalesce(held != F.col("__year"), F.lit(False))
    new = F.when(F.col("__date").isNull(), candidate).when(wrong & (better != F.col("__date")), better)
    rows = rows.withColumn("__new", new)
    action = F.when(F.col("__new").isNull(), "none").when(F.col("__date").isNull(), "backfill").otherwise("overwrite")
    stated = F.coalesce(records.filled(dynamic.field(F.col("__full"), "$.year")), F.lit(""))
    year = F.when(F.col("__month").isNotNull() & (stated != F.substring("__month", 1, 4)), F.substring("__month", 1, 4))
    return rows.withColumns({"published_date": F.coalesce("__new", "published_date"), "date_action": action, "source_year": year}).select(*metadata.columns, "date_action", "source_year")


def with_source_years(full: DataFrame, dates_: DataFrame, keys: list[str]) -> DataFrame:
    """Full records whose ``source_metadata`` takes the year that ``dated`` says it should."""
    years = dates_.filter("source_year is not null").select(*keys, F.col("source_year").alias("__year"))
    rows = full.join(years, keys, "left")
    mended = F.when(F.col("__year").isNotNull(), dynamic.with_fields(F.col("source_metadata"), {"year": F.col("__year")})).otherwise(F.col("source_metadata"))
    return rows.withColumn("source_metadata", mended).select(*full.columns)


#: What a fix of a wrong match leaves behind in a record's steps and sources (fixed values).
FORCED_STEPS = ["manual_fix:suspicious_source_mismatch", "manual:resolved_no_abstract", "manual_mark:no_abstract_available"]
NO_ABSTRACT = "no_abstract_available"


def forced_fix(tables: dict[str, DataFrame], context: DataFrame, denied: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The four tables of a collection (metadata, sources, trace, full), after records on a list of bad matches were set right.

    What was fetched for such a record is another work's: its title becomes the context's (else its key), its abstract goes,
    its year becomes the context's where that has one, and all tables say that it was resolved by hand. Other rows stay as
    they are. Records that the metadata don't have aren't touched anywhere.
    """
    key = F.col(keys[-1]).cast("string")
    bad = forced(tables["metadata"].select(*keys), denied, keys).distinct()
    told = context.select(*keys, *(records.filled(F.col(n)).alias(f"__{n}") for n in ("title", "year", "source_id"))).dropDuplicates(keys)
    known = F.coalesce("__title", key)
    fix = bad.join(told, keys, "left").select(
        *keys, F.lit(True).alias("__hit"), known.alias("__raw"), records.tex_cleaned(known, " ").alias("__t"), F.col("__year").alias("__y"),
        F.coalesce("__source_id", F.concat(F.lit("local:"), key)).alias("__s"))
    query = records.tex_cleaned(F.coalesce(records.filled(F.col("query_title")), F.col("__raw")), " ")
    found = {"title": F.col("__t"), "source": F.lit("manual"), "source_id": F.col("__s"), "match_status": F.lit("exact_title")}
    whole = {"title": F.col("__t"), "abstract": F.lit(None).cast("string")}
    stated = F.when(F.col("__y").isNotNull(), dynamic.with_fields(F.col("source_metadata"), whole | {"year": F.col("__y")})).otherwise(dynamic.with_fields(F.col("source_metadata"), whole))
    new = {
        "metadata": found | {"query_title": query, "normalized_title": text.normalized_title(F.coalesce(F.nullif(F.col("__t"), F.lit("")), query)), "abstract": F.lit(None).cast("string"), "missing_reason": F.lit(NO_ABSTRACT), "published_date": F.coalesce("__y", "published_date")},
        "sources": found | {"abstract_present": F.lit(False), "abstract_source": F.lit("missing"), "abstract_source_reason": F.lit(f"missing:{NO_ABSTRACT}")},
        "trace": {"lookup_steps": records.with_steps(F.col("lookup_steps"), FORCED_STEPS)},
        "full": found | {"source_metadata": stated},
    }
    out = {}
    for name, table in tables.items():
        rows = table.join(fix, keys, "left")
        out[name] = rows.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in new[name].items() if c in table.columns}).select(*table.columns)
    return out


def repair_counts(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """How many rows of each group each flag holds for."""
    return rows.groupBy(*by).agg(*(F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()))


def repaired(oracle: DataFrame, metadata: DataFrame, collected: DataFrame, others: dict[str, DataFrame], keys: list[str], dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole repair: targets, their states after a collection, and the metadata with all resolved rows merged in (as it
    was, on a dry run)."""
    states = resolved_keys(targets(oracle, metadata, keys), collected, others, keys)
    if dry_run:
        return states, metadata
    good = collected.join(states.filter("state = 'resolved'").select(*keys), keys, "left_semi").select(*metadata.columns)
    return states, metadata.join(good.select(*keys), keys, "left_anti").unionByName(good)


def patched(df: DataFrame, column: str, topic: str, field: str, definitions: dict[str, str]) -> DataFrame:
    """A nested field set from the first definition whose name is in the topic. Adds ``changed``; patching again changes
    nothing."""
    value = F.coalesce(*(F.when(F.contains(F.col(f"{column}.{topic}"), F.lit(name)), F.lit(text_)) for name, text_ in definitions.items()))
    rows = df.withColumn("changed", F.coalesce(value.isNotNull() & ~value.eqNullSafe(F.col(f"{column}.{field}")), F.lit(False)))
    return rows.withColumn(column, F.when(F.col("changed"), F.col(column).withField(field, value)).otherwise(F.col(column)))


def complete(files: DataFrame, key: str, least: int = 8000) -> DataFrame:
    """Keys that have a file of at least so many bytes (``length``)."""
    return files.filter(F.col("length") >= least).select(key).distinct()


def pending_counts(report: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Of a report (status), the pending keys' rows: downloaded and existing rows and distinct failed keys; no row where none
    of them is there."""
    rows = report.join(pending.select(key).distinct(), key, "left_semi").withColumn("status", F.lower(F.trim("status")))
    failed = rows.filter("status = 'failed'").select(key).distinct().agg(F.count("*").alias("n_failed"))
    done = rows.agg(F.count_if(F.col("status") == "downloaded").alias("n_downloaded"), F.count_if(F.col("status") == "existing").alias("n_existing"))
    return done.join(F.broadcast(failed)).filter("n_downloaded + n_existing + n_failed > 0")  # one row each


def stale(subsets: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Which prepared subsets hold fewer rows than their source and have to be built again."""
    out = totals.groupBy(key).agg(F.count("*").alias("n_total")).join(subsets.groupBy(key).agg(F.count("*").alias("n_subset")), key, "left")
    return out.select(key, "n_total", F.coalesce("n_subset", F.lit(0)).alias("n_subset")).withColumn("rebuild", F.col("n_subset") < F.col("n_total"))
