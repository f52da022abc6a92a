"""Replays of review rounds, stage gates, comparison of variants, and the rewriting of stored results by a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import records, verdicts
from loomsieve.operators import cutoff, evaluate, link
from loomsieve.operators.dedupe import by_key


def keyed_rows(rows: DataFrame, pos: str, keep: str = "first", key: str = "key", nested: Column | None = None) -> DataFrame:
    """One row per key, which may be nested; rows without one are dropped."""
    return by_key(rows.withColumn(key, records.record_key(F.col(key), nested)), [key], pos, keep)


def gold_labels(rows: DataFrame, pos: str, label: str, key: str = "key") -> DataFrame:
    """Key and boolean gold label; labels that say neither are dropped, the last of a key counts."""
    known = rows.withColumn("gold", verdicts.lenient_boolean(F.col(label))).filter(F.col("gold").isNotNull())
    return keyed_rows(known.select(key, pos, "gold"), pos, "last", key).select(key, "gold")


def frozen_cases(rows: DataFrame, senior: str, key: str = "key") -> DataFrame:
    """Rows that reached the senior round: with a key and a valid senior score. Their position stays."""
    return rows.withColumn(key, records.record_key(F.col(key))).withColumn(senior, verdicts.score(F.col(senior))).filter(F.col(key).isNotNull() & F.col(senior).isNotNull())


def overlay(rows: DataFrame, replay: DataFrame, juniors: tuple[str, str], senior: str, verdict: str, key: str = "key") -> DataFrame:
    """Rows whose senior score a replay gave anew, with the verdict that follows from it; rows that never had a senior
    score, and those the replay lacks, stay. Adds ``replayed``."""
    r = replay.select(key, F.lit(True).alias("__r"), verdicts.score(F.col(senior)).alias("__s"))
    out = rows.join(r, key, "left").withColumn("replayed", F.coalesce("__r", F.lit(False)) & verdicts.score(F.col(senior)).isNotNull())
    scores = [verdicts.score(F.col(c)) for c in juniors]
    again = verdicts.panel_verdict(*scores, F.col("__s"))
    return out.withColumn(verdict, F.when(F.col("replayed"), again).otherwise(F.col(verdict))).withColumn(senior, F.when(F.col("replayed"), F.col("__s")).otherwise(F.col(senior))).drop("__r", "__s")


def compared(variants: dict[str, DataFrame], gold: DataFrame, verdict: str, group: str, key: str = "key") -> DataFrame:
    """Confusion and ratios of every variant in each group and in all (a null group), by one rollup over their union."""
    parts = [v.select(key, group, F.col(verdict).alias("__v")).withColumn("variant", F.lit(name)) for name, v in variants.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(gold.select(key, "gold"), key).withColumn("__p", verdicts.predicted(F.col("__v"), known_only=True) == 1)
    cells = {"tp": F.col("__p") & F.col("gold"), "fp": F.col("__p") & ~F.col("gold"), "tn": ~F.col("__p") & ~F.col("gold"), "fn": ~F.col("__p") & F.col("gold")}
    counts = rows.groupingSets([["variant", group], ["variant"]], "variant", group).agg(*(F.count_if(t).alias(n) for n, t in cells.items()))
    return evaluate.with_ratios(counts)


def score_spread(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """How many scores are low (1, 2), middle (3) and high (4, 5), and how many are missing."""
    s = F.col(score)
    return evaluate.histogram(rows, s, {"low": s <= 2, "mid": s == 3, "high": s >= 4}, by)


def matrix(papers: DataFrame, key: str, variants: list[str], runs: int) -> DataFrame:
    """Every paper with every variant and run, as lists that each paper's row holds."""
    each = F.explode(F.array(*map(F.lit, variants))).alias("variant")
    return papers.select(key, each).select(key, "variant", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def probed(keys: DataFrame, variants: dict[str, DataFrame], score: str, key: str = "key") -> DataFrame:
    """Named keys with their score in every variant; a key that a variant lacks has a null."""
    out = keys
    for name, rows in variants.items():
        out = out.join(rows.select(key, verdicts.score(F.col(score)).alias(f"{name}_score")), key, "left")
    return out


def positive_keys(rows: DataFrame, verdict: str, key: str = "key") -> DataFrame:
    """Keys whose verdict is include or maybe: those the next stage reads."""
    return rows.filter(verdicts.label(F.col(verdict)).isin("include", "maybe") & records.record_key(F.col(key)).isNotNull()).select(key).distinct()


def gated(candidates: DataFrame, rows: DataFrame, verdict: str, key: str = "key") -> DataFrame:
    """Candidates that passed the stage before."""
    return candidates.join(positive_keys(rows, verdict, key), key, "left_semi")


def two_round_review(candidates: DataFrame, scores: DataFrame, key: str = "key") -> DataFrame:
    """Each candidate's two first-round scores and a senior score where those disagree (scores: reviewer, score): adds first,
    second, senior, needs_senior and final_verdict.

    A senior score where the first round agrees isn't used.
    """
    each = scores.groupBy(key).agg(*(F.max(F.when(F.col("reviewer") == r, verdicts.score(F.col("score")))).alias(r) for r in ("first", "second", "senior")))
    out = candidates.join(each, key, "left")
    agree = ((F.col("first") >= 4) & (F.col("second") >= 4)) | ((F.col("first") <= 2) & (F.col("second") <= 2))
    out = out.withColumn("needs_senior", F.coalesce(~agree, F.lit(False)))
    return out.withColumn("senior", F.when(F.col("needs_senior"), F.col("senior"))).withColumn("final_verdict", verdicts.panel_verdict(F.col("first"), F.col("second"), F.col("senior")))


def normalized_answers(answers: Column) -> Column:
    """Answers (state, basis) in which absent for want of a signal is unclear."""
    wrong = lambda a: (a["state"] == "absent") & (a["basis"] == "insufficient_signal")
    return F.transform(answers, lambda a: a.withField("state", F.when(wrong(a), "unclear").otherwise(a["state"])))


def authoritative(df: DataFrame, output: str, values: dict[str, Column]) -> DataFrame:
    """A nested output with the fields that the record itself knows better, whatever the output says of them."""
    out = F.col(output)
    for name, value in values.items():
        out = out.withField(name, value)
    return df.withColumn(output, F.when(F.col(output).isNotNull(), out))


def provenance(df: DataFrame, available: Column, path: Column, out: str = "provenance") -> DataFrame:
    """Where a record comes from, as one struct."""
    title = records.first_filled(F.col("title"), F.col("query_title"))
    return df.withColumn(out, F.struct(
        records.record_key(F.col("key")).alias("record_key"), title.alias("record_title"), records.filled(F.col("source")).alias("source"), records.filled(F.col("source_id")).alias("source_id"),
        F.when(available, path).otherwise(F.lit("")).alias("fulltext_path"), available.alias("fulltext_available")))


def result_rows(kind: str, key: Column, title: Column, state: Column, reason: Column | None = None, verdict: Column | None = None) -> list[Column]:
    """Columns of a result row, the same for rows that a window excludes (``cutoff``), that failed (``error``) and that were
    reviewed (``reviewed``)."""
    shapes = {
        "cutoff": (F.lit("cutoff_filtered"), F.lit(True), F.concat(F.lit("cutoff_time_window:"), state), F.lit(cutoff.EXCLUDED)),
        "error": (state, F.lit(False), state, F.concat(F.lit("maybe (review_state:"), state, F.lit(")"))),
        "reviewed": (F.lit("reviewed"), F.lit(False), reason if reason is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string"))}
    review_state, skipped, discarded, final = shapes[kind]
    return [key.alias("key"), title.alias("title"), review_state.alias("review_state"), skipped.alias("review_skipped"), discarded.alias("discard_reason"), final.alias("final_verdict")]


def rewritten(rows: DataFrame, metadata: DataFrame, policy: cutoff.Policy, fallback: DataFrame | None = None, synthesize: bool = False, key: str = "key", pos: str = "pos") -> DataFrame:
    """Stored results (final_verdict, review_state, discard_reason and the two saved columns) judged by a window anew.

    Rows that fail are excluded, those that pass get back what was saved, else what ``fallback`` (key, final_verdict) has.
    With ``synthesize``, metadata that fails and has no row gets one. Rows without a key stay. ``pos`` orders them: judged
    rows in their order, then synthesized ones, then rows without a key. Adds ``origin`` and ``cutoff_status``.
    """
    own = ["final_verdict", "review_state", "discard_reason", "pre_cutoff_final_verdict", "pre_cutoff_review_state"]
    decided = cutoff.decide(metadata.select(key, "published_date"), policy).select(key, F.col("cutoff.status").alias("cutoff_status"), F.col("cutoff.pass").alias("__pass"))
    known = rows.filter(records.record_key(F.col(key)).isNotNull())
    if fallback is None:
        known = known.withColumn("__back", F.lit(None).cast("string"))
    else:
        known = known.join(fallback.select(key, F.col("final_verdict").alias("__back")), key, "left")
    judged = known.join(decided, key, "left").withColumn("cutoff_status", F.coalesce("cutoff_status", F.lit("missing_published_date"))).withColumn("__pass", F.coalesce("__pass", F.lit(False)))
    gone = cutoff.exclude_row(F.col("final_verdict"), F.col("review_state"), F.col("cutoff_status"))
    back = cutoff.restore_row(F.col("final_verdict"), F.col("review_state"), F.col("discard_reason"), F.col("__back"))
    judged = judged.withColumns({c: F.when(F.col("__pass"), back[c] if c in back else F.col(c)).otherwise(gone[c]) for c in own})
    shape = lambda df, origin, order: df.select(key, *own, "cutoff_status", F.lit(origin).alias("origin"), F.lit(order).alias("__order"), pos)
    out = shape(judged, "adjusted", 0)
    if synthesize:
        new = decided.filter(~F.col("__pass")).join(known.select(key), key, "left_anti").join(metadata.select(key, pos), key)
        new = new.withColumns({c: F.lit(None).cast("string") for c in own})
        verdict = cutoff.exclude_row(F.col("final_verdict"), F.col("review_state"), F.col("cutoff_status"))
        out = out.unionByName(shape(new.withColumns(verdict), "synthesized", 1))
    extra = rows.filter(records.record_key(F.col(key)).isNull()).withColumn("cutoff_status", F.lit(None).cast("string"))
    return out.unionByName(shape(extra, "untouched", 2)).withColumn(pos, F.struct("__order", pos)).drop("__order")


def rescued(records_: DataFrame, adjusted: DataFrame, old: cutoff.Policy, new: cutoff.Policy, key: str = "key") -> DataFrame:
    """Keys that fail under the old window and pass under the new one, with what is wrong with their adjusted row (null where
    it was restored)."""
    before = cutoff.decide(records_, old).withColumn("__old", F.col("cutoff.pass"))
    both = cutoff.decide(before.drop("cutoff"), new).filter(~F.col("__old") & F.col("cutoff.pass")).select(key)
    out = both.join(adjusted.select(key, F.lit(True).alias("__a"), "final_verdict"), key, "left")
    fault = F.when(F.col("__a").isNull(), "missing_adjusted_row").when(F.col("final_verdict") == cutoff.EXCLUDED, "still_cutoff").when(records.filled(F.col("final_verdict")).isNull(), "missing_final_verdict")
    return out.select(key, fault.alias("fault"))


def sibling_name(name: Column, swaps: dict[str, str]) -> Column:
    """The name of the first-stage results that belong to a second-stage file, by parts of names that are swapped; null for
    names without such a part."""
    swapped = name
    for second, first in swaps.items():
        swapped = F.replace(swapped, F.lit(second), F.lit(first))
    return F.when(swapped != name, swapped)


def with_sibling(files: DataFrame, folder: str, name: str, swaps: dict[str, str]) -> DataFrame:
    """Each second-stage file with its folder's first-stage file: the one its name points to, else the only one there is
    (first-stage names begin with one of the parts that are swapped in)."""
    first = files.filter(F.greatest(*(F.col(name).startswith(p) for p in (*swaps.values(), *swaps.values())))).select(folder, F.col(name).alias("__n"))
    only = first.groupBy(folder).agg(F.min("__n").alias("__only"), F.count("*").alias("__c"))
    second = files.withColumn("__want", sibling_name(F.col(name), swaps)).filter(F.col("__want").isNotNull())
    named = second.join(first.select(folder, F.col("__n").alias("__want"), F.lit(True).alias("__hit")).distinct(), [folder, "__want"], "left").join(only, folder, "left")
    found = F.when(F.col("__hit"), F.col("__want")).when(F.col("__c") == 1, F.col("__only"))
    return named.select(folder, name, found.alias("sibling"))


def recomputed(results: DataFrame, gold: DataFrame, by: list[str], positive_mode: str = "include_or_maybe", key: str = "key") -> DataFrame:
    """The metrics of every stored result file at once."""
    rows = results.withColumn("__p", verdicts.predicted(F.col("final_verdict"), positive_mode) == 1).join(gold, key)
    return evaluate.with_ratios(evaluate.confusion(rows, F.col("__p"), F.col("gold"), by))


def latest_summary(history: DataFrame, wanted: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first matching summary of each wanted combination; combinations without one are left out."""
    return by_key(history.join(wanted.select(*keys).distinct(), keys, "left_semi"), keys, pos, "first")


def run_summary(stage1: DataFrame, stage2: DataFrame, by: list[str], gold: DataFrame, key: str = "key") -> DataFrame:
    """Per run: first-stage and combined F1, how many keys were selected, and second-stage rows reviewed and missing."""
    f1 = lambda rows, name: recomputed(rows, gold, by, key=key).select(*by, F.col("f1").alias(name))
    selected = stage1.filter(verdicts.label(F.col("final_verdict")).isin("include", "maybe")).groupBy(*by).agg(F.count("*").alias("n_selected"))
    states = stage2.groupBy(*by).agg(F.count_if(F.col("review_state") == "reviewed").alias("n_reviewed"), F.count_if(F.col("review_state") == "missing").alias("n_missing"))
    combined = link.override(stage1.select(F.struct(*by, key).alias("__k"), "final_verdict"), stage2.select(F.struct(*by, key).alias("__k"), "final_verdict"), "__k", ["final_verdict"]).select("__k.*", "final_verdict")
    out = f1(stage1, "stage1_f1").join(f1(combined, "combined_f1"), by, "full_outer")
    return out.join(selected, by, "left").join(states, by, "left").fillna(0, ["n_selected", "n_reviewed", "n_missing"])


# --- audits ----------------------------------------------------------------------------------------------------


def availability(wanted: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """For each wanted key, which of the parts have it."""
    out = wanted.select(key).distinct()
    for name, rows in parts.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def with_counts(wanted: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counts of each wanted key, zeros where there are none."""
    numbers = [c for c in counts.columns if c != key]
    return wanted.select(key).distinct().join(counts, key, "left").fillna(0, numbers)


def policy_columns(policy: Column) -> list[Column]:
    """A time policy's fields with their defaults."""
    p = policy.getField
    empty = F.array().cast("array<string>")
    return [
        F.coalesce(p("enabled"), F.lit(False)).alias("enabled"), p("start_date").alias("start_date"), p("start_inclusive").alias("start_inclusive"), p("end_date").alias("end_date"),
        p("end_inclusive").alias("end_inclusive"), F.coalesce(p("binding_clause_ids"), empty).alias("binding_clause_ids"), F.coalesce(p("fallback_applied"), F.lit(False)).alias("fallback_applied")]


#: Words of a policy's evidence that point to passages about its dates (fixed values).
HINTS = (("search", ("search",)), ("cited", ("cited",)), ("citation", ("citation",)), ("published", ("published",)), ("cutoff", ("cut-off", "cutoff")))


def hint_terms(evidence: Column, start: Column, end: Column) -> Column:
    """Sorted terms to look for: years and words of the evidence texts, the bounds and their years."""
    low = F.lower(F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), "\n"))
    years = F.regexp_extract_all(low, F.lit(r"((?:19|20)\d{2})"), 1)
    words = F.array(*(F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in (*ws, ws[0]))), F.lit(name)) for name, ws in HINTS))
    bounds = F.array(F.lower(start), F.substring(start, 1, 4), F.lower(end), F.substring(end, 1, 4))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(years, words, bounds))))


def composite(key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per key with each part's columns in a struct of its name; a part that lacks the key is null."""
    out = None
    for name, rows in parts.items():
        packed = rows.select(key, F.struct(*(c for c in rows.columns if c != key)).alias(name))
        out = packed if out is None else out.join(packed, key, "left")
    return out
