"""Record linkage and keyed merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import text
from loomsieve.operators.dedupe import unique_index
from loomsieve.tables import scratch


def cascade(left: DataFrame, right: DataFrame, steps: list[tuple[str, str, str]], target: str) -> DataFrame:
    """Link by the first step that finds a unique partner. A step is (method, left column, right column).

    Keys that stand for several targets link nothing. Adds ``target`` and ``method`` (null where no step links).
    """
    out = left
    for method, a, b in steps:
        index = unique_index(right.select(F.col(b).alias(f"__k_{method}"), F.col(target).alias(f"__t_{method}")), f"__k_{method}", f"__t_{method}")
        out = out.join(index, F.col(a) == F.col(f"__k_{method}"), "left").drop(f"__k_{method}")
    found = [F.col(f"__t_{m}") for m, _, _ in steps]
    method = F.coalesce(*(F.when(F.col(f"__t_{m}").isNotNull(), F.lit(m)) for m, _, _ in steps))
    return out.withColumn(target, F.coalesce(*found)).withColumn("method", method).drop(*(f"__t_{m}" for m, _, _ in steps))


def resolve(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Exact, then normalized lookup of keys: ``status`` is exact, normalized, retrieval_ambiguous or retrieval_failed."""
    exact = known.select(F.col(key).alias("__exact")).distinct()
    loose = known.select(text.normalized_key(F.col(key)).alias("__loose"), F.col(key).alias("__hit")).groupBy("__loose").agg(F.array_sort(F.collect_set("__hit")).alias("candidates"))
    out = wanted.join(exact, F.col(key) == F.col("__exact"), "left").withColumn("__n", text.normalized_key(F.col(key))).join(loose, F.col("__n") == F.col("__loose"), "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(F.col("__exact").isNotNull(), "exact").when(n == 1, "normalized").when(n > 1, "retrieval_ambiguous").otherwise("retrieval_failed")
    resolved = F.when(status == "exact", F.col("__exact")).when(status == "normalized", F.get("candidates", F.lit(0)))
    return out.withColumn("status", status).withColumn("resolved", resolved).drop("__exact", "__n", "__loose", "candidates")


def best_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, title: str, least: float = 0.9, short: int = 7) -> DataFrame:
    """The best partner by word sets for each left row that has one of at least ``least``: an equal normalized title
    first, else the largest similarity. Titles under ``short`` words link only to an equal title (else a null id).

    Equal titles are compared once. Sets so similar share at least least * n words of either, so of a set's words in order
    of rarity they share two among the first n - ceil(least * n) + 2 (one among one less, where one word is enough): only
    titles that share such a pair, and whose lengths are near enough, are compared. A word that every title holds forms no
    pairs.
    """
    own = lambda df, i, p: df.select(F.col(i).alias(f"{p}_id"), text.normalized_title(F.col(title)).alias(f"{p}_title"))
    a, b = own(left, left_id, "l"), own(right, right_id, "r")
    sides = {"l": a.select("l_title").distinct(), "r": b.groupBy("r_title").agg(F.min("r_id").alias("r_id"))}
    sides = {p: df.withColumn(f"{p}_words", text.tokens(F.col(f"{p}_title"))).withColumn(f"{p}_n", F.size(f"{p}_words")).filter(F.col(f"{p}_n") > 0) for p, df in sides.items()}
    each = lambda p: sides[p].select(f"{p}_title", f"{p}_n", F.explode(f"{p}_words").alias("w"))
    held = each("l").select("w").unionAll(each("r").select("w")).groupBy("w").agg(F.count("*").alias("held"))

    def keys(p: str, other_small: str, own_small: str) -> DataFrame:
        """What titles meet by: pairs of rare words, or single ones where one of two is short."""
        n = F.col(f"{p}_n")
        shared = F.ceil(n * least - 1e-9).cast("int")
        lists = each(p).join(held, "w").groupBy(f"{p}_title", f"{p}_n").agg(F.array_sort(F.collect_list(F.struct("held", "w"))).alias("x"))
        lists = lists.select(f"{p}_title", f"{p}_n", F.transform("x", lambda s: s["w"]).alias("x"), shared.alias("o"))
        one, two = F.slice("x", F.lit(1), n - F.col("o") + 1), F.slice("x", F.lit(1), n - F.col("o") + 2)
        pairs = F.flatten(F.transform(two, lambda w, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda v: F.concat(F.lit("2 "), w, F.lit(" "), v))))
        single = lambda tag: F.transform(one, lambda w: F.concat(F.lit(tag), w))
        none = F.array().cast("array<string>")
        small = F.col("o") < 2
        found = F.concat(F.when(small, none).otherwise(pairs), single(other_small), F.when(small, single(own_small)).otherwise(none))
        return lists.select(f"{p}_title", f"{p}_n", F.explode(found).alias("key"))

    near = (F.col("l_n") >= least * F.col("r_n") - 1e-9) & (F.col("r_n") >= least * F.col("l_n") - 1e-9)
    met = keys("l", "a ", "b ").join(keys("r", "b ", "a "), "key").filter(near).select("l_title", "r_title").distinct()
    pairs = met.join(sides["l"], "l_title").join(sides["r"], "r_title")
    pairs = pairs.select("l_title", "l_n", "r_id", text.jaccard(F.col("l_words"), F.col("r_words")).alias("similarity"), (F.col("l_title") == F.col("r_title")).alias("same"))
    best = pairs.filter(F.col("similarity") >= least).groupBy("l_title").agg(F.max_by(F.struct("r_id", "similarity", "same", "l_n"), F.struct("same", "similarity", (-F.col("r_id")).alias("o"))).alias("m"))
    gate = F.col("m.same") | (F.col("m.l_n") >= short)
    out = a.join(best, "l_title")
    return out.select(F.col("l_id").alias(left_id), F.when(gate, F.col("m.r_id")).alias(right_id), F.col("m.similarity").alias("similarity"), F.col("m.same").alias("same_title"))


#: Words of the right titles in a block, about; counters that a task holds at a time.
BLOCK_WORDS, COUNTERS = 1 << 20, 1 << 21


def best_jaccard_of_all(left: DataFrame, right: DataFrame, left_id: str, right_id: str, title: str, least: float = 0.9, short: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As ``best_jaccard``, for every left row: a best similarity under ``least`` is returned too, with a null partner,
    and 0 where no word is shared.

    Texts are mostly best at a similarity that a few frequent words make, so no threshold leaves out many of the pairs, and
    pairs aren't made as rows. Distinct right titles are dealt to blocks of ``block_words`` words, left rows to parts; a part
    reads a block's lists (which titles hold a word) and then, as a stream, its own rows, for each of which it counts the words
    that all titles of the block share with it. A left row's words are shuffled once for each block, a block once for each part.
    """
    spark = left.sparkSession
    own = lambda df, i, p: df.select(F.col(i).alias(f"{p}_id"), text.normalized_title(F.col(title)).alias(f"{p}_title"))
    words = lambda p: F.array_distinct(F.array_remove(F.split(f"{p}_title", " "), "")).alias("words")
    path = scratch(spark)
    own(right, right_id, "r").groupBy("r_title").agg(F.min("r_id").alias("r_id")).filter("r_title <> ''").select("r_title", "r_id", words("r")).write.parquet(path)
    titles = spark.read.parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-(titles.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df, i: F.lit(None).cast(df.schema[i].dataType)

    equal = titles.select("r_title", "r_id")
    asking = own(left, left_id, "l").join(equal, F.col("l_title") == F.col("r_title"), "left").select(F.monotonically_increasing_id().alias("row"), "l_id", "r_id", words("l"))
    asking = asking.select(F.pmod("row", F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"), F.lit(True).alias("asks"), "row", "l_id", "r_id", "words")
    lists = titles.select(every(parts).alias("part"), F.pmod(F.xxhash64("r_title"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("row"), none(left, left_id).alias("l_id"), "r_id", "words")
    met = lists.unionByName(asking).repartitionById(parts, "part").sortWithinPartitions("block", "asks").drop("part")
    kinds = [df.schema[i].dataType.simpleString() for df, i in ((left, left_id), (right, right_id))]
    found = met.mapInArrow(_best_sets, f"row long, l_id {kinds[0]}, equal_id {kinds[1]}, n int, r_id {kinds[1]}, similarity double")
    best = found.groupBy("row", "l_id", "equal_id", "n").agg(F.max_by(F.struct("r_id", "similarity"), F.struct("similarity", (-F.col("r_id")).alias("o"))).alias("m"))
    same = F.col("equal_id").isNotNull()
    partner = F.when(same, F.col("equal_id")).when((F.col("n") >= short) & (F.col("m.similarity") >= least), F.col("m.r_id"))
    return best.select(F.col("l_id").alias(left_id), partner.alias(right_id), F.col("m.similarity").alias("similarity"), same.alias("same_title"))


class _Lists:
    """The titles of a block, in the order of their ids, and which of them hold each word."""

    def __init__(self, ids: pa.Array, words: pa.Array):
        order = pc.sort_indices(ids)
        self.ids = ids.take(order)
        place = np.empty(len(ids), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(ids))
        lengths = pc.list_value_length(words).to_numpy()
        self.sizes = lengths[order.to_numpy()].astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy()
        self.titles = np.repeat(place, lengths)[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.words)))])

    def best(self, words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each set of words: its size, the id of the most similar title (of equal ones the first) and the similarity."""
        lengths = pc.list_value_length(words).to_numpy()
        places, similarity = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        codes = pc.index_in(pc.list_flatten(words), value_set=self.words)
        owners = np.repeat(np.arange(len(words)), lengths)[codes.is_valid().to_numpy(zero_copy_only=False)]
        codes = codes.drop_null().to_numpy()
        starts, counts = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        # Rows are taken together as long as their counters, and what they add to these, are few.
        n = len(self.ids)
        cost = np.cumsum(np.bincount(owners, weights=counts, minlength=len(words)) + n)
        low = 0
        while low < len(words) and n:
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + COUNTERS, side="right")))
            a, b = np.searchsorted(owners, [low, high])
            each = counts[a:b]
            at = np.repeat(starts[a:b] - np.cumsum(each) + each, each) + np.arange(each.sum())
            shared = np.bincount(np.repeat((owners[a:b] - low) * n, each) + self.titles[at], minlength=(high - low) * n).reshape(-1, n)
            alike = shared / (lengths[low:high, None] + self.sizes[None, :] - shared)
            places[low:high] = alike.argmax(1)
            similarity[low:high] = alike[np.arange(high - low), places[low:high]]
            low = high
        return pa.array(lengths.astype(np.int32)), self.ids.take(pa.array(places, mask=similarity == 0)), pa.array(similarity)


def _best_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part, block by block: first the titles that are offered, then the rows that ask."""
    block, offered, lists = None, [], None
    for batch in batches:
        state = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(state)) + 1).tolist(), len(state)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            rows = batch.slice(begin, end - begin)
            if state[begin] // 2 != block:
                block, offered, lists = state[begin] // 2, [], None
            if not state[begin] % 2:
                offered.append(rows.select(["r_id", "words"]))
                continue
            if lists is None:
                table = pa.Table.from_batches(offered, rows.select(["r_id", "words"]).schema).combine_chunks()
                lists, offered = _Lists(*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns)), []
            for k in range(0, rows.num_rows, 1024):
                own = rows.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("l_id"), own.column("r_id"), *lists.best(own.column("words"))], ["row", "l_id", "equal_id", "n", "r_id", "similarity"])


def waterfall(df: DataFrame, sources: list[tuple[str, Column]], out: str) -> DataFrame:
    """The first source with a value, its name, and the trace of all that were looked at up to it."""
    value = F.coalesce(*(c for _, c in sources))
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sources))
    trace = F.array_compact(F.array(*(F.when(F.coalesce(*(c for _, c in sources[:i]), F.lit(None)).isNull() if i else F.lit(True), F.concat(F.lit(f"{n}:"), F.when(c.isNotNull(), "match").otherwise("miss"))) for i, (n, c) in enumerate(sources))))
    return df.withColumn(out, value).withColumn(f"{out}_source", name).withColumn(f"{out}_trace", trace)


def override(base: DataFrame, over: DataFrame, key: str, columns: list[str], keep_base: dict[str, str] | None = None) -> DataFrame:
    """Full outer merge: a row of ``over`` replaces the columns, nulls included; rows of one side only stay."""
    o = over.select(F.col(key), F.lit(True).alias("__over"), *(F.col(c).alias(f"__o_{c}") for c in columns))
    b = base.withColumn("__base", F.lit(True))
    out = b.join(o, key, "full_outer")
    kept = {new: F.col(old) for old, new in (keep_base or {}).items()}
    merged = {c: F.when(F.col("__over"), F.col(f"__o_{c}")).otherwise(F.col(c)) for c in columns}
    origin = F.when(F.col("__over").isNull(), "base").when(F.col("__base").isNull(), "appended").otherwise("override")
    return out.select(key, *(c.alias(n) for n, c in kept.items()), *(merged[c].alias(c) if c in merged else F.col(c) for c in base.columns if c != key), origin.alias("origin"))


def upsert(base: DataFrame, changes: DataFrame, key: str, pos: str, selected: Column | None = None) -> DataFrame:
    """Changed rows take the place of the ones they replace; new ones follow after them in their own order."""
    chosen = changes if selected is None else changes.filter(selected)
    columns = [c for c in base.columns if c not in (key, pos)]
    last = base.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("__last"))
    c = chosen.select(F.col(key), F.col(pos).alias("__pos"), F.lit(True).alias("__new"), *(F.col(x).alias(f"__c_{x}") for x in columns))
    out = base.join(c, key, "full_outer").join(F.broadcast(last))  # one row
    place = F.coalesce(F.col(pos), F.col("__last") + 1 + F.col("__pos"))
    action = F.when(F.col("__new").isNull(), "kept").when(F.col(pos).isNull(), "appended").otherwise("replaced")
    return out.select(key, place.alias(pos), *(F.when(F.col("__new"), F.col(f"__c_{x}")).otherwise(F.col(x)).alias(x) for x in columns), action.alias("action"))


def fill_blanks(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left rows; the columns take the right value wherever that is neither null nor blank."""
    r = right.select(F.col(key), *(F.col(c).alias(f"__r_{c}") for c in columns))
    full = lambda c: F.col(f"__r_{c}").isNotNull() & (F.trim(F.col(f"__r_{c}").cast("string")) != "")
    out = left.join(r, key, "left")
    return out.select(*(F.when(full(c), F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns))


def in_order(requests: DataFrame, results: DataFrame, key: str, pos: str) -> DataFrame:
    """Results with the position of their request, which orders them; requests without a result give no row."""
    return requests.select(key, pos).join(results, key)


def both_sided_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are on both sides, only left, only right."""
    a, b = left.select(key).dropna().distinct().withColumn("l", F.lit(1)), right.select(key).dropna().distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def wildcard_rules(df: DataFrame, rules: DataFrame, columns: list[str], order: str, value: str) -> DataFrame:
    """The first rule all of whose non-null columns equal the row's. ``rules`` is a small table, which is checked: it
    becomes one literal, so rows are neither joined nor shuffled, and equal rows stay."""
    kept = rules.select(F.col(order), F.col(value), *columns)
    found = kept.orderBy(order).select(F.to_json(F.struct("*"))).limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("rules are meant to be a small table")
    table = F.from_json(F.lit("[" + ",".join(r[0] for r in found) + "]"), f"array<{kept.schema.simpleString()}>")

    def fits(rule: Column) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & (rule[c].isNull() | (rule[c] == F.col(c)))
        return out

    return df.withColumn(value, F.get(F.filter(table, fits), F.lit(0)).getField(value))


def best_ratio(left: DataFrame, right: DataFrame, left_id: str, right_id: str, title: str, least: float = 0.9, high: float = 0.95, by_word: bool = True) -> DataFrame:
    """The most alike title by longest matching blocks: an equal normalized title that is unique first (1.0, exact).

    Pairs whose lengths, pieces of three letters or letters differ too much for the ratio 2 * matches / (sum of lengths) to
    reach ``least`` aren't compared. ``by_word`` also leaves out pairs that share no word of three letters, though their ratio may reach it
    ("autoencoders survey", "autoencoder surveys"); without it every pair that can reach ``least`` is compared. Titles
    without a letter or digit link only to an equal one that is unique. (left id, right id, score, confidence).
    """
    norm = lambda df, i, p: df.select(F.col(i).alias(f"{p}_id"), text.normalized_title(F.col(title)).alias(f"{p}_title"))
    a, b = norm(left, left_id, "l"), norm(right, right_id, "r")
    exact = a.join(unique_index(b, "r_title", "r_id"), F.col("l_title") == F.col("r_title")).select("l_id", "r_id", F.lit(1.0).alias("score"))
    rest = a.join(exact.select("l_id"), "l_id", "left_anti")
    if by_word:
        words = lambda df, p: df.select(f"{p}_id", F.explode(text.tokens(F.col(f"{p}_title"), 3)).alias("w"))
        pairs = words(rest, "l").join(words(b, "r"), "w").select("l_id", "r_id").distinct().join(a, "l_id").join(b, "r_id")
    else:
        titles = _near_titles(rest.select("l_title").distinct(), b.select("r_title").distinct(), least)
        # Equal titles are compared once: of the right ones that of the least id counts.
        pairs = titles.join(b.groupBy("r_title").agg(F.min("r_id").alias("r_id")), "r_title").join(rest, "l_title")
    n, m = F.length("l_title"), F.length("r_title")
    pairs = pairs.filter(2 * F.least(n, m) >= least * (n + m) - 1e-9)
    scored = pairs.select("l_id", "r_id", _ratio(least)("l_title", "r_title").alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("l_id").agg(F.max_by(F.struct("r_id", "score"), F.struct("score", (-F.col("r_id")).alias("o"))).alias("m")).select("l_id", "m.*")
    out = exact.unionByName(best)
    return out.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "score", F.when(F.col("score") == 1.0, "exact").when(F.col("score") >= high, "high").otherwise("medium").alias("confidence"))


#: Letters of the pieces by which titles meet.
GRAM = 3


def shared_grams(n: int | float, least: float) -> float:
    """How many pieces of GRAM letters a title of n letters shares at least with any whose ratio to it reaches ``least``.

    Matching blocks are a common subsequence, so of two titles of n and m letters all but (1 - least) (n + m) are matched, and
    that many deletions and insertions lead from one to the other. A deletion spoils GRAM pieces of the first, an insertion
    one less. The bound is linear in m, so it is least at an end of m's range.
    """
    ends = (math.ceil(least * n / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9))

    def bound(m: int) -> float:
        edits = (1 - least) * (n + m)
        return n - GRAM + 1 - GRAM * (edits + n - m) / 2 - (GRAM - 1) * (edits - n + m) / 2

    return min(map(bound, ends))


def _near_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (l_title, r_title) of distinct titles that hold all whose ratio can reach ``least``.

    Titles meet by the rarest of their pieces of GRAM letters: of g pieces, t shared at least, one of the first g - t + 1 is
    among the other's first ones. Titles so short that no piece need be shared meet by their length instead, each with all
    lengths that it can reach; they are few letters long.
    """
    slope = [shared_grams(x, least) for x in (10_000, 20_000)]
    per = (slope[1] - slope[0]) / 10_000  # the bound is linear in n but for rounding of m's range, which 2 covers
    need = lambda n: F.floor(n * per + (slope[0] - 10_000 * per) - 2 - 1e-6).cast("int")
    sides = {}
    for p, df in (("l", left), ("r", right)):
        n = F.length(f"{p}_title")
        sides[p] = df.filter(n > 0).select(f"{p}_title", n.alias("n")).withColumn("need", need(F.col("n")))

    def tagged(p: str) -> DataFrame:
        """Every piece of a title, repeated ones told apart by number."""
        at = F.sequence(F.lit(1), F.col("n") - GRAM + 1)
        pieces = sides[p].filter("need >= 1").select(f"{p}_title", "n", "need", F.explode(F.transform(at, lambda i: F.substring(F.col(f"{p}_title"), i, F.lit(GRAM)))).alias("g"))
        counted = pieces.groupBy(f"{p}_title", "n", "need", "g").agg(F.count("*").cast("int").alias("c"))
        return counted.select(f"{p}_title", "n", "need", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("c"), "g").select(f"{p}_title", "n", "need", F.concat("g", F.col("c").cast("string")).alias("g"))

    both = {p: tagged(p) for p in sides}
    held = both["l"].select("g").unionAll(both["r"].select("g")).groupBy("g").agg(F.count("*").alias("held"))

    def rare(p: str) -> DataFrame:
        lists = both[p].join(held, "g").groupBy(f"{p}_title", "n", "need").agg(F.array_sort(F.collect_list(F.struct("held", "g"))).alias("x"))
        first = F.slice("x", F.lit(1), F.col("n") - GRAM + 2 - F.col("need"))
        return lists.select(f"{p}_title", F.col("n").alias(f"{p}_n"), F.explode(F.transform(first, lambda s: s["g"])).alias("g"))

    near = 2 * F.least("l_n", "r_n") >= least * (F.col("l_n") + F.col("r_n")) - 1e-9
    met = rare("l").join(rare("r"), "g").filter(near).select("l_title", "r_title")
    shortest = lambda p: sides[p].filter("need < 1")
    reach = F.sequence(F.greatest(F.ceil(F.col("n") * least / (2 - least) - 1e-9), F.lit(1)).cast("int"), F.floor(F.col("n") * (2 - least) / least + 1e-9).cast("int"))
    one = shortest("l").select("l_title", F.explode(reach).alias("n")).join(sides["r"].select("r_title", "n"), "n").select("l_title", "r_title")
    two = shortest("r").select("r_title", F.explode(reach).alias("n")).join(sides["l"].filter("need >= 1").select("l_title", "n"), "n").select("l_title", "r_title")
    return met.unionAll(one).unionAll(two).distinct()


def _ratio(least: float):
    """Ratio of two normalized titles; 0 where the letters that both hold are too few for ``least``."""

    def run(a, b):
        import difflib

        import numpy as np
        import pyarrow as pa

        x, y = a.to_pylist(), b.to_pylist()
        places: dict[str, int] = {}
        at, to = (np.array([places.setdefault(t, len(places)) for t in some], dtype=np.int64) for some in (x, y))
        letters = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128) for t in places]).reshape(-1, 128)
        out = np.zeros(len(x))
        for k in range(0, len(x), 4096):
            i, j = letters[at[k : k + 4096]], letters[to[k : k + 4096]]
            able = 2 * np.minimum(i, j).sum(1) >= least * (i.sum(1) + j.sum(1)) - 1e-9
            for c in (np.flatnonzero(able) + k).tolist():
                out[c] = difflib.SequenceMatcher(None, x[c], y[c]).ratio()
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")
