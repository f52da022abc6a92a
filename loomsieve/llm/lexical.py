"""Ranked lexical search: dual-sorted wavelet trees, one per shard of documents.

A shard lists for each of its terms the documents that hold it, by falling impact (what a term adds to a document's score,
before the term's own weight). All lists, one after another, are the sequence of a wavelet tree over the shard's documents
in the order of their ids. So a list is sorted twice: read along the root it goes by impact, and a node of the tree holds
the part of it that lies in a range of documents, still by impact. The first entry of a list's part of a node is therefore
its greatest impact there, and the sum of these over a query's terms bounds every score in the node.

A search takes nodes best bound first, meets all of the query's lists in both halves of each, and leaves out halves whose
bound can't reach the k-th best score so far; a leaf's bound is a document's score. Nodes are taken many at a time, which
changes their order and never the result. A task keeps the best documents of every query over all shards that it reads, so
later shards are left out sooner. Weights need the number of documents that hold a term anywhere, which is summed from the
shards' term lists first. Queries go to the shards in bounded blocks.

Defined results: null texts and texts without a term match nothing and don't count as documents; repeated rows are documents
of their own; repeated rows of queries are one query; equal scores go by id, null ids first; empty tables give an empty
table; other columns are ignored, whatever their names. Ids of documents are integers. Terms are told apart by 128 bits of
two hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm.common import WORD_BYTE, Scratch, blocks, documents, joined, materialise, mix, spans_of, text_key, trim, word_hashes, worker_serves

#: A term, for JVM and RE2 expressions alike: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes of a shard's texts, about; queries in a block; nodes that a search opens at a time.
SHARD_BYTES, BLOCK, OPENED = 8 << 20, 256, 128
TOP = 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WIDE = mix(np.arange(1, 257, dtype=np.uint64))
_NO_ID = np.iinfo(np.int64).min


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a term, in order: its text and two hashes."""
    owners, ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for begin, end in blocks(texts):
        data, offsets = joined(texts[begin:end])
        data = _LOWER[data]
        starts, ends = spans_of(WORD_BYTE[data])
        owners.append(np.searchsorted(offsets, starts, side="right") - 1 + begin)
        ones.append(word_hashes(data, starts, ends))
        twos.append(word_hashes(_WIDE[data], starts, ends))
    return np.concatenate(owners), np.concatenate(ones), np.concatenate(twos)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def postings_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, text): two hashes, text, occurrences, by term and then text; and the terms of each text."""
    owner, one, two = terms_of(texts)
    order = np.lexsort((owner, one))
    if np.any((one[order][1:] == one[order][:-1]) & (two[order][1:] != two[order][:-1])):
        order = np.lexsort((owner, two, one))
    owner_s, one, two = owner[order], one[order], two[order]
    new = _changes(one, two, owner_s)
    return one[new], two[new], owner_s[new], np.diff(new, append=len(one)), np.bincount(owner, minlength=len(texts))


# --- the tree of a shard ---------------------------------------------------------------------------------------


def tree_levels(sequence: np.ndarray, levels: int) -> np.ndarray:
    """The bits of a wavelet tree, level by level: at level l the sequence stands in the order of its l highest bits."""
    small = np.uint16 if levels <= 16 else np.uint32
    sequence, out = sequence.astype(small), np.zeros((levels, len(sequence)), dtype=bool)
    for level in range(levels):
        shift = small(levels - 1 - level)
        out[level] = (sequence >> shift) & small(1)
        sequence = sequence[np.argsort(sequence >> shift, kind="stable")]
    return out


class Shard:
    """A shard's tree with ranks, and the impacts in every level's order."""

    def __init__(self, bits: np.ndarray, impacts: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.levels, n = bits.shape
        self.one, self.two, self.ids = one, two, ids
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.width = n + 1
        self.ranks = np.zeros((self.levels, n + 1), dtype=np.int32)
        self.impacts = np.zeros((self.levels + 1, n + 1), dtype=np.int32)
        self.impacts[0, :n] = impacts
        node, small = np.zeros(n, dtype=np.uint16 if self.levels <= 16 else np.uint32), None
        for level in range(self.levels):
            np.cumsum(bits[level], out=self.ranks[level, 1:])
            node = 2 * node + bits[level]
            small = np.argsort(node, kind="stable")
            node = node[small]
            self.impacts[level + 1, :n] = self.impacts[level, small]

    def lists(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each term among the shard's, -1 where it holds none."""
        at = np.searchsorted(self.one, one)
        out = np.full(len(one), -1)
        for step in range(2):  # equal first hashes are next to each other
            k = np.minimum(at + step, len(self.one) - 1)
            hit = (self.one[k] == one) & (self.two[k] == two)
            out[hit] = k[hit]
        return out

    def search(self, places: np.ndarray, weights: np.ndarray, best: Best, opened: int = OPENED) -> None:
        """Put the best documents by the sum of weight times impact into ``best``."""
        ranks, impacts, width, ids = self.ranks.ravel(), self.impacts.ravel(), self.width, self.ids
        start, end = self.starts[places][None, :], self.ends[places][None, :]
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high = np.zeros(1, np.int64), np.full(1, width - 1)
        bound = impacts[start] @ weights
        while len(bound):
            if len(bound) > opened:
                top = np.argpartition(-bound, opened)
                now, later = top[:opened], top[opened:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            at = level[now] * width
            s, e, lo, hi = start[now], end[now], low[now], high[now]
            before = ranks[at + lo]
            zeros = (hi - lo) - (ranks[at + hi] - before)
            rs, re = ranks[at[:, None] + s] - before[:, None], ranks[at[:, None] + e] - before[:, None]
            middle = lo + zeros
            s = np.concatenate([s - rs, middle[:, None] + rs])
            e = np.concatenate([e - re, middle[:, None] + re])
            lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
            lv, pre = np.tile(level[now] + 1, 2), np.concatenate([2 * prefix[now], 2 * prefix[now] + 1])
            b = np.where(s < e, impacts[(lv * width)[:, None] + s], 0) @ weights
            done = lv == self.levels
            if done.any():
                best.offer(b[done], ids[np.minimum(pre[done], len(ids) - 1)])
            # What is kept: bounds that reach the k-th best; of equal ones those that hold a smaller id.
            bound = np.concatenate([bound[later], b])
            level, prefix = np.concatenate([level[later], lv]), np.concatenate([prefix[later], pre])
            first = np.minimum(prefix << (self.levels - level), len(ids) - 1)
            keep = (level < self.levels) & best.open(bound, ids[first])
            start, end = np.concatenate([start[later], s])[keep], np.concatenate([end[later], e])[keep]
            low, high = np.concatenate([low[later], lo])[keep], np.concatenate([high[later], hi])[keep]
            bound, level, prefix = bound[keep], level[keep], prefix[keep]


class Best:
    """The k best (score, id): highest first, of equal scores the least id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def open(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Which bounds could still bring a document."""
        if len(self.scores) < self.k:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (least_id < self.ids[-1]))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = self.open(scores, ids)
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


_SHARD = "shard long, ids array<long>, terms array<struct<h:long,g:long,n:int>>, bits binary, impacts binary"


def _index_shard(total: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        worker_serves("lexical")
        ids = np.array([_NO_ID if i is None else i for i in table.column("id").to_pylist()], dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        texts = table.column("text").take(pa.array(order)).to_pylist()
        one, two, doc, count, terms = postings_of(texts)
        m = 25 + (75 * terms * total) // length
        impact = (1_000_000_000 * count) // (1000 * count + 8 * m[doc])
        new = _changes(one, two)
        sizes = np.diff(new, append=len(one))
        by_impact = np.lexsort((doc, -impact, np.repeat(np.arange(len(new)), sizes)))
        bits = tree_levels(doc[by_impact], max(1, int(len(texts) - 1).bit_length()))
        held = pa.StructArray.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(sizes.astype(np.int32))], ["h", "g", "n"])
        out = pa.table({
            "shard": table.column("shard")[:1],
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "terms": pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), held),
            "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
            "impacts": pa.array([impact[by_impact].astype("<i4").tobytes()], pa.binary()),
        })
        del one, two, doc, count, bits, by_impact, texts
        trim()
        return out

    return run


@dataclass(frozen=True)
class Index:
    """The shards' rows, the number of documents that hold a term at all, and the terms of all of them."""

    shards: DataFrame
    documents: int
    terms: int


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: texts that hold a term, their terms, their bytes."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sums = np.zeros(3, dtype=np.int64)
        for begin, end in blocks(texts):
            data, offsets = joined(texts[begin:end])
            inside = WORD_BYTE[data]
            opens = np.zeros(len(data), dtype=bool)
            opens[1:] = inside[1:] & ~inside[:-1]
            opens[:1] = inside[:1]
            terms = np.add.reduceat(opens, offsets[:-1], dtype=np.int64)
            sums += [(terms > 0).sum(), terms.sum(), np.diff(offsets)[terms > 0].sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], ["n", "terms", "bytes"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row; the shards are written to the shared folder."""
    sizes = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(_sizes, "n long, terms long, bytes long")
    total, length, volume = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("terms"), F.sum("bytes")).first())
    count = max(1, -(-volume // shard_bytes))
    shard = F.pmod(F.xxhash64(id_col, text_col), F.lit(count)).alias("shard")
    rows = docs.filter(F.col(text_col).rlike(TERM)).select(shard, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # A partition for each shard, about: a file holds few, so neither its writer's nor its reader's memory grows with the table.
    rows = rows.repartition(count, "shard")
    return Index(materialise(rows.groupBy("shard").applyInArrow(_index_shard(total, max(length, 1)), _SHARD)), total, length)


# --- queries ---------------------------------------------------------------------------------------------------


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two, owner, count, _ = postings_of([t or "" for t in batch.column("text").to_pylist()])
        keys, own = batch.column("query").to_pylist(), owner.tolist()
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(count.astype(np.int64))], ["query", "h", "g", "times"])


def _loaded(batch: pa.RecordBatch, k: int) -> Shard:
    terms = batch.column("terms")[k].values
    one, two, sizes = (terms.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    ids = batch.column("ids")[k].values.to_numpy(zero_copy_only=False)
    impacts = np.frombuffer(batch.column("impacts")[k].as_buffer(), dtype="<i4")
    levels = max(1, int(len(ids) - 1).bit_length())
    packed = np.frombuffer(batch.column("bits")[k].as_buffer(), dtype=np.uint8).reshape(levels, -1)
    return Shard(np.unpackbits(packed, axis=1, count=len(impacts)), impacts, one.view(np.uint64), two.view(np.uint64), sizes.astype(np.int64), ids)


def _search_shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_serves("lexical")
        best: dict[bytes, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard, asks = _loaded(batch, row), batch.column("asks")[row].values
                for query, terms in zip(asks.field("query").to_pylist(), asks.field("terms"), strict=True):
                    h, g, weight = (terms.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    places = shard.lists(h.view(np.uint64), g.view(np.uint64))
                    held = (places >= 0) & (weight > 0)
                    if held.any():
                        shard.search(places[held], weight[held], best.setdefault(query, Best(k)))
                del shard
        trim()
        flat = [(q, s, i) for q, b in best.items() for s, i in zip(b.scores.tolist(), b.ids.tolist(), strict=True)]
        ids = pa.array([None if i == _NO_ID else i for _, _, i in flat], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in flat], pa.binary()), ids, pa.array([s for _, s, _ in flat], pa.int64())], ["query", "doc_id", "score"])

    return run


def weight_of(df: Column, total: int) -> Column:
    """Of a term that ``df`` of ``total`` documents hold: floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * total + 2)) / (2 * df + 1).cast("double"))).cast("long")


def search(index: Index, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query: the query's id, rank (from 1), doc_id and score."""
    scratch = Scratch()
    key = text_key(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))))
    named = queries.select(F.col(id_col).alias("id"), key.alias("query"), F.col(text_col).alias("text")).dropDuplicates(["query"])
    asked = scratch(named.select("query", "text").mapInArrow(_query_terms, "query binary, h long, g long, times long"))
    wanted = asked.select("h", "g").distinct()
    held = index.shards.select(F.explode("terms").alias("t")).select("t.*").join(wanted, ["h", "g"]).groupBy("h", "g").agg(F.sum("n").alias("df"))
    weighed = asked.join(scratch(held), ["h", "g"]).select("query", F.struct("h", "g", (F.col("times") * weight_of(F.col("df"), index.documents)).alias("w")).alias("term"))
    per_query = scratch(weighed.groupBy("query").agg(F.collect_list("term").alias("terms")))
    count = max(1, -(-per_query.count() // BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(count)).cast("int").alias("block")
    asks = per_query.groupBy(block).agg(F.collect_list(F.struct("query", "terms")).alias("asks"))
    pairs = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(asks, "block")
    found = pairs.select("ids", "terms", "bits", "impacts", "asks").mapInArrow(_search_shards(k), "query binary, doc_id long, score long")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    top = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    out = materialise(top.join(named.select("id", "query"), "query").select(F.col("id").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    scratch.drop()
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(documents(spark, sf_dir).select("doc_id", "text"))
    return search(index, documents(spark, sf_dir, "benchmark").select("item_id", "text"))


_SQL = """
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS term FROM documents),
  lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
  totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
  tfs AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
  weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, nn),
  asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS term FROM benchmark) GROUP BY item_id, term),
  scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
  ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("{term}", TERM)

QUERIES = {"op13_lexical": op13_lexical}
ORACLE = {"op13_lexical": _SQL}
