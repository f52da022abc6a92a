"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A document is its shingles of five words, each weighing its count times an inverse document frequency over all
documents. A sample of improved consistent weighted sampling agrees between two documents with the probability of their
weighted Jaccard similarity. Bands of samples give candidates, whose similarity is computed from the weights.

Document frequencies: documents are dealt to bounded batches; a batch sends each of its shingle hashes once, with a count
and packed by hash range; a range answers every batch with the shingles that occur in two documents or more. A packet holds
a shingle at least, so there are never more of them than shingles, as in a plain aggregate, however many ranges there are. A document
whose shared shingles weigh less than the threshold's part of it can't have a partner, which is exact, and goes no further.

Candidates of a band meet one member of their group, not each other: in every other band the most central one (whose
shingles most documents hold, as an original among its copies), elsewhere one of the band's own choice. Where that leaves
the documents of a band's value in several parts, all but the largest part's are compared with all of them in bounded
blocks that give links only. Equal texts are one node throughout.

Defined results: null texts count as empty; equal texts are always one class, also empty ones; a text of fewer than five
words is one shingle, one without words resembles nothing else; repeated rows count as documents; an empty table gives an
empty table; other columns stay as they are. The class of a document is the least id in it (null ids don't count).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import SPACE_BYTE, Scratch, blocks, components, documents, joined, materialise, mix, partitions, release, spans_of, text_key, trim, word_hashes, worker_serves

SHINGLE_WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 12, 3
#: UTF-8 bytes of a batch's texts, about, and of the texts whose shingles a hash range holds.
BATCH_BYTES, RANGE_BYTES = 6 << 20, 12 << 20

#: Documents of a block that ask, and that are asked.
ASKING, ASKED = 128, 512

_SPACES = re.compile(r"[\t\n\v\f\r ]")
_LAST_WORD = re.compile(r"[^\t\n\v\f\r ]+[\t\n\v\f\r ]*$")
_LOW = np.uint64((1 << 40) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: list[str], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, in order, and the text of each."""
    data, offsets = joined(texts)
    data = _LOWER[data]
    starts, ends = spans_of(~SPACE_BYTE[data])
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    out = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        out = mix(out ^ words[j : j + len(out)]) if len(out) else out
    full = np.maximum(counts - width + 1, 0)
    at = np.arange(full.sum()) + np.repeat(first[:-1] - (np.cumsum(full) - full), full)
    owner = np.repeat(np.arange(len(texts)), full)
    hashes = out[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for k in short.tolist():
            h = np.uint64(counts[k])
            for w in words[first[k] : first[k + 1]]:
                h = mix(np.array([h ^ w]))[0]
            extra.append(h)
        hashes, owner = np.concatenate([hashes, np.array(extra, dtype=np.uint64)]), np.concatenate([owner, short])
    return hashes, owner


def coded(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range in the high bits, 40 bits of the hash below: the identity of a shingle from here on."""
    return ((hashes >> np.uint64(40)) % np.uint64(ranges) << np.uint64(40)) | (hashes & _LOW)


def _parts(text: str, limit: int, width: int) -> list[str]:
    """A long text in parts, cut at white space; each later part begins ``width - 1`` words before the cut, so that every
    shingle lies in exactly one part."""
    text = text.rstrip()
    out, at = [], 0
    while len(text) - at > limit and (space := _SPACES.search(text, at + limit)):
        end = space.start()
        out.append(text[at:end])
        back = end
        for _ in range(width - 1):
            word = _LAST_WORD.search(text, max(at, back - limit // 8), back)
            back = word.start() if word else back
        at = back
    return [*out, text[at:]]


def counted(texts: list[str], ranges: int, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner (ascending), code and count. Memory beside the result is bounded."""
    parts, owners = [], []
    for k, t in enumerate(texts):
        own = _parts(t, 1 << 20, width) if len(t) > 1 << 20 else [t]
        parts += own
        owners += [k] * len(own)
    all_codes, all_owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in blocks(parts, 1 << 19):
        hashes, owner = shingles(parts[begin:end], width)
        all_codes.append(coded(hashes, ranges))
        all_owners.append(np.array(owners[begin:end], dtype=np.int64)[owner])
    codes, owner = np.concatenate(all_codes), np.concatenate(all_owners)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else np.zeros(0, int)
    return owner[new], codes[new], np.diff(np.concatenate([new, [len(codes)]]))


def idf(df: np.ndarray, documents_total: int) -> np.ndarray:
    """Between 1 (in every document) and 2 (in one of many): damped, so that an edit of a much-copied text stays an edit."""
    return 1 + np.log((1 + documents_total) / (1 + df)) / np.log(2 + documents_total)


def signature(codes: np.ndarray, weights: np.ndarray, begins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band values (documents, bands) of improved consistent weighted samples; each document has a shingle at least."""
    log_weight = np.log(weights)
    out = np.zeros((len(begins), bands), dtype=np.uint64)
    owner = np.repeat(np.arange(len(begins)), np.diff(np.concatenate([begins, [len(codes)]])))
    scale = 1.0 / (1 << 32)
    for k in range(bands * rows):
        seed = mix(np.array([k + 1], dtype=np.uint64))[0]
        one = mix(codes ^ seed)
        two = mix(one + np.uint64(0x9E3779B97F4A7C15))
        three = mix(two + np.uint64(0x9E3779B97F4A7C15))
        half = np.uint64(32)
        low = np.uint64(0xFFFFFFFF)
        r = -np.log(((one >> half).astype(np.float64) + 0.5) * scale * (((one & low).astype(np.float64) + 0.5) * scale))
        log_c = np.log(-np.log(((two >> half).astype(np.float64) + 0.5) * scale * (((two & low).astype(np.float64) + 0.5) * scale)))
        beta = (three >> half).astype(np.float64) * scale
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, begins)
        hit = np.flatnonzero(log_a == least[owner])
        hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
        sample = mix(codes[hit] ^ mix(t[hit].astype(np.int64).view(np.uint64) + seed))
        out[:, k // rows] = mix(out[:, k // rows] ^ sample)
    return out.view(np.int64)


def _send(ranges: int):
    """Each batch's shingles with the number of its documents that hold them, packed by range of the hash."""

    def run(batches):
        def flush(batch_ids: list[int], texts: list[str]):
            owner, codes, _ = counted(texts, ranges)
            place = np.array(batch_ids, dtype=np.int64)[owner]
            order = np.lexsort((codes, place))
            codes, place = codes[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (place[1:] != place[:-1])])) if len(codes) else np.zeros(0, int)
            n = np.diff(np.concatenate([new, [len(codes)]])).astype("<u4")
            codes, place = codes[new], place[new]
            span = (codes >> np.uint64(40)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (place[1:] != place[:-1])])) if len(codes) else np.zeros(0, int)
            low, high = (codes & np.uint64(0xFFFFFFFF)).astype("<u4"), ((codes >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
            edges = np.concatenate([cut, [len(codes)]]).tolist()
            blobs = [(low[a:b].tobytes(), high[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(place[cut]), pa.array(span[cut]), *(pa.array([x[i] for x in blobs], pa.binary()) for i in range(3))], ["batch", "span", "low", "high", "n"]
            )

        worker_serves("neardup")
        # A batch is sent whole where it fits a few buffers; parts of it would be added up all the same.
        ids, texts, size = [], [], 0
        for table in batches:
            for b, t in zip(table.column("batch").to_pylist(), table.column("text").to_pylist(), strict=True):
                if size > 2 * BATCH_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(b)
                texts.append(t)
                size += len(t)
        if ids:
            yield flush(ids, texts)
        del ids, texts
        trim()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one hash range: to every batch, those of its shingles that two documents or more hold, and how many hold them."""
    lows, highs, ns = ([np.frombuffer(x, dtype=d) for x in table.column(c).to_pylist()] for c, d in (("low", "<u4"), ("high", np.uint8), ("n", "<u4")))
    sizes = np.array([len(x) for x in lows])
    codes = np.concatenate(lows).astype(np.uint64) | (np.concatenate(highs).astype(np.uint64) << np.uint64(32))
    order = np.argsort(codes, kind="stable")
    inner = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
    df = np.add.reduceat(np.concatenate(ns)[order].astype(np.int64), heads)
    per = np.empty(len(codes), dtype=np.int64)
    per[order] = np.repeat(df, np.diff(np.concatenate([heads, [len(codes)]])))
    span = np.uint64(table.column("span")[0].as_py())
    out, begin = ([], [], []), 0
    for batch, n in zip(table.column("batch").to_pylist(), sizes.tolist(), strict=True):
        own = slice(begin, begin + n)
        begin += n
        shared = per[own] > 1
        if shared.any():
            out[0].append(batch)
            out[1].append((codes[own][shared] | (span << np.uint64(40))).astype("<u8").tobytes())
            out[2].append(per[own][shared].astype("<u4").tobytes())
    return pa.table({"batch": pa.array(out[0], pa.int64()), "codes": pa.array(out[1], pa.binary()), "df": pa.array(out[2], pa.binary())})


def _sign(ranges: int, total: int, threshold: float):
    """Of one batch: band values and shared weights of the distinct texts that could have a partner."""
    schema = pa.schema([("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("total", pa.float64()), ("codes", pa.binary()), ("counts", pa.binary()), ("idfs", pa.binary()), ("centre", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim()  # of the batch before
        if not docs.num_rows or not answers.num_rows:
            return schema.empty_table()
        known = np.concatenate([np.frombuffer(x, dtype="<u8") for x in answers.column("codes").to_pylist()])
        df = np.concatenate([np.frombuffer(x, dtype="<u4") for x in answers.column("df").to_pylist()]).astype(np.int64)
        order = np.argsort(known)
        known, df = known[order], df[order]
        texts = dict(zip(docs.column("key").to_pylist(), docs.column("text").to_pylist(), strict=True))
        keys, texts = list(texts), list(texts.values())
        owner, codes, n = counted(texts, ranges)
        if not len(codes):
            return schema.empty_table()
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        shared = known[at] == codes
        scale = idf(np.where(shared, df[at], 1), total).astype("<f4").astype(np.float64)
        weights = n * scale
        whole = np.bincount(owner, weights=weights, minlength=len(keys))
        common = np.bincount(owner, weights=weights * shared, minlength=len(keys))
        held = np.bincount(owner, weights=weights * np.where(shared, df[at], 1), minlength=len(keys))
        live = (common >= threshold * whole * (1 - 1e-9)) & (whole > 0)
        keep = live[owner]
        owner, codes, weights, shared, n, scale = owner[keep], codes[keep], weights[keep], shared[keep], n[keep], scale[keep]
        if not len(codes):
            return schema.empty_table()
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bands = signature(codes, weights, begins)
        ends = np.concatenate([begins[1:], [len(codes)]])
        small = mix(codes).astype("<u4")
        packed: list[list[bytes]] = [[], [], []]
        for x, y in zip(begins, ends, strict=True):
            own = np.flatnonzero(shared[x:y]) + x
            own = own[np.argsort(small[own], kind="stable")]
            for out, values in zip(packed, (small[own], n[own].astype("<u4"), scale[own].astype("<f4")), strict=True):
                out.append(values.tobytes())
        mine = owner[begins]
        return pa.Table.from_arrays(
            [pa.array([keys[i] for i in mine.tolist()], pa.binary()), pa.array(bands.tolist(), pa.list_(pa.int64())), pa.array(whole[mine]), *(pa.array(x, pa.binary()) for x in packed), pa.array(held[mine] / whole[mine])],
            schema=schema,
        )

    return run


def _similarity(codes_a: pa.Array, counts_a: pa.Array, idfs_a: pa.Array, total_a: pa.Array, codes_b: pa.Array, counts_b: pa.Array, total_b: pa.Array) -> pa.Array:
    """Weighted Jaccard similarity; shingles that only one document of the corpus holds are in the totals alone."""
    out = []
    for ca, na, wa, ta, cb, nb, tb in zip(*(x.to_pylist() for x in (codes_a, counts_a, idfs_a, total_a, codes_b, counts_b, total_b)), strict=True):
        _, ia, ib = np.intersect1d(np.frombuffer(ca, "<u4"), np.frombuffer(cb, "<u4"), return_indices=True)
        both = float((np.minimum(np.frombuffer(na, "<u4")[ia], np.frombuffer(nb, "<u4")[ib]) * np.frombuffer(wa, "<f4")[ia].astype(np.float64)).sum())
        out.append(both / max(ta + tb - both, 1e-12))
    return pa.array(out, pa.float64())


def _elements(code: bytes, count: bytes, scale: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document as a set: its k-th occurrence of a shingle is an element, so a sum over common elements is one of minima."""
    codes, counts = np.frombuffer(code, "<u4").astype(np.uint64), np.frombuffer(count, "<u4").astype(np.int64)
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(codes, counts) + (level.astype(np.uint64) << np.uint64(32))), np.repeat(np.frombuffer(scale, "<f4").astype(np.float64), counts)


def _cross(threshold: float):
    """Links between the asking and the other documents of one block, by products of slices of their incidence matrices."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        key, total = table.column("key").to_pylist(), table.column("total").to_numpy()
        sets = [_elements(*x) for x in zip(*(table.column(c).to_pylist() for c in ("codes", "counts", "idfs")), strict=True)]
        sides = [np.flatnonzero(asks), np.flatnonzero(~asks)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        words = np.unique(np.concatenate([sets[i][0] for i in sides[0]]))
        flat = []
        for side in sides:
            row = np.repeat(np.arange(len(side)), [len(sets[i][0]) for i in side])
            e, w = np.concatenate([sets[i][0] for i in side]), np.concatenate([sets[i][1] for i in side])
            at = np.minimum(np.searchsorted(words, e), max(len(words) - 1, 0))
            known = words[at] == e if len(words) else np.zeros(len(e), bool)
            order = np.argsort(at[known], kind="stable")
            flat.append((at[known][order], row[known][order], np.sqrt(w[known][order])))
        both = np.zeros((len(sides[0]), len(sides[1])))
        for begin in range(0, len(words), 4096):
            part = []
            for (at, row, w), side in zip(flat, sides, strict=True):
                x, y = np.searchsorted(at, (begin, begin + 4096))
                m = np.zeros((len(side), 4096))
                m[row[x:y], at[x:y] - begin] = w[x:y]
                part.append(m)
            both += part[0] @ part[1].T
        similar = both / np.maximum(total[sides[0]][:, None] + total[sides[1]][None, :] - both, 1e-12)
        i, j = np.nonzero(similar >= threshold - 1e-12)
        found = [(key[sides[0][x]], key[sides[1][y]]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if key[sides[0][x]] != key[sides[1][y]]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return run


def _remaining(nodes: DataFrame, shared: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Links that comparisons with representatives can't have found.

    ``shared`` has the documents of each band value that several have. Where the links so far leave those of one value in
    several parts, all but the largest part's are compared with all of them, in blocks. Values that the same documents
    share count once.
    """
    scratch = Scratch()
    roots = components(links)
    members = scratch(shared.select(F.col("key").alias("node"), "band", "value").join(roots, "node", "left").select("node", "band", "value", F.coalesce("root", "node").alias("part")))
    sizes = members.groupBy("band", "value", "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    values = sizes.groupBy("band", "value").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("size > most")
    once = values.groupBy("x", "y", "size").agg(F.min(F.struct("band", "value", "main", "most")).alias("v")).select("v.*", "size")
    once = scratch(once)  # so that the join below reads exchanges only, and adaptive execution can split a value's documents
    open_ = members.join(once, ["band", "value"]).withColumn("asks", F.col("part") != F.col("main")).withColumn("others", F.col("size") - F.col("most"))
    open_ = scratch(open_.select(F.col("node").alias("key"), "band", "value", "asks", "size", "others"))
    if open_.isEmpty():
        scratch.drop()
        return links
    rows, columns = F.ceil(F.col("others") / ASKING).cast("int"), F.ceil(F.col("size") / ASKED).cast("int")
    loaded = open_.join(nodes.select("key", "total", "codes", "counts", "idfs"), "key")
    payload = ["band", "value", "key", "total", "codes", "counts", "idfs"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = loaded.filter("asks").select(*payload, F.pmod(F.xxhash64("key"), rows).cast("int").alias("i"), every(columns).alias("j"), F.lit(True).alias("asks"))
    asked = loaded.select(*payload, F.pmod(F.xxhash64("key"), columns).cast("int").alias("j"), every(rows).alias("i"), F.lit(False).alias("asks"))
    more = asking.unionByName(asked).groupBy("band", "value", "i", "j").applyInArrow(_cross(threshold), "a binary, b binary")
    out = materialise(links.unionByName(more))
    scratch.drop()
    return out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: key (binary identity), ids (rows that have it), least_id and class_id.

    Join it to ``text_key(text)`` of the documents for a row each.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    total, volume = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    batches, ranges = (max(partitions(spark), -(-volume // size)) for size in (BATCH_BYTES, RANGE_BYTES))
    rows = docs.select(text_key(text).alias("key"), text.alias("text"), F.pmod(F.xxhash64(text, F.col(id_col)), F.lit(batches)).alias("batch"))
    rows = rows.repartition(max(partitions(spark), 1), "batch")  # once: the answers meet the batches where they are
    sent = rows.mapInArrow(_send(ranges), "batch long, span long, low binary, high binary, n binary")
    answers = sent.groupBy("span").applyInArrow(_answer, "batch long, codes binary, df binary")
    signed = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_sign(ranges, total, threshold), "key binary, bands array<long>, total double, codes binary, counts binary, idfs binary, centre double")
    scratch = Scratch()
    signed = scratch(signed)
    del rows, sent, answers  # else their shuffle files stay
    release(spark)
    nodes = scratch(signed.dropDuplicates(["key"]))
    scratch.drop(signed)
    bands = nodes.select("key", "centre", F.posexplode("bands").alias("band", "value"))
    # Half of the bands compare with the member whose shingles most documents hold, the others each with another one.
    rank = F.when(F.col("band") % 2 == 0, -F.col("centre")).otherwise(F.xxhash64("key", "band").cast("double"))
    groups = bands.groupBy("band", "value").agg(F.min_by("key", F.struct(rank.alias("r"), F.col("key"))).alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = scratch(bands.join(groups, ["band", "value"]))
    met = shared.filter("key <> b").select(F.col("key").alias("a"), "b").distinct()
    left = nodes.select(F.col("key").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("codes", "counts", "idfs", "total")))
    right = nodes.select(F.col("key").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("codes", "counts", "total")))
    similarity = F.arrow_udf(_similarity, "double")("codes_a", "counts_a", "idfs_a", "total_a", "codes_b", "counts_b", "total_b")
    links = materialise(met.join(left, "a").join(right, "b").filter(similarity >= threshold).select("a", "b"))
    links = _remaining(nodes, shared, links, threshold)
    scratch.drop()
    ids = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key")).groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("ids"))
    ids = materialise(ids)
    roots = components(links)
    placed = ids.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = materialise(placed)
    classes = materialise(placed.groupBy("root").agg(F.min("least_id").alias("class_id")))
    return placed.join(classes, "root").select("key", "ids", "least_id", "class_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all columns: the least id's; of rows with that id and text, the one of the least hash.

    Copies are reduced to one row in the task that reads them, before texts are shuffled.
    """
    classes = near_classes(docs, threshold, id_col, text_col)
    keep = classes.filter(F.col("least_id") == F.col("class_id")).groupBy("class_id").agg(F.min("key").alias("key")).select("key")
    # Without any id in a class there is no least one; its least text stays.
    keep = keep.union(classes.filter("class_id is null").select("key"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.hash(*(F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant"))).alias("h"))
    once = docs.select(text_key(F.col(text_col)).alias("key"), row.alias("row"), rank.alias("rank")).groupBy("key").agg(F.min_by("row", "rank").alias("row"))
    return once.join(keep, "key", "left_semi").select("row.*")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    classes = near_classes(docs).select("key", "class_id")
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(classes, "key").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


QUERIES = {"op1_neardup": op1_neardup}
