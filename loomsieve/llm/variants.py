"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary, and the form each stands for.

One inserted, deleted or replaced character leaves a half of a word intact. So two near words meet in a block of the forward
dictionary, where they share their first half, or in a block of the reversed one, where they share their last half.
Words of one length meet for replacements, words of lengths m and m + 1 for insertions. A block is the words that share so
many characters at the head and so many at the tail, and its window is what lies between. A crowded block is subdivided in
the same way: an edit in the window leaves a half of the window intact, so each word goes to the part that shares the first
half too and to the part that shares the last half too. Windows halve until blocks are small, or the window is the edited
character itself, where a block is no larger than the alphabet. The dictionaries are range-partitioned and sorted by block,
and a scan verifies the pairs of each block. A pair has one block: that which its first differing character chooses.

Defined results: null texts hold no word; a null id counts as empty in what is hashed; repeated rows count as often as they
occur; equal counts go by code-point order; an empty table gives an empty table; other columns are ignored, whatever their
names. Very long words are compared as any other, in slices that hold memory bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import Scratch, documents, materialise, partitions, worker_serves

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Of each so many (document, word) pairs one loses a character, as a made-up misspelling.
SPOILED = 97
#: Words of a block before it is subdivided; times a word's count that its form must have.
CROWD, RATIO = 128, 2
#: Characters that a scan compares at a time.
SLICE = 1 << 22

_BLOCK = ("inserted", "m", "head", "tail", "a", "b")


def ascii_lower(word: Column) -> Column:
    """A to Z in lower case, nothing else."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoiled: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in whole texts. With ``spoiled``, words whose hash with the document's id it divides
    lose the character that the hash names."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", ascii_lower(F.col("run")).alias("word"))
    if spoiled:
        words = words.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "UTF-8")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.char_length("word")))
        words = words.withColumn("word", F.when(F.col("h") % spoiled == 0, cut).otherwise(F.col("word")))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


# --- blocks ----------------------------------------------------------------------------------------------------


def _placed(rows: DataFrame) -> DataFrame:
    """Each row once for every part of its block: those that share the first half of its window too, or the last half."""
    window = F.col("m") - F.col("a") - F.col("b")
    # A replacement leaves window - 1 characters, an insertion all of the shorter word's.
    first = F.when(F.col("inserted"), F.ceil(window / 2)).otherwise(F.floor(window / 2)).cast("int")
    last = window - first + F.col("inserted").cast("int")
    parts = F.inline(F.array(F.struct((F.col("a") + first).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + last).alias("b"))))
    split = rows.select("word", "n", "inserted", "m", parts)
    length = F.char_length("word")
    return split.select("word", "n", "inserted", "m", F.col("word").substr(F.lit(1), F.col("a")).alias("head"), F.col("word").substr(length - F.col("b") + 1, F.col("b")).alias("tail"), "a", "b")


def _first_blocks(words: DataFrame) -> DataFrame:
    length = F.char_length("word").cast("int")
    kinds = F.inline(F.array(*(F.struct(F.lit(inserted).alias("inserted"), (length - less).alias("m")) for inserted, less in ((False, 0), (True, 0), (True, 1)))))
    return _placed(words.select("word", "n", kinds).select("*", F.lit(0).alias("a"), F.lit(0).alias("b")))


def near_within(lengths: np.ndarray, codes: np.ndarray, block: np.ndarray, inserted: np.ndarray, last_head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of near words in one block each. ``codes`` are all words' characters, one after another; rows of a
    block are next to each other; a pair whose insertion comes behind ``last_head`` characters belongs to another block."""
    order = np.lexsort((lengths, block))  # the shorter word comes first
    opens = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
    sizes = np.diff(opens, append=len(order))
    behind = np.repeat(opens + sizes, sizes) - np.arange(len(order)) - 1
    left = np.repeat(np.arange(len(order)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    left, right = order[left], order[right]
    fits = lengths[right] - lengths[left] == inserted[left]
    left, right = left[fits], right[fits]
    begins = np.cumsum(lengths) - lengths
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    # Pairs of similar length together, so that padding is small.
    by_length = np.argsort(lengths[left], kind="stable")
    at = 0
    while at < len(by_length):
        rows = max(1, SLICE // int(lengths[left[by_length[at]]] + 2))
        some = by_length[at : at + rows]
        width = int(lengths[right[some]].max()) + 1
        if len(some) * width > 2 * SLICE and len(some) > 1:
            some = some[: max(1, SLICE // width)]
            width = int(lengths[right[some]].max()) + 1
        at += len(some)
        i, j = left[some], right[some]
        column = np.arange(width)
        x, y = (np.where(column < lengths[k][:, None], codes[np.minimum(begins[k][:, None] + column, len(codes) - 1)], 0) for k in (i, j))
        differ = x != y
        first = differ.argmax(1)
        shifted = x[:, :-1] != y[:, 1:]
        # Of an insertion, everything from the first difference on agrees when it is moved by one.
        last = np.where(shifted.any(1), width - 2 - shifted[:, ::-1].argmax(1), -1)
        near = np.where(inserted[i], (last < first) & (first <= last_head[i]), differ.sum(1) == 1)
        out[0].append(i[near])
        out[1].append(j[near])
    return np.concatenate(out[0]), np.concatenate(out[1])


_PAIR = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def _verified(table: pa.Table) -> pa.RecordBatch:
    words = table.column("word").to_pylist()
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    inserted = table.column("inserted").to_numpy()
    last_head = table.column("m").to_numpy().astype(np.int64) - table.column("b").to_numpy()
    i, j = near_within(lengths, codes, _block_numbers(table), inserted, last_head)
    n = table.column("n").combine_chunks()
    word = table.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([word.take(pa.array(i)), n.take(pa.array(i)), word.take(pa.array(j)), n.take(pa.array(j))], schema=_PAIR)


def _block_numbers(table: pa.Table) -> np.ndarray:
    """Rows of one block have one number; they are next to each other."""
    new = np.zeros(table.num_rows, dtype=bool)
    for name in _BLOCK:
        column = table.column(name).combine_chunks()
        new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a sorted part of the dictionaries; a block that a batch cuts waits for its rest."""
    worker_serves("variants")
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        number = _block_numbers(table)
        cut = int(np.searchsorted(number, number[-1]))
        held = table.slice(cut)
        if cut:
            yield _verified(table.slice(0, cut))
    if held is not None and held.num_rows:
        yield _verified(held)


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """From (word, n) rows with distinct words: each pair of near words once, as (a, n_a, b, n_b). The result is written."""
    scratch = Scratch()
    found, rows, spent = None, scratch(_first_blocks(words)), []
    while True:
        # Aggregates are written before they are joined: a join of two exchanges can be split where a block is large.
        sizes = rows.groupBy(*_BLOCK).agg(F.count("*").alias("size"), F.countDistinct(F.char_length("word")).alias("lengths"))
        useful = (F.col("size") > 1) & ((F.col("lengths") == 2) | ~F.col("inserted"))
        window = F.col("m") - F.col("a") - F.col("b")
        crowded = (F.col("size") > crowd) & (window > F.when(F.col("inserted"), 0).otherwise(1))
        sizes = scratch(sizes.filter(useful).select(*_BLOCK, crowded.alias("crowded")))
        met = rows.join(sizes, list(_BLOCK))
        small = met.filter(~F.col("crowded")).select(*_BLOCK, "word", "n")
        order = [F.col(c) for c in _BLOCK]
        pairs = scratch(scratch(small).repartitionByRange(partitions(words.sparkSession), *order).sortWithinPartitions(*order, "word").mapInArrow(_scan, "a string, n_a long, b string, n_b long"))
        found = pairs if found is None else found.unionByName(pairs)
        if not sizes.filter("crowded").limit(1).count():
            out = materialise(found)
            scratch.drop()
            return out
        spent.append(rows)
        rows = scratch(_placed(met.filter("crowded")))


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """From (word, n) rows with distinct words: word, n, n_near, form (its near word of the largest n, where that is at least
    ``ratio`` times its own), form_n, and root (the form of its form and so on)."""
    scratch = Scratch()
    pairs = near_pairs(words, crowd)
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(both).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has_form = -F.col("best.less") >= ratio * F.col("n")
    placed = scratch(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")))
    # Counts at least double from form to form, so chains are short; each round makes every way twice as long.
    ways = scratch(placed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = scratch(ways.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        scratch.drop(ways)
        ways = further
        if not ways.filter("moved").limit(1).count():
            break
    out = materialise(placed.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.drop()
    return out


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return variants(materialise(word_counts(docs, spoiled=SPOILED)))


#: The same in SQL: CRC-32 by its table, near words by the words and gaps that a left-out character leaves.
_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
pairs AS (SELECT id, w, count(*) AS k, hex(encode(id || ':' || w)) AS x FROM runs WHERE length(w) >= 5 GROUP BY id, w),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: 16 * strpos('123456789ABCDEF', substr(x, 2 * i + 1, 1)) + strpos('123456789ABCDEF', substr(x, 2 * i + 2, 1)))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM pairs, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM words, range(1, length(word) + 1) r(p)),
near AS (SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND length(x.word) = length(y.word) AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT ways.word, ways.root FROM ways JOIN forms e ON e.word = ways.root WHERE e.form IS NULL) r ON r.word = f.word
"""

QUERIES = {"op11_variants": op11_variants}
ORACLE = {"op11_variants": _SQL}
