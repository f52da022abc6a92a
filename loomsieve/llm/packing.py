"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths; equal lengths form buckets.

A document of n tokens gives n // max pieces of the largest length and one piece for each bit of the rest, so each piece
is a sequence of its own at a power of two: no sequence crosses documents and nothing is padded.

Defined results: a null text counts as empty (its only id is the end id); repeated rows are packed each; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import array
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm.bpe import byte_symbols
from loomsieve.llm.common import WORKER_CACHES, documents, materialise, worker_serves

#: Chunks remembered by a worker before the older half goes; bounds memory and never changes a result.
CACHE_CHUNKS = 1_200_000

_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LOADED: dict[int, _Chunks] = {}


class _Chunks(dict):
    """From a chunk of text without spaces and newlines to its ids, made by the library when first asked for."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.older: dict[str, bytes] = {}
        self.symbol = {b: s for b, s in enumerate(byte_symbols())}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(chunk)
        if found is None:
            found = array.array("I", self._ids(chunk)).tobytes()
        self[chunk] = found
        return found

    def _ids(self, chunk: str) -> list[int]:
        """Plain words go to the library's model at once; whatever its normaliser or splitter could change, through all of it."""
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return [t.id for word in _ASCII_WORDS.findall(chunk.lower()) for t in self.model.tokenize(word)]
        if chunk.isalpha() and "\u03a3" not in chunk and unicodedata.is_normalized("NFC", chunk) and (low := chunk.lower()).isalpha():
            return [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.symbol))]
        return self.whole.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _loaded(content: str) -> _Chunks:
    worker_serves("packing")
    WORKER_CACHES["packing"] = _LOADED.clear
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Chunks(content)
    return _LOADED[key]


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, in order."""
    full = n // longest
    out = [(k * longest, longest) for k in range(full)]
    at, rest = full * longest, n % longest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, vocabulary: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id column, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    ``longest`` is a power of two. Within the bucket of a length, sequences are numbered without gaps, k = 0, 1, ...;
    sequence_id is k * (log2(longest) + 1) + log2(length), so the bucket can be read off it. Tokens are made once and
    written to the shared folder; only counts per input partition and length are shuffled for the numbering.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    end = np.uint32(end_id).tobytes()
    names = ["id", "start", "length", "ids", "doc_tokens", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _loaded(content.value)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                rows: list[list] = [[], [], [], [], [], []]
                for k, ids in enumerate(chunks.encode(t) + end for t in some.column(1).to_pylist()):
                    for start, length in pieces_of(len(ids) // 4, longest):
                        for column, value in zip(rows, (k, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.int64()) for r in rows[1:3]), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64()), pa.array([part] * len(rows[0]), pa.int64()), pa.array(rows[5], pa.int64())],
                    names,
                )

    pieces = materialise(source.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, part long, nth long"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # Written as well, so that its true size decides whether it is broadcast (a row for each input partition and length).
    firsts = materialise(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    bit = F.round(F.log2("length")).cast("long")
    return pieces.join(firsts, ["length", "part"]).select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        ((F.col("first") + F.col("nth")) * F.lit(longest.bit_length()) + bit).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
