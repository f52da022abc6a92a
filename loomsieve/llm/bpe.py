"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Defined results: a null text counts as empty (no ids, empty decoded text); an empty table gives an empty table; repeated
rows each give a row; other columns are ignored, whatever their names. A long text costs memory in proportion to itself.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import WORKER_CACHES, documents, worker_serves

#: Pieces remembered by a worker before it starts afresh; bounds memory and never changes a result.
CACHE_PIECES = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class ByteBpe:
    """One vocabulary file of the tokenizers library (a byte-level BPE model without normaliser)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: b for b, s in enumerate(symbols)}
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {token: np.uint32(i).tobytes() for token, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = _Remembered(lambda piece: np.array(self.merge(piece.encode()), dtype="<u4").tobytes())
        whole = lambda chunk: b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))
        self.heads, self.tails = _Remembered(whole), _Remembered(lambda chunk: whole(" " + chunk))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest rank first, the leftmost among equals; entries made stale by a merge are skipped."""
        ids = [self.of_byte[b] for b in piece]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], k, found[1], ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, into, left, right = heapq.heappop(queue)
            nxt = after[k]
            if ids[k] != left or nxt < 0 or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = into, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if found := merges.get((into, ids[after[k]])):
                    heapq.heappush(queue, (found[0], k, found[1], into, ids[after[k]]))
            if (p := before[k]) >= 0 and (found := merges.get((ids[p], into))):
                heapq.heappush(queue, (found[0], p, found[1], ids[p], into))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens in the text become those tokens."""
        if self.cut and any(s in text for s in self.added):
            return b"".join(self.added.get(part) or self._plain(part) for part in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _DOUBLE_SPACE.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        # White space stands alone here, so every space opens a piece and every newline is one: cut there, look chunks up.
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.heads["\n"])
            first, *rest = line.split(" ")
            out.append(self.heads[first])
            out.extend(map(self.tails.__getitem__, rest))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Concatenated vocabulary strings; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_DOUBLE_SPACE = re.compile(r"\s\s")


class _Remembered(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_PIECES:
            self.clear()
        value = self[key] = self.make(key)
        return value


_LOADED: dict[str, ByteBpe] = {}


def _loaded(content: str) -> ByteBpe:
    worker_serves("bpe")
    WORKER_CACHES["bpe"] = _LOADED.clear
    key = f"{len(content)}-{hash(content)}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(content)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id column, ``ids`` (binary, little-endian uint32) and ``decoded`` (text made from the ids).

    ``vocabulary`` is a path on the driver; the file (a fixed few MB) goes to the executors as a broadcast variable.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(content.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin in range(0, len(texts), 500):
                encoded = [model.encode(t) for t in texts.slice(begin, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, 500), pa.array(encoded, pa.binary()), pa.array(map(model.decode, encoded), pa.string())], ["id", "ids", "decoded"]
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_bpe": op6_bpe}
