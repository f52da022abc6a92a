"""Language identification: a linear-chain conditional random field labels every word, by forward-backward.

Emissions are sums of hashed weights: the word itself (lexicon), its affixes and its byte trigrams. Transitions are
learned on sequences spliced from texts of different languages, as code-switched text is. A text's language is the one
with the largest mean posterior over its words.

Defined results: ``und`` with score 0 for null texts and texts without a letter; equal texts get equal results; an empty
table gives an empty table; without training texts everything is ``und``. Results are column expressions, so other
columns stay as they are. Texts above a few million characters are labelled in parts whose posteriors are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import WORD_BYTE, Once, blocks, bounded_sample, cut_long, documents, held_out, joined, mix, spans_of, word_hashes

ROWS = 1 << 17
LETTER_BYTE = WORD_BYTE.copy()
LETTER_BYTE[48:58] = False
#: (from the end, bytes) of the affixes that are features.
AFFIXES = ((False, 1), (False, 2), (False, 3), (True, 1), (True, 2), (True, 3), (True, 4))
#: Most texts of each language that the model is fitted on (chosen by hash of the id).
MAX_TEXTS = 250
#: UTF-8 bytes of those texts, at most.
MAX_BYTES = 8 << 20
EPOCHS, SPLICE, SEQUENCE, BATCH, RATE = 10, 40, 200, 128, 0.3
CHUNK = 64
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Word starts and ends, rows of the word-level features (one array each), and the trigram row of every byte."""
    inside = LETTER_BYTE[data]
    starts, ends = spans_of(inside)
    rows = [word_hashes(data, starts, ends)]
    for from_end, n in AFFIXES:
        a, b = (np.maximum(ends - n, starts), ends) if from_end else (starts, np.minimum(starts + n, ends))
        rows.append(mix(word_hashes(data, a, b) + np.uint64(2 * n + from_end + 1)))
    letters = np.where(inside, data, 0).astype(np.uint32)
    code = letters << np.uint32(8)
    code[1:] |= letters[:-1] << np.uint32(16)
    code[:-1] |= letters[1:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 17)
    return starts, ends, [(r % np.uint64(ROWS)).astype(np.int64) for r in rows], code


def emissions(weights: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials of all words (n, languages), and their starts."""
    starts, ends, rows, code = _features(data)
    if not len(starts):
        return np.zeros((0, weights.shape[1]), np.float32), starts
    out = sum(weights[r] for r in rows)
    inside = np.flatnonzero(LETTER_BYTE[data])
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    grams = weights[code[inside]]
    return out + np.add.reduceat(grams, firsts, axis=0), starts


def posteriors(log_emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over words of many texts in a row; ``first`` marks the words that begin a text.

    Words are cut into chunks that run side by side: a pass gives each chunk's transfer matrix, a scan over the chunks
    gives the messages that enter each, a second pass gives every word's messages. The result is the exact posterior.
    """
    n, k = log_emit.shape
    chunks = -(-n // CHUNK)
    emit = np.ones((chunks * CHUNK, k))
    emit[:n] = np.exp(log_emit - log_emit.max(1, keepdims=True))
    emit = emit.reshape(chunks, CHUNK, k).transpose(1, 0, 2).copy()
    reset = np.zeros(chunks * CHUNK, bool)
    reset[:n], reset[n:] = first, True
    reset = reset.reshape(chunks, CHUNK).T.copy()
    move, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    some = reset.any(1)
    whole = np.tile(np.eye(k), (chunks, 1, 1))
    for t in range(CHUNK):
        step = (whole.reshape(-1, k) @ move).reshape(chunks, k, k)
        if some[t]:
            r = reset[t]
            step[r] = whole[r].sum(2, keepdims=True) * begin
        step *= emit[t][:, None, :]
        whole = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.full((chunks, k), 1 / k), np.full((chunks, k), 1 / k)
    for c in range(1, chunks):
        v = enter[c - 1] @ whole[c - 1]
        enter[c] = v / v.sum()
    for c in range(chunks - 2, -1, -1):
        v = whole[c + 1] @ leave[c + 1]
        leave[c] = v / v.sum()
    ahead = np.empty_like(emit)
    a = enter
    for t in range(CHUNK):
        a = a @ move
        if some[t]:
            a[reset[t]] = begin
        a = a * emit[t]
        a = ahead[t] = a / a.sum(1, keepdims=True)
    b = leave
    out = np.empty_like(emit)
    for t in range(CHUNK - 1, -1, -1):
        p = ahead[t] * b
        out[t] = p / p.sum(1, keepdims=True)
        b = (b * emit[t]) @ move.T
        if some[t]:
            b[reset[t]] = 1
        b = b / b.sum(1, keepdims=True)
    return out.transpose(1, 0, 2).reshape(-1, k)[:n]


def word_posteriors(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word of all texts, and the number of words of each text."""
    data, offsets = joined([t.lower() for t in texts])
    log_emit, starts = emissions(model["weights"], data)
    own = np.searchsorted(starts, offsets)
    first = np.zeros(len(starts), bool)
    first[own[:-1][np.diff(own) > 0]] = True
    if not len(starts):
        return np.zeros((0, len(model["langs"]))), np.diff(own)
    return posteriors(log_emit, first, model["trans"], model["start"]), np.diff(own)


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model["langs"] else []
    parts, owner = cut_long([texts[k] for k in known])
    total, words = np.zeros((len(known), max(1, len(model["langs"])))), np.zeros(len(known))
    for begin, end in blocks(parts, 1 << 20):
        post, counts = word_posteriors(model, parts[begin:end])
        text_of = np.repeat(owner[begin:end], counts)
        for j in range(post.shape[1]):
            total[:, j] += np.bincount(text_of, weights=post[:, j], minlength=len(known))
        np.add.at(words, owner[begin:end], counts)
    best = total.argmax(1)
    for i, k in enumerate(known):
        labels[k] = model["langs"][best[i]]
        scores[k] = min(1.0, total[i, best[i]] / max(words[i], 1))
    return labels, scores


def fit(texts: list[str], langs: list[str], seed: int = 11) -> dict:
    """Maximise the likelihood of the languages of spliced word sequences by AdaGrad."""
    names = sorted(set(langs))
    k = len(names)
    model = {"langs": names, "weights": np.zeros((ROWS, k), np.float32), "trans": np.zeros((k, k)), "start": np.zeros(k)}
    rng = np.random.default_rng(seed)
    kept = [(t.lower(), names.index(g)) for t, g in zip(texts, langs, strict=True) if has_letter(t)]
    if not kept:
        return model | {"langs": []}
    data, offsets = joined([t for t, _ in kept])
    starts, ends, rows, code = _features(data)
    if k == 1 or not len(starts):
        return model
    own = np.diff(np.searchsorted(starts, offsets))
    label = np.repeat([g for _, g in kept], own)
    # Features of distinct words only; words share them.
    _, pick, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[pick]
    of_word = np.concatenate([*(np.arange(len(pick)) for _ in rows), np.repeat(np.arange(len(pick)), lengths)])
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[pick], lengths)
    feature = np.concatenate([*(r[pick] for r in rows), code[at].astype(np.int64)])
    runs = [np.arange(s, min(s + SPLICE, e)) for e, n in zip(np.cumsum(own), own, strict=True) for s in range(e - n, e, SPLICE)]
    square = {name: np.full_like(model[name], 1e-2) for name in ("weights", "trans", "start")}
    for epoch in range(EPOCHS):
        stream = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
        size = min(SEQUENCE, len(stream))
        stream = stream[: len(stream) // size * size].reshape(-1, size)
        for b in range(0, len(stream), BATCH):
            some = stream[b : b + BATCH]
            words, truth = word[some].ravel(), label[some].ravel()
            used, back = np.unique(words, return_inverse=True)
            mine = np.zeros(len(pick), bool)
            mine[used] = True
            entry = np.flatnonzero(mine[of_word])
            slot = np.searchsorted(used, of_word[entry])
            emit = np.stack([np.bincount(slot, weights=model["weights"][feature[entry], j], minlength=len(used)) for j in range(k)], axis=1)[back]
            post, pair = _pairs(emit.reshape(len(some), size, k), model["trans"], model["start"])
            n = words.size
            miss = post.reshape(-1, k)
            miss[np.arange(n), truth] -= 1
            t = truth.reshape(some.shape)
            seen = np.zeros((k, k))
            np.add.at(seen, (t[:, :-1].ravel(), t[:, 1:].ravel()), 1)
            grads = {"trans": (pair - seen) / n, "start": miss.reshape(len(some), size, k)[:, 0].sum(0) / n}
            by_word = np.stack([np.bincount(back, weights=miss[:, j], minlength=len(used)) for j in range(k)], axis=1) / n
            touched, inverse = np.unique(feature[entry], return_inverse=True)
            pull = np.stack([np.bincount(inverse, weights=by_word[slot, j], minlength=len(touched)) for j in range(k)], axis=1).astype(np.float32) * 100
            square["weights"][touched] += pull**2
            model["weights"][touched] -= RATE * pull / np.sqrt(square["weights"][touched])
            for name, g in grads.items():
                square[name] += (g * 100) ** 2
                model[name] -= RATE * g * 100 / np.sqrt(square[name])
    return model


def _pairs(log_emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected transition counts of sequences of equal length."""
    b, n, k = log_emit.shape
    emit = np.exp(log_emit - log_emit.max(2, keepdims=True))
    move, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    ahead = np.empty((n, b, k))
    a = begin * emit[:, 0]
    ahead[0] = a / a.sum(1, keepdims=True)
    for t in range(1, n):
        a = (ahead[t - 1] @ move) * emit[:, t]
        ahead[t] = a / a.sum(1, keepdims=True)
    post, back, pairs = np.empty((n, b, k)), np.ones((b, k)), np.zeros((k, k))
    for t in range(n - 1, -1, -1):
        p = ahead[t] * back
        post[t] = p / p.sum(1, keepdims=True)
        if t:
            right = back * emit[:, t]
            total = ((ahead[t - 1] @ move) * right).sum(1, keepdims=True)
            pairs += move * ((ahead[t - 1] / total).T @ right)
            back = right @ move.T
            back /= back.sum(1, keepdims=True)
    return post.transpose(1, 0, 2).copy(), pairs


def train(docs: DataFrame, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> dict:
    """Fit on at most ``max_texts`` texts of each language, of ``max_bytes`` together, from rows with a language outside the
    held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = bounded_sample(known, "lang", max_texts, max_bytes)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(spark: SparkSession, model: dict):
    """A function from a text column to a struct column (lang, score); the model goes out as a broadcast variable."""
    ready = Once(spark, model)

    @F.arrow_udf("lang string, score double")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            labels, scores = predict(ready.get(), batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return find


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    find = identify(spark, train(docs))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), find(F.col("text")).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


QUERIES = {"op2_langid": op2_langid}
