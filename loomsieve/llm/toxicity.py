"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first bytes. Filters of widths 1, 2 and 3
slide over the words, each is max-pooled over the whole text, and a logistic layer scores the pooled values. The first
component of a word's embedding begins as how much more often toxic texts hold the word than chance would have it (in
standard deviations, so that few texts say little), and the first filter reads it: small samples need no more.

Thresholds are calibrated by language: labelled rows are scored by classifiers that did not see them (cross-fitting), and
each language's scores are moved so that its own best threshold lies at CUT. The language is guessed from the text's word
beginnings, since a score has no other input than the text.

Defined results: null and empty texts and texts without words get the score of an empty text; equal texts get equal
scores; an empty table gives an empty table; without labelled rows of both classes every score is 0. Scores are a column
expression, so other columns stay as they are. Texts above 4 million characters are pooled over parts cut at white space
that overlap by more than a filter's width, which changes nothing; only one word without end longer than that is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import WORD_BYTE, Once, blocks, bounded_sample, cut_long, documents, held_out, joined, spans_of, word_hashes

WORD_ROWS, HEAD_ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 1 << 13, 16, 16, (1, 2, 3)
#: Bytes of a word that its second embedding is of.
HEAD_BYTES = 4
PAD = WORD_ROWS + HEAD_ROWS
#: Most labelled rows of class 1 and of class 0 that the classifier is fitted on (chosen by hash of the id).
MAX_TOXIC, MAX_CLEAN = 2500, 5000
#: UTF-8 bytes of each class's texts in the sample, at most.
MAX_BYTES = 24 << 20
#: Passes over the sample, at least; small samples get more, up to as many updates as STEPS.
EPOCHS, STEPS, BATCH, RATE = 3, 300, 32, 0.08
#: The score that calibrated thresholds are moved to.
CUT = 0.7
#: Parts of the sample that are scored by a classifier of the others; a language has its own threshold from so many
#: labelled texts and toxic ones on.
FOLDS, LANG_TEXTS, LANG_TOXIC = 3, 50, 10


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, (n, 2), one pad after each text; and where each text begins (one more at the end)."""
    data, offsets = joined([t.lower() for t in texts])
    starts, ends = spans_of(WORD_BYTE[data])
    own = np.searchsorted(starts, offsets)  # words before each text
    n = len(starts) + len(texts)
    rows = np.full((n, 2), PAD, dtype=np.int32)
    begins = own + np.arange(len(texts) + 1)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), np.diff(own))
    rows[at, 0] = word_hashes(data, starts, ends) % np.uint64(WORD_ROWS)
    rows[at, 1] = word_hashes(data, starts, np.minimum(ends, starts + HEAD_BYTES)) % np.uint64(HEAD_ROWS) + np.uint64(WORD_ROWS)
    return rows, begins


def _tables(model: dict) -> dict:
    """The filters applied to every embedding row, so that scoring only gathers and adds."""
    by_offset = [np.concatenate([model["emb"] @ model[f"w{w}"][j] for w in WIDTHS if w > j], axis=1) for j in range(max(WIDTHS))]
    return model | {"by_offset": by_offset}


def _pooled(model: dict, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Max over each text's windows of every filter (a window begins at each word and at the pad)."""
    wide, last = max(WIDTHS), len(rows)
    padded = np.concatenate([rows, np.full((wide - 1, 2), PAD, dtype=np.int32)])
    text_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    out = np.full((len(begins) - 1, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
    for s in range(0, last, 60_000):
        e = min(s + 60_000, last)
        some = padded[s : e + wide - 1]
        # A word of the next text counts as padding in windows that reach over the end of a text.
        same = [np.ones(e - s, bool), *(np.concatenate([text_of[s + j : e + j], np.full(max(0, e + j - last), -1)])[: e - s] == text_of[s:e] for j in range(1, wide))]
        total = None
        for j, table in enumerate(model["by_offset"]):
            found = table[some[j : j + e - s, 0]]
            found += table[some[j : j + e - s, 1]]
            if j:
                found[~same[j]] = 0
                total[:, j * FILTERS :] += found
            else:
                total = found
        first = np.flatnonzero(np.concatenate([[True], text_of[s + 1 : e] != text_of[s : e - 1]]))
        owner = text_of[s:e][first]
        out[owner] = np.maximum(out[owner], np.maximum.reduceat(total, first, axis=0))
    return out


def _languages(model: dict, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text's word beginnings in each language that has its own threshold (and in all others)."""
    words = model["speech"][rows[:, 1] - WORD_ROWS]
    return np.add.reduceat(words, begins[:-1], axis=0) if len(begins) > 1 else np.zeros((0, model["speech"].shape[1]))


def _logits(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The uncalibrated score of each text, as a logit, and the language it is taken for."""
    parts, owner = cut_long(texts, overlap=4096)
    pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
    spoken = np.zeros((len(texts), model["speech"].shape[1]))
    for begin, end in blocks(parts, 1 << 20):
        rows, begins = word_rows(parts[begin:end])
        np.maximum.at(pooled, owner[begin:end], _pooled(model, rows, begins))
        np.add.at(spoken, owner[begin:end], _languages(model, rows, begins))
    hidden = np.maximum(pooled + model["bias"], 0)
    return (hidden @ model["out"]).astype(np.float64) + model["shift"], spoken.argmax(1)


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    if model.get("void") or not len(texts):
        return np.zeros(len(texts))
    logits, lang = _logits(model, texts)
    return 1 / (1 + np.exp(-np.clip(logits + model["moves"][lang], -30, 30)))


def _speech(rows: list[np.ndarray], langs: list[str | None], own: list[str]) -> np.ndarray:
    """Log-frequencies of word beginnings: a column for each of ``own``, then one for all other languages together."""
    counts = np.full((HEAD_ROWS + 1, len(own) + 1), 0.5)
    for r, lang in zip(rows, langs, strict=True):
        column = own.index(lang) if lang in own else len(own)
        counts[:HEAD_ROWS, column] += np.bincount(r[:-1, 1] - WORD_ROWS, minlength=HEAD_ROWS)
    out = np.log(counts / counts.sum(0))
    if all(lang in own for lang in langs):
        out[:, -1] = out[:, :-1].min(1) - 1  # there are no others
    out[HEAD_ROWS] = 0  # the pad after a text
    return out.astype(np.float32)


def _surprise(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For every word row: by how many standard deviations more toxic texts hold it than chance would have it."""
    held, toxic = np.zeros(WORD_ROWS), np.zeros(WORD_ROWS)
    for r, label in zip(rows, y, strict=True):
        words = np.unique(r[:-1, 0])
        held[words] += 1
        toxic[words] += label
    p = float(y.mean())
    return (toxic - held * p) / np.sqrt(held * p * (1 - p) + 1)


def _learn(rows: list[np.ndarray], y: np.ndarray, seed: int) -> dict:
    """The classifier's weights from texts as embedding rows, by AdaGrad."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (PAD + 1, DIM)).astype(np.float32)
    emb[:, 0] = 0
    emb[:WORD_ROWS, 0] = np.clip(_surprise(rows, y), -4, 8) / 4
    emb[PAD] = 0
    model = {"emb": emb, "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), "shift": 0.0}
    model |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    model["w1"][0, :, 0] = np.eye(DIM)[0] * 2
    model["out"][0], model["bias"][0], model["shift"] = 2.0, -1.0, -2.0
    square = {k: np.full_like(v, 1e-3) for k, v in model.items() if k != "shift"}
    shift_square = 1e-3
    wide = max(WIDTHS)
    tail = np.full((wide - 1, 2), PAD, dtype=np.int32)
    epochs = max(EPOCHS, min(40, STEPS * BATCH // max(len(rows), 1)))
    for epoch in range(epochs):
        rate = RATE / (1 + 3 * epoch / epochs)
        train = rng.permutation(len(rows))
        for b in range(0, len(train), BATCH):
            some = train[b : b + BATCH]
            ids = np.concatenate([x for i in some for x in (rows[i], tail)])
            lengths = np.array([len(rows[i]) + wide - 1 for i in some])
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            x = model["emb"][ids[:, 0]] + model["emb"][ids[:, 1]]
            pooled, where = np.empty((len(some), len(WIDTHS) * FILTERS), np.float32), []
            for k, w in enumerate(WIDTHS):
                c = x @ model[f"w{w}"][0]
                for j in range(1, w):
                    c[:-j] += x[j:] @ model[f"w{w}"][j]
                at = np.stack([c[s : s + n - wide + 1].argmax(0) + s for s, n in zip(begins, lengths, strict=True)])
                pooled[:, k * FILTERS : (k + 1) * FILTERS] = c[at, np.arange(FILTERS)]
                where.append(at)
            hidden = np.maximum(pooled + model["bias"], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["shift"], -30, 30)))
            g = (p - y[some]) / len(some)
            gh = np.outer(g, model["out"]) * (hidden > 0)
            grads = {"out": hidden.T @ g, "bias": gh.sum(0)}
            touched, pulls = [], []
            for k, w in enumerate(WIDTHS):
                own = gh[:, k * FILTERS : (k + 1) * FILTERS]
                weights = model[f"w{w}"]
                grads[f"w{w}"] = np.stack([np.einsum("bf,bfd->df", own, x[where[k] + j]) for j in range(w)])
                for j in range(w):
                    pull = (own[:, :, None] * weights[j].T[None]).reshape(-1, DIM)
                    for column in (0, 1):
                        touched.append(ids[(where[k] + j).ravel(), column])
                        pulls.append(pull)
            at = np.concatenate(touched)
            order = np.argsort(at)
            firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
            unique, summed = at[order[firsts]], np.add.reduceat(np.concatenate(pulls)[order], firsts, axis=0)
            summed[unique == PAD] = 0
            square["emb"][unique] += summed**2
            model["emb"][unique] -= rate * summed / np.sqrt(square["emb"][unique])
            for name, grad in grads.items():
                square[name] += grad**2
                model[name] -= (rate * grad / np.sqrt(square[name])).astype(np.float32)
            shift_square += float(g.sum()) ** 2
            model["shift"] -= rate * float(g.sum()) / np.sqrt(shift_square)
    return model


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> dict:
    """Fit on the texts. The result's size doesn't depend on the texts, but for a column for each language."""
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return {"void": True}
    langs = [None if g is None else str(g) for g in langs]
    rows = [word_rows([t])[0] for t in texts]
    own = sorted({g for g in langs if g is not None and (mine := np.array([x == g for x in langs])).sum() >= LANG_TEXTS and y[mine].sum() >= LANG_TOXIC and (1 - y[mine]).sum() >= LANG_TOXIC})
    speech = _speech(rows, langs, own)
    # Each class is dealt evenly to the folds.
    fold = np.empty(len(y), dtype=int)
    rng = np.random.default_rng(seed)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        fold[rng.permutation(at)] = np.arange(len(at)) % FOLDS
    logits, guess = np.zeros(len(y)), np.zeros(len(y), dtype=int)
    for k in range(FOLDS):
        seen, unseen = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(unseen) and y[seen].min() < y[seen].max():
            part = _tables(_learn([rows[i] for i in seen], y[seen], seed) | {"speech": speech})
            logits[unseen], guess[unseen] = _logits(part, [texts[i] for i in unseen])
    cut = np.log(CUT / (1 - CUT))
    common = cut - _threshold(logits, y)
    moves = np.full(len(own) + 1, common)
    for k in range(len(own)):
        mine = guess == k
        if mine.sum() >= LANG_TEXTS and min(y[mine].sum(), (1 - y[mine]).sum()) >= LANG_TOXIC:
            moves[k] = cut - _threshold(logits[mine], y[mine])
    return _learn(rows, y, seed) | {"speech": speech, "moves": moves, "languages": own}


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """In the middle of the widest gap among cuts of nearly the best F1, so that neither class sits at the edge."""
    grid = np.sort(np.concatenate([[-8.0], np.clip(logits, -8, 8), [8.0]]))
    middles = (grid[1:] + grid[:-1]) / 2
    pos = np.sort(logits[y == 1])
    neg = np.sort(logits[y == 0])
    tp = len(pos) - np.searchsorted(pos, middles)
    fp = len(neg) - np.searchsorted(neg, middles)
    f1 = 2 * tp / np.maximum(tp + fp + len(pos), 1)
    near = f1 >= f1.max() - 0.002
    return float(middles[np.where(near, np.diff(grid), -1).argmax()])


def labelled(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> list[tuple[str, int, str | None]]:
    """The bounded sample that the classifier learns from: (text, label, language) of rows outside the held-out fold. An id
    that is labelled both ways counts as toxic. Ids are drawn before they meet texts, so that texts aren't shuffled; labels
    without a document take their share of the draw."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # max_toxic + max_clean rows at most
    return [(r["text"], int(r["toxic"]), r["lang"]) for r in bounded_sample(rows, "toxic", {1: max_toxic, 0: max_clean}, max_bytes)]


def train(docs: DataFrame, labels: DataFrame) -> dict:
    rows = labelled(docs, labels)
    return fit([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows])


def scorer(spark: SparkSession, model: dict):
    """A function from a text column to its score column; the model (a fixed 3 MB) goes out as a broadcast variable."""
    ready = Once(spark, model, lambda m: m if m.get("void") else _tables(m))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(score_texts(ready.get(), [t or "" for t in batch.to_pylist()]), pa.float64())

    return score


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows whose score is below CUT, where the threshold of every language lies, with the columns they had."""
    score = scorer(docs.sparkSession, model)
    return docs.filter(score(F.col(text_col)) < CUT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = scorer(spark, train(docs, documents(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.select("*", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
