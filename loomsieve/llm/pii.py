"""Personal data: exact base patterns, extended by a skip-chain conditional random field.

Nodes are the tokens that hold a digit or an at sign; every other token can only be "none", so messages through it are
constant and it need not be a node. Neighbouring nodes share a transition potential. Repeated tokens of a document, and
similar ones (half of a long number, or an address's local part), share skip potentials however distant they are, with the
occurrence before and with the first, so evidence passes in two steps; loopy belief propagation runs until a document's
messages settle. Tokens that the field is sure about and no base match touches are added spans, neighbours of one kind as one.
The field reads every text that holds such a token, with a base match or without.

The base matches are certain, so the field is fitted on what they leave out: training texts get spoiled repeats of their
own matches (a local number, a mistyped or regrouped card, a cut address), labelled as the match is, and spoiled matches
of other texts, which repeat nothing and are labelled as none. So it learns that such a token is personal data where the
document says so elsewhere, and not by its looks. They also get whole phone numbers and cards with another number behind
them, which the greedy patterns read as one that is too long and drop; those are labelled as what they are. Secrets have no base
pattern: long words that training texts assign to a name as token or password are labelled so, and their repeats elsewhere.

Defined results: null and empty texts have no spans; equal texts get equal spans; offsets are code points, ends are
exclusive; an empty table gives an empty table; without training texts only base matches are found. Results are column
expressions, so other columns stay as they are. Every scan is linear in the text, also for one unbroken token.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import Once, bounded_sample, documents

#: Kinds that have base patterns, and those that the field tells apart.
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
_RANK = {k: i for i, k in enumerate(LABELS)}
#: Hashed feature rows; most texts the field is fitted on; a token is added from this posterior on.
ROWS, MAX_TEXTS, SURE = 1 << 13, 3000, 0.9
EPOCHS, RATE, DAMPING = 300, 0.5, 0.3
#: UTF-8 bytes of those texts, at most.
MAX_BYTES = 32 << 20
#: Messages of a document settle when none moves by more; loops that don't settle end after so many rounds.
SETTLED, ROUNDS = 1e-4, 100
#: Potentials of the edges: neighbours, repeated tokens, similar tokens.
EDGES = ("chain", "same", "similar")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so later digits of the run need no attempt.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ENTITY = re.compile("[0-9@]")
#: What a training text says is a secret: a long word that is assigned to a name of one.
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s{0,8}[=:]\s{0,8}["']?([A-Za-z0-9+/_-]{16,})""")
_LONG_WORD = re.compile("[A-Za-z0-9+/_-]{16,}")
_NO_WORD = re.compile(r"[^\w=:]+")
_SPACE = re.compile(r"\s")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile(r"[^\W\d_]")
_LONG_RUN = re.compile(r"(.)\1\1+", re.DOTALL)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four patterns that pass their tests: (kind, start, end), by start and then kind."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Long words with a digit that are assigned to a name of a secret: what the field learns secrets from."""
    return [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text) if _DIGIT.search(m[1])]


def overlong(text: str) -> list[tuple[str, int, int]]:
    """What the phone and card patterns read as one number of too many digits: what it holds isn't known."""
    found = [("card", m.start(), m.end()) for m in _CARD.finditer(text) if sum("0" <= c <= "9" for c in m[0]) > 19]
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if sum("0" <= c <= "9" for c in m[0]) > 15] if "+" in text else []
    return sorted(found, key=lambda s: s[1])


# --- the graph of a text ---------------------------------------------------------------------------------------


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or an at sign."""
    out, end = [], 0
    m = _ENTITY.search(text)
    while m:
        start = max(text.rfind(c, end, m.start()) for c in " \n\t\r\f\v") + 1 or end
        white = _SPACE.search(text, m.end())
        end = white.start() if white else len(text)
        out.append((start, end))
        m = _ENTITY.search(text, end)
    return out


def _shape(token: str) -> str:
    """Digits as 9 and letters as a, runs of three or more cut to two."""
    return _LONG_RUN.sub(r"\1\1", _LETTER.sub("a", _DIGIT.sub("9", token)))


def _row(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % ROWS


def _keys(token: str) -> list[tuple[str, str, str]]:
    """What links a token to others of its document: (potential, name, value)."""
    core = "".join(c for c in token if c.isalnum() or c == "@").lower()
    digits = "".join(_DIGIT.findall(token))
    keys = [("same", "core", core)]
    if len(digits) >= 7:
        keys.append(("same", "tail", digits[-7:]))
    if len(digits) >= 12:  # one wrong digit leaves one of the halves
        keys += [("similar", "head", digits[: len(digits) // 2]), ("similar", "half", digits[len(digits) // 2 :])]
    elif "." in token or "-" in token:
        keys.append(("similar", "digits", digits))
    if "@" in token and len(local := token.split("@")[0].lstrip("([{<\"',;:").lower()) >= 4:
        keys.append(("similar", "local", local))
    return keys


def _words_before(text: str, at: int, count: int = 2, reach: int = 40) -> list[str]:
    """The last words before a place, the nearest first; empty ones where there are fewer."""
    words = _NO_WORD.sub(" ", text[max(0, at - reach) : at].lower()).split()[-count:][::-1]
    return words + [""] * (count - len(words))


def graph(text: str, at: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> tuple[list[list[int]], dict[str, list[tuple[int, int]]]]:
    """Feature rows of each node, and the edges of each potential. ``spans`` are the base matches, sorted: the first token
    of one also has the whole match's links."""
    features: list[list[int]] = []
    edges: dict[str, list[tuple[int, int]]] = {name: [] for name in EDGES}
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    shapes = [_shape(text[s:e]) for s, e in at]
    k = 0
    for i, (s, e) in enumerate(at):
        token = text[s:e]
        core = sum(c.isalnum() or c == "@" for c in token)
        digits = len(_DIGIT.findall(token))
        near = bool(i) and not text[at[i - 1][1] : s].strip()
        after = i + 1 < len(at) and not text[e : at[i + 1][0]].strip()
        features.append([
            _row("bias"), _row("shape", shapes[i]), _row("digits", min(digits, 20)), _row("head", token[0], token[-1]),
            _row("counts", token.count("@"), min(token.count("."), 4), min(token.count("-"), 4)), _row("all", digits == core),
            _row("check", 12 <= digits <= 19 and luhn("".join(_DIGIT.findall(token)))),
            _row("before", shapes[i - 1] if near else ""), _row("after", shapes[i + 1] if after else ""),
            *(_row("word", n, w) for n, w in enumerate(_words_before(text, s))), _row("long", min(core // 8, 8), digits == core), _row("assigned", bool(_SECRET.search(token))),
        ])
        if near:
            edges["chain"].append((i - 1, i))
        keys = _keys(token)
        while k < len(spans) and spans[k][1] < e:
            keys += _keys(text[spans[k][1] : spans[k][2]])
            k += 1
        # The occurrence before and the first: a third of a text may share one key, and still has two edges a token.
        done: set[int] = {i, i - 1} if near else {i}
        for kind in ("same", "similar"):
            linked = {j for key in keys if key[0] == kind for j in (last.get(key), first.get(key)) if j is not None}
            edges[kind] += [(j, i) for j in sorted(linked - done)]
            done |= linked
        for key in keys:
            first.setdefault(key, i)
            last[key] = i
    return features, edges


def _propagate(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Beliefs by damped loopy belief propagation; potentials (edges, from, to) are exponentials. A text's messages stop
    when they have settled, so its beliefs don't depend on the texts beside it."""
    n, k = unary.shape
    node = np.log(np.exp(unary - unary.max(1, keepdims=True)) + 1e-12)
    half = len(edges)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    both = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    message = np.full((2 * half, k), 1 / k)
    live = np.arange(2 * half)
    for _ in range(ROUNDS):
        if not len(live):
            break
        total = node.copy()
        np.add.at(total, target[live], np.log(message[live]))
        send = total[source[live]] - np.log(message[back[live]])
        send = np.exp(send - send.max(1, keepdims=True))
        new = np.einsum("ek,ekj->ej", send, both[live])
        new /= new.sum(1, keepdims=True)
        new = np.maximum(DAMPING * message[live] + (1 - DAMPING) * new, 1e-12)
        moved = np.zeros(text_of[-1] + 1)
        np.maximum.at(moved, text_of[target[live]], np.abs(new - message[live]).max(1))
        message[live] = new
        live = live[moved[text_of[target[live]]] > SETTLED]
    total = node
    np.add.at(total, target, np.log(message))
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def _overlaps(at: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """For each token the label of the first span that touches it, 0 where none does. Both lists are sorted."""
    out, k = [0] * len(at), 0
    reach: list[tuple[str, int, int]] = []
    for i, (s, e) in enumerate(at):
        reach = [x for x in reach if x[2] > s]
        while k < len(spans) and spans[k][1] < e:
            if spans[k][2] > s:
                reach.append(spans[k])
            k += 1
        if reach:
            out[i] = 1 + _RANK[min(reach, key=lambda x: (x[1], _RANK[x[0]]))[0]]
    return out


def spoiled(kind: str, match: str, rng: np.random.Generator) -> str:
    """A match as a later mention may have it, so that no base pattern takes it for its kind."""
    digits = "".join(_DIGIT.findall(match))
    if kind == "phone":
        return (f"{digits[-7:-4]}-{digits[-4:]}", digits[-10:], f"{digits[-7:-4]}.{digits[-4:]}")[rng.integers(3)]
    if kind == "card":
        if rng.integers(2):
            at = int(rng.integers(len(digits)))
            return digits[:at] + str((int(digits[at]) + int(rng.integers(1, 10))) % 10) + digits[at + 1 :]
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "email":
        local, domain = match.split("@", 1)
        return f"{local}@{domain.split('.')[0]}"
    return match.replace(".", "-")


def _other(match: str, rng: np.random.Generator) -> str:
    """A match of the same look with its own letters and digits."""
    return "".join(str(rng.integers(10)) if c in "0123456789" else chr(97 + rng.integers(26)) if c.isalpha() else c for c in match)


def swallowed(kind: str, match: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A phone number or card with a number behind it, so that the pattern reads both as one; and (start, end, label) of the
    tokens, but for an address behind a phone number, which has its own pattern."""
    address = kind == "phone" and rng.integers(2)
    behind = ".".join(str(rng.integers(1, 256)) for _ in range(4)) if address else str(rng.integers(10 ** int(rng.integers(5, 10))) + 10**5)
    made = f"{match} {behind}"
    own = [(s, e, 1 + _RANK[kind] if e <= len(match) else 0) for s, e in tokens(made)]
    return made, own[:-1] if address else own


def spoil(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with spoiled repeats of its own matches, of made-up ones, and swallowed ones put between its words: (text,
    (start, end, label) of each of their tokens, label 0 for made-up ones)."""
    known, secrets = base_spans(text), secret_spans(text)
    if not known and not secrets:
        return text, []
    extra: list[tuple[str, list[tuple[int, int, int]]]] = []
    for kind, s, e in known[:: max(1, len(known) // 8)]:
        for token, label in ((text[s:e], 1 + _RANK[kind]), (_other(text[s:e], rng), 0)):
            if rng.integers(2):
                made = spoiled(kind, token, rng)
                extra.append((made, [(0, len(made), label)]))
        if kind in ("phone", "card") and rng.integers(2):
            extra.append(swallowed(kind, text[s:e], rng))
    for _, s, e in secrets[:8]:
        for made, label in ((text[s:e], 1 + _RANK["secret"]), ("".join(rng.choice(list("0123456789abcdef"), e - s)), 0)):
            if rng.integers(2):
                extra.append((made, [(0, len(made), label)]))
    gaps = [m.start() for m in _SPACE.finditer(text) if not any(s < m.start() < e for _, s, e in known)] or [len(text)]
    places = sorted((gaps[int(rng.integers(len(gaps)))], i) for i in range(len(extra)))
    out, marks, at, size = [], [], 0, 0
    for place, i in places:
        made, own = extra[i]
        out += [text[at:place], " and " + made + " and"]
        size += place - at + 5
        marks += [(size + s, size + e, label) for s, e, label in own]
        size += len(made) + 4
        at = place
    return "".join([*out, text[at:]]), marks


def _truth(at: list[tuple[int, int]], spans: list[tuple[str, int, int]], secrets: list[tuple[str, int, int]], marks: list[tuple[int, int, int]]) -> list[int]:
    wanted = {(s, e): label for s, e, label in marks}
    return [wanted.get(span, label or other) for span, label, other in zip(at, _overlaps(at, spans), _overlaps(at, secrets), strict=True)]


def fit(texts: list[str]) -> dict:
    """Pseudo-likelihood: each node given the labels of its neighbours, by AdaGrad; each text as it is and spoiled."""
    k = len(LABELS) + 1
    model = {"unary": np.zeros((ROWS, k)), **{name: np.zeros((k, k)) for name in EDGES}}
    features, truth, counts = [], [], []
    found: dict[str, list[tuple[int, int]]] = {name: [] for name in EDGES}
    rng = np.random.default_rng(11)
    for text in texts:
        for some, marks in ((text, []), spoil(text, rng)):
            at, spans = tokens(some), base_spans(some)
            f, edges = graph(some, at, spans)
            n = len(truth)
            own = _truth(at, spans, secret_spans(some), marks)
            marked = {(s, e) for s, e, _ in marks}
            # Tokens of numbers that are too long teach nothing, but for those that were put there.
            counts += [float(label > 0 or span in marked or not far) for span, label, far in zip(at, own, _overlaps(at, overlong(some)), strict=True)]
            truth += own
            features += f
            for name in EDGES:
                found[name] += [(a + n, b + n) for a, b in edges[name]]
    if not truth:
        return model
    rows, y = np.array(features), np.array(truth)
    links = {name: np.array(e, dtype=np.int64).reshape(-1, 2) for name, e in found.items()}
    want, share = np.eye(k)[y], (np.array(counts) / len(y))[:, None]
    square = {name: np.full_like(v, 1e-6) for name, v in model.items()}
    for _ in range(EPOCHS):
        score = model["unary"][rows].sum(1)
        for name, e in links.items():
            np.add.at(score, e[:, 1], model[name][y[e[:, 0]]])
            np.add.at(score, e[:, 0], model[name].T[y[e[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = (p / p.sum(1, keepdims=True) - want) * share
        pulls = np.repeat(miss, rows.shape[1], axis=0)
        grads = {"unary": np.stack([np.bincount(rows.ravel(), weights=pulls[:, j], minlength=ROWS) for j in range(k)], axis=1)}
        for name, e in links.items():
            g = np.zeros((k, k))
            np.add.at(g, y[e[:, 0]], miss[e[:, 1]])
            np.add.at(g.T, y[e[:, 1]], miss[e[:, 0]])
            grads[name] = g if name == "chain" else (g + g.T) / 2  # the order of two distant tokens says nothing
        for name, g in grads.items():
            g = g + 1e-6 * model[name]
            square[name] += g**2
            model[name] -= RATE * g / np.sqrt(square[name])
    return model


def added_spans(model: dict, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Tokens that the field is sure to be personal data and no base match touches; neighbours of one kind are one span."""
    where, features, edges, kinds, taken, text_of = [], [], [], [], [], []
    for k, text in enumerate(texts):
        at = tokens(text)
        if at:
            f, links = graph(text, at, bases[k])
            n = len(features)
            features += f
            for i, name in enumerate(EDGES):
                edges += [(a + n, b + n) for a, b in links[name]]
                kinds += [i] * len(links[name])
            taken += _overlaps(at, bases[k])
            text_of += [len(where)] * len(at)
            where.append((k, n, at))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not features:
        return out
    both = np.exp(np.stack([model[name] for name in EDGES]))
    unary, seen = model["unary"][np.array(features)].sum(1), np.array(taken)
    unary[seen > 0] += 20 * np.eye(unary.shape[1])[seen[seen > 0]]  # base matches are observed
    belief = _propagate(unary, np.array(edges, dtype=np.int64).reshape(-1, 2), both[np.array(kinds, dtype=int)], np.array(text_of))
    best = belief.argmax(1)
    sure = (belief.max(1) >= SURE) & (best > 0) & (seen == 0)
    for k, n, at in where:
        text, runs = texts[k], []
        for i in np.flatnonzero(sure[n : n + len(at)]).tolist():
            kind, (s, e) = LABELS[best[n + i] - 1], at[i]
            if kind == "secret":  # without its name and what else stands in the token
                m = _SECRET.search(text, s, e)
                s, e = m.span(1) if m else m.span() if (m := _LONG_WORD.search(text, s, e)) else (s, e)
            if runs and runs[-1][0] == kind and kind in ("phone", "card") and runs[-1][3] == i - 1 and not text[runs[-1][2] : s].strip(" "):
                runs[-1][2:] = [e, i]
            else:
                runs.append([kind, s, e, i])
        for kind, s, e, _ in runs:
            token = text[s:e]
            s, e = s + len(token) - len(token.lstrip("([{<\"',;:")), e - len(token) + len(token.rstrip(")]}>\"',;:.!?"))
            if s < e:
                out[k].append((kind, s, e))
    return out


def find(model: dict, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text, sorted by start and then kind."""
    bases = [base_spans(t) for t in texts]
    added = added_spans(model, texts, bases)
    return bases, [sorted(b + a, key=lambda s: (s[1], _RANK[s[0]], s[2])) if a else b for b, a in zip(bases, added, strict=True)]


def train(docs: DataFrame, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES, text_col: str = "text") -> dict:
    """Fit on at most ``max_texts`` texts that hold a digit or an at sign, of ``max_bytes`` together, chosen by hash of the
    text."""
    known = docs.select(F.col(text_col).alias("text"), F.lit(0).alias("one"), F.lit(0).alias("doc_id")).filter(F.col("text").rlike("[0-9@]"))
    return fit([r["text"] for r in bounded_sample(known, "one", max_texts, max_bytes)])


def finder(spark: SparkSession, model: dict):
    """From a text column to struct(base, spans), both array<struct<kind,start,end>>; the model goes out as a broadcast."""
    ready = Once(spark, model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bases, spans = find(ready.get(), [t or "" for t in batch.to_pylist()])
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in rows], pa.list_(span)) for rows in (bases, spans)]
            yield pa.StructArray.from_arrays(columns, ["base", "spans"])

    return run


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by the first one's kind, as in <email>."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with every span of the text column replaced. Texts without spans, and nulls, stay."""
    ready = Once(docs.sparkSession, model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            _, spans = find(ready.get(), [t or "" for t in texts])
            yield pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())

    return docs.withColumn(text_col, run(F.col(text_col)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns; also n_spans, how many spans a text has with the added ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    run = finder(spark, train(docs))
    out = docs.select("doc_id", run(F.col("text")).alias("found")).select("doc_id", F.col("found.base").alias("base"), F.col("found.spans").alias("spans"))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return out.select("doc_id", *map(count, KINDS), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n_spans)


QUERIES = {"op10_pii": op10_pii}
