import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsieve.llm import neardup, sketches, suffixes
from loomsieve.llm.common import components, text_key


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 10), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = re.findall(r"[^\t\n\x0b\x0c\r ]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter()


def test_near_classes_against_all_pairs(docs, corpus):
    texts = sorted({t or "" for _, t, _, _ in corpus})
    df = Counter(g for _, t, _, _ in corpus for g in shingles(t or ""))
    n = len(corpus)
    weights = {t: {g: c * (1 + math.log((1 + n) / (1 + df[g])) / math.log(2 + n)) for g, c in shingles(t).items()} for t in texts}
    pairs = []
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = sum(min(w, weights[b].get(g, 0)) for g, w in weights[a].items())
            either = sum(weights[a].values()) + sum(weights[b].values()) - both
            if either and both / either >= 0.8:
                pairs.append((b, a))
    root = roots(pairs, texts)
    least = defaultdict(list)
    for i, t, _, _ in corpus:
        least[root[t or ""]].append(i)
    classes = neardup.near_classes(docs).collect()
    by_key = {bytes(r["key"]): r["class_id"] for r in classes}
    assert len(by_key) == len(texts)
    for t in texts:
        assert by_key[hashlib.md5(t.encode()).digest()] == min((i for i in least[root[t]] if i is not None), default=None)
    kept = neardup.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(root.values()))
    assert {root[r["text"] or ""] for r in kept} == set(root.values())
    assert sorted(kept[0].asDict()) == sorted(docs.columns)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_leftover_parts_are_compared(spark):
    """Chains of near copies: neighbours are alike, the ends are not, so one representative can't find all links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 200])) for k in range(30)]
    got = {r["class_id"] for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_long_texts_are_cut_without_loss():
    text = " ".join(f"w{i * i % 997}" for i in range(3000))
    whole = Counter(neardup.shingles([text])[0].tolist())
    parts = neardup._parts(text, 400, 5)
    assert len(parts) > 5 and Counter(h for p in parts for h in neardup.shingles([p])[0].tolist()) == whole


def test_samples_agree_as_often_as_texts_do():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    w = rng.uniform(1, 2, 300)
    a, b = slice(0, 250), slice(50, 300)
    sig = neardup.signature(np.concatenate([codes[a], codes[b]]), np.concatenate([w[a], w[b]]), np.array([0, 250]), bands=600, rows=1)
    j = w[50:250].sum() / w.sum()
    assert abs((sig[0] == sig[1]).mean() - j) < 0.07


def removed(texts, length):
    counts = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        flags = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                flags[k : k + length] = True
        runs = int(np.diff(np.concatenate(([0], flags.astype(int)))).clip(0).sum())
        out.append((len(b), int(flags.sum()), runs, bytes(x for x, f in zip(b, flags) if not f)))
    return out


@pytest.mark.parametrize("length,limits", [(400, {}), (90, {}), (90, {"crowd": 1, "bundle": 4000})])
def test_repeats_against_counting_all_windows(docs, corpus, length, limits):
    want = removed([(t or "").encode() for _, t, _, _ in corpus], length)
    got = suffixes.remove_repeats(docs, length, **limits).collect()
    assert Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter((c[0], *w) for c, w in zip(corpus, want))
    assert "key" in got[0]["row"].asDict() and sum(w[1] for w in want) > 0
    assert suffixes.remove_repeats(docs.limit(0), length).count() == 0


@pytest.mark.parametrize("limits", [{}, {"crowd": 1, "bundle": 4000}])
def test_shorter_passages_are_all_counted(spark, docs, corpus, limits):
    """n_repeated covers every string of 200 bytes that starts anywhere else, also where no 400 bytes around it repeat."""
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passages = [letters(n) for n in (199, 200, 201, 230, 260, 300, 336, 380, 399, 400, 450) * 4]
    # Between texts, twice in one text, as a whole text, and at both ends.
    texts = [letters(int(rng.integers(500))) + p + letters(int(rng.integers(500))) for p in passages for _ in range(2)]
    texts += [p + letters(50) + p for p in passages[:11]] + [letters(210)] * 3 + [letters(220), "é" * 130, None, ""]
    rows = [(1000 + k, t) for k, t in enumerate(texts)] + [(i, t) for i, t, _, _ in corpus]
    encoded = [(t or "").encode() for _, t in rows]
    want = Counter((i, long[1], short[1]) for (i, _), long, short in zip(rows, removed(encoded, 400), removed(encoded, 200)))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 400, **limits).collect()
    assert Counter((r["row"]["doc_id"], r["n_removed"], r["n_repeated"]) for r in got) == want


def test_shorter_passages_over_blocks(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    rng = np.random.default_rng(6)
    a = bytes(rng.integers(97, 123, 9000).astype(np.uint8)).decode()
    # The last text's end behind its first block is too short for a long string.
    texts = [a[:5000], "x" * 7 + a[700:1000] + "y" + a[1900:2110] + "z" + a[2800:3300] + a[6000:6900], a[5600:8000], a[8000:] + a[900:1250]]
    encoded = [t.encode() for t in texts]
    want = {k: (long[1], short[1]) for k, (long, short) in enumerate(zip(removed(encoded, 400), removed(encoded, 200)))}
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).collect()
    assert {r["row"]["doc_id"]: (r["n_removed"], r["n_repeated"]) for r in got} == want


def test_interval_expansion_on_random_texts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length = int(rng.integers(2, 30))
        base = [bytes(rng.integers(97, 97 + int(rng.integers(2, 4)), int(rng.integers(1, 90))).astype(np.uint8)) for _ in range(4)]
        segments = [base[rng.integers(4)] + base[rng.integers(4)] for _ in range(int(rng.integers(1, 8)))]
        weights = [int(rng.choice([1, 1, 1, 2])) for _ in segments]
        counts = Counter(s[k : k + length] for s, w in zip(segments, weights) for _ in range(w) for k in range(len(s) - length + 1))
        repeated, head, begins = suffixes.repeated_starts(segments, [[(0, max(len(s) - length + 1, 0), w)] for s, w in zip(segments, weights)], length)
        assert head.sum() == sum(n > 1 for n in counts.values())
        for s, b in zip(segments, begins):
            assert [bool(x) for x in repeated[b : b + len(s) + 1]] == [counts[s[k : k + length]] > 1 if k + length <= len(s) else False for k in range(len(s) + 1)]


def test_a_crowded_anchor_takes_bounded_memory():
    """Kinds that share one line, as many as an anchor has in a bundle: in bytes that its bound lets in, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa, pyarrow.compute
from loomsieve.llm import suffixes
rng = np.random.default_rng(1)
size = 735
count = suffixes.CROWD_BYTES // size
line = rng.integers(97, 123, 80).astype(np.uint8).tobytes()
pieces = [rng.integers(97, 123, 327).astype(np.uint8).tobytes() + line + rng.integers(97, 123, 328).astype(np.uint8).tobytes() for _ in range(count)]
pieces[7] = pieces[8][:500] + pieces[7][500:]
kind = [('anchor', pa.int64()), ('content', pa.int64()), ('check', pa.int64()), ('weight', pa.int64()), ('parts', pa.int32()), ('alone', pa.bool_()), ('off', pa.int32()), ('size', pa.int32())]
members = [[dict(anchor=1, content=i, check=i, weight=1, parts=4, alone=False, off=0, size=size)] for i in range(count)]
table = pa.table({'rid': pa.array([str(i).encode() for i in range(count)], pa.binary()), 'start': pa.array([0] * count, pa.int32()), 'members': pa.array(members, pa.list_(pa.struct(kind))), 'bytes': pa.array(pieces, pa.binary())})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = suffixes._expand_bundle(400)(table)
windows = pa.compute.sum(pa.compute.list_value_length(out.column('loose'))).as_py()
assert windows == count * (size - 399) - 101, windows
assert out.column('spans').to_pylist()[7] == out.column('spans').to_pylist()[8] == [0, 500]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) < 600


def test_all_repeats_come_out_of_the_expansion(docs, monkeypatch):
    def finds_nothing(length):
        def run(table):
            found = [m for own in table.column("members").to_pylist() for m in own]
            n = len(found)
            return pa.table({**{k: pa.array([m[k] for m in found], pa.int64()) for k in suffixes.KIND}, **{k: pa.array([[]] * n, pa.list_(pa.int32())) for k in ("spans", "also")}, "whole": pa.array([False] * n), "loose": pa.nulls(n, pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64()), ("at", pa.int32())])))})

        return run

    monkeypatch.setattr(suffixes, "_expand_bundle", finds_nothing)
    assert suffixes.remove_repeats(docs, 90).agg(F.sum("n_removed")).first()[0] == 0


def test_blocks_of_long_texts(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    rng = np.random.default_rng(2)
    a = bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode()
    texts = [a[:3000], "x" + a[1000:4200], a[3900:] + "tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, 100).collect()}
    assert got == dict(enumerate(removed([t.encode() for t in texts], 100)))


def test_sketches(spark, docs, corpus):
    df = sketches.with_sketch(docs, "text", "mark", scale=4)
    rows = df.select("doc_id", "text", "mark").collect()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(tuple(r["mark"]))
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {()} and len(next(iter(by_text["one"]))) == 1
    everything = {r["doc_id"]: set(r["mark"]) for r in sketches.with_sketch(docs.filter("doc_id < 300"), "text", "mark", scale=1).select("doc_id", "mark").collect()}
    some = {r["doc_id"]: set(r["mark"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 300}
    limit = -(1 << 63) + (1 << 64) // 4
    assert all(some[i] == ({h for h in v if h < limit} or ({min(v)} if v else set())) for i, v in everything.items())
    pair = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([], [1])], "a array<bigint>, b array<bigint>")
    got = pair.select(sketches.likeness(F.col("a"), F.col("b")), sketches.containment(F.col("a"), F.col("b")), sketches.merge(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 2 / 3, [1, 2, 3, 4]), (1.0, 1.0, []), (0.0, 1.0, [1])]


def test_next_row_in_bounded_ranges(spark, docs, corpus):
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in sketches.with_next(df, "doc_id", ["text"], "text").collect())
    order = sorted(((i is not None, i or 0, t or "") for i, t, _, _ in corpus))
    want = Counter((i if known else None, t, order[(k + 1) % len(order)][2]) for k, (known, i, t) in enumerate(order))
    assert got == want
    assert sketches.with_next(df.limit(0), "doc_id", ["text"], "text").count() == 0
    one = sketches.with_next(df.filter("doc_id = 600"), "doc_id", ["text"], "text").first()
    assert one["text"] == one["next_text"]


def test_text_key_takes_null_as_empty(spark):
    a, b = spark.createDataFrame([(None,), ("",)], "t string").select(text_key(F.col("t"))).collect()
    assert a == b
