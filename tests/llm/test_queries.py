"""Every opN query on a written fixture: all contract columns against a plain version of each."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsieve import llm
from loomsieve.llm import sketches

from test_dedup import removed
from test_others import brute_links, plain_spans

QUERIES = llm.queries()
FOLD = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    rows = [(k, (base[k % 12] + rng.normal(size=6) * rng.choice([0.05, 0.3])).tolist()) for k in range(90)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0, -2.0])]
    # Of one direction, though their squares overflow, vanish or are ordinary.
    rows += [(206, [1e200, 1e200]), (207, [1.0, 1.0]), (208, [1e-200, 1e-200]), (5, rows[5][1]), (None, rows[6][1])]
    return rows


@pytest.fixture(scope="module")
def tables(spark, docs, labels, vectors, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def rows_of(spark, tables, name):
    return QUERIES[next(n for n in QUERIES if n.startswith(name))](spark, tables).collect()


def test_op1(spark, tables, corpus):
    got = rows_of(spark, tables, "op1_")
    assert Counter(r["doc_id"] for r in got) == Counter(c[0] for c in corpus)
    texts = {i: t or "" for i, t, _, _ in corpus}
    classes = defaultdict(set)
    for r in got:
        assert r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["class_id"])
        if r["doc_id"] is not None:
            classes[texts[r["doc_id"]]].add(r["class_id"])
    assert all(len(v) == 1 for v in classes.values())


def test_op2(spark, tables, corpus):
    got = rows_of(spark, tables, "op2_")
    texts = {i: t or "" for i, t, _, _ in corpus}
    assert len(got) == len(corpus)
    for r in got:
        assert r["held_out"] == FOLD(r["doc_id"]) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]])))
    said = {i: g for i, _, g, _ in corpus if i is not None and i < 240}  # prose of one language each
    right = [r["lang_pred"] == said[r["doc_id"]] for r in got if r["doc_id"] in said and r["held_out"]]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)


def test_op3(spark, tables, corpus):
    got = rows_of(spark, tables, "op3_")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in Counter(c[0] for c in corpus).items():
        if n > 1 or i is None:  # their pieces can't be told apart
            continue
        text = next(c[1] for c in corpus if c[0] == i)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_op4(spark, tables, corpus):
    texts = [(t or "").encode() for _, t, _, _ in corpus]
    want = Counter((c[0], n, gone, runs, hashlib.sha256(kept).hexdigest()) for c, (n, gone, runs, kept) in zip(corpus, removed(texts, 400)))
    got = rows_of(spark, tables, "op4_")
    assert Counter(tuple(r)[:5] for r in got) == want
    # n_repeated: at least what was removed, and never a byte that no repeated string of 200 bytes covers.
    most = defaultdict(list)
    for c, w in zip(corpus, removed(texts, 200)):
        most[c[0]].append(w[1])
    assert all(r["n_removed"] <= r["n_repeated"] <= max(most[r["doc_id"]]) for r in got)
    assert sum(r["n_repeated"] for r in got) > sum(r["n_removed"] for r in got)


def test_op5(spark, tables, corpus):
    got = rows_of(spark, tables, "op5_")
    order = sorted((i is not None, i or 0, t or "") for i, t, _, _ in corpus)
    want = Counter()
    for k, (known, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    marks = {}
    texts = {i: t or "" for i, t, _, _ in corpus}
    for r in got:
        if r["doc_id"] is not None:
            assert marks.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        a, b = ({x for x in r[c].split(",") if x} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    elements = {t: {x for x in f.split(",") if x} for t, f in marks.items()}
    ids = Counter(i for known, i, _ in order if known)
    nexts = {i: (t, order[(k + 1) % len(order)][2]) for k, (known, i, t) in enumerate(order) if known and ids[i] == 1}
    checked = [r["near_next"] == pytest.approx(likeness(elements[nexts[r["doc_id"]][0]], elements[nexts[r["doc_id"]][1]])) for r in got if r["doc_id"] in nexts and nexts[r["doc_id"]][1] in elements]
    assert all(checked) and len(checked) > 250
    assert sketches.SCALE == 4


def test_op6(spark, tables, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _, _ in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows_of(spark, tables, "op6_")) == want


def test_op7(spark, tables, corpus):
    got = rows_of(spark, tables, "op7_")
    data = [((t or "").encode(), i) for i, t, _, _ in corpus]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for b, i in data)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots, sums = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sums.values()) - min(sums.values()) <= max(Counter({b: 0 for b, _ in data} | {b: (len(b) + 1) * n for b, n in Counter(b for b, _ in data).items()}).values())


def test_op8(spark, tables, corpus):
    got = rows_of(spark, tables, "op8_")
    assert Counter(r["doc_id"] for r in got) == Counter(c[0] for c in corpus)
    truth = {i: y for i, _, _, y in corpus if y is not None}
    for r in got:
        assert r["held_out"] == FOLD(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([p for p, y in held if y]) > 0.8 and np.mean([p for p, y in held if not y]) < 0.05


def test_op9(spark, tables, vectors):
    got = rows_of(spark, tables, "op9_")
    scaled = [(i, v if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else (np.array(v) / np.abs(v).max()).tolist()) for i, v in vectors]
    want = brute_links(scaled, 0.9)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (None if r["vec_id"] is None else r["vec_id"] == r["component_id"]) for r in got)
    assert {r["component_id"] for r in got if r["vec_id"] in (206, 207, 208)} == {206}


def test_op10(spark, tables, corpus):
    texts = Counter()
    for i, t, _, _ in corpus:
        base = plain_spans(t or "")
        kinds = Counter(k for k, _, _ in base)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        texts[i, *(kinds[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest()] += 1
    got = rows_of(spark, tables, "op10_")
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == texts
    by_id = {i: t or "" for i, t, _, _ in corpus}
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["n_spans"] == len(spans)
        if r["doc_id"] is not None:
            assert {f"{k}:{s}:{e}" for k, s, e in plain_spans(by_id[r["doc_id"]])} <= set(spans)


def test_very_long_texts(spark, tmp_path):
    """A text of some five million characters goes through the operators that read texts in parts."""
    words = ["the", "of", "and", "nicht", "auf", "house42", "x@y.zz"]
    rng = np.random.default_rng(3)
    long = " ".join(words[k] for k in rng.integers(0, len(words), 1_100_000))
    small = [(i, f"the house of {i} and nicht auf der {i}", "en" if i % 2 else "de", "s", 1) for i in range(60)]
    spark.createDataFrame([(900, long, "en", "s", len(long)), *small], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, i % 3 % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one = {n: next(r for r in rows_of(spark, str(tmp_path), n) if r["doc_id"] == 900) for n in ("op2_", "op5_", "op6_", "op8_")}
    assert one["op2_"]["lang_pred"] in ("en", "de") and one["op5_"]["n_chars"] == len(long) and 0 <= one["op8_"]["score"] <= 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert one["op6_"]["n_tokens"] == len(library.encode(long, add_special_tokens=False).ids)
    pieces = [r for r in rows_of(spark, str(tmp_path), "op3_") if r["doc_id"] == 900]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] == len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids) + 1
