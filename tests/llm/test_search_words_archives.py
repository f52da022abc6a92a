"""Spelling variants, WARC archives and ranked search against plain versions of each."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomsieve import llm
from loomsieve.llm import lexical, variants, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants -----------------------------------------------------------------------------------------


def counts_of(rows, spoiled=97, least=3):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if spoiled and h % spoiled == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def forms_of(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return Counter((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.fixture(scope="module")
def spelled():
    """Texts whose words come in many spellings; long, accented, hot and repeated ones among them."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "straßen", "×÷×÷×"]

    def spelling(w):
        kind, p = rng.randrange(6), rng.randrange(len(w))
        return w[:p] + w[p + 1 :] if kind == 0 else w[:p] + rng.choice("abé") + w[p:] if kind == 1 else w[:p] + rng.choice("abé") + w[p + 1 :] if kind == 2 else w.upper() if kind == 3 and w.isascii() else w

    rows = [(i, " ".join(spelling(rng.choice(stems)) for _ in range(rng.randrange(1, 80))) + rng.choice([".", " 12x", "\n"])) for i in range(90)]
    long = "".join(rng.choice("ab") for _ in range(30_000))
    rows += [(200, f"{long} {long} {long}"), (201, " ".join([long[:-1] + "c"] * 4)), (202, " ".join([long[:777] + long[778:]] * 5))]
    rows += [(210, "chained " * 3), (211, "chainez " * 7), (212, "chainyz " * 20)]
    rows += [(300, None), (301, ""), (302, "ab cd 12 ΟΔΟΣ 日本語"), (None, "abcdef abcdef abcdef"), (None, None), rows[3], rows[3]]
    return rows


def with_clashes(spark, rows, columns="id long, text string"):
    df = spark.createDataFrame(rows, columns.replace("id long", "doc_id long", 1))
    return df.withColumns({"word": F.lit("w"), "n": F.lit(1), "form": F.lit("f"), "m": F.lit(2), "shard": F.lit("s"), "terms": F.array(F.lit(1)), "query": F.lit("q"), "lang": F.lit("en")}).repartition(3)


def test_op11(spark, spelled, tmp_path):
    with_clashes(spark, spelled).write.parquet(str(tmp_path / "documents.parquet"))
    got = llm.queries()["op11_variants"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = forms_of(counts_of(spelled))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a form's own form


@pytest.mark.parametrize("crowd", [1, 2, 7])
def test_crowded_blocks_are_subdivided(spark, crowd):
    rng = random.Random(crowd)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(700)} | {"x" * k for k in range(5, 12)}
    counts = {w: rng.randrange(3, 40) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_pairs(df, crowd).collect()]
    want = {(a, b) for a in counts for b in counts if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    if crowd == 2:
        assert Counter(tuple(r) for r in variants.variants(df, crowd=crowd).select("word", "form", "root", "n", "n_near", "form_n").collect()) == forms_of(counts)


def test_words_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert llm.queries()["op11_variants"](spark, str(tmp_path)).collect() == []


# --- archives --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    body = lambda n: "<html>" + " ".join(rng.choice(["alpha", "beta", "gäß", "日本", "x" * 30]) for _ in range(n)) + "</html>"
    rows = [(i, f"http://h.example/{i % 7}", body(rng.randrange(1, 90))) for i in range(120)]
    rows += [(200 + k, "http://h.example/copy", rows[3][2]) for k in range(60)]
    rows += [(300, None, None), (301, "http://h.example/\r\nEvil: 1", ""), (302, "u", None), (303, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (304, "u", body(300_000))]
    rows += [rows[5], rows[5], (None, "u", rows[6][2]), (None, "u", "only without an id"), (90, "again", "other body of a repeated id")]
    return rows


def archived(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, b in data:
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = Counter()
    for i, b in data:
        revisit = len(b) >= least and b in top and i != top[b]
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[b] if revisit else None] += 1
    return out


def test_op12(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "size": F.lit("s"), "at": F.lit(2), "body": F.lit("b")})
    df.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = llm.queries()["op12_warc"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == archived(pages)


def test_archives_as_files(spark, pages, tmp_path):
    """Archives open without Spark: a dictionary frame, then a frame for each record, at the places that the writer names."""
    folder = tmp_path / "archives"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    places = warc.write_archives(df, str(folder), min_bytes=5, archive_bytes=40_000).collect()
    names = sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))
    assert len(names) > 2 and set(names) == {p["archive"] for p in places} and len(places) == len(pages)
    sizes = 0
    for name in names:
        data = (folder / name).read_bytes()
        magic, length = np.frombuffer(data[:8], "<u4").tolist()
        assert magic == 0x184D2A5D
        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + length]))
        ends = [8 + length]
        for p in sorted((p for p in places if p["archive"] == name), key=lambda p: p["at"]):
            assert p["at"] == ends[-1]
            record = inflate.decompress(data[p["at"] : p["at"] + p["length"]], max_output_size=1 << 24)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: re") and f"WARC-Record-ID: {p['record_id']}".encode() in record and b"\r\nEvil" not in record
            ends.append(p["at"] + p["length"])
            sizes += len(record)
        assert ends[-1] == len(data)
    records = warc.read_archives(spark, str(folder)).collect()
    assert {(r["archive"], r["at"], r["length"], r["record_id"]) for r in records} == {(p["archive"], p["at"], p["length"], p["record_id"]) for p in places}
    want = archived(pages, 5)
    assert Counter(tuple(r) for r in warc.resolved(warc.read_archives(spark, str(folder))).collect()) == want
    texts = Counter((h or "") for i, _, h in pages)
    assert all(r["payload"] in texts for r in records if r["record_type"] == "response")
    assert all(r["payload"] is None for r in records if r["record_type"] == "revisit")


def test_a_damaged_archive_is_an_error(spark, pages, tmp_path):
    folder = tmp_path / "archives"
    warc.write_archives(spark.createDataFrame(pages[:20], "page_id long, url string, html string").coalesce(1), str(folder)).collect()
    name = next(p for p in folder.iterdir() if p.name.endswith(".zst"))
    name.write_bytes(name.read_bytes()[:-7])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, str(folder)).collect()


def test_archives_without_a_dictionary_are_read(spark, tmp_path):
    record = warc.response_bytes(7, "u", b"body", warc.digest_of(b"body"), None)
    plain = zstandard.ZstdCompressor().compress
    (tmp_path / "a.warc.zst").write_bytes(plain(record) + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + plain(warc._header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"software: x")))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["record_type"], r["page_id"], r["payload"]) for r in got] == [("response", 7, "body"), ("warcinfo", None, None)]
    assert [r["page_id"] for r in warc.resolved(warc.read_archives(spark, str(tmp_path))).collect()] == [7]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert llm.queries()["op12_warc"](spark, str(tmp_path)).collect() == []


# --- ranked search ---------------------------------------------------------------------------------------------

TERM = re.compile(lexical.TERM)


def best_of(rows, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    terms = [(i, t, Counter(t)) for i, t in terms if t]
    total, length = len(terms), sum(len(t) for _, t, _ in terms)
    df = Counter(w for _, _, tf in terms for w in tf)
    out = Counter()
    for item, text in set(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, t, tf in terms:
            m = 25 + (75 * len(t) * total) // length
            s = sum(c * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w, c in asked.items() if tf[w])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        for rank, (s, known, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i if known else None, -s] += 1
    return out


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)] + ["Éa", "ÉA", "日本", "x1", "😀", "the", "THE"]
    rows = [(i, rng.choice([" ", ", ", "\0", "\n"]).join(rng.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=rng.randrange(1, 60)))) for i in range(400)]
    rows += [(500 + i, "the same words w1 w2 w3") for i in range(150)]  # ties
    rows += [(700, None), (701, ""), (702, " .,- "), (703, "rare once"), (None, "rare twice"), (None, "rare twice"), rows[2], (-5, "rare once"), (704, "w1 " * 30_000 + "rare")]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "absent"), (103, "rare Rare RARE once"), (104, "the the same words"), (104, "the the same words"), (105, "words same"), (None, "rare")]
    return rows, items


def test_op13(spark, searched, tmp_path):
    rows, items = searched
    with_clashes(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "block": F.lit(2), "asks": F.lit(3)}).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = llm.queries()["op13_lexical"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == best_of(rows, items)


@pytest.mark.parametrize(("size", "k"), [(300, 3), (2000, 10), (1 << 30, 1000)])
def test_search_over_many_shards_and_blocks(spark, searched, size, k, monkeypatch):
    rows, items = searched
    monkeypatch.setattr(lexical, "BLOCK", 4)
    index = lexical.build(with_clashes(spark, rows), shard_bytes=size)
    assert (index.shards.count() > 3) == (size < 1 << 20)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k)
    assert Counter(tuple(r) for r in got.collect()) == best_of(rows, items, k)


def test_tree_keeps_lists_by_impact():
    rng = np.random.default_rng(2)
    lists = [rng.permutation(50)[: rng.integers(1, 50)] for _ in range(30)]
    sizes = np.array([len(x) for x in lists])
    impacts = np.concatenate([np.sort(rng.integers(1, 99, n))[::-1] for n in sizes])
    bits = lexical.tree_levels(np.concatenate(lists), 6)
    shard = lexical.Shard(bits, impacts, np.arange(30, dtype=np.uint64), np.zeros(30, np.uint64), sizes, np.arange(50) * 10)
    score = defaultdict(int)
    for t in (2, 5, 9):
        for doc, impact in zip(lists[t], impacts[shard.starts[t] : shard.ends[t]], strict=True):
            score[int(doc) * 10] += int(impact) * (t + 1)
    for opened in (1, 3, 64):
        best = lexical.Best(7)
        shard.search(np.array([2, 5, 9]), np.array([3, 6, 10]), best, opened)
        assert list(zip(best.scores.tolist(), best.ids.tolist())) == sorted(((s, d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:7]
    assert shard.lists(np.array([3, 77], np.uint64), np.array([0, 0], np.uint64)).tolist() == [3, -1]


def test_nothing_to_search(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert llm.queries()["op13_lexical"](spark, str(tmp_path)).collect() == []
