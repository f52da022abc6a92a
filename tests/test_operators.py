import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsieve.functions import records, text, verdicts
from loomsieve.operators import dedupe, evaluate, incremental, link, route
from loomsieve.sources import bibtex, files


def test_dedupe_keeps(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), (None, 4, "z")], "key string, pos int, v string")
    got = {k: sorted(map(tuple, dedupe.by_key(df, ["key"], "pos", k).collect())) for k in ("first", "last", "first_pos_last_val")}
    assert got == {"first": [("a", 1, "x"), ("b", 2, "y")], "last": [("a", 3, None), ("b", 2, "y")], "first_pos_last_val": [("a", 1, None), ("b", 2, "y")]}
    assert dedupe.by_key(df.limit(0), ["key"], "pos").count() == 0


def test_disagreement_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "x")], "key string, v string")
    assert {r["key"]: r["disagrees"] for r in dedupe.disagreement(df, ["key"], "v").collect()} == {"a": True, "b": False}


def test_unique_index_drops_ambiguous_keys(spark):
    df = spark.createDataFrame([("k", 1), ("k", 1), ("m", 1), ("m", 2), (None, 3)], "key string, v int")
    assert [tuple(r) for r in dedupe.unique_index(df, "key", "v").collect()] == [("k", 1)]


def test_override_takes_nulls_and_keeps_both_sides(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    over = spark.createDataFrame([(2, None), (3, "c")], "key int, v string")
    got = sorted(map(tuple, link.override(base, over, "key", ["v"], {"v": "was"}).collect()))
    assert got == [(1, "a", "a", "base"), (2, "b", None, "override"), (3, None, "c", "appended")]


def test_upsert_keeps_positions(spark):
    base = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "key string, pos int, v string")
    new = spark.createDataFrame([("c", 0, "n"), ("a", 1, "m")], "key string, pos int, v string")
    got = [tuple(r) for r in link.upsert(base, new, "key", "pos").orderBy("pos").collect()]
    assert got == [("a", 0, "m", "replaced"), ("b", 1, "y", "kept"), ("c", 2, "n", "appended")]


def test_fill_blanks_ignores_blank_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "key int, v string")
    b = spark.createDataFrame([(1, " "), (2, "z")], "key int, v string")
    assert sorted(map(tuple, link.fill_blanks(a, b, "key", ["v"]).collect()), key=str) == [(1, "x"), (2, "z"), (3, None)]


def test_best_jaccard_gate(spark):
    a = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short title"), (3, "nothing shared")], "l int, t string")
    b = spark.createDataFrame([(10, "one two three four five six seven eight"), (11, "Short  Title!"), (12, "short titles")], "r int, t string")
    got = {r["l"]: (r["r"], r["same_title"]) for r in link.best_jaccard(a, b, "l", "r", "t", 0.8, 7).collect()}
    assert got == {1: (10, False), 2: (11, True)}


@pytest.mark.parametrize("value,label,pred", [("include (junior:5,5)", "include", 1), (" Maybe", "maybe", 1), ("exclude (senior:1)", "exclude", 0), ("discard", "discard", None), ("", None, None), (None, None, None), ("7", None, None)])
def test_verdict_labels(spark, value, label, pred):
    row = spark.createDataFrame([(value,)], "v string").select(verdicts.label(F.col("v")), verdicts.predicted(F.col("v")), verdicts.predicted(F.col("v"), "maybe_only")).first()
    assert tuple(row) == (label, pred, pred)


def test_panel(spark):
    df = spark.createDataFrame([(5, 4, None), (1, 2, 5), (3, 5, 2), (3, 3, None), (None, 5, None), (None, None, 3)], "a int, b int, s int")
    got = [tuple(r) for r in df.select(verdicts.panel_verdict(F.col("a"), F.col("b"), F.col("s")), verdicts.panel_verdict(F.col("a"), F.col("b"), F.col("s"), False)).collect()]
    assert got == [("include (junior:5,4)",) * 2, ("include (senior:5)", "exclude (junior:1,2)"), ("exclude (senior:2)",) * 2, ("maybe (junior:3,3)",) * 2, (None, None), ("maybe (senior:3)",) * 2]


def test_ratios_on_empty(spark):
    c = evaluate.with_ratios(evaluate.confusion(spark.createDataFrame([], "p boolean, g boolean"), F.col("p"), F.col("g"))).first()
    assert tuple(c) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("raw,title", [(r"{The \& Th\"eorem: $x$ of A_B}", "the and th eorem x of a b"), ('"{Quoted}"', "quoted"), (None, ""), ("  ", ""), ("50\\% ~ x@y", "50 percent x at y")])
def test_normalized_title(spark, raw, title):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalized_title(F.col("t"))).first()[0] == title


def test_folded_title(spark):
    assert spark.createDataFrame([("Éléments naïfs",)], "t string").select(text.normalized_title(F.col("t"), fold=True)).first()[0] == "elements naifs"


def test_text_pieces(spark):
    df = spark.createDataFrame([("A Survey of Things: the long tail", "Doe, Jane", "<p>a &amp;  b</p>", "x\nReferences\ny", "```json\n{}\n```")], "a string, b string, c string, d string, e string")
    row = df.select(text.main_title(F.col("a")), text.surname(F.col("b")), text.stripped_tags(F.col("c")), text.before_references(F.col("d")), text.without_fences(F.col("e"))).first()
    assert tuple(row) == ("A Survey of Things", "Doe", "a & b", "x\n", "{}")


def test_violations(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "v int")
    good, bad = route.quarantine(df, {"small": F.col("v") < 5, "odd": F.col("v") % 2 == 1})
    assert [r[0] for r in good.collect()] == [1]
    assert sorted((r["v"], r["violations"]) for r in bad.collect() if r["v"]) == [(9, ["small"])] and bad.count() == 2


def test_as_of_includes_the_same_time(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    a = spark.createDataFrame([("u", t(5)), ("u", t(1)), ("w", t(9))], "k string, ts timestamp")
    b = spark.createDataFrame([("u", t(5), 7), ("u", t(3), 6)], "k string, ts timestamp, v int")
    assert Counter(r["v"] for r in incremental.as_of(a, b, "k", "ts", ["v"]).collect()) == Counter([7, None, None])


BIB = """@comment{no} @string{acm = "ACM Press"}
@Article{k1, title = {A {Nested} "title"}, journal = acm # { Letters}, year = 2020, Title = "Last wins",}
@misc{, note = {no key}}
@book(k2, publisher = {P {\\{}x}, note = {}, author = unknown)
"""


def test_bibtex(spark, tmp_path):
    assert bibtex.parse(BIB) == [("article", "k1", {"title": "Last wins", "journal": "ACM Press Letters", "year": "2020"}), ("book", "k2", {"publisher": "P {\\{}x", "note": "", "author": "unknown"})]
    with pytest.raises(bibtex.BibTexError):
        bibtex.parse("@article{k, title = {open}")
    (tmp_path / "a.bib").write_text(BIB)
    bibtex.register(spark)
    assert spark.read.format("bibtex").load(str(tmp_path)).count() == 2 == bibtex.read(spark, str(tmp_path / "*.bib")).count()
    out = bibtex.read(spark, str(tmp_path)).filter("key = 'k1'").select(bibtex.entry_text(F.col("entry_type"), F.col("key"), F.col("fields")).alias("t")).first()[0]
    assert bibtex.parse(out)[0][1:] == ("k1", {"title": "Last wins", "journal": "ACM Press Letters", "year": "2020"})


def test_json_and_lists(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "a", "v": 1}\n\n{"key": " a ", "v": 2}\n{"key": "", "v": 3}\n')
    rows = files.numbered_json_lines(spark, str(tmp_path / "a.jsonl"), "key string, v int").select("line_no", "row.*")
    assert [(r["key"], r["v"]) for r in files.keyed(rows, "key", "line_no").collect()] == [("a", 2)]
    (tmp_path / "b.json").write_text('{"items": [{"key": "x", "v": 1}, null]}')
    assert [tuple(r) for r in files.json_records(spark, str(tmp_path / "b.json"), "key string, v int").collect()] == [("x", 1)]
    (tmp_path / "keys.txt").write_text("a\n# no\n\n b \n")
    assert sorted(r[0] for r in files.key_list(spark, str(tmp_path / "keys.txt")).collect()) == ["a", "b"]
    (tmp_path / "c.csv").write_text("﻿x,y\n1,\"a,b\"\n")
    df = files.csv(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["x", "y"]
    files.write_report(df.withColumn("d", F.lit(0.5)).withColumn("ok", F.lit(True)), str(tmp_path / "out"), ["y", "d", "ok"])
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "out")).collect()] == [("a;b", "0.50", "true")]


def test_best_match_under_the_threshold_keeps_its_similarity(spark):
    words = "one two three four five six seven eight nine ten".split()
    left = [(1, " ".join(words)), (2, " ".join(words[:5])), (3, "nothing shared"), (4, " ".join(words[::-1])), (5, None), (6, "six seven eight"), (7, "!"), (8, "Short, title")]
    right = [(20, "short title"), (11, " ".join(words)), (12, " ".join(words)), (13, "six seven eight nine"), (14, "")]
    out = link.best_jaccard_of_all(spark.createDataFrame(left, "l int, t string"), spark.createDataFrame(right, "r int, t string"), "l", "r", "t")
    assert sorted(map(tuple, out.collect())) == [(1, 11, 1.0, True), (2, None, 0.5, False), (3, None, 0.0, False), (4, 11, 1.0, False), (5, None, 0.0, False), (6, None, 0.75, False), (7, None, 0.0, False), (8, 20, 1.0, True)]


def test_wildcard_rules_keep_equal_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, None)], "a int, b int")
    rules = spark.createDataFrame([(2, None, None, "any"), (1, 1, 2, "both")], "pos int, a int, b int, v string")
    assert sorted(r["v"] for r in link.wildcard_rules(df, rules, ["a", "b"], "pos", "v").collect()) == ["any", "both", "both"]


def test_meta_tags_in_any_order_and_quotes(spark):
    html = """<meta content='one "quoted"' name='a'><META property = "og:title" content="The title"><meta name=x><title>Other</title>"""
    row = spark.createDataFrame([(html,)], "h string").select(text.meta_tags(F.col("h")), text.page_title(F.col("h")), text.page_abstract(F.col("h"))).first()
    assert tuple(row) == ({"a": ['one "quoted"'], "og:title": ["The title"]}, "The title", None)


def test_page_abstract_prefers_long_ones_and_falls_back_to_the_last(spark):
    pages = ["<meta name='description' content='too short'><div id=\"Abst\"><p>Long enough to be the abstract of it</p></div></div>", "<meta name='description' content='too short'><div class=\"x abstract\">short</div>"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(text.page_abstract(F.col("h"))).collect()]
    assert got == ["Long enough to be the abstract of it", "short"]


def test_every_layer_is_unwrapped(spark):
    rows = ['{{"{{{{a}}}}"}}', ' { "b" } ', "{c} and {d}", '"', "", "{{{{{{{e}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.unwrapped(F.col("t"))).collect()]

    def plain(t):
        while True:
            s = t.strip()
            s = s[1:-1].strip() if len(s) > 1 and (s[0] + s[-1]) in ("{}", '""') else s
            if s == t:
                return t
            t = s

    assert got == [plain(t) for t in rows]


def test_identifiers_and_names(spark):
    df = spark.createDataFrame([("https://doi.org/10.1000/AbC.", "see arXiv: 1906.12345v3", "Roe, R. and Doe, J."), ("(doi:10.5/x)", "cs.LG/0701001", "Jane van Doe; X"), (None, "none here 1906.12345", "")], "d string, a string, n string")
    got = [tuple(r) for r in df.select(records.doi_of(F.col("d")), records.arxiv_of(F.col("a")), records.first_surname(F.col("n"))).collect()]
    assert got == [("10.1000/abc", "1906.12345", "roe"), (None, "cs.LG/0701001", "doe"), (None, None, None)]


def test_json_records_take_nested_schemas_and_fail_on_malformed_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"n": 1, "items": [{"key": "a", "price": 1.25, "in": {"x": [1, 2]}}, null]}')
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("price", T.DecimalType(5, 2)), T.StructField("in", T.StructType([T.StructField("x", T.ArrayType(T.IntegerType()))]))])
    assert [(r["key"], float(r["price"]), r["in"]["x"]) for r in files.json_records(spark, str(tmp_path / "good.json"), schema).collect()] == [("a", 1.25, [1, 2])]
    (tmp_path / "bad.json").write_text('[{"key": "a"}, {"key": ')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.json_records(spark, str(tmp_path / "bad.json"), "key string").collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join('{"i": %d}\n' % i if i % 5 else "\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = files.numbered_json_lines(spark, str(tmp_path / "a.jsonl"), "i int").select("line_no", "row.i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, rows)) == [(i, i) for i in range(1, 4001) if i % 5]


def test_first_with_counts(spark):
    df = spark.createDataFrame([(" a", 3), ("a", 1), ("", 0), (None, 2), ("b", 5), ("c", 4)], "key string, pos int")
    allow = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    assert [tuple(r) for r in dedupe.first_with_counts(df, "key", "pos", allow, 2).collect()] == [("a", 1, 2), ("c", 4, 1)]
    with pytest.raises(Exception, match="no usable key"):
        dedupe.first_with_counts(df, "key", "pos", strict=True).collect()


@pytest.mark.parametrize("least", [0.34, 0.5, 0.6, 0.9])
def test_best_jaccard_against_all_pairs(spark, least):
    import random

    rng = random.Random(int(least * 100))
    title = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7)))
    a, b = [(i, title()) for i in range(120)], [(i, title()) for i in range(120)]
    got = {r["l"]: (r["r"], round(r["similarity"], 9), r["same_title"]) for r in link.best_jaccard(spark.createDataFrame(a, "l int, t string"), spark.createDataFrame(b, "r int, t string"), "l", "r", "t", least, 3).collect()}
    want = {}
    for i, t in a:
        x = set(t.split())
        found = [(t == u, len(x & set(u.split())) / len(x | set(u.split())), -j) for j, u in b if x & set(u.split())]
        found = [f for f in found if f[1] >= least - 1e-12]
        if found:
            same, similarity, j = max(found)
            want[i] = (-j if same or len(x) >= 3 else None, round(similarity, 9), same)
    assert got == want


def test_numbers_within_groups_over_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), p, "x") for p in rng.sample(range(10_000), 700)]
    got = dedupe.numbered(spark.createDataFrame(rows, "g string, pos int, v string"), ["g"], "pos", "k", 8).collect()
    order = {}
    for g, p, _ in sorted(rows, key=lambda r: r[1]):
        order[g, p] = sum(1 for q, _ in order if q == g) + 1
    assert {(r["g"], r["pos"]): r["k"] for r in got} == order
    assert dedupe.numbered(spark.createDataFrame([], "g string, pos int, v string"), ["g"], "pos", "k").count() == 0


def test_as_of_over_buckets(spark):
    import random

    rng = random.Random(3)
    at = lambda: datetime.datetime(2024, 1, rng.randrange(1, 9), rng.randrange(24), rng.randrange(3))
    left = [(i, rng.choice("ab"), at()) for i in range(200)]
    right = [(rng.choice("ab"), at(), i) for i in range(40)]
    out = incremental.as_of(spark.createDataFrame(left, "id int, key string, ts timestamp"), spark.createDataFrame(right, "key string, ts timestamp, v int"), "key", "ts", ["v"])
    want = {i: max(((t, v) for k, t, v in right if k == key and t <= ts), default=(None, None))[1] for i, key, ts in left}
    assert {r["id"]: r["v"] for r in out.collect()} == want


def test_running_values_over_buckets(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab") if i % 9 else None, datetime.datetime(2024, 1, rng.randrange(1, 6), rng.randrange(24)), rng.randrange(9), rng.choice("xyz")) for i in range(150)]
    got = incremental.running(spark.createDataFrame(rows, "id int, key string, ts timestamp, v int, label string"), "key", "ts", "id", "v", "label").collect()
    want = {}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(own):
            want[r[0]] = (sum(x[3] for x in own[: k + 1]), own[k - 1][4] if k else None, own[k + 1][4] if k + 1 < len(own) else None, own[0][0])
    assert {r["id"]: (r["running"], r["before"], r["after"], r["first"]) for r in got} == want
