import difflib

import pytest
from pyspark.sql import functions as F

from loomsieve.functions import alignment, notes, text
from loomsieve.operators import link
from loomsieve.plans import sources
from loomsieve.sources import documents


@pytest.mark.parametrize("note,title,reason", [
    (None, "", "missing_note"), ("[online] https://x.org", "", "empty_after_cleanup"),
    ("Doe J, Roe R. A small study of large things. Nature. 2019;3(2):11-15.", "A small study of large things", "from_after_authors"),
    ("Jane Doe and Richard Roe. Deep nets for speech. In: Proc. Interspeech 2017.", "Deep nets for speech", "from_after_authors"),
    ("Doe J. et al. Learning to parse. arXiv 2020.", "Learning to parse", "from_after_authors"),
    ("Only a title (2018)", "Only a title", "from_first_segment")])
def test_notes(note, title, reason):
    got = notes.parse(note)
    assert (got["title"], got["reason"]) == (title, reason)


def test_note_locators():
    got = notes.parse("Doe J., Roe R. A study. Journal of Tests 12(3): 45–67, 2001. Reprinted 2003.")
    assert (got["volume"], got["number"], got["pages"], got["year"], got["journal"]) == ("12", "3", "45-67", "2003", "Journal of Tests")


def test_confidence_keeps_segment_titles_low_even_if_looked_up(spark):
    df = spark.createDataFrame([("t", "a", "from_first_segment", True), ("t", "a", "", True), ("t", "", "from_after_authors", False), ("", "", "", True)], "t string, a string, r string, c boolean")
    got = [tuple(r[0]) for r in df.select(notes.confidence(F.col("t"), F.col("a"), F.col("r"), F.col("c"))).collect()]
    assert got == [(0.6, 0.85, False), (0.9, 0.85, False), (0.75, 0.2, True), (0.0, 0.2, True)]


def test_meta_tags_keep_repeats(spark):
    html = '<meta name="a" content="1"><META name=" a " content="2"><meta property="og:x" content="&lt;y">'
    assert spark.createDataFrame([(html,), (None,)], "h string").select(text.meta_tags(F.col("h")).alias("m")).collect()[0][0] == {"a": ["1", "2"], "og:x": ["<y"]}


def test_best_ratio_equals_the_plain_search(spark):
    titles = ["deep learning for speech recognition", "deep learning of speech recognition", "speech", "a survey of things", "the survey of things", "other words entirely"]
    a = [(i, t + s) for i, (t, s) in enumerate(zip(titles, ["", "!", "es", " now", "", "x"]))]
    b = list(enumerate(titles))
    got = {r["l"]: (r["r"], round(r["score"], 6)) for r in link.best_ratio(spark.createDataFrame(a, "l int, t string"), spark.createDataFrame(b, "r int, t string"), "l", "r", "t", 0.85).collect()}
    want = {}
    for i, t in a:
        t = t.replace("!", "")
        same = [j for j, u in b if u == t]
        score, j = (1.0, -same[0]) if same else max((difflib.SequenceMatcher(None, t, u).ratio(), -j) for j, u in b if set(t.split()) & set(u.split())) if any(set(t.split()) & set(u.split()) for _, u in b) else (0, 0)
        if score >= 0.85:
            want[i] = (-j, round(score, 6))
    assert got == want


def test_best_ratio_equals_the_unfiltered_search(spark):
    titles = ["neurosymbolics", "reinforcementlearning", "autoencoders survey", "ab cd ef", "a survey of things", "", "speech"]
    a = list(enumerate(["neurosymbolic", "reinforcement learning", "autoencoder surveys", "abcd ef", "the survey of thing", "!", "speeches", "speech", "listen"]))
    b = list(enumerate(titles))
    for least in (0.85, 0.9, 1.0):
        out = link.best_ratio(spark.createDataFrame(a, "l int, t string"), spark.createDataFrame(b, "r int, t string"), "l", "r", "t", least, by_word=False)
        got = {r["l"]: (r["r"], round(r["score"], 6)) for r in out.collect()}
        want = {}
        for i, t in a:
            score, j = max((difflib.SequenceMatcher(None, t.replace("!", ""), u).ratio(), -j) for j, u in b)
            if score >= least:
                want[i] = (-j, round(score, 6))
        assert got == want


def test_fuzzy_ratio_match_reads_whole_texts(spark, tmp_path):
    head, tails = "the same words stand at the head of every one of these texts and go on for eighty", ["apples", "nothing like it at all in the rest of this text, which is a long one", "", "cherries"]
    spark.createDataFrame([(3 * i, f"{head} {t}") for i, t in enumerate(tails)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = sources.fuzzy_ratio_match(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == [(3 * i, 3 * i, 1.0, "exact") for i in range(4)]


def test_policies(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"time_policy": {"enabled": true, "start_date": "2018-02-01", "end_date": null}}')
    row = documents.policies(spark, str(tmp_path)).first()
    assert (row["paper_id"], row["enabled"], str(row["start"]), row["end"], row["start_inclusive"], row["end_inclusive"]) == ("p1", True, "2018-02-01", None, True, False)
    (tmp_path / "p2.json").write_text("{}")
    with pytest.raises(Exception, match="no time_policy in p2"):
        documents.policies(spark, str(tmp_path)).collect()


def test_alignment_of_pages_with_metadata(spark):
    long = "some words of the first page that go on for quite a while, sixty letters at least"
    rows = [("Deep Nets: a Study", "abs", "", "deep nets a study " + long, "match", "full_title_found_in_first_page"),
            ("Deep Networks here: a Study", "abs", "", "Deep networks here " + long, "match", "main_title_found_in_first_page"),
            ("Deep Nets", None, "On Deep Nets", "", "match", "title_header_consistent"), ("Deep Nets", "abs", "On Deep Nets", "short", "uncertain", "first_page_text_too_short_for_topic_check"),
            ("Deep Networks here: a Study", "", "Deep networks here and there", "", "match", "main_title_header_consistent"), (None, None, None, None, "mismatch", "title_not_consistent_with_metadata"), ("Other", "a", "Title", long, "mismatch", "title_not_consistent_with_metadata")]
    df = spark.createDataFrame(rows, "t string, a string, h string, p string, v string, r string")
    assert all((x["m"]["verdict"], x["m"]["reason"]) == (x["v"], x["r"]) for x in df.select("v", "r", alignment.judge_match()("t", "a", "h", "p").alias("m")).collect())
    pairs = spark.createDataFrame([("A  b", "a B"), ("a b", "a c"), (None, "a"), ("a", "")], "a string, b string")
    assert [r[0] for r in pairs.select(alignment.abstract_similarity()("a", "b")).collect()] == pytest.approx([1.0, 0.5 * 2 / 3 + 0.25, 0.0, 0.0])
