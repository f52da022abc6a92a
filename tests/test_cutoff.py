import datetime

import pytest
from pyspark.sql import functions as F

from loomsieve.functions import dates
from loomsieve.operators import cutoff

D = datetime.date
SCHEMA = "key string, source string, source_id string, published_date string, source_metadata struct<published:string,comment:string,doi:string,journal_ref:string>"
PLAIN = cutoff.Policy(start="2018-02-01", end="2023-02-01", end_inclusive=True)
SPLIT = cutoff.Policy(start="2018-02-01", end="2023-02-01", end_inclusive=True, split_preprints=True)


@pytest.mark.parametrize("raw,start,end", [
    ("2024-02-07", D(2024, 2, 7), D(2024, 2, 7)), ("2024/02/07", D(2024, 2, 7), D(2024, 2, 7)), ("2024-02-07T03:04:05", D(2024, 2, 7), D(2024, 2, 7)),
    ("2024-02-07T03:04:05Z", D(2024, 2, 7), D(2024, 2, 7)), ("2024-02-07T23:30:00-08:00", D(2024, 2, 7), D(2024, 2, 7)), ("20240207", D(2024, 2, 7), D(2024, 2, 7)),
    ("March 17, 2024", D(2024, 3, 17), D(2024, 3, 17)), ("Mar 17, 2024", D(2024, 3, 17), D(2024, 3, 17)), (" 2024 ", D(2024, 1, 1), D(2024, 12, 31)),
    ("2020-12", D(2020, 12, 1), D(2020, 12, 31)), ("2024-02", D(2024, 2, 1), D(2024, 2, 29)),
    *((bad, None, None) for bad in ("March 2020", "2020/12", "2020-13", "2020-00", "2020-12-XX", "2020-02-30", "", "null", "0000", "2024-02-07 junk", None))])
def test_date_intervals(spark, raw, start, end):
    iv = spark.createDataFrame([(raw,)], "raw string").select(dates.date_interval(F.col("raw")).alias("iv")).first()[0]
    assert iv is None if start is None else (iv["start"], iv["end"]) == (start, end)


def _decide(spark, policy, source="arxiv", source_id=None, published_date=None, key="k", **meta):
    row = (key, source, source_id, published_date, tuple(meta.get(n) for n in ("published", "comment", "doi", "journal_ref")))
    return cutoff.decide(spark.createDataFrame([row], SCHEMA), policy).first()["cutoff"]


def test_plain_mode_judges_a_year_by_its_first_day(spark):
    c = _decide(spark, PLAIN, source_id="1810.11946v4", published_date="2018")
    assert not c["pass"] and c["status"] == "before_start"


def test_preprint_by_submission(spark):
    c = _decide(spark, SPLIT, source_id="1810.11946v4", published_date="2018", published="2018-10-29")
    assert c["pass"] and (c["role"], c["basis"], c["start"]) == ("preprint", "submitted_date", D(2018, 10, 29))


def test_reviewed_by_year_in_key(spark):
    c = _decide(spark, SPLIT, key="smith2020", published_date="2016", comment="Published in IEEE Trans. on Data", published="2016-01-01")
    assert c["pass"] and (c["role"], c["start"], c["end"]) == ("peer_reviewed", D(2020, 1, 1), D(2020, 12, 31))


def test_submission_from_identifier(spark):
    c = _decide(spark, SPLIT, source_id="1909.13287")
    assert c["pass"] and (c["start"], c["end"]) == (D(2019, 9, 1), D(2019, 9, 30))


def test_reviewed_falls_back_to_submission(spark):
    c = _decide(spark, SPLIT, journal_ref="Interspeech-2017", published="2019-03-14")
    assert c["pass"] and c["basis"] == "submitted_date_fallback"


def test_outside_window(spark):
    assert _decide(spark, SPLIT, published="2017-06-12")["status"] == "before_start"


def test_impossible_identifier_month_is_no_date(spark):
    assert _decide(spark, SPLIT, source_id="1913.00001")["status"] == "missing_submitted_date"


def test_other_source_and_missing(spark):
    assert _decide(spark, SPLIT, source="crossref", published_date="2018")["status"] == "passed"
    assert _decide(spark, SPLIT, source=None)["status"] == "missing_published_date"
    assert _decide(spark, PLAIN, published_date="soon")["status"] == "unparseable_published_date"
    assert _decide(spark, PLAIN)["status"] == "missing_published_date"


def test_disabled_policy_passes_anything(spark):
    c = _decide(spark, cutoff.Policy(enabled=False), published_date="soon")
    assert c["pass"] and c["status"] == "disabled"


def test_split_counts_add_up(spark):
    rows = [(str(i), "x", None, d, None) for i, d in enumerate(["2019", "2010", "2030", None])]
    kept, gone, counts = cutoff.split(cutoff.decide(spark.createDataFrame(rows, SCHEMA), PLAIN))
    assert (kept.count(), gone.count()) == (1, 3)
    assert {r["status"]: r["n"] for r in counts.collect()} == {"passed": 1, "before_start": 1, "after_end": 1, "missing_published_date": 1}


def test_signals_are_whole_words(spark):
    rows = ["Accepted at X", "accepted2 times", "journal_club notes", "In Proc. of Y", "to be published", "IEEE Trans", "transformers"]
    df = spark.createDataFrame([(c,) for c in rows], "c string")
    got = [r[0]["status"] for r in df.select(cutoff.review_status(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("c"))).collect()]
    assert [g == "peer_reviewed" for g in got] == [True, False, False, True, True, True, False]


def test_a_record_is_parsed_once(spark):
    """The window's plan holds the parse of a date once, however often its parts are used."""
    df = spark.createDataFrame([("k", "arxiv", "1901.00001", "2019", None)], SCHEMA)
    for policy in (PLAIN, SPLIT):
        plan = cutoff.decide(df, policy)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(array(") <= 2
