import oracle
import pytest

from loomsieve import plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql_or_is_tested_otherwise():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"diversified_passages", "fuzzy_ratio_match"}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_agrees_with_its_sql(spark, con, name):
    assert oracle.difference(spark, con, plans.queries()[name], plans.oracle_sql()[name], SF) == ""


def test_diversified_passages_against_a_plain_loop(spark):
    import re

    from loomsieve.operators.passages import diversified

    cues = {"[0-9]": 2, "key": 3, "@": 4}
    texts = {1: "a 1\nb key 2\nc\nd\n x@y\nkey\nb key 2\n9", 2: "none\nat all", 3: "", 4: None, 5: "\n".join(f"line {i} key" for i in range(40))}
    got = diversified(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", cues, 5).collect()
    want = []
    for i, t in texts.items():
        rows = []
        for n, line in enumerate((t or "").split("\n"), 1):
            hit = [k for k, p in enumerate(cues) if re.search(p, line, re.I)]
            if hit:
                rows.append((-sum(list(cues.values())[k] for k in hit), n, line.strip(), hit))
        rows.sort()
        chosen = []
        for pool in [[r for r in rows if k in r[3]] for k in range(len(cues))]:
            for r in pool:
                if len(chosen) < 5 and all(r[2] != c[2] and abs(r[1] - c[1]) >= 3 for c in chosen):
                    chosen.append(r)
                    break
        for r in rows:
            if len(chosen) < 5 and all(r[2] != c[2] and abs(r[1] - c[1]) >= 3 for c in chosen):
                chosen.append(r)
        want += [(i, r[1], -r[0], k) for k, r in enumerate(chosen, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gate_of_texts_that_share_frequent_words(spark, tmp_path):
    """Against SQL; what is shuffled stays near the size of the texts, though every pair shares a word."""
    import random

    import duckdb

    rng = random.Random(8)
    say = lambda own, n: " ".join(["The", "of", *(f"{own}{rng.randrange(10_000)}" for _ in range(n))])
    items = [say("y", 20) for _ in range(200)]
    texts = [say("x", 100) for _ in range(300)] + [items[3].upper(), items[5] + " more", items[7], items[7], None, "", "nothing shared"]
    con = duckdb.connect()
    for name, key, values in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        spark.createDataFrame(list(enumerate(values)), f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    before = oracle.shuffled(spark)
    name = "weak_match_gate_texts"
    assert oracle.difference(spark, con, plans.queries()[name], plans.oracle_sql()[name], str(tmp_path)) == ""
    assert oracle.shuffled(spark) - before < 3_000_000
    assert plans.queries()[name](spark, str(tmp_path)).first().asDict() == {"ungated": 304, "gated": 4, "same_title": 3}
