"""Rules in the plan and rules in a table choose as plain string operations do."""

import random

import pytest

from rungwise.llm import urls


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    hosts = ["com", "net", "a.com", "b.a.com", "xa.com", "long.b.a.com", "net.com", "a.net", "ünï.net", "A.com"]
    paths = ["/", "/e", "/en", "/en/", "/en/x", "/en/x/y", "/é/", ""]
    pages = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q=/en/', '#/en/', '/t'])}" for _ in range(300)]
    rules = sorted({(rng.choice(["allow", "block"]), h + p) for h in hosts[:9] for p in paths[:7] if rng.random() < 0.6}, key=lambda r: r[1])
    unique = {rule: kind for kind, rule in rules}
    return [*pages, None, "", "no scheme", "x://", "x://com", "x:///en/"], [(kind, rule) for rule, kind in unique.items()]


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_choice_of_rules(spark, made, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
    pages, rules = made
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    want = {i: urls.brute_force_rule(u, rules) for i, u in enumerate(pages)}
    assert len({w[2] for w in want.values()}) > 15
    table = spark.createDataFrame([*rules, ("block", "no slash")], "kind string, rule string")
    for given in (rules, table):
        ruled, kinds = urls._ruled(df, given)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["ruled"]) for r in ruled.collect()}
        assert got == want and sum(kinds.values()) == sum(w[3] is not None for w in want.values())


def test_more_rules_than_a_plan_holds(spark, made):
    pages, rules = made
    many = [*rules, *[("block", f"host{i}.example/p{i % 7}/") for i in range(2000)]]
    df = spark.createDataFrame([*enumerate(pages), (900, "http://host77.example/p0/x"), (901, "http://sub.host78.example/p1/"), (902, "http://host78.example/p2/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, many).collect()}
    assert all(got[i][0] == urls.brute_force_rule(u, rules)[2] for i, u in enumerate(pages))
    assert got[900] == ("host77.example/p0/", "block") and got[901] == ("host78.example/p1/", "block") and got[902][0] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    table = spark.createDataFrame([], "kind string, rule string")
    assert urls.judge(none, table).count() == 0
    one = none.union(spark.createDataFrame([(1, "http://com/x")], none.schema))
    assert one.transform(lambda d: urls.judge(d, table)).select("rule", "verdict").first() == (None, "allow")
