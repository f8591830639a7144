"""The tree of path templates on urls that the supplied pages don't have: deep ones and hosts with many branches."""

from __future__ import annotations

import random

import duckdb
import pytest

from quillon.llm import shared, url_filter


def judged(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.url: r for r in url_filter.judge(df, rules).join(df, "page_id").collect()}


def test_branches_below_a_deep_id(spark):
    kinds = {"spam": "block", "reviews": "allow"}
    rules = [(verdict, "h.net", f"/a/b/item/{i}/{k}") for k, verdict in kinds.items() for i in range(100, 110)]
    got = judged(spark, [f"http://h.net/a/b/item/{i}/{k}" for k in kinds for i in range(100, 150)], rules)
    for k, verdict in kinds.items():
        r = got[f"http://h.net/a/b/item/140/{k}"]
        assert (r.rule, r.template, r.verdict) == (None, f"h.net/a/b/item/?/{k}", verdict)


def test_tree_is_as_deep_as_the_paths(spark):
    deep = "/".join("abcdefghij")
    got = judged(spark, [f"http://h.net/{deep}/{i}" for i in range(12)] + ["http://h.net", "http://h.net//a/"], [("allow", "h.net", "/z")])
    assert got[f"http://h.net/{deep}/7"].template == f"h.net/{deep}/?"
    assert got["http://h.net"].template == "h.net" and got["http://h.net//a/"].template == "h.net/a"


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_urls_against_sql(spark, seed):
    rng = random.Random(seed)
    urls = []
    for _ in range(1500):
        path = [rng.choice(["es", "en", "fr", "de"])] + [rng.choice(["a", "b", "c", str(rng.randrange(100))]) for _ in range(rng.randrange(6))]
        urls.append(f"http://{rng.choice(['example.org', 'w.example.org', 'x.com', 'y.net'])}/{'/'.join(path)}")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.execute(url_filter.ORACLE).fetchall()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], round(r[6], 9))
    assert len(want) == len(urls)
    assert sorted(map(repr, map(key, want))) == sorted(map(repr, (key(tuple(r)) for r in url_filter.judge(df).collect())))


def test_branches_of_a_hot_host_are_judged_apart(spark):
    branches = ["bad"] + [f"good{k}" for k in range(29)]  # each 3.3 % of the host
    rules = [("block" if b == "bad" else "allow", "h.net", f"/{b}/1") for b in branches]
    got = judged(spark, [f"http://h.net/{b}/{i}{b}" for b in branches for i in range(185, 215)], rules)
    assert (got["http://h.net/bad/210bad"].template, got["http://h.net/bad/210bad"].verdict) == ("h.net/bad/?", "block")
    assert (got["http://h.net/good7/210good7"].template, got["http://h.net/good7/210good7"].verdict) == ("h.net/?/?", "allow")


def test_branches_like_each_other_are_one(spark):
    """Four branches differ from the rest but not from each other; one differs from all."""
    share = {f"bad{k}": 1.0 for k in range(4)} | {"half": 0.5} | {f"good{k}": 0.0 for k in range(20)}
    urls, rules = [], []
    for b, p in share.items():
        for i in range(40):
            urls.append(f"http://h.net/{b}/x{i}")
            if i < 20:
                rules.append(("block" if i < 20 * p else "allow", "h.net", f"/{b}/x{i}"))
    got = judged(spark, urls, rules)
    assert {got[f"http://h.net/bad{k}/x39"].template for k in range(4)} == {"h.net/?5/?"}
    assert got["http://h.net/half/x39"].template == "h.net/half/?"
    assert got["http://h.net/good3/x39"].template.startswith("h.net/?")
    assert {got[f"http://h.net/bad{k}/x39"].verdict for k in range(4)} == {"block"}


def test_a_literal_wildcard_is_a_segment(spark):
    got = judged(spark, [f"http://h.net/*/{'*' if i % 2 else 'long' * 20_000}" for i in range(12)], [("allow", "z.net", "/")])
    assert {r.template for r in got.values()} == {"h.net/*/*", "h.net/*/" + "long" * 20_000}


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "HOT", 20)
    test_deep_urls_against_sql(spark, 3)
