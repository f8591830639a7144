"""Importance resampling, centroid clustering and k-d sharding against their SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from quillon.llm import cluster, importance, kd_shards, queries
from tests.test_queries import SF, cell

CLASHING = ", ".join(f"`{c}` int" for c in ["id", "uid", "x", "c", "j", "s", "n", "part", "run", "seq", "rank", "score", "weight", "cluster", "distance", "shard", "slot", "node", "leaf", "size", "h_row", "d0", "k", "g"])
FILL = [0] * (CLASHING.count("`") // 2)


@pytest.mark.parametrize("name", ["op11_importance", "op12_cluster", "op13_kd_shards"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].map(cell).itertuples(index=False)))
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- importance


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def draw_by_brute_force(docs, target):
    """(doc_id, n_features, weight, score, rank) of op11's contract, a document at a time."""

    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in pairwise(w))]]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for key, text in docs:
        f = buckets(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(5)
    vocabulary = ["Ähre", "naïve", "x1", "Zoo", "the", "of", "あい", "don't", "a-b", "É"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 19, 20, 21, 60])))) for i in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(None, "the of " * 30)] * 30 + [(900, None), (901, ""), (902, "\x00 \x85\xa0"), (903, "word " * 250_000), (904, "x" * 2_500_000 + " y z")]
    return docs


def test_importance_by_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(importance, "RUN", 16)
    monkeypatch.setattr(importance, "BLOCK", 4)
    df = spark.createDataFrame([(*r, *FILL) for r in odd_docs], "doc_id long, text string, " + CLASHING).repartition(5)
    target = ["the zoo of naïve x1", None, "", "of the"]
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert sorted(map(tuple, got), key=str) == draw_by_brute_force(odd_docs, target)
    assert importance.resample(df.limit(0), df.limit(0).select("text")).count() == 0
    assert importance.resample(df, df.limit(0).select("text")).count() == len(odd_docs)


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = b"One two-three  \xc3\x84 4five" * 50
    for n in (1, 2, 3):
        whole = list(importance.features(text, n, 997))
        monkeypatch.setattr(importance, "PIECE", 7)
        pieces = list(importance.features(text, n, 997))
        monkeypatch.undo()
        assert len(whole) == 1 < len(pieces) and sum(w for w, _ in pieces) == whole[0][0]
        assert Counter(b for _, a in pieces for b in a.tolist()) == Counter(whole[0][1].tolist())


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 64, 65, 300])
def test_tournaments_merge_any_number_of_runs(k):
    rng, spool, rows = random.Random(k), importance.Spool(), []
    runs = []
    for _ in range(k):
        run = sorted(((rng.choice([None, rng.randint(0, 9)]), rng.randint(0, 1 << 40), 1, 2, rng.randint(-3, 3)) for _ in range(rng.randint(0, 9))), key=lambda r: importance._key(r[4], r[0], r[1]))
        rows += run
        runs.append(spool.rows(iter(run)))
    order = importance.merged(spool, runs)
    some = [order.pop() for _ in range(len(rows) // 2)]
    rows.sort(key=lambda r: importance._key(r[4], r[0], r[1]))
    assert some == rows[: len(rows) // 2]
    assert Counter(order.rest()) == Counter(rows[len(rows) // 2 :])


# ---------------------------------------------------------------- clusters


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 10, 1 << 24, cluster.BOUND):
        c = rng.integers(-size, size + 1, (9, 64))
        c[3], c[7] = c[1], c[1] + 1  # a tie and a near tie
        x = np.concatenate([rng.integers(-size, size + 1, (300, 64)), c, (c[1:2] + c[5:6]) // 2, np.zeros((1, 64), int)])
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x], object)
        want = [min(range(9), key=lambda j: (row[j], j)) for row in d]
        maybe = cluster.screen(x, c)
        assert all(maybe[i, j] for i, j in enumerate(want))
        got, exact = cluster.nearest(x, c)
        assert got.tolist() == want
        if size == 1 << 10:
            assert exact < maybe.size / 2  # most are decided by the screen


def test_odd_vectors(spark):
    v = [float(i) for i in range(64)]
    rows = [(1, v), (1, v), (2, [x / 3 for x in v]), (None, v), (3, None), (4, v[:63]), (5, [*v, 1.0]), (6, [None, *v[1:]]), (7, [float("nan"), *v[1:]]), (8, [float("-inf"), *v[1:]]), (9, []), (10, [-1e30, *v[1:]]), (11, [3e38] * 64)]
    df = spark.createDataFrame([(*r, *FILL) for r in rows], "vec_id long, embedding array<float>, " + CLASHING)
    got = cluster.cluster(df, k=3).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 10), (False, 11), (True, 0)]
    same = {(r.cluster, r.distance) for r in got if r.vec_id in (1, None)}
    assert len(same) == 1  # copies share a cluster
    for c in {r.cluster for r in got}:
        mine = [r for r in got if r.cluster == c]
        assert {r.cluster_inertia for r in mine} == {sum(r.distance for r in mine)}
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert cluster.cluster(df.limit(0)).count() == 0 == cluster.cluster(df.where("vec_id = 3")).count()
    assert cluster.cluster(df, k=50).count() == 6  # more centroids than vectors


# ---------------------------------------------------------------- shards


def shards_by_brute_force(rows, shards, dims):
    """Shard of each row (id, text, source, lang), by sorting each node whole."""
    number = lambda t: -1 if t is None else int((t.encode().hex()[:14]).ljust(14, "0") or "0", 16)
    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    points = []
    for uid, (key, text, source, lang) in enumerate(rows):
        size = len((text or "").encode()) + 8
        place = {"source": number(source), "lang": number(lang), "bytes": size}
        points.append({"d": [place[d] for d in dims], "size": size, "t": -1 if text is None else md5(text), "r": md5(("null" if key is None else str(key)) + "|" + hashlib.md5((text or "").encode()).hexdigest()), "uid": uid})
    spans = [max(p["d"][i] for p in points) - min(p["d"][i] for p in points) for i in range(len(dims))]
    out = {}

    def cut(ps, first, n):
        if n == 1 or not ps:
            out.update({p["uid"]: first for p in ps})
            return
        ratio = [(max(p["d"][i] for p in ps) - min(p["d"][i] for p in ps)) / spans[i] if spans[i] else 0.0 for i in range(len(dims))]
        i = ratio.index(max(ratio))
        keys = lambda p: (p["d"][i], p["t"], p["r"], p["uid"])
        total = sum(p["size"] for p in ps)
        goal, share, left, right, before, level = total * (n // 2) // n, total // n, [], [], 0, 1
        inside = sorted(ps, key=keys)
        while inside:  # the key at which the bytes cross the goal, by ever more of its parts
            groups = defaultdict(list)
            for p in inside:
                groups[keys(p)[:level]].append(p)
            inside, crossed = [], False
            for g in groups.values():
                size = sum(p["size"] for p in g)
                if crossed:
                    right += g
                elif before + size <= goal:
                    left += g
                    before += size
                else:
                    crossed = True
                    if size * kd_shards.WHOLE <= share or level == 4:
                        (left if before + size - goal < goal - before else right).extend(g)
                    else:
                        inside = g
            level += 1
        cut(left, first, n // 2)
        cut(right, first + n // 2, n - n // 2)

    cut(points, 0, shards)
    return [out[i] for i in range(len(rows))]


def test_shards_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 300) + str(i), rng.choice(["a", "b", "web/long/name", None, "hot", "hot"]), rng.choice(["de", "en", None, "ü"])) for i in range(400)]
    rows += [(1000 + i, "one text that many rows have " * 5, "hot", "en") for i in range(250)]  # a hot group of copies
    rows += [(None, "no id", "hot", "en")] * 60 + [(5000, "repeated row", "b", "de")] * 90 + [(6000, None, None, None), (6001, "", "a", "de"), (6002, "long " * 3000, "a", "de")]
    df = spark.createDataFrame([(*r, *FILL) for r in rows], "doc_id long, text string, source string, lang string, " + CLASHING).repartition(3)
    got = kd_shards.shard(df, shards=24).collect()
    mine = Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), s) for r, s in zip(rows, shards_by_brute_force(rows, 24, ("source", "lang", "bytes"))))
    assert mine == want
    total = sum(r.size for r in got)
    sizes = Counter()
    slots = defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(v for s, v in sizes.items()) < 1.1 * total / 24 + 15_100
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_of_few_rows_and_other_dimensions(spark):
    df = spark.createDataFrame([(1, "a", 5, 1.5), (2, None, None, None), (3, "ccc", -(1 << 63), -2.0)], "doc_id long, text string, n long, f double")
    got = kd_shards.shard(df, shards=5, dims=("n", "f", "bytes")).collect()
    assert len({r.shard for r in got}) == 3 and all(0 <= r.shard < 5 and r.slot == 0 for r in got)
    assert kd_shards.shard(df.limit(0), shards=5, dims=("n",)).count() == 0
    assert {r.shard for r in kd_shards.shard(df, shards=1, dims=("n",)).collect()} == {0}


def test_hot_keys_are_numbered_by_task(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "GROUP", 2)
    df = spark.createDataFrame([(1, "same", "s", "l")] * 300 + [(i, f"t{i}", "s", "l") for i in range(50)], "doc_id long, text string, source string, lang string").repartition(4)
    slots = defaultdict(list)
    for r in kd_shards.shard(df, shards=3).collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 3 and all(sorted(x) == list(range(len(x))) for x in slots.values())
