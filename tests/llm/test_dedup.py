"""Exact dedup, n-gram join, repeated passages, fingerprints, mixing, URL filter, toxicity, pipeline: small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, exact_dedup, fingerprint, mixing, near_dup, repeats, shared, toxicity, url_filter
from quillon.llm.wordhash import Words

SPACE = "[\\x20\\x09-\\x0D]+"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def random_texts(seed=2, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choices(vocab, k=rng.randint(60, 160))))
    for t in list(out[:20]):  # near copies, and copies of copies
        ws = t.split()
        for k in range(rng.randint(1, 5)):
            ws[rng.randrange(len(ws))] = f"x{k}"
            out.append(" ".join(ws))
    out += ["same short", "Same  SHORT", "a b c d e", "A b\tc d e", "", None, " \n", out[0], out[0].upper()]
    return out


# ---------------------------------------------------------------- exact dedup


def test_exact_groups(spark):
    cases = [(4, "a  b"), (2, "a\tb"), (3, "a b "), (7, None), (6, ""), (None, "a b"), (2, "a b"), (9, "z" * 100_000), (8, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in cases], "doc_id long, text string, keep_id string")
    got = sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=str)
    norm = lambda t: re.sub(SPACE, " ", t or "")
    groups = defaultdict(list)
    for i, t in cases:
        groups[norm(t)].append(i)
    for i, keep, size, kept, sha in got:
        g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == sha)
        assert size == len(g) and keep == min(x for x in g if x is not None)
    assert len(got) == len(cases)
    assert sum(r[3] for r in got) == len(groups)
    stay = exact_dedup.exact_dedup(df)
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_grace_splits_and_loses_nothing(tmp_path):
    rng = random.Random(1)
    texts = [f"text {rng.randrange(300)}".encode() for _ in range(2000)]
    hashes = {t: rng.randrange(1 << 64) for t in texts}
    for t in texts[:60]:
        hashes[t] = 7  # different texts with one hash
    got = {t: sorted(p[0] for p in ps) for _, t, ps in exact_dedup.grace(iter([(hashes[t], t, (i,)) for i, t in enumerate(texts)]), 2000, str(tmp_path))}
    expected = defaultdict(list)
    for i, t in enumerate(texts):
        expected[t].append(i)
    assert got == dict(expected)
    assert not list(tmp_path.iterdir())


def test_small_budget_gives_the_same(spark):
    df = spark.createDataFrame([(i, f"text {i % 37} " * 20) for i in range(400)], "doc_id long, text string")
    a = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    assert a == sorted(map(tuple, exact_dedup.exact_groups(df, budget=1000).collect()))


# ---------------------------------------------------------------- n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile, hot", [(3, 8), (128, 2)])
def test_near_groups(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "HOT", hot)
    rows = list(enumerate(random_texts()))
    # many documents that share most of a passage, none of them hub of all links
    rng = random.Random(9)
    base = [f"s{i}" for i in range(120)]
    for k in range(40):
        ws = list(base)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(len(ws))] = f"y{rng.randrange(50)}"
        rows.append((len(rows), " ".join(ws)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_groups(df).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in near_dup.one_of_each(df).collect()}
    assert kept == {c for _, c in brute_components(rows).values()}


def test_near_groups_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None), (2, "")], "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_groups(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (1, 0, 1), (2, 0, 2)], key=str)
    assert near_dup.near_groups(df.limit(0)).count() == 0


def test_bit_counts_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)]))
        x, y = near_dup.bitmap(a), near_dup.bitmap(b)
        w = min(len(x), len(y))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert near_dup.may_link(len(a), len(b), (near_dup.fold(x, w) ^ near_dup.fold(y, w)).bit_count(), 80, 100)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# ---------------------------------------------------------------- repeated passages


@pytest.mark.parametrize("block, local, common", [(64, 3000, 8), (3, 900, 8), (1 << 16, 6 << 20, 2)])
def test_repeated_spans(spark, monkeypatch, block, local, common):
    for name, x in (("BLOCK", block), ("LOCAL", local), ("COMMON", common), ("VOCABULARY", 30)):
        monkeypatch.setattr(repeats, name, x)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    passage = rng.choices(vocab, k=30)
    rows = []
    for i in range(40):
        ws = rng.choices(vocab, k=rng.randint(0, 90))
        if i % 3 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = passage[rng.randint(0, 8) :]
        rows.append((i, " ".join(ws)))
    rows += [(40, rows[3][1].upper()), (41, None), (42, "q " * 60), (None, " ".join(passage))]
    n = 12
    seen = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        w = words(t)
        for a in range(len(w) - n + 1):
            seen[tuple(w[a : a + n])].append(((i is None, i or 0, k), k, a))
    repeated, extra = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            for p in places:
                repeated[p[1]] |= set(range(p[2], p[2] + n))
                if p != first:
                    extra[p[1]] |= set(range(p[2], p[2] + n))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, uid int, id string").repartition(3, "text")
    got = {r.doc_id: r for r in repeats.repeated_spans(df, n).collect()}
    for k, (i, t) in enumerate(rows):
        cover = lambda spans: {x for s in spans for x in range(s.start, s.end)}
        assert got[i].n_words == len(words(t))
        assert cover(got[i].spans) == repeated[k] and got[i].repeated_words == len(repeated[k]), i
        assert cover(got[i].extra) == extra[k] and got[i].extra_words == len(extra[k]), i
    cut = {r.doc_id: r.text for r in repeats.without_repeats(df, n).collect()}
    for k, (i, t) in enumerate(rows):
        if i is not None:
            assert words(cut[i]) == [w for x, w in enumerate(words(t)) if x not in extra[k]]
    assert repeats.repeated_spans(df.limit(0), n).count() == 0


# ---------------------------------------------------------------- fingerprints


def own_paragraphs(t):
    """Lines, cut behind words whose hash says so: by the rule, without the module's arrays."""
    out = []
    for line in t.split("\n") if t else []:
        raw, start = line.encode(), 0
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
        for m in found[:-1]:
            h = int(Words([m[0]]).hash[0])
            if (h >> 13) % fingerprint.CUT == 0:
                out.append(raw[start : m.end()])
                start = m.end()
        out.append(raw[start:])
    return out


def test_fingerprints(spark):
    cases = [(5, "one\ntwo\nthree words here"), (3, None), (9, "äöü" * 2000), (4, "x"), (None, "null id\nhere"), (4, "x"), (None, "another"), (6, "many words stand in this line " * 30 + "\n\nend"), (8, "w " * 60_000)]
    cases += [(7, f"row {i} of one id\nwith a text of its own") for i in range(20)]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in cases], "doc_id long, text string, part string, id string")
    tie = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), shared.tie(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = sorted((tuple(r) for r in fingerprint.fingerprints(df).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    order = sorted(cases, key=lambda x: (x[0] is None, -(x[0] or 0), -tie[x[1] or ""], x[1] or ""))
    expected = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + u[:m]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, u))
    expected.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    multiset = lambda t: tuple(sorted(own_paragraphs(t)))
    prints = defaultdict(set)
    for r, x in zip(got, expected):
        assert r[:3] == x[:3]
        prints[multiset(x[3])].add(r[3])
        prints[multiset(x[4])].add(r[4])
        for near, other in ((r[5], x[4]), (r[6], x[5])):
            a, b = Counter(own_paragraphs(x[3])), Counter(own_paragraphs(other))
            size = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
            true = 2 * sum(v * b[p] for p, v in a.items()) / size if size else 1.0
            assert abs(near - true) < 0.25, (x[3][:40], near, true)
    assert all(len(v) == 1 for v in prints.values()) and len(set.union(*prints.values())) == len(prints)
    assert len(got) == len(cases)
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df.limit(1)).count() == 1


def test_likeness_estimates_shared_paragraphs():
    rng = random.Random(3)
    line = lambda: "".join(rng.choices("abcdefgh", k=12)).encode()
    for share in (0, 0.25, 0.5, 0.75, 1):
        common = [line() for _ in range(int(80 * share))]
        texts = [b"\n".join(rng.sample(x := common + [line() for _ in range(80 - len(common))], len(x))) for _ in range(2)]
        v = fingerprint.vectors(texts)
        near = fingerprint.likeness((v[0][:1], v[1][:1]), (v[0][1:], v[1][1:]))[0]
        assert abs(near - share) < 0.2
    v = fingerprint.vectors([b"same\n" * 40_000, b"same\n" * 40_000 + b"x"])
    assert fingerprint.likeness((v[0][:1], v[1][:1]), (v[0][1:], v[1][1:]))[0] > 0.99
    assert [list(map(int, x)) for x in fingerprint.parse(fingerprint.digest(v[0][0], v[1][0]))] == [v[0][0].tolist(), v[1][0].tolist()]


def test_fingerprints_add_up():
    of = lambda t: fingerprint.digest(*(v[0] for v in fingerprint.vectors([t.encode()])))
    assert of("a b c\nd\n\ne") == of("e\n\nd\na b c")
    assert fingerprint.insert(of("e\nd"), ["a b c", ""]) == of("a b c\nd\n\ne")
    assert fingerprint.delete(of("a b c\nd\n\ne"), ["d", "e"]) == of("\na b c")
    assert of("a") != of("a\na") and of("") != of("\n")


# ---------------------------------------------------------------- mixing


def test_mix(spark):
    rng = random.Random(8)
    cases = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "Ä", None, "zz"])) for i in range(500)] + [(900, None, "a"), (None, "x y", "empty"), (None, "x y", "empty")]
    df = spark.createDataFrame(cases, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(cases)
    size = defaultdict(int)
    for _, t, s in cases:
        size[s] += len((t or "").split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    by_id = {i: s for i, _, s in cases}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0


# ---------------------------------------------------------------- URL filter


def test_url_rules(spark):
    cases = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "ftp://x.com/fr/", "http://com/de/5#a", "http://notexample.org", None, "no scheme", "http://h.net?x=/de/", "http://x.org/", "http://xorg/de/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(cases)] + [(None, cases[0], "c")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") == got[None]
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[3] == ("com", "/de/5", "com/de/", "block")
    assert got[4] == ("notexample.org", "", None, "allow")
    assert got[5][:3] == ("", "", None) == got[6][:3]
    assert got[7][:3] == ("h.net", "", None)
    assert got[8] == ("x.org", "/", "org/", "allow")
    assert got[9][2] is None
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    rules = [("block", "bad.net", "/ads/1"), ("allow", "bad.net", "/news/1")]
    urls = [f"http://bad.net/{k}/{i}" for k in ("ads", "news") for i in range(100, 240)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r for r in url_filter.judge(df, rules).join(df, "page_id").collect()}
    assert got["http://bad.net/ads/230"].verdict == "block" and got["http://bad.net/ads/230"].template == "bad.net/ads/?"
    assert got["http://bad.net/news/230"].verdict == "allow"


# ---------------------------------------------------------------- toxicity


def toxic_corpus(seed, n=400):
    rng = random.Random(seed)
    sounds = ["ti", "on", "er", "an", "the", "ou", "re", "st", "ha", "ing", "bo", "le"]
    word = lambda: "".join(rng.choices(sounds, k=rng.randint(1, 4)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(30, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(["grubnik", "vexpaw", "Zorblat!", "grub*nik", "ve.xpaw", "zorrblat"])
        out.append((i, " ".join(ws) + ".", int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_corpus(1) + [(1000 + i, t, y) for i, t, y in toxic_corpus(2)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert toxicity.harmless(docs, model, 0.5).count() < len(got)
    gap = model.scores(["ti on er gru.bn-ik the ou re", "ti on er the ou re"])
    assert gap[0] > 0.5 > gap[1]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).first().predicted == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(random_texts(5)) if t and t.strip()]
    bad = [(2000 + i, t, "en", "s1", len(t)) for i, t, y in toxic_corpus(3, 300)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, y) for i, _, y in toxic_corpus(3, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in at.collect()]
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append((before, at.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
    toxic = {2000 + i for i, _, y in toxic_corpus(3, 300) if y}
    kept = {r.doc_id for r in steps[0][1]}
    assert len(kept & toxic) <= 0.2 * len(toxic) and len(kept - toxic) >= 0.95 * (len(docs.collect()) - len(toxic))
    first = {}
    for r in sorted(steps[1][0]):
        first.setdefault(re.sub(SPACE, " ", r[1]), r[0])
    assert {r.doc_id for r in steps[1][1]} == set(first.values())
    comp = brute_components([(r[0], r[1]) for r in steps[2][0]])
    assert {r.doc_id for r in steps[2][1]} == {c for _, c in comp.values()}
    total = sum(len(r[1].split()) for r in steps[3][0])
    assert abs(sum(len(r.text.split()) for r in steps[3][1]) - 1.5 * total) < 0.1 * total
    assert sorted(r.doc_id for r in steps[4][1]) == sorted(r[0] for r in steps[4][0])
    assert all(len(r.ids) == r.n_tokens for r in steps[4][1])


@pytest.mark.parametrize("own", [lambda r: 4, lambda r: r.randint(1, 40)])
def test_a_page_template_makes_no_more_rows_than_documents(spark, monkeypatch, own):
    """Texts that share most of their words but are too different meet in no tile; those that link do so at once."""
    seen, links = [], near_dup._tile_links

    def counted(rows, *rest):
        seen.append(rows.count())
        return links(rows, *rest)

    monkeypatch.setattr(near_dup, "_tile_links", counted)
    size = 20 if own(random.Random(0)) == 4 else 120
    texts = [" ".join([f"c{i}" for i in range(size)] + [str(r.random()) for _ in range(own(r))]) for r in map(random.Random, range(600))]
    got = near_dup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, find(i)) for i in range(len(sets))}
    assert sum(seen) <= len(texts) + 20
