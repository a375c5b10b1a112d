"""The operators over text and measurements: hard cases, brute force, exact round trips."""

from __future__ import annotations

import sys

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seston.llm import leaks as L
from seston.llm import stuffing as S
from seston.llm.encode import Vocabulary, decode_ids, default_folder, encode_texts
from seston.llm.forest import Search
from seston.llm.groups import describe_groups, linked, mass_within, medoid, merged, nearest_label, object_groups
from seston.llm.neighbours import exact_neighbours, neighbour_pairs, neighbours, recall
from seston.llm.objects import current_objects
from seston.llm.varied import draw, drawn_groups, inverse_density_sample, linkage_groups, varied_sample


def test_registered():
    assert {"p1_found", "p3_found", "p6_found", "p8_ids", "p9_found", "p10_found"} <= set(entry.queries())


def test_missing_module_is_an_error(monkeypatch):
    monkeypatch.setitem(sys.modules, "seston.llm.queries", None)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


# ---- 8


@pytest.fixture(scope="module")
def vocabulary():
    v = Vocabulary(default_folder().rstrip("/") + "/byte_bpe_50k.tiktoken")
    import public_tokenizers

    return v, tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


TEXT = st.text(st.one_of(st.sampled_from("ab stmdrevl''  \n\t\r\x1c\x85　é日½1٣!?.́😀ſSREVE"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encode_like_the_library(vocabulary, texts):
    v, library = vocabulary
    made = list(v.encode(texts))
    assert made == [library.encode_ordinary(t) for t in texts]
    assert [v.decode(m) for m in made] == texts


def test_encode_rows(spark, vocabulary):
    v, library = vocabulary
    texts = ["Hello world", "", None, "<|endoftext|> can't, we'll 's", "x" * 30000 + " ü\n\n " * 2000, "Hello world", " \n "]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in encode_texts(rows, offsets=True).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == (library.encode_ordinary(t) if t else []) and len(got[i].offsets) == len(got[i].ids)
    assert got[0].ids == [15496, 995] and got[0].offsets == [0, 5] and got[None].ids == [64] and 50256 not in got[3].ids
    back = decode_ids(encode_texts(rows)).filter("doc_id IS NOT NULL").orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in texts]
    assert encode_texts(rows.limit(0)).count() == 0


# ---- 1


@pytest.mark.parametrize("ties", [0, 1500])
def test_forest_against_all_pairs(ties):
    x = np.random.default_rng(ties).random((3000, 3))
    x[:ties] = x[0]
    points = np.c_[x, np.random.default_rng(1).random(3000) * 1e-7]
    s = Search(points, points, np.arange(3000), 5, real=3, slack=2e-7)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (s.dist <= np.sort(d, 1)[:, :5] + 1e-12).mean() > 0.99 and (s.near != np.arange(3000)[:, None]).all()
    assert all(len(set(r)) == 5 for r in s.near.tolist())


def test_neighbours_over_buckets(spark):
    x = np.random.default_rng(1).random((3000, 3))
    x[:1000] = x[0]
    rows = spark.createDataFrame([(i, *map(float, p), "clash") for i, p in enumerate(x)] + [(9999, None, 0.5, 0.5, "")], "roi_id long, a double, b double, c double, d string")
    near = neighbours(rows, ["a", "b", "c"], bucket=400)
    got = {r.id: r.near for r in near.collect()}
    assert len(got) == 3000 and all(len(v) == 5 and len({p.b for p in v}) == 5 for v in got.values()) and all(i not in {p.b for p in v} for i, v in got.items())
    r = recall(near, exact_neighbours(rows, rows.filter("roi_id % 100 = 0"), ["a", "b", "c"])).first()
    assert r.n_queries == 30 and r.n_true == 150 and r.recall >= 0.98
    pairs = neighbour_pairs(near)
    assert pairs.filter("roi_id_a >= roi_id_b").count() == 0 and pairs.distinct().count() == pairs.count()


def test_few_points(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "roi_id long, a double")
    assert {r.id: [p.b for p in r.near] for r in neighbours(rows, ["a"]).collect()} == {1: [2, 3], 2: [3, 1], 3: [2, 1]}
    assert [r.near for r in neighbours(rows.limit(1), ["a"]).collect()] == [[]] and neighbours(rows.limit(0), ["a"]).count() == 0
    assert recall(neighbours(rows.limit(0), ["a"]), exact_neighbours(rows, rows.limit(0), ["a"])).first().recall == 1.0


def test_current_objects(spark):
    rows = [(1, 1, 2.0, "s"), (1, 2, 3.0, "t"), (2, 1, float("nan"), "s"), (3, 1, -1.0, "s"), (4, 2, None, "s"), (4, 1, 5.0, "s"), (5, 1, float("inf"), "s"), (None, 1, 1.0, "s"), (6, 1, 4.0, None), (6, 1, 4.0, None)]
    df = spark.createDataFrame(rows, "roi_id long, processed_at int, area double, sample_id string")
    assert sorted(tuple(r) for r in current_objects(df, ["area"], "sample_id").collect()) == [(1, "t", 3.0), (6, None, 4.0)]


# ---- 3


def test_sample_covers_small_groups(spark):
    rows = [(i, " S ", 100.0 * (1 + i * 1e-5), 0.3) for i in range(1, 500)] + [(500, "s", 900.0, 0.3), (501, "s", 100.0, 0.9), (502, "t", 5.0, 0.1), (502, "t", 5.0, 0.1), (503, None, 5.0, 0.1), (504, "s", None, 0.1)]
    objects = spark.createDataFrame(rows, "roi_id long, sample_id string, area double, circ double")
    plan = spark.createDataFrame([("S", 3), ("t", 4), ("u", 2), (None, 1), ("s ", 1)], "sample_id string, n_pick int")
    axes = [F.log("area"), F.col("circ") * 4]
    assert sorted(r.roi_id for r in varied_sample(objects, plan, axes).collect()) == [1, 500, 501, 502]
    assert varied_sample(objects.limit(0), plan, axes).count() == 0 and varied_sample(objects, plan.limit(0), axes).count() == 0


def test_inverse_density_draw(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.01, (4000, 2)), rng.normal(5, 0.01, (40, 2)), rng.uniform(10, 40, (40, 2))])
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(None, 0.0, 0.0), (5000, None, 0.0), (0, *map(float, x[0]))], "roi_id long, a double, b double")
    axes = [F.col("a"), F.col("b")]
    got = [r.roi_id for r in inverse_density_sample(rows, 40, axes).collect()]
    assert len(set(got)) == 40 and sum(g >= 4040 for g in got) >= 30 and got == [r.roi_id for r in inverse_density_sample(rows, 40, axes).collect()]
    assert inverse_density_sample(rows, 10**6, axes).count() == 4080 and inverse_density_sample(rows.limit(0), 5, axes).count() == 0


def test_linkage():
    assert list(linkage_groups(np.zeros((1, 2)), 4)) == [0]
    points = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    for n, want in ((1, {5}), (2, {2, 3}), (3, {2, 2, 1}), (5, {1})):
        group = linkage_groups(points, n)
        assert len(set(group)) == n and set(np.bincount(group)) == want


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_draw_decides_what_is_linked():
    # a group of 3000 places, each in a bucket with all the others, and three places by themselves
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.uniform(0, 0.5, (3000, 2)), [[3.0, 0.0], [0.0, 3.0], [3.0, 3.0]]])
    ids, chance = np.arange(3003), rng.random(3003)
    whole = linkage_groups(points, 4)
    density = np.r_[np.full(3000, 3000.0), np.ones(3)]
    group, linked_over = drawn_groups(points, draw(ids, 1 / density, chance), 4)
    assert linked_over == 32 and same_parts(group, whole)
    # drawn without regard to density the first draw misses them: it is found out, and the groups are the same
    group, linked_over = drawn_groups(points, draw(ids, np.ones(3003), chance), 4)
    assert linked_over > 32 and same_parts(group, whole)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_drawn_groups_are_those_of_all(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 8))
    centres = rng.uniform(0, 4, (int(rng.integers(1, 9)), 2))
    points = np.concatenate([c + rng.normal(0, rng.choice([0.01, 0.1, 0.4]), (int(rng.integers(1, 60)), 2)) for c in centres])
    group, linked_over = drawn_groups(points, rng.permutation(len(points)), n, first=int(rng.integers(1, 9)))
    assert same_parts(group, linkage_groups(points, n)) and linked_over <= len(points)


# ---- 6


def test_local_clustering_against_all_pairs():
    rng = np.random.default_rng(3)
    p = rng.random((400, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    w = rng.integers(1, 5, 400).astype(float)
    assert np.allclose(mass_within(p, p, w, 0.1), (d <= 0.1) @ w)
    label = np.arange(400)
    while True:
        new = np.where(d <= 0.1, label[None, :], 400).min(1)
        if (new == label).all():
            break
        label = new
    assert (linked(p, 0.1) == label).all()
    near = nearest_label(p[:50], p[50:], np.arange(350), 0.1)
    assert [(n if n >= 0 else None) for n in near] == [int(r.argmin()) if r.min() <= 0.1 else None for r in d[:50, 50:]]


def test_merging_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.v: r.label for r in merged(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_groups_and_noise(spark):
    rng = np.random.default_rng(2)
    # two groups, one of which lies over the borders of blocks, and two objects apart
    p = np.concatenate([rng.normal(0, 0.02, (300, 2)), rng.normal(0, 0.02, (300, 2)) + 1, [[5.0, 5.0], [5.0, 5.0]]])
    objects = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(None, 0.0, 0.0), (900, None, 0.0)], "roi_id long, a double, b double")
    ex = spark.createDataFrame([(7, 0.0, 0.0), (3, 0.01, 0.0), (9, 1.0, 1.0), (1, 5.0, 5.0), (2, None, 0.0)], "exemplar_id int, a double, b double")
    axes = [F.col("a"), F.col("b")]
    found = object_groups(objects, ex, axes)
    assert {r.roi_id: r.exemplar_id for r in found.collect()} == {i: 3 if i < 300 else 9 for i in range(600)}
    told = {r.exemplar_id: r for r in describe_groups(found, 2).collect()}
    assert told[3].n_objects == told[9].n_objects == 300 and all(np.abs(p[told[3].medoid]) < 0.02) and len(told[9].typical) == 5
    assert {r.exemplar_id for r in object_groups(objects, ex.limit(0), axes).collect()} == {None}
    assert object_groups(objects.limit(0), ex, axes).count() == 0


def test_medoid_far_from_the_mean(spark):
    # 300 objects at one end of a chain of 100 cells with two objects each: the mean lies 20 cells away from where the most are
    x = [0.02] * 300 + [0.02 + 0.04 * k for k in range(1, 101) for _ in range(2)]
    objects = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "roi_id long, a double")
    ex = spark.createDataFrame([(7, 0.02)], "exemplar_id int, a double")
    told = describe_groups(object_groups(objects, ex, [F.col("a")]), 1).collect()
    assert [(r.exemplar_id, r.n_objects, r.medoid, r.typical) for r in told] == [(7, 500, 0, [0, 1, 2, 3, 4])]
    told = describe_groups(object_groups(objects, ex.limit(0), [F.col("a")]), 1).collect()
    assert [(r.exemplar_id, r.medoid) for r in told] == [(None, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_medoid_against_all_sums(seed):
    rng = np.random.default_rng(seed)
    n, axes = int(rng.integers(1, 300)), int(rng.integers(1, 5))
    shape = rng.integers(0, 4)
    p = rng.normal(0, 0.1, (n, axes)) if shape < 2 else rng.integers(0, 4, (n, axes)).astype(float)
    if shape == 1:  # a ring: nothing lies near the mean
        p /= np.sqrt((p**2).sum(1, keepdims=True))
    w = rng.integers(1, 10 ** int(rng.integers(1, 7)), n).astype(float)
    sums = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) @ w
    at, counted = medoid(p, w)
    assert sums[at] <= sums.min() * (1 + 1e-9) + 1e-12 and 1 <= counted <= n
    assert at == np.flatnonzero(sums <= sums.min() * (1 + 1e-9))[0] or shape < 3  # of equal sums the first


def test_medoid_counts_few_sums():
    p = np.random.default_rng(0).normal(0, 0.1, (20000, 4))
    assert medoid(p, np.ones(20000))[1] < 2000


# ---- 9

W = [f"w{chr(97 + i)}" for i in range(26)]


def test_leaks(spark):
    items = spark.createDataFrame([(5, " ".join(W)), (6, "too short"), (7, None), (None, " ".join(W)), (8, "")], "item_id long, passage string")
    texts = {
        "so " + " ".join(W[3:16]).upper() + " end": True,  # 13 words
        "so " + ", ".join(W[3:9]) + " (Applause) " + " ".join(W[9:16]): True,
        " ".join(W[2:7] + ["x"] + W[8:20]): True,
        " ".join(W[2:7] + W[8:12] + ["y"] + W[12:20]): True,
        "so " + " ".join(W[3:15]) + " end": False,  # 12 words
        " ".join(W[16:2:-1]): False,
        " ".join(w for k in range(0, 26, 3) for w in (*W[k : k + 3], "z")): False,  # an error in every four words
        "lorem ipsum " * 20000 + " ".join(W): True,
        "": False,
    }
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(99, None, 0), (0, next(iter(texts)), 0)], "doc_id long, text string, item_id int")
    assert sorted(tuple(r) for r in L.leaks(rows, items).collect()) == [(i, 5) for i, hit in enumerate(texts.values()) if hit]
    assert L.leaks(rows, items.limit(0)).count() == 0 and L.leaks(rows.limit(0), items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"{w}{k}" for w in W)) for k in range(5)], "item_id long, passage string")
    rows = spark.createDataFrame([(k, "x " + " ".join(f"{w}{k}" for w in W[4:20])) for k in range(5)], "doc_id long, text string")
    monkeypatch.setattr(L, "BLOCK_WORDS", 30)
    assert sorted(tuple(r) for r in L.leaks(rows, items).collect()) == [(k, k) for k in range(5)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_seeds_lose_nothing(seed):
    """Whatever alignment accepts is found through the seeds as well."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in rng.permutation(60)]
    length = int(rng.integers(13, 40))
    at = int(rng.integers(0, 60 - length + 1))
    part = passage[at : at + length]
    for k in sorted(rng.choice(np.arange(1, length - 1), min(int(length // 6), length - 2), replace=False), reverse=True):
        kind = rng.integers(0, 3)
        part[k : k + 1] = [] if kind == 0 else ["other"] if kind == 1 else [part[k], "more"]
    text = [f"t{i}" for i in range(30)] + part + [f"u{i}" for i in range(30)]
    items = L.Items([(1, " ".join(passage))])
    numbers = items.numbers(text)
    assert L.found_in([numbers], items) == ([(0, 0)] if L.takes_over(numbers, items.words[0]) else [])


# ---- 10


def corpus():
    """Prose, notes, rolls and stuffing, enough to learn from."""
    rng = np.random.default_rng(5)
    nouns, verbs = "levy port road school budget library tariff harbour council forest".split(), "supports delays rejects protects funds reviews extends burdens".split()
    names = [a + b for a in ("Des", "Mor", "Hin", "Tas", "Vo", "Lor") for b in ("hades", "darja", "sol", "wil", "elfe", "ban")]
    goods = "boat varnish|used tractors|camping stove|solar roof quote|fishing reels|wedding tents".split("|")
    pick = lambda xs: xs[rng.integers(0, len(xs))]
    prose = lambda n: "\n".join(f"In this House the {pick(nouns)} {pick(verbs)} the {pick(nouns)}, and we have to say that it is not for the {pick(nouns)}." for _ in range(n))
    out = [(prose(int(rng.integers(3, 9))), False) for _ in range(60)]
    out += [("In favour: " + ", ".join(pick(names) for _ in range(40)) + ".", False) for _ in range(10)]
    out += [("\n".join(f"[{k}] https://archive.example/{k}" for k in range(1, 4)) + "\n" + prose(3), False) for _ in range(5)]
    for _ in range(6):
        good = pick(goods)
        out.append((" ".join(f"{good} {pick(['buy', 'best', 'now', 'top'])}" for _ in range(30)), True))
        out.append((" ".join("#" + pick(goods).title().replace(" ", "") for _ in range(30)), True))
        out.append(("\n".join(f"http://shop.example/{pick(goods).replace(' ', '-')}/{rng.integers(1, 999)}" for _ in range(20)), True))
        out.append(("\n".join(f"{pick(goods).title()} eco steel EUR {rng.integers(9, 99)}.00 Add to cart" for _ in range(12)), True))
        out.append((prose(1) + "\n" + "\n".join(f"[{pick(goods)}](shop.example/{rng.integers(1, 999)})" for _ in range(15)), True))
    out += [("Never again! " * 20 + prose(3), False), ("", False), (None, False), (" \n ", False), (prose(2000), False)]
    return out


def test_stuffing(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, t int")
    assert sorted(r.doc_id for r in S.stuffed(rows).collect()) == [i for i, (_, hit) in enumerate(texts) if hit]
    assert S.stuffed(rows.limit(0)).count() == 0
    # a smaller sample to learn from gives the same
    assert S.stuffed(rows, sample=60).count() == sum(hit for _, hit in texts)


def test_likeliest_paths_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    n = len(S.LABELS)
    m = S.Model(rng.random(n), rng.random((n, n)), [rng.random((n, s)) * 9 for s in S.SIZES])
    values = [np.stack([rng.integers(0, s, length) for s in S.SIZES], 1) for length in (1, 3, 0, 4)]
    for v, path in zip(values, m.paths(values)):
        def score(p):
            return m.start[p[0]] + sum(m.change[a, b] for a, b in zip(p, p[1:])) + sum(s[p[t], v[t, f]] for f, s in enumerate(m.shows) for t in range(len(v)))

        if len(v):
            assert score(path) == pytest.approx(max(map(score, itertools.product(range(n), repeat=len(v)))))
