"""Searches, clusterings and sequential generators against plain restatements."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quillon.operators import cluster, nulls, sequential
from quillon.plans import controls, parsing, search


def plain_merges(words, n):
    words = [([*w], k) for w, k in words]
    out = []
    for _ in range(n):
        pairs = Counter()
        for u, k in words:
            for p in zip(u, u[1:]):
                pairs[p] += k
        if not pairs or max(pairs.values()) < 2:
            break
        (a, b), k = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((a, b, k))
        words = [(sequential.merge_pair(u, a, b), k) for u, k in words]
    return out


def test_merges(spark):
    r = random.Random(1)
    words = {c: [("".join(r.choices("aab", k=r.randint(1, 9))), r.randint(1, 5)) for _ in range(40)] for c in ("x", "y")}
    df = spark.createDataFrame([(c, n, [*w]) for c, own in words.items() for w, n in own], "corpus string, n long, units array<string>")
    got = search.learn_merges(df, 12)
    for c, own in words.items():
        assert [(a, b, n) for k, _, a, b, n in got if k == c] == plain_merges(own, 12)


def cuts(word):
    for k in range(1 << (len(word) - 1)):
        ends = [i + 1 for i in range(len(word) - 1) if k >> i & 1] + [len(word)]
        yield [word[a:b] for a, b in zip([0, *ends], ends)]


def test_viterbi_is_the_cheapest_of_all_cuts():
    r = random.Random(3)
    units = {"".join(r.choices("abc", k=r.randint(1, 3))): r.uniform(0.5, 6) for _ in range(14)}
    for _ in range(60):
        w = "".join(r.choices("abcd", k=r.randint(1, 8)))
        units_of, cost = sequential.viterbi(w, units)
        every = [sum(units.get(u, 12.0 if len(u) == 1 else math.inf) for u in c) for c in cuts(w)]
        assert "".join(units_of) == w and cost == pytest.approx(min(every))


def test_an_inventory_finds_the_units_that_words_are_made_of(spark):
    r = random.Random(5)
    made = ["qo", "kee", "dy", "ain", "ch"]
    words = Counter("".join(r.choices(made, k=r.randint(1, 4))) for _ in range(600))
    df = spark.createDataFrame([("x", w, n) for w, n in words.items()], "corpus string, word string, n long")
    costs = search.learn_inventory(df, 5, 10, 30)["x"]
    before = search._cut(df, {"x": {c: 4.0 for c in "qokedyainch"}}).selectExpr("sum(n * bits)").first()[0]
    after = search._cut(df, {"x": costs}).selectExpr("sum(n * bits)").first()[0]
    assert {"qo", "dy"} <= set(costs) and after < 0.7 * before and sum(2**-x for x in costs.values()) <= 1.0001


def test_a_climb_never_loses_and_scores_what_it_says():
    r = random.Random(2)
    letters = "abcdefgh"
    model = {(a, b): -r.uniform(1, 9) for a in letters for b in letters}
    counts = {(a, b): r.randint(1, 50) for a in letters for b in letters}
    short, long = (sequential.climb(0, counts, model, letters, letters, steps=n) for n in (5, 400))
    assert long["score"][0] >= short["score"][0]
    to = dict(zip(long["symbol"], long["letter"]))
    assert sorted(to.values()) == sorted(letters)
    assert long["score"][0] == pytest.approx(sum(n * model[to[a], to[b]] for (a, b), n in counts.items()), abs=1e-3)


def test_beam_candidates_and_their_entropy(spark, tmp_path):
    r = random.Random(8)
    texts = [(i, " ".join("".join(r.choices("aobkt", k=r.randint(2, 6))) for _ in range(40)), "en", "s", 0) for i in range(5)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = search.alphabet_beam_search(spark, str(tmp_path), beam=3, depth=2, top=4).collect()
    words = Counter(w for _, t, *_ in texts for w in t.split())
    pairs = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] += n
    top = [p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:4]]

    def entropy(rewrites):
        two, one = Counter(), Counter()
        for w, n in words.items():
            for a, b in rewrites:
                w = w.replace(a, b)
            for a, b in itertools.pairwise(f" {w} "):
                two[a, b] += n
                one[a] += n
        total = sum(two.values())
        h = lambda c: -sum(n / total * math.log2(n / total) for n in c.values())
        return h(two) - h(one)

    first = {f"merge {p}": entropy([(p, "\ue000")]) for p in top} | {"unify tk": entropy([("t", "k")]), "unify ao": entropy([("a", "o")])}
    best = sorted(first.items(), key=lambda x: x[1])[:3]
    assert [(x.recoding, x.h_cond) for x in sorted((x for x in rows if x.step == 0), key=lambda x: x.h_cond)] == [(k, pytest.approx(v, abs=1e-5)) for k, v in best]
    assert all("; " in x.recoding for x in rows if x.step == 1) and min(x.h_cond for x in rows if x.step == 1) <= best[0][1]


def joint(spark, r, letters="abcdefg", corpora=("x", "y")):
    rows = [(c, a, b, r.randint(1, 60)) for c in corpora for a in letters for b in letters if r.random() < 0.7]
    return rows, spark.createDataFrame(rows, "corpus string, a string, b string, n long")


def test_sukhotin(spark):
    rows, df = joint(spark, random.Random(4))
    got = {(x.corpus, x.letter): x.vowel for x in cluster.sukhotin(df).collect()}
    for corpus in ("x", "y"):
        contact = Counter()
        for c, a, b, n in rows:
            if c == corpus and a != b:
                contact[a, b] += n
                contact[b, a] += n
        letters = sorted({x for c, a, b, _ in rows if c == corpus for x in (a, b)})
        score, vowels = {a: sum(contact[a, b] for b in letters) for a in letters}, set()
        while len(vowels) < len(letters):
            best = min((x for x in letters if x not in vowels), key=lambda x: (-score[x], x))
            if score[best] <= 0:
                break
            vowels.add(best)
            for x in letters:
                score[x] -= 2 * contact[x, best]
        assert {x for x in letters if got[corpus, x]} == vowels


def test_linkage_against_sets_of_members():
    r = np.random.default_rng(3)
    for single in (False, True):
        d = r.random((9, 9))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        groups = [{i} for i in range(9)]
        while len(groups) > 3:
            def apart(x, y):
                return (min if single else lambda v: sum(v) / len(v))([d[i, j] for i in x for j in y])

            x, y = min(itertools.combinations(groups, 2), key=lambda p: apart(*p))
            groups = [g for g in groups if g not in (x, y)] + [x | y]
        label, merges = cluster.linkage(d, 3, single)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == set(map(frozenset, groups)) and len(merges) == 6


def test_agglomerate_spectral_and_axes(spark):
    # two blocks of letters that follow only each other's block
    rows = [("x", a, b, 50 if (a in "abc") != (b in "abc") else 1) for a in "abcdef" for b in "abcdef"]
    df = spark.createDataFrame(rows, "corpus string, a string, b string, n long")
    groups = {x.letter: x.cluster for x in cluster.agglomerate(df, 2).collect()}
    assert {groups[c] for c in "abc"} == {"a"} and len({groups[c] for c in "def"}) == 1 and groups["d"] != "a"
    s = {x.letter: x for x in cluster.spectral(df).collect()}
    assert [s[c].side for c in "abcdef"] == [*"aaabbb"] and s["a"].alternation == pytest.approx(900 / 918, abs=1e-6)
    m = np.array([[n for _, a, b, n in rows if a == x] for x in "abcdef"], dtype=float)
    values = sorted(np.abs(np.linalg.eigvals(m / m.sum(axis=1, keepdims=True))), reverse=True)
    assert s["a"].gap == pytest.approx(values[0] - values[1], abs=1e-5)
    rows, df = joint(spark, random.Random(6), corpora=("x",))
    got = {(x.letter, x.axis): x.value for x in cluster.ppmi_svd(df, 2).collect()}
    letters = sorted({x for _, a, b, _ in rows for x in (a, b)})
    n = {(a, b): k for _, a, b, k in rows}
    total, left, right = sum(n.values()), Counter(), Counter()
    for (a, b), k in n.items():
        left[a] += k
        right[b] += k
    x = np.array([[max(0.0, math.log2(n[a, b] * total / (left[a] * right[b]))) if (a, b) in n else 0.0 for b in letters] for a in letters])
    own = np.array([[got[c, k] for c in letters] for k in range(2)])
    gram = x @ x.T  # the axes are eigenvectors of the table's products, as long as their singular values
    for v in own:
        assert gram @ v == pytest.approx((v @ v) * v, abs=1e-3)
    assert own[0] @ own[1] == pytest.approx(0, abs=1e-4) and own[0] @ own[0] >= own[1] @ own[1]


def test_principal_axes(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)) * [5, 3, 1, 1, 0.5]
    df = spark.createDataFrame(pd.DataFrame({"v": [row.tolist() for row in x]}))
    shares = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    got = [s for _, s in cluster.principal_axes(df, "v", 3)]
    assert got == pytest.approx((shares / shares.sum())[:3], abs=1e-5)


def test_copies_places_and_breaks():
    told = sequential.copy_and_change(0, 300, ["daiin", "ol", "chedy"])["word"]
    for i in range(3, 300):  # every word is one of the fifty before it, or a letter away from one
        assert any(w == told[i] or abs(len(w) - len(told[i])) <= 1 and parsing_distance(w, told[i]) <= 1 for w in told[max(0, i - 50) : i])
    words = "one two six ten elf zwo".split()
    weight = {("t", 0): 50.0, ("z", 5): 50.0}
    firsts = Counter(sequential.place_by_class(words, weight, 1.0, (k,))[0][0] for k in range(400))
    assert all(sorted(sequential.place_by_class(words, weight, 1.0, (k,))) == sorted(words) for k in range(20)) and firsts["t"] > 350
    table = {"a": ["a", "xy"], "b": ["pqr", "k"], "c": ["c", "c"]}
    for k in range(50):
        out = sequential.broken("abcabc", table, (k,))
        assert all(len(x) >= 3 for x in out[:-1]) and any("".join(out) == "".join(p) for p in itertools.product(*(table[c] for c in "abcabc")))
    code = sequential.huffman({"a": 5.0, "b": 2.0, "c": 1.0, "d": 1.0})
    assert sorted(map(len, code.values())) == [1, 2, 3, 3] and not any(x != y and y.startswith(x) for x in code.values() for y in code.values())


def parsing_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edits_and_subsequences_against_all_pairs(spark, tmp_path):
    r = random.Random(11)
    words = sorted({"".join(r.choices("abcé", k=r.randint(1, 7))) for _ in range(150)})
    entries = sorted({"".join(r.choices("abcé", k=r.randint(2, 7))) for _ in range(60)})
    spark.createDataFrame([(1, " ".join(words), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(entries))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(x.first, x.second) for x in parsing.near_dup_edit1(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(words, 2) if parsing_distance(a, b) == 1}
    fuzzy = {x.word: (x.distance, x.entry) for x in parsing.fuzzy_dictionary_match(spark, str(tmp_path)).collect()}
    expected = {}
    for w in words:
        near = [(parsing_distance(w, e), e) for e in entries if e != w and len(e) >= 4 and len(w) >= 4]
        if near and min(near)[0] <= 2:
            expected[w] = min(near)
    assert fuzzy == expected

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    skeleton = lambda w: "".join(c for c in w if c not in "aeiou")
    best = {}
    for w in words:
        s = skeleton(w)
        ways = [(lcs(s, skeleton(e)), e) for e in entries if len(skeleton(e)) == len(s) >= 3]
        ways = [x for x in ways if x[0] >= len(s) - 1]
        if ways:
            best[w] = max(ways)
    assert {x.word: (x.lcs, x.entry) for x in parsing.lcs_match(spark, str(tmp_path)).collect()} == best


def test_permutations_are_the_same_in_any_ranges(spark):
    df = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(500)], "g int, k int, v string")
    one, many = (sorted(map(tuple, nulls.permuted(df, ["g"], "v", ["k"], "t", width=w).select("g", "k", "v").collect())) for w in (4096, 7))
    assert one == many and [x[2] for x in one] != [x[2] for x in sorted(map(tuple, df.collect()))]
    assert sorted(x[2] for x in one) == sorted(f"v{i}" for i in range(500))


def test_components(spark):
    r = random.Random(2)
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100, 160)] + [(f"n{r.randrange(90):03}", f"n{r.randrange(90):03}") for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in controls.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for p in links for x in p}
