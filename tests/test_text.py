"""Column expressions against plain restatements of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    return [r.x for r in df.select("i", expr(F.col("w")).alias("x")).orderBy("i").collect()]


WORDS = ["".join(random.Random(i).choices(["c", "t", "k", "h", "s", "e", "o", "a", "i", "d", "y", "q", "n", "f", "p", "l"], k=i % 12 + 1)) for i in range(600)]


def plain_strip(word):
    found = []
    for g in T.GALLOWS:
        while g in word:
            found.append(g)
            word = word.replace(g, "", 1)
    return word, found


def test_strip_gallows_is_the_loop(spark):
    words = WORDS + ["otchey", "qokedy", "aiin", "ctctckhhhx", "ccthth", "tctchch"]
    assert column(spark, words, T.strip_gallows) == [plain_strip(w)[0] for w in words]
    assert column(spark, words, T.gallows) == [plain_strip(w)[1] for w in words]
    assert column(spark, ["otchey", "qokedy", "aiin"], T.strip_gallows) == ["oey", "qoedy", "aiin"]


def test_collapse(spark):
    assert column(spark, ["cheeey", "qokeedy"], T.collapse_e) == ["chey", "qokedy"]
    assert column(spark, ["qokeedy"], T.collapsed) == ["qoedy"]


def test_glyphs(spark):
    assert column(spark, ["qockhedy", "okcth", "ach"], T.glyphs) == [["q", "o", "ckh", "e", "d", "y"], ["o", "k", "cth"], ["a", "ch"]]


def test_morphology(spark):
    found = column(spark, ["qoedy", "qoy", "daiin", "o"], T.morphology)
    assert [tuple(x) for x in found[:2]] == [("qo", "e", "dy"), ("q", "o", "y")]
    for word, m in zip(["qoedy", "qoy", "daiin", "o"], found):
        assert "".join(m) == word


def test_suffixes(spark):
    assert column(spark, ["daiin", "aiin"], lambda w: T.suffix(w, spare=1)) == ["aiin", "iin"]


def plain_chunks(glyphs):
    slots = [({"ch", "sh", "y"}, 1), ({"e"}, 3), ({"o"}, 1), ({"i"}, 3), (set("ypfklrstnm") | {"cth", "ckh", "cph", "cfh"}, 1)]
    single = {1: {"q", "a"}, 3: {"d"}}
    chunks, rest, at = [], [], 0
    while at < len(glyphs):
        chunk = []
        if len(chunks) < T.MOST_CHUNKS:
            for k, (own, most) in enumerate(slots):
                n = 0
                while at + n < len(glyphs) and n < most and glyphs[at + n] in own:
                    n += 1
                if not n and at < len(glyphs) and glyphs[at] in single.get(k, ()):
                    n = 1
                chunk += glyphs[at : at + n]
                at += n
        if chunk:
            chunks.append(chunk)
        else:
            rest.append(glyphs[at])
            at += 1
    return chunks, rest


def test_chunks(spark):
    words = ["daiin", "qokeeeedyx", "zz", "ododododododod", *WORDS]
    found = column(spark, words, T.chunks)
    assert found[0].chunks == [["d"], ["a", "i", "i", "n"]] and found[0].unparsed == []
    for word, c in zip(words, found):
        glyphs = re.findall("c[tkpf]h|[cstkpf]h|.", word)
        assert (c.chunks, c.unparsed) == plain_chunks(glyphs), word


def test_cleaning(spark):
    texts = ["chofa[r:n]y.ch!ol", "cho%or.daiin", "okal,dy", "<!note>qo<->y;ab"]
    assert column(spark, texts, T.clean_ivtff) == [["chofary", "chol"], ["daiin"], ["okal", "dy"], ["qo", "y", "ab"]]
    assert column(spark, ["okal,dy"], lambda t: T.clean_ivtff(t, comma_break=False)) == [["okaldy"]]
    assert column(spark, ["f1r.1,@P0", "f1r"], T.locus_type) == ["P", None]


def test_twelve_slots(spark):
    found = column(spark, ["qokeedy", "daiin", "xyz"], T.twelve_slots)
    for w, x in zip(["qokeedy", "daiin", "xyz"], found):
        assert "".join(x.slots) + x.rest == w
    assert found[2].rest == "xyz"


def test_masked_and_runs(spark):
    assert [tuple(x) for x in column(spark, ["abc"], T.masked)[0]] == [(1, "_bc", "a"), (2, "a_c", "b"), (3, "ab_", "c")]
    assert column(spark, [""], T.masked) == [[]]
    assert [tuple(x) for x in column(spark, ["aabccc"], T.runs)[0]] == [("a", 2), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("n", [5, 6, 7, 12])
def test_position_bins(spark, n):
    def plain(i):
        if i < 2:
            return f"p{i + 1}"
        if i >= n - 2:
            return "pL" if i == n - 1 else "pL-1"
        return f"m{min((i - 2) * 3 // (n - 4), 2) + 1}"

    df = spark.range(n).select("id", T.position_bin(F.col("id"), F.lit(n)).alias("b")).orderBy("id")
    assert [r.b for r in df.collect()] == [plain(i) for i in range(n)]


def test_encodings(spark):
    from quillon.functions import encodings as E

    assert column(spark, ["banana", "aeiou", "xyz"], E.abjad) == ["bnn", "a", "xyz"]
    table = E.substitution("t")
    assert sorted(table.values()) == list(E.ALPHABET)
    assert column(spark, ["abc"], lambda w: E.translate(w, table)) == ["".join(table[c] for c in "abc")]
    assert sorted(column(spark, ["anagram"], E.anagram)[0]) == sorted("anagram")
    assert column(spark, ["banana"], E.syllabic_split) == [["ba", "na", "na"]]
    assert column(spark, ["station", "inter", "x"], E.abbreviate) == ["sta9", "int2", "x"]
    assert column(spark, ["abcd"], lambda w: E.positional_rules(w, [("start", "a", "A"), ("end", "d", "D"), ("any", "b", "BB")])) == ["ABBcD"]


def test_lcs():
    from quillon.functions.udfs import lcs

    assert lcs("kitten", "sitting") == 4 and lcs("", "a") == 0 and lcs("abc", "abc") == 3
