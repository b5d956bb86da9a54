"""Statistics at their known values and edges."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import nulls, order, sequential, stats


def counts(spark, d):
    return spark.createDataFrame([("c", k, n) for k, n in d.items()], "corpus string, x string, n long")


@pytest.mark.parametrize(
    ("d", "h"), [({"a": 1, "b": 1, "c": 1, "d": 1}, 2), ({"a": 7}, 0), ({"a": 1, "b": 3}, 0.8112781244591328)]
)
def test_entropy(spark, d, h):
    assert stats.entropy(counts(spark, d), ["corpus"]).first().entropy == pytest.approx(h)


def test_entropy_of_nothing(spark):
    assert counts(spark, {}).agg(stats.plogp().alias("h")).first().h == 0


def joint(spark, pairs):
    df = spark.createDataFrame([("c", a, b) for a, b in pairs], "corpus string, x string, y string")
    return stats.freq(df, ["corpus"], "x", "y")


@pytest.mark.parametrize(
    ("pairs", "mi"),
    [
        ([("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")], 0),
        ([("a", "a"), ("a", "a"), ("b", "b"), ("b", "b")], 1),
        ([("a", "c"), ("a", "c"), ("a", "d"), ("b", "d")], 0.31127812445913283),
    ],
)
def test_mutual_information(spark, pairs, mi):
    assert stats.mutual_information(joint(spark, pairs), ["corpus"], "x", "y").first().mi == pytest.approx(mi)


def test_conditional_entropy(spark):
    assert stats.conditional_entropy(joint(spark, [("a", "b")] * 2 + [("b", "a")] * 2), ["corpus"], "x").first().h_cond == 0


def test_coincidence(spark):
    for d, ic in (({"a": 2, "b": 2}, 1 / 3), ({"a": 4}, 1), ({"a": 1, "b": 1, "c": 1}, 0), ({"a": 1}, 0)):
        assert stats.coincidence(counts(spark, d), ["corpus"]).first().ic == pytest.approx(ic)


def test_zipf(spark):
    c = counts(spark, {f"w{r}": 6000 // r for r in range(1, 51)})
    assert 0.95 < stats.zipf(c, ["corpus"]).first().alpha < 1.05
    assert stats.zipf(counts(spark, {"a": 5, "b": 2}), ["corpus"]).first().alpha == 0


def test_jsd(spark):
    a, b = counts(spark, {"a": 1, "b": 1}), counts(spark, {"c": 5})
    assert stats.jsd(stats.sides(a, b, ["corpus"], "x"), ["corpus"]).first().jsd == pytest.approx(1)
    assert stats.jsd(stats.sides(a, a, ["corpus"], "x"), ["corpus"]).first().jsd == pytest.approx(0)


def test_normal_tail(spark):
    df = spark.createDataFrame([(z,) for z in (-2.0, 0.0, 1.0, 1.96, 4.0)], "z double")
    for r in df.select("z", stats.normal_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), abs=2e-7)


def test_guarded_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(stats.guarded_corr("x", "y").alias("r")).first().r == 0


def test_before_sums_over_many_ranges(spark):
    width = order.WIDTH
    order.WIDTH = 3
    try:
        df = spark.range(0, 100, 2).select(F.lit("c").alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
        got = {r.k: r.s for r in order.before(df, ["g"], "k", "v", "s").collect()}
    finally:
        order.WIDTH = width
    assert got == {k: sum(j % 7 for j in range(0, k, 2)) for k in range(0, 100, 2)}


def test_fingerprint_of_periodic_text(spark):
    from quillon.plans.line_effects import FEATURES, fingerprint

    lines = spark.createDataFrame([("c", 0, i, ["ab"] * 10) for i in range(5)], "corpus string, doc_id long, line_no long, words array<string>")
    f = fingerprint(lines).first()
    assert list(f.asDict())[1:] == list(FEATURES)
    assert f.h0_char == pytest.approx(math.log2(3)) and f.h1_char == pytest.approx(math.log2(3)) and f.h2_char == pytest.approx(0)
    assert f.adj_exact == 1 and f.n_types == 1 and f.heaps_beta is None


def test_viterbi_and_huffman():
    units, cost = sequential.viterbi("abcab", {"ab": 1.0, "c": 2.0, "a": 3.0, "b": 3.0})
    assert units == ["ab", "c", "ab"] and cost == 4
    assert sequential.viterbi("xa", {"a": 1.0})[1] == 13.0
    code = sequential.huffman({"a": 5, "b": 2, "c": 1})
    assert len(code["a"]) == 1 and len(code["b"]) == len(code["c"]) == 2 and len(set(code.values())) == 3
    assert sequential.justified(["aaa", "bb", "c"], 6) == [["aaa", "bb"], ["c"]]
    assert sorted(sequential.place_by_class(["b", "a", "c"], {}, 1.0, (1, 2))) == ["a", "b", "c"]


def test_linkage():
    import numpy as np

    from quillon.operators.cluster import linkage

    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], dtype=float)
    label, merges = linkage(d, 2)
    assert label.tolist() == [0, 0, 2, 2] and merges == [(0, 1, 1.0), (2, 3, 2.0)]


def test_merges_are_greedy_and_do_not_overlap(spark):
    from quillon.plans.search import learn_merges, marked, merged, unmarked

    df = spark.createDataFrame([("x", ["a", "a", "a", "b"], 3), ("x", ["a", "b"], 2)], "corpus string, units array<string>, n long")
    assert learn_merges(df, 2)[:1] == [("x", 0, "a", "a", 6)]
    told = df.select("corpus", marked(F.col("units")).alias("told")).select(merged("told", [("x", "a", "a")]).alias("told"))
    got = [r.u for r in told.select(unmarked("told").alias("u")).collect()]
    assert got == [["aa", "a", "b"], ["a", "b"]] and sequential.merge_pair(["a", "a", "a", "b"], "a", "a") == got[0]


def test_a_hot_type_is_dealt_by_ranges(spark):
    df = spark.range(900).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7 == 0).alias("x"), F.lit(300).alias("n"))
    one, many = (nulls.redealt(df, ["g"], "x", ["id"], "s", "n", width) for width in (1000, 9))
    got = {r.id: r.x for r in one.collect()}
    assert got == {r.id: r.x for r in many.collect()} and got != {r.id: r.x for r in df.collect()}
    assert one.groupBy("g").agg(F.count_if("x").alias("k")).exceptAll(df.groupBy("g").agg(F.count_if("x").alias("k"))).count() == 0


def test_resplit_takes_the_most_frequent_types(spark, tmp_path):
    from quillon import catalog

    line = "the " + " ".join(f"the {w}" for w in ("one", "two", "six") * 4)
    row = (1, "en", "\n".join([line] * 2000))
    df = spark.createDataFrame([row], "doc_id long, lang string, text string")
    df.withColumn("source", F.lit("s")).withColumn("quality", F.lit(0.5)).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["pooled_resplit_jsd"](spark, str(tmp_path)).first()
    assert got.real is not None and got.null_mean is not None


def test_resplit_of_a_type_that_only_begins_lines_is_as_in_sql(spark, tmp_path):
    import duckdb

    from quillon import catalog

    rows = [(1, "en", "\n".join(["once upon a a b"] * 120)), (2, "de", "\n".join(["da da du"] * 120 + ["da er da er"] * 9))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.corpus: r for r in catalog.queries()["pooled_resplit_jsd"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = c.execute(catalog.oracle_sql()["pooled_resplit_jsd"])
    names = [d[0] for d in told.description]
    wanted = {r["corpus"]: r for r in (dict(zip(names, x)) for x in told.fetchall())}
    assert math.isnan(wanted["en"]["real"]) and not math.isnan(wanted["de"]["real"]) and set(got) == set(wanted)
    for corpus, r in wanted.items():
        assert [got[corpus][c] for c in names[1:]] == pytest.approx([r[c] for c in names[1:]], nan_ok=True)


def test_a_resplit_is_decided_where_it_is_read_as_by_ranks(spark, tmp_path, monkeypatch):
    from quillon import catalog
    from quillon.plans import families
    from quillon.sources import corpus as C

    long = "l" * 70  # over a block of MD5
    line = f"un Été 𐐨u ßo un {long} a un été b un {long} c d un a un 𐐨x un"
    rows = [(k, "en" if k % 3 else "de", "\n".join([line, line[3:], f"{long} {line[8:]}\n", f"{line} {line}"] * (k % 4 + 1))) for k in range(50)]
    rows += [(90, None, line), (None, "en", line), (92, "fr", None), (93, "fr", ""), (94, "x", "\n".join(["da di"] * 150)), (1 << 62, "en", line)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lines = C.lines(spark, str(tmp_path), extra=())
    p = C.pairs(lines, keep=("corpus", "doc_id", "line_no")).select("corpus", F.col("a").alias("word"), F.ascii("b").alias("c"), (F.col("pos") == 0).alias("start"), "doc_id", "line_no", "pos")
    often = p.groupBy("corpus", "word").agg(F.count("*").alias("n"), F.count_if("start").alias("k")).where("n >= 100 and k >= 20")
    p = p.join(often, ["corpus", "word"])
    dealt = nulls.redealt(nulls.replicates(p, 12), ["rep", "corpus", "word"], "start", ["doc_id", "line_no", "pos"], "resplit", "n", 50)
    both = p.withColumn("rep", F.lit(-1)).unionByName(dealt).groupBy("corpus", "word", "rep", "c").agg(F.count_if("start").alias("a"), F.count_if(~F.col("start")).alias("b"))
    wanted = {(r.corpus, r.word, r.rep, r.c): (r.a, r.b) for r in both.collect()}
    assert {x[1] for x in wanted} == {"un", "été", long, "da"} and len({x[0] for x in wanted}) == 3

    def found(*limits):
        return {(r.corpus, r.word, r.rep, r.c): (r.a, r.b) for r in families.resplits(lines, 12, *limits).collect()}

    for limits in ((0.0,), (20.0, 2), (20.0, 0)):  # by ranks: types whose bounds missed; types beyond what workers hold; all
        assert found(*limits) == wanted
    monkeypatch.setattr(nulls, "redealt", None)  # no place is ranked by a row of its own but near the cut
    assert found() == wanted
    assert {r.corpus for r in catalog.queries()["pooled_resplit_jsd"](spark, str(tmp_path)).collect()} == {"en", "de", "x"}
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert catalog.queries()["pooled_resplit_jsd"](spark, f"{tmp_path}/none").count() == 0


def test_undecided_places_of_a_resplit_are_few():
    import pyarrow as pa

    from quillon.plans import families

    words = (["the", "a"] + ["the", "b"] * 4) * 5
    n = 2000
    lines = pa.record_batch({"corpus": ["en"] * n, "doc_id": [*range(n)], "line_no": [0] * n, "words": [words] * n})
    types = pa.table({"corpus": ["en"], "word": ["the"], "n": [n * 25], "k": [n]})
    told = pa.Table.from_batches(families._resplit([lines], types, 10, 20.0)).to_pylist()
    near = [r for r in told if r["high"] is not None]
    assert 0 < len(near) < 10 * (13 * n**0.5 + 40) < 10 * n * 25 / 50
    for rep in range(10):
        sure = sum(r["n"] for r in told if r["rep"] == rep and r["high"] is None)
        assert sure <= n <= sure + sum(r["rep"] == rep for r in near)


def test_packed_dealing_counts_what_permuted_deals(spark):
    df = spark.range(700).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), "id", (F.col("id") % 5).alias("s"), F.when(F.col("id") == 4, 70_000).otherwise(F.col("id") % 7).alias("v"))
    dealt = nulls.permuted(df, ["g"], "v", ["id"], "t").groupBy("g", "s", "v").agg(F.count("*").alias("n"))
    wanted = sorted(map(tuple, dealt.collect()))
    for width in (1 << 20, 16):
        assert sorted(map(tuple, nulls.joint_dealt(df, ["g"], F.col("s"), F.col("v"), ["id"], "t", width).collect())) == wanted
    assert nulls.joint_dealt(df.limit(0), ["g"], F.col("s"), F.col("v"), ["id"], "t").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_many_messages_are_md5():
    from hashlib import md5 as plain

    import numpy as np
    import pyarrow as pa

    from quillon.functions import md5

    rows, n = pa.array(["é" * (k // 2) + "a" * (k % 2) for k in range(80)]), np.arange(80) % 3 * 60
    where, place = md5.places(n)
    told = md5.Messages.placed(rows, n, where, place)
    for own, tails in ((told, [f"{rows[int(i)]}|{k}" for i, k in zip(where, place)]), (md5.Messages(rows), rows.to_pylist())):
        whole = [plain(b"seed|" + x.encode()).digest() for x in tails]
        hashes = own.first64(b"seed|")
        assert hashes.tolist() == [int.from_bytes(x[:8], "big") for x in whole] and [own.digest(b"seed|", i) for i in range(len(own))] == whole
        group = np.arange(len(own)) % 5
        for first in (hashes, hashes & np.uint64(0xF << 60)):  # ties are told apart by the whole hash
            assert md5.ordered(first.copy(), lambda i: whole[i]).tolist() == sorted(range(len(own)), key=lambda i: (whole[i], i))
            assert md5.ordered(first.copy(), lambda i: whole[i], group).tolist() == sorted(range(len(own)), key=lambda i: (group[i], whole[i], i))


def test_parts_of_hashes_for_several_prefixes_are_md5():
    from hashlib import md5 as plain

    import numpy as np
    import pyarrow as pa

    from quillon.functions import md5

    tails = ["é" * (k // 2) + "a" * (k % 2) for k in range(80)]
    told, prefixes = md5.Messages(pa.array(tails)), [b"seed|", b"s|", b"seat|", b"seeds|10", b"a" * 60, b"a" * 70]
    whole = [[plain(p + x.encode()).digest() for x in tails] for p in prefixes]
    assert told.first32(prefixes).tolist() == [[int.from_bytes(x[:4], "big") for x in row] for row in whole]
    some = np.arange(3, 80, 4)
    for p, row in zip(prefixes, whole):
        assert [b"".join(int(v).to_bytes(8, "big") for v in x) for x in told.whole(p, some).T] == [row[i] for i in some]
    none = md5.Messages(pa.array([], pa.string()))
    assert none.first32(prefixes).shape == (6, 0) and none.whole(b"s", np.zeros(0, int)).shape == (2, 0)


def test_a_document_is_dealt_in_its_own_row(spark, tmp_path):
    from quillon import catalog
    from quillon.sources import corpus as C

    texts = ["one two three\n\nfour four fifteen", "eins zwei\ndrei vier " * 30, "", None, "Ünder\nthe 12 Bridge"]
    rows = [(i, "en" if i % 2 else "de", t) for i, t in enumerate(texts)] + [(None, "en", "no id here"), (9, None, "a bb ccc\ndddd e")]

    def dealt(df, at):
        df.withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        got = catalog.queries()["null_within_doc_shuffle"](spark, f"{tmp_path}/{at}")
        t = C.tokens(C.split_lines(df.where("doc_id is not null"), F.col("lang")))
        s = nulls.permuted(nulls.replicates(t, 3), ["doc_id", "rep"], "word", ["line_no", "pos"], "doc")
        n, first = F.length("word"), F.col("pos") == 0
        wanted = s.groupBy("corpus", "rep").agg(F.count("*").alias("tokens"), F.round(F.avg(F.when(first, n)), 6), F.round(F.avg(F.when(~first, n)), 6))
        return got, sorted(map(str, map(tuple, got.collect()))), sorted(map(str, map(tuple, wanted.collect())))

    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got, ours, wanted = dealt(df, "once")
    assert ours == wanted and len(ours) == 9 and not re.search("Window|SortMergeJoin", plan(got))  # words take no shuffle
    other = spark.createDataFrame([(2, "fr", "\n\n\n\nsome more words\nfor two")], df.schema)
    _, ours, wanted = dealt(df.unionByName(other.withColumn("doc_id", F.lit(1).cast("long"))), "again")  # its lines have numbers of their own
    assert ours == wanted and len(ours) == 12


def test_letters_are_dealt_in_a_task_as_in_ranges(spark, tmp_path):
    from quillon.plans import families

    text = "a bb Straße été " + "ab" * 50 + " one\ntwo three Three four fünfzehn z"
    rows = [(1, "en", text), (2, "de", text[::-1] + " 𝔘𝔫𝔡 und"), (3, None, "no corpus"), (4, "x", "q w e"), (5, "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for seed, slots, name in SHUFFLES:
        small, large = (families.letters_dealt(spark, str(tmp_path), 3, seed, slots, most) for most in (1 << 25, 30))
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
        assert {r.corpus for r in small.collect()} == {"en", "de"}
        found = plan(getattr(families, name)(spark, str(tmp_path)))
        assert "SortMergeJoin" not in found and "Window" not in found


SHUFFLES = [("flat", False, "flat_shuffle_null"), ("slot", True, "slot_shuffle_null")]


def test_columns_are_dealt_in_a_task_as_in_ranges(spark, tmp_path):
    from quillon import catalog
    from quillon.functions import text as T
    from quillon.plans import controls
    from quillon.sources import corpus as C

    text = "qodain shol dary chedy\n\none\nqokain lcheor y dol" + "\nolar shy dain" * 9
    rows = [(k, "en" if k % 3 else "de", f"{'a long name ' * 5 * (k % 2)}{k % 4}", text[k:] * (k % 3 + 1)) for k in range(12)]
    rows += [(90, None, "s", text), (91, "en", None, text), (92, "fr", "s", None), (93, "fr", "s", "alone")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    packed = controls.packed_affixes(spark, str(tmp_path))
    p = C.pairs(C.lines(spark, str(tmp_path)), keep=("corpus", "source", "doc_id", "line_no"))
    p = p.select("corpus", "source", "doc_id", "line_no", "pos", T.suffix(F.col("a")).alias("x"), T.prefix(F.col("b")).alias("y"))
    within, key = ["corpus", "source", "rep"], ["doc_id", "line_no", "pos"]
    dealt = nulls.permuted(nulls.permuted(nulls.replicates(p, 3), within, "x", key, "suffix"), within, "y", key, "prefix")
    wanted = sorted((r.corpus, r.rep, r.x, r.y, r["count"]) for r in dealt.groupBy("corpus", "rep", "x", "y").count().collect())
    for most in (1 << 25, 60, 0):
        found = controls.columns_dealt(packed, 3, most)
        assert sorted((r.corpus, r.rep, controls.ENDINGS[r.x - 1], controls.BEGINNINGS[r.y - 1], r.n) for r in found.collect()) == wanted
    found = plan(catalog.queries()["null_column_shuffle"](spark, str(tmp_path)))
    assert "doc_id" not in found  # no pair is ranked outside a task


def test_nearest_vectors_by_products_are_those_of_all_pairs(spark, tmp_path):
    import numpy as np

    from quillon import catalog
    from quillon.plans import vectors

    rng = np.random.default_rng(3)
    rows = {int(i): (rng.normal(size=64) * 10.0 ** int(rng.integers(-3, 4))).astype(np.float32).tolist() for i in range(-300, 900)}
    rows |= {i: rows[7] for i in (*range(400, 460), 800)}  # copies: their ids decide
    rows |= {i: [x * (1 + 1e-6 * (i % 7)) for x in rows[0]] for i in range(500, 540)}  # nearer than single precision tells
    rows |= {3: [0.0] * 64, 600: [0.0] * 64, 11: None}
    df = spark.createDataFrame([*rows.items()], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    x = {i: None if v is None else np.array(v, np.float32).astype(float) for i, v in rows.items()}

    def cosine(a, b):
        if a is None or b is None or not a.any() or not b.any():
            return 0.0
        ab, aa, bb = (float(np.cumsum(u * w)[-1]) for u, w in ((a, b), (a, a), (b, b)))  # one after another
        return ab / (aa * bb) ** 0.5

    wanted = {(i, j) for i in x if i % 100 == 0 for j in sorted((j for j in x if j != i), key=lambda j: (-cosine(x[i], x[j]), j))[:3]}
    got = catalog.queries()["cosine_neighbours"](spark, str(tmp_path))
    assert {(r.first, r.second) for r in got.collect()} == wanted
    assert "MapInArrow" in plan(got)
    v = df.where("embedding is not null and vec_id not in (3, 600)").select("vec_id", "embedding")
    one, many = (vectors.nearest(v, v.where("vec_id % 100 = 0"), 3, 64, block).groupBy("first").agg(F.array_sort(F.collect_list(F.struct(-F.col("c"), "second"))).alias("s")) for block in (1 << 16, 4))
    assert {r.first: [s[1] for s in r.s[:3]] for r in one.collect()} == {r.first: [s[1] for s in r.s[:3]] for r in many.collect()}
