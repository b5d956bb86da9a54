"""More null models and controls: shuffles of whole corpora, columns and transitions, merges, grids, samples, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import cluster, nulls, order, shared, stats
from quillon.plans import sql
from quillon.plans.families import CHUNKED
from quillon.plans.information import r6
from quillon.plans.line_effects import FP, documents_and_benchmark, edge_jsd, fingerprint, first_letters, rank_t
from quillon.plans.parsing import EDGE, ENDS
from quillon.plans.resampling import WEIGHT, bootstrap_ci
from quillon.plans.vectors import letter_profiles
from quillon.plans.vocabulary import word_counts
from quillon.registry import analysis
from quillon.sources import corpus as C

UNIT = "('0x' || substring(md5({parts}), 1, 12))::bigint / 281474976710656.0"


# ---- shuffles


@analysis(oracle=f"""with {sql.TOKENS}, s as (select *, row_number() over (partition by corpus order by md5('global@|' || corpus || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as slot,
      row_number() over (partition by corpus order by md5('global|' || corpus || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as k from tokens),
    d as (select a.corpus, a.doc_id, a.line_no, a.pos, a.line_len, b.word from s a join s b on a.corpus = b.corpus and a.slot = b.k)
    select corpus, count(*) as tokens, round(avg(length(word)) filter (pos = 0), 6) as first_len, round(avg(length(word)) filter (pos = line_len - 1), 6) as last_len, round(avg(length(word)), 6) as mean_len from d group by corpus""")
def null_global_word_shuffle(spark, sf_dir):
    """All words of a corpus dealt anew; lines keep their lengths."""
    t = C.tokens(C.lines(spark, sf_dir)).select("corpus", "doc_id", "line_no", "pos", "line_len", "word")
    edges = (F.col("pos") == 0).cast("int") + 2 * (F.col("pos") == F.col("line_len") - 1).cast("int")
    s = nulls.joint_dealt(t, ["corpus"], edges, F.length("word"), ["doc_id", "line_no", "pos"], "global")

    def mean(here) -> Column:
        return F.round(F.sum(F.when(here, F.col("n") * F.col("value"))) / F.sum(F.when(here, F.col("n"))), 6)

    first, last = F.col("slot").isin(1, 3), F.col("slot") >= 2
    return s.groupBy("corpus").agg(F.sum("n").alias("tokens"), mean(first).alias("first_len"), mean(last).alias("last_len"), mean(F.lit(True)).alias("mean_len"))


@analysis(oracle=f"""with {sql.CHARS}, s as (select *, row_number() over (partition by corpus, doc_id, line_no order by pos, i) as slot from chars),
    r as (select *, row_number() over (partition by corpus, doc_id, line_no order by md5('letters|' || doc_id || '|' || line_no || '|' || (slot - 1)), slot) as k from s),
    w as (select a.corpus, a.doc_id, a.line_no, a.pos, string_agg(b.c, '' order by a.slot) as word from r a join r b on a.corpus = b.corpus and a.doc_id = b.doc_id and a.line_no = b.line_no and a.slot = b.k group by all),
    n as (select corpus, word, count(*)::double as n from w group by all)
    select corpus, sum(n)::bigint as tokens, count(*) as types, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as h_word from n group by corpus""")
def null_line_letter_shuffle(spark, sf_dir):
    """The letters of each line in a drawn order, cut again where its words end."""
    lines = C.lines(spark, sf_dir)
    # a flag for each letter says whether a word ends with it, so the cuts need no running sums
    ends = F.split(F.array_join(F.transform("words", lambda w: F.concat(F.repeat(F.lit("0"), F.length(w) - 1), F.lit("1"))), ""), "")
    letters = F.filter(F.split(F.array_join("words", ""), ""), lambda c: c != "")
    two = lines.select("corpus", nulls.shuffled(letters, "letters", "doc_id", "line_no").alias("c"), F.filter(ends, lambda c: c != "").alias("e"))
    told = F.array_join(F.zip_with("c", "e", lambda c, e: F.when(e == "1", F.concat(c, F.lit(" "))).otherwise(c)), "")
    words = two.select("corpus", F.explode(F.split(F.rtrim(told), " ")).alias("word")).groupBy("corpus", "word").agg(F.count("*").alias("n"))
    return words.groupBy("corpus").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(stats.plogp(), 6).alias("h_word"))


AFFIXES = EDGE.replace("word", "b"), ENDS.replace("word", "a")


@analysis(reps=5, oracle=f"""with {sql.PAIRS.replace("select corpus, doc_id", "select corpus, source, doc_id")}, p as (select corpus, source, doc_id, line_no, pos - 1 as pos, {AFFIXES[1]} as s, {AFFIXES[0]} as p from pairs),
    q as (select * from p, (select unnest(range(0, 5)) as rep)),
    r as (select *, row_number() over (w order by md5('suffix@|' || corpus || '|' || source || '|' || rep || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as s1, row_number() over (w order by md5('suffix|' || corpus || '|' || source || '|' || rep || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as k1,
      row_number() over (w order by md5('prefix@|' || corpus || '|' || source || '|' || rep || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as s2, row_number() over (w order by md5('prefix|' || corpus || '|' || source || '|' || rep || '|' || doc_id || '|' || line_no || '|' || pos), doc_id, line_no, pos) as k2 from q window w as (partition by corpus, source, rep)),
    d as (select a.corpus, a.rep, b.s as x, c.p as y from r a join r b on a.corpus = b.corpus and a.source = b.source and a.rep = b.rep and a.s1 = b.k1 join r c on a.corpus = c.corpus and a.source = c.source and a.rep = c.rep and a.s2 = c.k2 union all select corpus, -1, s, p from p),
    j as (select corpus, rep, x, y, count(*)::double as n from d group by all), t as (select *, sum(n) over (partition by corpus, rep, x) as nx, sum(n) over (partition by corpus, rep, y) as ny, sum(n) over (partition by corpus, rep) as total from j),
    m as (select corpus, rep, sum(n * log2(n * total / (nx * ny))) / max(total) as mi from t group by all), o as (select corpus, mi as real from m where rep = -1)
    select m.corpus, round(any_value(real), 6) as real, round(avg(mi), 6) as null_mean, round((1 + count(*) filter (mi >= real)) / 6.0, 6) as p from m join o using (corpus) where rep >= 0 group by m.corpus""")
def null_column_shuffle(spark, sf_dir, reps=5):
    """What a word's ending tells of the next word's beginning, against both columns dealt anew, each by itself, in every source."""
    packed = shared.written(packed_affixes(spark, sf_dir), "affixes", cleanup=True)
    told = packed.select("corpus", "pairs").mapInArrow(_own_pairs, "corpus string, x int, y int, n long")
    real = stats.mutual_information(told.groupBy("corpus", "x", "y").agg(F.sum("n").alias("n")), ["corpus"], "x", "y").select("corpus", F.col("mi").alias("real"))
    dealt = shared.written(columns_dealt(packed, reps), "columns", cleanup=True)  # read more than once
    null = stats.mutual_information(dealt, ["corpus", "rep"], "x", "y").select("corpus", "rep", "mi").join(real, "corpus")
    return null.groupBy("corpus").agg(F.round(F.max("real"), 6).alias("real"), F.round(F.avg("mi"), 6).alias("null_mean"), F.round(nulls.empirical_p(F.col("mi"), F.col("real")), 6).alias("p"))


#: Affixes by number; the last is none of them. A pair is 16 times its ending's number and its beginning's.
ENDINGS, BEGINNINGS = [*T.EDGE_SUFFIXES, "X"], [*T.EDGE_PREFIXES, "X"]


def packed_affixes(spark, sf_dir) -> DataFrame:
    """(corpus, source, doc_id, lines, sizes, pairs, n): a document's lines of two words or more, packed: their numbers and
    how many pairs each has, four bytes each, and a byte a pair; n pairs in all."""
    import numpy as np
    import pyarrow as pa

    def put(batches):
        for batch in batches:
            lens = batch["lines"]
            of = np.diff(lens.offsets.to_numpy())
            lines = lens.flatten()
            sizes, codes = np.diff(lines.offsets.to_numpy()).astype(np.int64), lines.flatten().to_numpy().astype(np.int64)
            number = np.arange(len(sizes)) - np.repeat(np.cumsum(of) - of, of)
            last = np.zeros(len(codes), bool)
            last[np.cumsum(sizes)[sizes > 0] - 1] = True
            pairs = (codes[:-1] & 0xF0 | codes[1:] & 0xF)[~last[:-1]].astype(np.uint8)
            sizes = np.maximum(sizes - 1, 0)
            kept, ends = sizes > 0, np.cumsum(of)
            pair_at, line_at = np.concatenate([[0], np.cumsum(sizes)])[[0, *ends]], np.concatenate([[0], np.cumsum(kept)])[[0, *ends]]
            number, sizes = number[kept].astype("<u4"), sizes[kept].astype("<u4")
            cut = lambda x, at: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            told = [batch["corpus"], batch["source"], batch["doc_id"], cut(number, line_at), cut(sizes, line_at), cut(pairs, pair_at), pa.array(np.diff(pair_at), pa.int64())]
            yield pa.RecordBatch.from_arrays(told, names=["corpus", "source", "doc_id", "lines", "sizes", "pairs", "n"])

    def code(w) -> Column:
        s, p = T.suffix(w), T.prefix(w)
        return (F.array_position(F.array(*map(F.lit, ENDINGS)), s) * 16 + F.array_position(F.array(*map(F.lit, BEGINNINGS)), p)).cast("int")

    lines = F.transform(F.split("text", "\n", -1), lambda l: F.transform(T.words(l), code))
    docs = C.table(spark, sf_dir, "documents").where("text is not null").select(F.col("lang").alias("corpus"), "source", F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
    return docs.mapInArrow(put, "corpus string, source string, doc_id long, lines binary, sizes binary, pairs binary, n long").where("n > 0")


def _own_pairs(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        corpora = batch["corpus"].to_pylist()
        found = {c: np.zeros(256, np.int64) for c in set(corpora)}
        for corpus, pairs in zip(corpora, batch["pairs"]):
            found[corpus] += np.bincount(np.frombuffer(pairs.as_buffer(), np.uint8), minlength=256)
        for corpus, n in found.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([corpus] * len(k), pa.string()), pa.array((k >> 4).astype(np.int32)), pa.array((k & 15).astype(np.int32)), pa.array(n[k])], names=["corpus", "x", "y", "n"])


def columns_dealt(packed: DataFrame, reps: int, most: int = 1 << 25) -> DataFrame:
    """(corpus, rep, x, y, n): pairs with their endings and their beginnings dealt anew in every source.

    A task takes the packed documents of a source and orders its pairs by arrays of hashes, once for each column and side.
    A source of over `most` pairs is dealt by nulls.permuted(), which ranks in ranges of the hashes.
    """
    packed = packed.where("corpus is not null and source is not null")
    by = ["corpus", "source"]
    large = packed.groupBy(*by).agg(F.sum("n").alias("k")).where(F.col("k") > most).select(*by)
    is_large = large.limit(1).count() > 0
    small = packed.join(large, by, "left_anti") if is_large else packed
    small = small.repartition(4 * packed.sparkSession.sparkContext.defaultParallelism, *by)  # few bytes, but much work
    j = small.groupBy(*by).applyInArrow(lambda t: _columns_dealt(t, reps), "corpus string, rep int, x int, y int, n long")
    if is_large:
        rows = packed.join(large, by, "left_semi").mapInArrow(_unpacked, "corpus string, source string, doc_id long, line_no long, pos long, x int, y int")
        within, key = [*by, "rep"], ["doc_id", "line_no", "pos"]
        dealt = nulls.permuted(nulls.replicates(rows, reps), within, "x", key, "suffix")
        j = j.unionByName(stats.freq(nulls.permuted(dealt, within, "y", key, "prefix"), ["corpus", "rep"], "x", "y"))
    return j.groupBy("corpus", "rep", "x", "y").agg(F.sum("n").alias("n"))


def _rows(table):
    """Of packed documents: the documents' ids and their lines' numbers, a line each, the lines' sizes and all pairs."""
    import numpy as np
    import pyarrow as pa

    lines, sizes, pairs = ([x.as_buffer() for x in table[c]] for c in ("lines", "sizes", "pairs"))
    lines, sizes, pairs = (np.frombuffer(b"".join(x), kind) for x, kind in ((lines, "<u4"), (sizes, "<u4"), (pairs, np.uint8)))
    ids = table["doc_id"]
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    of = np.array([x.as_buffer().size // 4 for x in table["lines"]], np.int64)
    return ids.take(pa.array(np.repeat(np.arange(len(of)), of))), lines.astype(np.int64), sizes.astype(np.int64), pairs, np.repeat(np.arange(len(of)), of)


def _unpacked(batches):
    import numpy as np
    import pyarrow as pa

    from quillon.functions import md5

    for batch in batches:
        for k in range(batch.num_rows):
            ids, lines, sizes, pairs, row = _rows(batch.slice(k, 1))
            where, pos = md5.places(sizes)
            at = pa.array(np.zeros(len(where), np.int64))
            told = [batch["corpus"].slice(k, 1).take(at), batch["source"].slice(k, 1).take(at), ids.take(pa.array(where)), pa.array(lines[where]), pa.array(pos), pa.array((pairs >> 4).astype(np.int32)), pa.array((pairs & 15).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(told, names=["corpus", "source", "doc_id", "line_no", "pos", "x", "y"])


def _columns_dealt(table, reps: int):
    import numpy as np
    import pyarrow as pa

    from quillon.functions import md5

    corpus, source = table["corpus"][0].as_py(), table["source"][0].as_py()
    ids, lines, sizes, pairs, _ = _rows(table.sort_by("doc_id"))
    upto, cuts = np.concatenate([[0], np.cumsum(sizes)]), [0]
    while cuts[-1] < len(sizes):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + (1 << 18), "right")) - 1))

    def part(a: int, b: int) -> md5.Messages:
        return md5.Messages.placed(md5.joined(ids.slice(a, b - a), lines[a:b]), sizes[a:b], *md5.places(sizes[a:b]))

    def digest(prefix: bytes, i: int) -> bytes:
        a = int(np.searchsorted(upto, i, "right")) - 1
        return part(a, a + 1).digest(prefix, int(i - upto[a]))

    def orders(prefixes: list[bytes]):
        """Row numbers by each prefix's hashes; as many are hashed in a go as a few hundred MB hold."""
        step = max(1, (1 << 24) // len(pairs))
        for k in range(0, len(prefixes), step):
            some = prefixes[k : k + step]
            hashed = [np.empty(len(pairs), np.uint64) for _ in some]
            for a, b in zip(cuts, cuts[1:]):
                told = part(a, b)
                for prefix, h in zip(some, hashed):
                    h[upto[a] : upto[b]] = told.first64(prefix)
            for prefix in some:
                yield md5.ordered(hashed.pop(0), lambda i, prefix=prefix: digest(prefix, i))

    by = orders([f"{seed}|{corpus}|{source}|{rep}|".encode() for rep in range(reps) for seed in ("suffix", "suffix@", "prefix", "prefix@")])
    out = []
    for _ in range(reps):
        new = np.zeros(len(pairs), np.uint8)
        for mask in (0xF0, 0x0F):
            dealt = pairs[next(by)] & np.uint8(mask)
            new[next(by)] |= dealt
        out.append(np.bincount(new, minlength=256))
    rep, k = np.nonzero(out)
    told = [pa.array([corpus] * len(k), pa.string()), *(pa.array(x.astype(np.int32)) for x in (rep, k >> 4, k & 15)), pa.array(np.array(out)[rep, k].astype(np.int64))]
    return pa.table(told, names=["corpus", "rep", "x", "y", "n"])


TOP_LETTERS = f"""with {sql.COUNTS}, pr as (select corpus, n, unnest(list_transform(range(1, length(word)), lambda i: word[i:i + 1])) as ab from counts where length(word) > 1),
    j as (select corpus, ab[1] as a, ab[2] as b, sum(n)::bigint as n from pr group by all), top as (select corpus, a from j group by corpus, a qualify row_number() over (partition by corpus order by sum(n) desc, a) <= 26),
    m as (select j.corpus, j.a, j.b, n from j join top x on x.corpus = j.corpus and x.a = j.a join top y on y.corpus = j.corpus and y.a = j.b)"""


def row_permuted(joint: DataFrame, reps: int) -> DataFrame:
    """(corpus, rep, a, b, n): each letter's row of followers given to another letter, by two hash orders; an alphabet a group."""
    rows = nulls.replicates(joint.select("corpus", "a").distinct(), reps)
    w = Window.partitionBy("corpus", "rep")
    to = rows.select("corpus", "rep", "a", F.row_number().over(w.orderBy(nulls.draw("row@", "corpus", "rep", "a"), "a")).alias("k"))
    of = rows.select("corpus", "rep", F.col("a").alias("own"), F.row_number().over(w.orderBy(nulls.draw("row", "corpus", "rep", "a"), "a")).alias("k"))
    dealt = to.join(of, ["corpus", "rep", "k"]).select("corpus", "rep", "a", "own")
    return dealt.join(joint.withColumnRenamed("a", "own"), ["corpus", "own"]).select("corpus", "rep", "a", "b", "n")


@analysis(reps=3, oracle=TOP_LETTERS + """, r as (select corpus, rep, a, row_number() over (partition by corpus, rep order by md5('row@|' || corpus || '|' || rep || '|' || a), a) as s, row_number() over (partition by corpus, rep order by md5('row|' || corpus || '|' || rep || '|' || a), a) as k from (select distinct corpus, a from m), (select unnest(range(0, 3)) as rep))
    select x.corpus, x.rep::int as rep, x.a, m.b, m.n from r x join r y on x.corpus = y.corpus and x.rep = y.rep and x.s = y.k join m on m.corpus = y.corpus and m.a = y.a""")
def row_permuted_transitions(spark, sf_dir, reps=3):
    """The transition counts of letters with their rows permuted."""
    return row_permuted(letter_profiles(spark, sf_dir), reps)


def shuffled_bigrams(spark, sf_dir, reps: int) -> DataFrame:
    """(corpus, rep, a, b, n): transition counts after the letters of every word are shuffled."""
    w = nulls.replicates(word_counts(spark, sf_dir), reps).withColumn("c", nulls.shuffled(F.filter(F.split("word", ""), lambda c: c != ""), "bigram", "rep", "word"))
    two = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))
    return w.where(F.size("c") > 1).select("corpus", "rep", "n", F.explode(two).alias("x")).groupBy("corpus", "rep", "x.a", "x.b").agg(F.sum("n").alias("n"))


@analysis(reps=3, oracle=f"""with {sql.COUNTS}, l as (select corpus, word, n, unnest(cs) as c, generate_subscripts(cs, 1) - 1 as i from (select *, string_split(word, '') as cs from counts)),
    s as (select corpus, rep, word, n, string_agg(c, '' order by md5('bigram|' || rep || '|' || word || '|' || i), c) as new from l, (select unnest(range(0, 3)) as rep) group by all),
    p as (select corpus, rep, n, unnest(list_transform(range(1, length(new)), lambda i: new[i:i + 1])) as ab from s where length(new) > 1)
    select corpus, rep::int as rep, ab[1] as a, ab[2] as b, sum(n)::bigint as n from p group by all""")
def shuffled_bigram_transitions(spark, sf_dir, reps=3):
    """Transition counts of letters when the letters of every word are shuffled."""
    return shuffled_bigrams(spark, sf_dir, reps)


@analysis(depends=("spectral_split",), reps=3)
def spectral_nulls(spark, sf_dir, reps=3):
    """Gap and alternation of the spectral split, real and under both nulls of the transitions; a row a corpus and null."""
    joint = letter_profiles(spark, sf_dir)
    letters = joint.select("corpus", "a").distinct()
    two = shuffled_bigrams(spark, sf_dir, reps).join(letters, ["corpus", "a"], "left_semi")
    two = two.join(letters.select("corpus", F.col("a").alias("b")), ["corpus", "b"], "left_semi")
    each = [("real", joint.withColumn("rep", F.lit(0))), ("rows", row_permuted(joint, reps)), ("bigrams", two)]
    out = None
    for name, df in each:
        tagged = df.select(F.concat_ws("|", "corpus", "rep").alias("corpus"), "a", "b", "n")
        s = cluster.spectral(tagged).groupBy("corpus").agg(F.first("gap").alias("gap"), F.first("alternation").alias("alternation"))
        s = s.select(F.split_part("corpus", F.lit("|"), F.lit(1)).alias("corpus"), F.lit(name).alias("kind"), "gap", "alternation")
        out = s if out is None else out.unionByName(s)
    return out.groupBy("corpus", "kind").agg(*(F.round(f(c), 5).alias(f"{c}_{n}") for c in ("gap", "alternation") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


# ---- merges of chunks


def chunk_words(spark, sf_dir) -> DataFrame:
    """(corpus, n, ch): the chunks of each type."""
    ch = F.transform(T.chunks(F.col("word"))["chunks"], lambda x: F.array_join(x, ""))
    return word_counts(spark, sf_dir).select("corpus", "n", ch.alias("ch"))


def merged_ratio(words: DataFrame, classes: DataFrame) -> DataFrame:
    """(corpus, ratio): entropy of a chunk's class after the one before it, by that of all classes.

    classes: (corpus, chunk, class), some thousands of chunk types a corpus.
    """
    single = words.select("corpus", "n", F.explode("ch").alias("chunk")).join(classes, ["corpus", "chunk"])
    h = stats.entropy(single.groupBy("corpus", "class").agg(F.sum("n").alias("n")), ["corpus"], "h")
    two = F.transform(F.sequence(F.lit(1), F.size("ch") - 1), lambda i: F.struct(F.element_at("ch", i).alias("a"), F.element_at("ch", i + 1).alias("b")))
    pairs = words.where(F.size("ch") > 1).select("corpus", "n", F.explode(two).alias("x")).groupBy("corpus", "x.a", "x.b").agg(F.sum("n").alias("n"))
    for c in ("a", "b"):
        pairs = pairs.join(classes.select("corpus", F.col("chunk").alias(c), F.col("class").alias(f"c{c}")), ["corpus", c])
    joint = pairs.groupBy("corpus", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("n").alias("n"))
    cond = stats.conditional_entropy(joint, ["corpus"], "a", "hc")
    return h.join(cond, "corpus").select("corpus", (F.col("hc") / F.nullif("h", F.lit(0.0))).alias("ratio"))


def skeleton_class(chunk):
    """Which of the five slots a chunk fills, as ones and zeros."""
    one = chunk
    for glyph, char in T.ONE.items():
        one = F.replace(one, F.lit(glyph), F.lit(char))
    pattern = "^" + "".join(f"({s})?" for s in T.SLOTS) + ".*$"
    return F.concat(*(F.when(F.regexp_extract(one, pattern, i + 1) != "", "1").otherwise("0") for i in range(5)))


_SLOTS = "^" + "".join(f"({s})?" for s in T.SLOTS) + ".*$"
MERGES = CHUNKED.replace("from counts)", "from counts)", 1) + f""", o2 as (select c.corpus, c.word, replace_back as chunk, i, n from (select *, {sql.replaced("p", [(b, a) for a, b in T.ONE.items()])} as replace_back from c) c join counts using (corpus, word)),
    f as (select corpus, chunk, any_value(p) as p, sum(n) as n from (select o2.*, c.p from o2 join c on c.corpus = o2.corpus and c.word = o2.word and c.i = o2.i) group by corpus, chunk),
    r as (select *, row_number() over (partition by corpus order by n desc, chunk) - 1 as r from f),
    k as (select corpus, chunk, unnest(['rank', 'random', 'skeleton']) as kind, unnest(['F' || (r % 25), 'R' || (('0x' || substring(md5('merge|' || chunk), 1, 8))::bigint % 25),
      """ + " || ".join(f"(regexp_extract(p, '{_SLOTS}', {i + 1}) <> '')::int::varchar" for i in range(5)) + """]) as class from r),
    s as (select o2.*, kind, class from o2 join k using (corpus, chunk)),
    h as (select corpus, kind, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from (select corpus, kind, class, sum(n)::double as n from s group by all) group by all),
    j as (select a.corpus, a.kind, a.class as a, b.class as b, sum(a.n)::double as n from s a join s b on a.corpus = b.corpus and a.word = b.word and a.kind = b.kind and b.i = a.i + 1 group by all),
    hj as (select corpus, kind, log2(sum(n)) - sum(n * log2(n)) / sum(n) as hj from j group by all), ha as (select corpus, kind, log2(sum(n)) - sum(n * log2(n)) / sum(n) as ha from (select corpus, kind, a, sum(n) as n from j group by all) group by all)
    select corpus, kind, round((hj - ha) / h, 6) as ratio from h join hj using (corpus, kind) join ha using (corpus, kind)"""


@analysis(k=25, oracle=MERGES)
def chunk_merges(spark, sf_dir, k=25):
    """Predictability of chunks merged by frequency rank, at random, and by the slots that they fill."""
    words = shared.written(chunk_words(spark, sf_dir), "chunks")
    counts = words.select("corpus", "n", F.explode("ch").alias("chunk")).groupBy("corpus", "chunk").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "chunk")) - 1  # chunk types, some thousands
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("merge|"), F.col("chunk"))), 1, 8), 16, 10).cast("long") % k
    kinds = {"rank": F.concat(F.lit("F"), rank % k), "random": F.concat(F.lit("R"), drawn), "skeleton": skeleton_class(F.col("chunk"))}
    out = None
    for kind, cls in kinds.items():
        r = merged_ratio(words, counts.select("corpus", "chunk", cls.alias("class"))).select("corpus", F.lit(kind).alias("kind"), r6("ratio"))
        out = r if out is None else out.unionByName(r)
    return out


# ---- a grid of strengths, fitted on one feature and frozen

GRID = tuple(0.25 * k for k in range(17))


def ordered_lines(lines: DataFrame, means: DataFrame, strengths: DataFrame) -> DataFrame:
    """Lines of first letters put in order by a draw plus strength times the mean place of the letter's class."""
    j = lines.join(F.broadcast(means), "corpus").join(F.broadcast(strengths), "corpus")  # a row a corpus; a row a corpus and strength
    u = lambda i: nulls.uniform(nulls.draw("grid", "doc_id", "line_no", i))
    keyed = F.transform(F.transform("words", lambda w: F.substring(w, 1, 1)), lambda c, i: F.struct((u(i) + F.col("lambda") * F.coalesce(F.element_at("means", c), F.lit(0.5))).alias("k"), i.alias("i"), c.alias("c")))
    return j.withColumn("words", F.transform(F.sort_array(keyed), lambda x: x["c"])).drop("means")


LAMBDA = f"""with {sql.TOKENS}, u as (select corpus, word[1] as cls, (pos - 1.5) / (line_len - 4) as u from tokens where pos >= 2 and pos < line_len - 2), mu as (select corpus, cls, avg(u) as mu from u group by all),
    g as (select tokens.corpus, lam, doc_id, line_no, line_len, row_number() over (partition by doc_id, line_no, lam order by {UNIT.format(parts="'grid|' || doc_id || '|' || line_no || '|' || pos")} + lam * coalesce(mu.mu, 0.5), pos) - 1 as pos, word[1] as cls
      from tokens left join mu on mu.corpus = tokens.corpus and mu.cls = word[1], (select unnest(range(0, 17)) * 0.25::double as lam)),
    v as (select corpus, lam, cls, (pos - 1.5) / (line_len - 4) as u from g where pos >= 2 and pos < line_len - 2 union all select corpus, -1.0, cls, u from u),
    c as (select corpus, lam, cls, avg(u) as m, count(*) as n from v group by all having count(*) >= 20), a as (select corpus, lam, sum(m * n) / sum(n) as g from c group by all),
    t as (select c.corpus, c.lam, sum(n * (m - g) * (m - g)) / sum(n) as t from c join a on a.corpus = c.corpus and a.lam = c.lam group by all),
    best as (select corpus, lam, t, real from (select t.*, r.t as real from t join t r on r.corpus = t.corpus and r.lam = -1 where t.lam >= 0) qualify row_number() over (partition by corpus order by abs(t - real), lam) = 1),
    e as (select corpus, lam, cls as c, (pos = 0)::int as edge from g where line_len >= 3 and pos < line_len - 1 union all select corpus, -1.0, word[1], (pos = 0)::int from tokens where line_len >= 3 and pos < line_len - 1),
    s as (select corpus, lam, c, sum(edge)::double as a, sum(1 - edge)::double as b from e group by all), p as (select *, a / sum(a) over w as p, b / sum(b) over w as q from s window w as (partition by corpus, lam)),
    d as (select corpus, lam, sum(0.5 * case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + 0.5 * case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as jsd from p group by all)
    select best.corpus, best.lam as lambda, round(real, 6) as t_real, round(best.t, 6) as t_fitted, round(x.jsd, 5) as edge_real, round(y.jsd, 5) as edge_fitted, round(z.jsd, 5) as edge_ablated
    from best join d x on x.corpus = best.corpus and x.lam = -1 join d y on y.corpus = best.corpus and y.lam = best.lam join d z on z.corpus = best.corpus and z.lam = 0"""


@analysis(depends=("rank_statistic_t",), oracle=LAMBDA)
def lambda_grid(spark, sf_dir):
    """The strength of a line discipline, fitted on the interior rank statistic alone and then frozen: what it does to the
    line's edge, which it wasn't fitted on, beside the real lines and the ablation without any."""
    lines = C.lines(spark, sf_dir)
    first = first_letters(lines)
    place = first.where((F.col("pos") >= 2) & (F.col("pos") < F.col("line_len") - 2))
    m = place.groupBy("corpus", "cls").agg(F.avg((F.col("pos") - 1.5) / (F.col("line_len") - 4)).alias("m"))
    means = m.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("cls", "m"))).alias("means"))  # an alphabet
    grid = means.select("corpus", F.explode(F.array(*map(F.lit, GRID))).alias("lambda"))
    real = rank_t(first, ["corpus"]).select("corpus", F.col("t").alias("t_real"))
    fitted = rank_t(first_letters(ordered_lines(lines, means, grid)), ["corpus", "lambda"]).join(real, "corpus")
    best = fitted.groupBy("corpus").agg(F.min(F.struct(F.abs(F.col("t") - F.col("t_real")).alias("off"), "lambda", "t", "t_real")).alias("x"))
    best = shared.written(best.select("corpus", "x.lambda", "x.t", "x.t_real"), "frozen")  # a row a corpus
    frozen = best.select("corpus", "lambda", F.lit("edge_fitted").alias("which")).unionByName(best.select("corpus", F.lit(0.0).alias("lambda"), F.lit("edge_ablated").alias("which")))
    e = edge_jsd(ordered_lines(lines, means, frozen), ["corpus", "which"]).select("corpus", "which", "line_init_jsd")
    e = e.groupBy("corpus").agg(*(F.round(F.max(F.when(F.col("which") == k, F.col("line_init_jsd"))), 5).alias(k) for k in ("edge_fitted", "edge_ablated")))
    own = edge_jsd(lines, ["corpus"]).select("corpus", F.round("line_init_jsd", 5).alias("edge_real"))
    return best.select("corpus", "lambda", r6("t_real"), F.round("t", 6).alias("t_fitted")).join(own, "corpus").join(e, "corpus")


# ---- samples and intervals


@analysis(k=30, oracle=f"""with s as (select lang, source, doc_id, row_number() over (partition by lang, source order by md5('match|' || doc_id), doc_id) - 1 as r, count(*) over (partition by lang, source) as m from documents),
    d as (select lang, source, i, m, case when m >= 30 then i else ('0x' || substring(md5('again|' || lang || '|' || source || '|' || i), 1, 8))::bigint % m end as r from (select distinct lang, source, m from s), (select unnest(range(0, 30)) as i))
    select d.lang, d.source, d.i::int as i, s.doc_id, d.m < 30 as replaced from d join s on s.lang = d.lang and s.source = d.source and s.r = d.r""")
def size_matched_sample(spark, sf_dir, k=30):
    """k documents of every stratum: the first by a hash, or, where a stratum is short, draws with replacement."""
    d = C.table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    sizes = d.groupBy("lang", "source").agg(F.count("*").alias("m"))
    r = F.row_number().over(Window.partitionBy("lang", "source").orderBy(nulls.draw("match", "doc_id"), "doc_id")) - 1
    kept = d.withColumn("r", r.cast("long")).where(F.col("r") < k)  # Spark keeps k rows a stratum while it sorts
    wanted = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    again = F.conv(F.substring(nulls.draw("again", "lang", "source", "i"), 1, 8), 16, 10).cast("long") % F.col("m")
    wanted = wanted.withColumn("r", F.when(F.col("m") >= k, F.col("i").cast("long")).otherwise(again))
    return wanted.join(kept, ["lang", "source", "r"]).select("lang", "source", "i", "doc_id", (F.col("m") < k).alias("replaced"))


@analysis(oracle=f"""with {sql.ORDERED}, n as (select corpus, count(*) // 2 as mid from ordered group by corpus)
    select o.corpus, case when ord < mid then 'first' else 'second' end as half, count(*) as tokens, count(distinct word) as types, round(avg(length(word)), 6) as mean_len from ordered o join n using (corpus) group by all""")
def contiguous_halves(spark, sf_dir):
    """A corpus cut in the middle of its tokens."""
    t = C.tokens(order.number_tokens(C.lines(spark, sf_dir)))
    mid = t.groupBy("corpus").agg(F.floor(F.count("*") / 2).alias("mid"))
    half = F.when(F.col("ord") < F.col("mid"), "first").otherwise("second")
    words = t.join(F.broadcast(mid), "corpus").groupBy("corpus", half.alias("half"), "word").agg(F.count("*").alias("n"))  # a row a corpus
    return words.groupBy("corpus", "half").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.sum(F.col("n") * F.length("word")) / F.sum("n"), 6).alias("mean_len"))


@analysis(oracle=f"""with {sql.COUNTS}, r as (select corpus, word, row_number() over (partition by corpus order by n desc, word) as r from counts),
    p as (select a.corpus as x, b.corpus as y from (select distinct corpus from counts) a join (select distinct corpus from counts) b on a.corpus < b.corpus),
    u as (select x, y, word, coalesce(max(r) filter (corpus = x), (select max(r) + 1 from r q where q.corpus = x)) as rx, coalesce(max(r) filter (corpus = y), (select max(r) + 1 from r q where q.corpus = y)) as ry from p join r on r.corpus in (x, y) group by x, y, word),
    t as (select * from u where rx <= 50 or ry <= 50),
    o as (select x, y, row_number() over (partition by x, y order by rx, word) as a, row_number() over (partition by x, y order by ry, word) as b from t)
    select x as first, y as second, count(*) as items, round(1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1.0)), 6) as rho from o group by x, y""")
def spearman_top_union(spark, sf_dir, top=50):
    """Rank correlation by squared differences over the union of two corpora's most frequent words; an absent word ranks last."""
    c = word_counts(spark, sf_dir)
    sizes = c.groupBy("corpus").agg((F.count("*") + 1).alias("last"))
    r = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "word"))
    ranked = c.select("corpus", "word", r.alias("r"))
    heads = ranked.where(F.col("r") <= top).select("corpus", "word")  # `top` words a corpus
    langs = sizes.select(F.col("corpus").alias("first"), F.col("last").alias("lx")).crossJoin(F.broadcast(sizes.select(F.col("corpus").alias("second"), F.col("last").alias("ly")))).where("first < second")  # corpora squared
    items = langs.join(heads, (F.col("corpus") == F.col("first")) | (F.col("corpus") == F.col("second"))).select("first", "second", "lx", "ly", "word").distinct()
    known = ranked.join(F.broadcast(heads.select("word").distinct()), "word", "left_semi")
    for side, last, out in (("first", "lx", "rx"), ("second", "ly", "ry")):
        items = items.join(known.select(F.col("corpus").alias(side), "word", F.col("r").alias(out)), [side, "word"], "left").withColumn(out, F.coalesce(out, last))
    w = Window.partitionBy("first", "second")
    o = items.select("first", "second", F.row_number().over(w.orderBy("rx", "word")).alias("a"), F.row_number().over(w.orderBy("ry", "word")).alias("b"))
    d, n = F.col("a") - F.col("b"), F.count("*")
    return o.groupBy("first", "second").agg(n.alias("items"), F.round(1 - 6.0 * F.sum(d * d) / (n * (n * n - 1.0)), 6).alias("rho"))


SIX = ("h1_char", "h2_ratio", "mean_wlen", "pos_predict", "ttr_5000", "zipf_alpha")


@analysis(depends=("corpus_fingerprint",), oracle=FP + ", l as (select corpus, unnest([" + ", ".join(f"'{f}'" for f in SIX) + "]) as feature, unnest([" + ", ".join(SIX) + """]) as v from fp), s as (select feature, avg(v) as mu, stddev_pop(v) as sd from l group by all),
    z as (select corpus, feature, (v - mu) / sd as z from l join s using (feature) where sd > 1e-12)
    select a.corpus as first, b.corpus as second, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 4) as distance from z a join z b on a.feature = b.feature and a.corpus < b.corpus group by all""")
def six_feature_distance(spark, sf_dir):
    """Distances of the corpora in six standardised features."""
    long = fingerprint(documents_and_benchmark(spark, sf_dir)).unpivot(["corpus"], list(SIX), "feature", "v")
    s = long.groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    z = long.join(F.broadcast(s), "feature").where("sd > 1e-12").select("corpus", "feature", ((F.col("v") - F.col("mu")) / F.col("sd")).alias("z"))  # six rows
    a, b = z.select(F.col("corpus").alias("first"), "feature", F.col("z").alias("x")), z.select(F.col("corpus").alias("second"), "feature", F.col("z").alias("y"))
    d = a.join(b, "feature").where("first < second").groupBy("first", "second")
    return d.agg(F.round(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2.0)))), 4).alias("distance"))


# ---- classes and components


@analysis(frequent=15, oracle=f"""with {sql.COUNTS}, pr as (select corpus, n, unnest(list_transform(range(1, length(word)), lambda i: word[i:i + 1])) as ab from counts where length(word) > 1),
    x as (select corpus, c, side, o, sum(n)::double as n from (select corpus, ab[1] as c, 'right' as side, ab[2] as o, n from pr union all select corpus, ab[2], 'left', ab[1], n from pr) group by all),
    f as (select corpus, c, sum(n) as t, row_number() over (partition by corpus order by sum(n) desc, c) as r from x group by corpus, c), p as (select x.corpus, x.c, side, o, n / t as p, r from x join f using (corpus, c)),
    s as (select a.corpus, a.c, b.c as cls, sum(least(a.p, b.p)) as score from p a join p b on a.corpus = b.corpus and a.side = b.side and a.o = b.o where a.r > 15 and b.r <= 15 group by all)
    select corpus, c as letter, cls as class, round(score, 6) as overlap from s qualify row_number() over (partition by corpus, c order by round(score, 9) desc, cls) = 1""")
def rare_unit_classes(spark, sf_dir, frequent=15):
    """Each rare letter given to the frequent one whose neighbours, on either side, are most like its own."""
    two = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    pr = word_counts(spark, sf_dir).where(F.length("word") > 1).select("corpus", "n", F.explode(two).alias("ab"))
    ends = F.array(
        F.struct(F.substring("ab", 1, 1).alias("c"), F.lit("right").alias("side"), F.substring("ab", 2, 1).alias("o")),
        F.struct(F.substring("ab", 2, 1).alias("c"), F.lit("left").alias("side"), F.substring("ab", 1, 1).alias("o")),
    )
    x = pr.select("corpus", "n", F.explode(ends).alias("x")).groupBy("corpus", "x.c", "x.side", "x.o").agg(F.sum("n").alias("n"))
    f = x.groupBy("corpus", "c").agg(F.sum("n").alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("t"), "c")))  # an alphabet
    p = x.join(f, ["corpus", "c"]).withColumn("p", F.col("n") / F.col("t"))
    a = p.where(F.col("r") > frequent).select("corpus", "side", "o", F.col("c").alias("letter"), F.col("p").alias("x"))
    b = p.where(F.col("r") <= frequent).select("corpus", "side", "o", F.col("c").alias("class"), F.col("p").alias("y"))
    s = a.join(b, ["corpus", "side", "o"]).groupBy("corpus", "letter", "class").agg(F.sum(F.least("x", "y")).alias("s"))
    best = s.groupBy("corpus", "letter").agg(F.min(F.struct((-F.round("s", 9)).alias("k"), "class", "s"))["class"].alias("class"), F.max("s").alias("overlap"))
    return best.select("corpus", "letter", "class", r6("overlap"))


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that links lead to.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's own label; every
    table is written, so the plan stays short. A path of n nodes takes about log n rounds.
    """
    both = shared.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = shared.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "low").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = step.join(jump, "new", "left").select("node", F.col("root").alias("was"), F.least(F.coalesce("further", "new"), "new").alias("root"))
        after = shared.written(after, "labels")
        labels = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            break
    return labels


NEAR_SOURCES = f"""{sql.TOKENS}, v as (select distinct corpus, source, word from tokens), k as (select corpus, source, count(*) as k from v group by all),
    j as (select a.corpus, a.source as x, b.source as y, count(*) as common from v a join v b on a.corpus = b.corpus and a.word = b.word and a.source < b.source group by all),
    e as (select j.corpus || '/' || x as a, j.corpus || '/' || y as b, common / (p.k + q.k - common) as jaccard from j join k p on p.corpus = j.corpus and p.source = x join k q on q.corpus = j.corpus and q.source = y)"""


@analysis(cut=0.3, oracle=f"""with recursive {NEAR_SOURCES}, l as (select a, b from e where jaccard >= 0.3 union select b, a from e where jaccard >= 0.3),
    n as (select distinct corpus || '/' || source as node from v), reach as (select node, node as r from n union select reach.node, l.b from reach join l on l.a = reach.r)
    select node, min(r) as cluster from reach group by node""")
def single_linkage_sources(spark, sf_dir, cut=0.3):
    """Sources by single linkage of their vocabularies, cut at a similarity: the components of the links above it."""
    v = C.tokens(C.lines(spark, sf_dir)).select(F.concat_ws("/", "corpus", "source").alias("node"), "corpus", "word").distinct()
    k = v.groupBy("node").agg(F.count("*").alias("k"))
    a, b = v.select("corpus", "word", F.col("node").alias("a")), v.select("corpus", "word", F.col("node").alias("b"))
    j = a.join(b, ["corpus", "word"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    j = j.join(k.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    found = components(j.where(F.col("common") / (F.col("ka") + F.col("kb") - F.col("common")) >= cut).select("a", "b"))
    return k.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


# ---- parses and sections

_CUTS = "(select unnest([" + ", ".join(f"'{p}'" for p in ("", *T.PREFIXES)) + "]) as p) cross join (select unnest([" + ", ".join(f"'{s}'" for s in ("", *T.SUFFIXES)) + "]) as s)"


@analysis(oracle=f"""with {sql.COUNTS}, x as (select corpus, word, n, p, s, word[length(p) + 1:length(word) - length(s)] as root from counts, {_CUTS} where starts_with(word, p) and ends_with(word, s) and length(p) + length(s) < length(word)),
    y as (select x.corpus, x.word, x.n, p, s, root, length(p) + length(s) + case when r.n >= 3 then 2 * length(root) else 0 end as score from x left join counts r on r.corpus = x.corpus and r.word = x.root),
    b as (select * from y qualify row_number() over (partition by corpus, word order by score desc, length(p) desc, s) = 1)
    select corpus, p as prefix, s as suffix, count(*) as types, sum(n)::bigint as n, sum(score)::bigint as explained from b group by all""")
def best_path_parse(spark, sf_dir):
    """Every cut of a type into a listed beginning, a root and a listed ending; the one that explains most counts.

    Affixes explain their letters, and a root that is a word of the corpus itself (seen three times) explains its own twice.
    """
    w = word_counts(spark, sf_dir)
    cuts = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p in ("", *T.PREFIXES) for s in ("", *T.SUFFIXES)))
    fits = F.filter(cuts, lambda x: F.startswith("word", x["p"]) & F.endswith("word", x["s"]) & (F.length(x["p"]) + F.length(x["s"]) < F.length("word")))
    x = w.select("corpus", "word", "n", F.explode(fits).alias("x")).select("corpus", "word", "n", "x.p", "x.s", F.expr("substring(word, length(x.p) + 1, length(word) - length(x.p) - length(x.s))").alias("root"))
    roots = w.where("n >= 3").select("corpus", F.col("word").alias("root"), F.lit(2).alias("known"))
    y = x.join(roots, ["corpus", "root"], "left")
    score = F.length("p") + F.length("s") + F.coalesce("known", F.lit(0)) * F.length("root")
    b = y.groupBy("corpus", "word", "n").agg(F.min(F.struct((-score).alias("k"), (-F.length("p")).alias("l"), "s", "p")).alias("b"))
    return b.groupBy("corpus", F.col("b.p").alias("prefix"), F.col("b.s").alias("suffix")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum(-F.col("b.k")).cast("long").alias("explained"))


# The folios of the second hand in the older list.
SECOND_HAND = (26, 27, 28, 29, 31, 34, 35, 38, 39, 42, 43, 46, 47, 49, 50, 53, 54)


@analysis(oracle=f"""with s as (select p_size * 2 as f from part)
    select case when f in {SECOND_HAND} or f between 75 and 84 or f between 87 and 102 then 'B' else 'A' end as hand, count(*) as n, min(f) as low, max(f) as high from s group by 1""")
def currier_by_number(spark, sf_dir):
    """Hands by folio number, from the older list."""
    p = C.table(spark, sf_dir, "part").select((F.col("p_size") * 2).alias("f"))
    hand = F.when(F.col("f").isin(*SECOND_HAND) | F.col("f").between(75, 84) | F.col("f").between(87, 102), "B").otherwise("A")
    return p.groupBy(hand.alias("hand")).agg(F.count("*").alias("n"), F.min("f").alias("low"), F.max("f").alias("high"))


# The signs that each hold three decans of ten degrees.
SIGNS = ("aries", "taurus", "gemini", "cancer", "leo", "virgo", "libra", "scorpio", "sagittarius", "capricorn", "aquarius", "pisces")


def decans(spark) -> DataFrame:
    """The table of decans, by rule from the signs: (decan, sign, third, low), low in degrees."""
    return spark.createDataFrame([(3 * i + k, s, k + 1, 30 * i + 10 * k) for i, s in enumerate(SIGNS) for k in range(3)], "decan int, sign string, third int, low int")


@analysis(oracle="""with d as (select 3 * (i - 1) + k as decan, s as sign, k + 1 as third, 30 * (i - 1) + 10 * k as low from (select unnest(s) as s, generate_subscripts(s, 1) as i from (select ['aries', 'taurus', 'gemini', 'cancer', 'leo', 'virgo', 'libra', 'scorpio', 'sagittarius', 'capricorn', 'aquarius', 'pisces'] as s)), (select unnest([0, 1, 2]) as k)),
    e as (select event_type, (extract(hour from ts) * 30.0 + extract(minute from ts) * 0.5) % 360 as a from events)
    select sign, third::int as third, event_type, count(*) as n from e join d on a >= low and a < low + 10 group by all""")
def events_by_decan(spark, sf_dir):
    """Events by the decan of the clock's angle: a literal table joined by range, thirty-six rows."""
    e = C.table(spark, sf_dir, "events").select("event_type", ((F.hour("ts") * 30.0 + F.minute("ts") * 0.5) % 360).alias("a"))
    j = e.join(F.broadcast(decans(spark)), (F.col("a") >= F.col("low")) & (F.col("a") < F.col("low") + 10))
    return j.groupBy("sign", "third", "event_type").agg(F.count("*").alias("n"))


@analysis(depends=("bootstrap_ci",), reps=50, oracle=f"""with u as (select lang, doc_id, n_chars, rep, {UNIT.format(parts="'boot|' || rep || '|' || doc_id")} as u from documents, (select unnest(range(0, 50)) as rep)),
    w as (select *, {WEIGHT} as w from u), m as (select lang, rep, sum(w * n_chars) / sum(w) as m from w group by all),
    c as (select lang, round(quantile_cont(m, 0.025), 3) as low, round(quantile_cont(m, 0.975), 3) as high from m group by lang)
    select a.lang as first, b.lang as second, a.low <= b.high and b.low <= a.high as overlap from c a join c b on a.lang < b.lang""")
def bootstrap_overlap(spark, sf_dir, reps=50):
    """Whether the intervals of two languages' mean lengths overlap."""
    c = bootstrap_ci(spark, sf_dir, reps)
    a, b = (c.select(F.col("lang").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")) for x in ("first", "second"))
    p = a.crossJoin(F.broadcast(b)).where("first < second")  # corpora squared
    return p.select("first", "second", ((F.col("first_low") <= F.col("second_high")) & (F.col("second_low") <= F.col("first_high"))).alias("overlap"))
