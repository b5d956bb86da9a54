"""Cleaning and parsing of words: markup, glyphs, morphology, frames, skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import stats
from quillon.plans import sql
from quillon.plans.information import r6
from quillon.plans.vocabulary import word_counts
from quillon.registry import analysis
from quillon.sources import corpus as C


@analysis(oracle="""with t as (select page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') as h from pages),
    u as (select page_id, regexp_replace(h, '<[^>]*>', ' ', 'g') as h from t),
    v as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as h from u),
    w as (select page_id, regexp_extract_all(lower(h), '([\\p{L}]+)', 1) as ws from v)
    select page_id, len(ws) as n_words, md5(array_to_string(ws, ' ')) as digest from w""")
def clean_html_words(spark, sf_dir):
    w = C.table(spark, sf_dir, "pages").select("page_id", T.html_words(F.col("html")).alias("ws"))
    return w.select("page_id", F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ")).alias("digest"))


IVTFF = """with l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as t from (select doc_id, string_split(text, chr(10)) as ls from documents)),
    c as (select doc_id, line_no, replace(regexp_replace(regexp_replace(t, '<[^>]*>', '.', 'g'), '\\[([^:\\[\\]]*)(?::[^\\[\\]]*)+\\]', '\\1', 'g'), '!', '') as t from l),
    w as (select doc_id, line_no, list_filter(regexp_split_to_array(lower({t}), '[.\\s,;]+'), lambda x: regexp_full_match(x, '[a-z]+') and length(x) >= {least}) as ws from c)
    select doc_id, sum(len(ws))::bigint as n_words, md5(string_agg(array_to_string(ws, ' '), '/' order by line_no)) as digest from w group by doc_id"""


def cleaned(spark, sf_dir, comma_break: bool, least: int):
    """Texts read as transliterated lines: words with other letters than a to z are dropped whole."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    per = docs.select("doc_id", F.transform("ls", lambda t: T.clean_ivtff(t, comma_break, least)).alias("ws"))
    told = F.array_join(F.transform("ws", lambda w: F.array_join(w, " ")), "/")
    return per.select("doc_id", F.size(F.flatten("ws")).cast("long").alias("n_words"), F.md5(told).alias("digest"))


@analysis(oracle=IVTFF.replace("{t}", "t").replace("{least}", "1"))
def illegible_drop(spark, sf_dir):
    return cleaned(spark, sf_dir, True, 1)


@analysis(least=3, oracle=IVTFF.replace("{t}", "t").replace("{least}", "3"))
def min_word_len_filter(spark, sf_dir, least=3):
    return cleaned(spark, sf_dir, True, least)


@analysis(oracle=IVTFF.replace("{t}", "replace(t, ',', '')").replace("{least}", "1"))
def comma_break_join(spark, sf_dir):
    return cleaned(spark, sf_dir, False, 1)


@analysis(oracle=f"""with {sql.COUNTS}, g as (select corpus, n, unnest(regexp_extract_all(word, '(c[tkpf]h|[cstkpf]h|.)', 1)) as glyph from counts)
    select corpus, glyph, sum(n)::bigint as n from g group by all""")
def glyph_tokenize(spark, sf_dir):
    """Glyphs by corpus; words are cut once per type."""
    g = word_counts(spark, sf_dir).select("corpus", "n", F.explode(T.glyphs(F.col("word"))).alias("glyph"))
    return g.groupBy("corpus", "glyph").agg(F.sum("n").alias("n"))


@analysis(oracle=f"""with {sql.COUNTS} select corpus, regexp_replace(word, 'e+', 'e', 'g') as collapsed, sum(n)::bigint as n from counts group by 1, 2""")
def collapse_runs(spark, sf_dir):
    c = word_counts(spark, sf_dir).groupBy("corpus", T.collapse_e(F.col("word")).alias("collapsed"))
    return c.agg(F.sum("n").alias("n"))


@analysis(oracle=f"""with recursive {sql.COUNTS}, g as (select [{", ".join(f"'{x}'" for x in T.GALLOWS)}] as g),
    strip as (select corpus, word, n, word as s, '' as taken, 1 as k from counts
      union all select corpus, word, n, replace(s, g[k], ''), taken || repeat(g[k], ((length(s) - length(replace(s, g[k], ''))) // length(g[k]))::int), case when contains(replace(s, g[k], ''), g[k]) then k else k + 1 end from strip, g where k <= {len(T.GALLOWS)})
    select corpus, s as stripped, taken, sum(n)::bigint as n from strip where k > {len(T.GALLOWS)} group by all""")
def strip_markers(spark, sf_dir):
    """Words without their gallows, and which ones went, nested ones until none is left."""
    w = word_counts(spark, sf_dir).withColumn("x", T.stripped(F.col("word")))
    return w.groupBy("corpus", F.col("x.rest").alias("stripped"), F.array_join("x.taken", "").alias("taken")).agg(F.sum("n").alias("n"))


# Pieces of words with marks inside marks, for a test corpus of the same operators.
NESTED = ("cth", "ct", "ckh", "kch", "h", "c", "t", "s", "tsh", "o", "e")


@analysis(oracle=f"""with recursive w as (select i, string_agg(([{", ".join(f"'{x}'" for x in NESTED)}])[('0x' || substring(md5('nested|' || i || '|' || k), 1, 6))::bigint % {len(NESTED)} + 1], '' order by k) as word from range(2000) t(i), (select unnest(range(0, 12)) as k) group by i),
    g as (select [{", ".join(f"'{x}'" for x in T.GALLOWS)}] as g),
    strip as (select i, word, word as s, '' as taken, 1 as k from w
      union all select i, word, replace(s, g[k], ''), taken || repeat(g[k], ((length(s) - length(replace(s, g[k], ''))) // length(g[k]))::int), case when contains(replace(s, g[k], ''), g[k]) then k else k + 1 end from strip, g where k <= {len(T.GALLOWS)})
    select word, s as stripped, regexp_replace(s, 'e+', 'e', 'g') as collapsed, taken from strip where k > {len(T.GALLOWS)}""")
def nested_markers(spark, sf_dir):
    """Made words in which taking a mark out makes another: stripped, collapsed, and the marks that went."""
    pick = lambda k: F.get(F.array(*map(F.lit, NESTED)), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("nested"), F.col("id").cast("string"), k.cast("string"))), 1, 6), 16, 10).cast("long") % len(NESTED)).cast("int"))
    w = spark.range(2000).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), pick), "").alias("word"))
    x = w.withColumn("x", T.stripped(F.col("word")))
    return x.select("word", F.col("x.rest").alias("stripped"), T.collapse_e(F.col("x.rest")).alias("collapsed"), F.array_join("x.taken", "").alias("taken"))


PFX = "case " + " ".join(f"when starts_with(word, '{p}') and length(word) > {len(p) + 1} then '{p}'" for p in T.PREFIXES) + " else '' end"
SFX = "case " + " ".join(f"when ends_with(rest, '{s}') and length(rest) > {len(s)} then '{s}'" for s in T.SUFFIXES) + " else '' end"


@analysis(oracle=f"""with {sql.COUNTS}, p as (select corpus, n, word, {PFX} as prefix from counts), r as (select *, substring(word, length(prefix) + 1) as rest from p),
    s as (select *, {SFX} as suffix from r)
    select corpus, prefix, suffix, count(distinct substring(rest, 1, length(rest) - length(suffix))) as roots, sum(n)::bigint as n from s group by all""")
def morph_split(spark, sf_dir):
    m = word_counts(spark, sf_dir).select("corpus", "n", T.morphology(F.col("word")).alias("m"))
    return m.groupBy("corpus", "m.prefix", "m.suffix").agg(F.count_distinct("m.root").alias("roots"), F.sum("n").alias("n"))


EDGE = "case " + " ".join(f"when starts_with(word, '{p}') then '{p}'" for p in T.EDGE_PREFIXES) + " else 'X' end"
ENDS = "case " + " ".join(f"when ends_with(word, '{s}') then '{s}'" for s in T.EDGE_SUFFIXES) + " else 'X' end"


@analysis(oracle=f"with {sql.COUNTS} select corpus, {EDGE} as prefix, {ENDS} as suffix, sum(n)::bigint as n from counts group by all")
def edge_affix_profile(spark, sf_dir):
    e = word_counts(spark, sf_dir).groupBy("corpus", T.prefix(F.col("word")).alias("prefix"), T.suffix(F.col("word")).alias("suffix"))
    return e.agg(F.sum("n").alias("n"))


@analysis(oracle=f"""with {sql.COUNTS}, o as (select corpus, word, n, regexp_extract_all({sql.replaced("word", T.ONE.items())}, '({T.CHUNK}|.)', 1) as p from counts),
    u as (select corpus, word, n, unnest(p) as p, generate_subscripts(p, 1) as i from o), f as (select *, regexp_matches(p, '^{T.STARTS}') as fits, {sql.replaced("p", [(b, a) for a, b in T.ONE.items()])} as told from u),
    r as (select *, fits and sum(fits::int) over (partition by corpus, word order by i) <= {T.MOST_CHUNKS} as chunk from f),
    w as (select corpus, word, n, coalesce(string_agg(told, '|' order by i) filter (chunk), '') as chunks, coalesce(string_agg(told, '' order by i) filter (not chunk), '') as unparsed from r group by corpus, word, n)
    select corpus, chunks, unparsed, sum(n)::bigint as n from w group by all""")
def chunk_parse(spark, sf_dir):
    """Words by their chunks and what no chunk takes."""
    c = word_counts(spark, sf_dir).select("corpus", "n", T.chunks(F.col("word")).alias("c"))
    shape = F.array_join(F.transform("c.chunks", lambda x: F.array_join(x, "")), "|")
    return c.groupBy("corpus", shape.alias("chunks"), F.array_join("c.unparsed", "").alias("unparsed")).agg(F.sum("n").alias("n"))


_NAMED = "[" + ", ".join(f"'g{i}'" for i in range(13)) + "]"
_TWELVE = "^" + "".join(f"({'|'.join(s)})?" for s in T.TWELVE_SLOTS) + "(.*)$"


@analysis(oracle=f"""with {sql.COUNTS}, x as (select corpus, n, regexp_extract(word, '{_TWELVE}', {_NAMED}) as x from counts),
    s as (select corpus, n, unnest([{", ".join(f"x.g{i}" for i in range(12))}]) as token, unnest(range(0, 12)) as slot from x)
    select corpus, slot::int as slot, token, sum(n)::bigint as n from s where token <> '' group by all""")
def slot_decompose(spark, sf_dir):
    """How often each of twelve ordered slots is filled with what."""
    w = word_counts(spark, sf_dir).select("corpus", "n", T.twelve_slots(F.col("word")).alias("s"))
    e = w.select("corpus", "n", F.posexplode("s.slots").alias("slot", "token")).where("token <> ''")
    return e.groupBy("corpus", "slot", "token").agg(F.sum("n").alias("n"))


@analysis(oracle=f"""with {sql.COUNTS}, d as (select corpus, n, word, regexp_extract(word, '{_TWELVE}', {_NAMED}).g12 as rest from counts)
    select corpus, rest = '' as whole, count(*) as types, sum(n)::bigint as n, count(distinct rest) as rests from d group by all""")
def slot_coverage(spark, sf_dir):
    """Types and tokens that the twelve slots take whole, and what they leave of others."""
    w = word_counts(spark, sf_dir).select("corpus", "n", T.twelve_slots(F.col("word"))["rest"].alias("rest"))
    return w.groupBy("corpus", (F.col("rest") == "").alias("whole")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.count_distinct("rest").alias("rests"))


@analysis(oracle=f"with {sql.COUNTS} select corpus, regexp_replace(word, '[aeiou]', '', 'g') as skeleton, count(*) as types, sum(n)::bigint as n from counts group by 1, 2 having count(*) > 1")
def consonant_skeleton(spark, sf_dir):
    s = word_counts(spark, sf_dir).groupBy("corpus", T.skeleton(F.col("word")).alias("skeleton"))
    return s.agg(F.count("*").alias("types"), F.sum("n").alias("n")).where("types > 1")


@analysis(oracle=f"with {sql.COUNTS}, r as (select corpus, reverse(word) as word, n from counts) select r.corpus, count(*) as types, count(c.word) as also_words, sum(case when c.word is not null then r.n else 0 end)::bigint as tokens from r left join counts c on c.corpus = r.corpus and c.word = r.word group by r.corpus")
def reverse_words(spark, sf_dir):
    """Words that are words backwards."""
    c = word_counts(spark, sf_dir)
    r = c.select("corpus", F.reverse("word").alias("word"), F.col("n").alias("rn")).join(c, ["corpus", "word"], "left")
    return r.groupBy("corpus").agg(F.count("*").alias("types"), F.count("n").alias("also_words"), F.sum(F.when(F.col("n").isNotNull(), F.col("rn")).otherwise(0)).alias("tokens"))


@analysis(oracle=f"with {sql.COUNTS} select corpus, regexp_replace(regexp_replace(word, '[^aeiou]', 'C', 'g'), '[aeiou]', 'V', 'g') as pattern, count(*) as types, sum(n)::bigint as n from counts group by 1, 2")
def cv_pattern(spark, sf_dir):
    p = word_counts(spark, sf_dir).groupBy("corpus", T.cv_pattern(F.col("word")).alias("pattern"))
    return p.agg(F.count("*").alias("types"), F.sum("n").alias("n"))


FRAMES = f"""with {sql.COUNTS}, f as (select corpus, word, n, i as pos, substring(word, 1, i - 1) || '_' || substring(word, i + 1) as frame, word[i] as c from (select *, unnest(range(1, length(word) + 1)) as i from counts where n >= 3))"""


@analysis(oracle=FRAMES + " select corpus, pos::int as pos, frame, count(*) as words, string_agg(c, '' order by c) as fillers from f group by all having count(*) > 1")
def masked_frames(spark, sf_dir):
    """Words seen three times or more with one letter masked: frames that more than one letter fills."""
    f = frames(word_counts(spark, sf_dir).where("n >= 3"))
    return f.groupBy("corpus", "pos", "frame").agg(F.count("*").alias("words"), F.array_join(F.array_sort(F.collect_list("char")), "").alias("fillers")).where("words > 1")


def frames(counts):
    return counts.select("corpus", "word", "n", F.explode(T.masked(F.col("word"))).alias("m")).select("corpus", "word", "n", "m.pos", "m.frame", "m.char")


@analysis(oracle=FRAMES + " select a.corpus, least(a.c, b.c) as x, greatest(a.c, b.c) as y, count(*) as pairs from f a join f b on a.corpus = b.corpus and a.pos = b.pos and a.frame = b.frame and a.c < b.c group by all having count(*) >= 5")
def minimal_pairs(spark, sf_dir):
    """Letters that tell words apart: pairs of letters within equal frames, an equi-join on the frame."""
    f = frames(word_counts(spark, sf_dir).where("n >= 3"))
    a = f.select("corpus", "pos", "frame", F.col("char").alias("x"))
    b = f.select("corpus", "pos", "frame", F.col("char").alias("y"))
    p = a.join(b, ["corpus", "pos", "frame"]).where("x < y")
    return p.groupBy("corpus", "x", "y").agg(F.count("*").alias("pairs")).where("pairs >= 5")


@analysis(oracle=f"""with {sql.COUNTS}, cut as (select corpus, word, i, word[:i - 1] || word[i + 1:] as rest from (select corpus, word, unnest(range(1, length(word) + 1)) as i from counts)),
    p as (select a.corpus, a.word as x, b.word as y from cut a join cut b on a.corpus = b.corpus and a.i = b.i and a.rest = b.rest and a.word < b.word
      union select c.corpus, least(c.word, w.word), greatest(c.word, w.word) from cut c join counts w on w.corpus = c.corpus and w.word = c.rest)
    select corpus, x as first, y as second from p""")
def near_dup_edit1(spark, sf_dir):
    """Types one edit apart, in every corpus: equal frames are substitutions, a word that is another less a letter an insertion."""
    w = word_counts(spark, sf_dir).select("corpus", "word")
    cut = w.select("corpus", "word", F.explode(T.masked(F.col("word"))).alias("m")).select("corpus", "word", "m.frame")
    swaps = cut.withColumnRenamed("word", "a").join(cut.withColumnRenamed("word", "b"), ["corpus", "frame"]).where("a < b").select("corpus", "a", "b")
    shorter = cut.select("corpus", F.col("word").alias("long"), F.replace("frame", F.lit("_"), F.lit("")).alias("word")).join(w, ["corpus", "word"])
    drops = shorter.select("corpus", F.least("long", "word").alias("a"), F.greatest("long", "word").alias("b"))
    return swaps.unionByName(drops).distinct().select("corpus", F.col("a").alias("first"), F.col("b").alias("second"))


def deletions(word, most: int = 2):
    """The word less up to `most` letters, in all ways: two words within `most` edits have one of these in common."""

    def less(w):
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda w: w != ""), less)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def dictionary(spark, sf_dir) -> DataFrame:
    """(entry): the benchmark's words."""
    return C.table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("entry")).distinct()


ENTRIES = "d as (select distinct unnest(regexp_extract_all(lower(text), '([\\p{L}]+)', 1)) as entry from benchmark)"
LEAST_FUZZY = 4


@analysis(oracle=f"""with {sql.COUNTS}, {sql.ALPHABET}, {ENTRIES}, one as (select x, unnest(list_distinct(list_concat([x], list_transform(range(1, length(x) + 1), lambda i: x[:i - 1] || x[i + 1:])))) as v from (select distinct word as x from counts where length(word) >= {LEAST_FUZZY} union select entry from d where length(entry) >= {LEAST_FUZZY})),
    del as materialized (select distinct x, unnest(list_distinct(list_concat([v], list_transform(range(1, length(v) + 1), lambda i: v[:i - 1] || v[i + 1:])))) as v from one),
    p as (select distinct a.x as word, b.x as entry from del a join del b using (v) where b.x in (select entry from d) and a.x in (select word from counts) and a.x <> b.x and abs(length(a.x) - length(b.x)) <= 2),
    r as (select word, entry, {sql.distance("word", "entry")} as d from p, alphabet)
    select corpus, word, min(r.d)::bigint as distance, min_by(entry, (r.d, entry)) as entry from counts join r using (word) where r.d <= 2 group by corpus, word""")
def fuzzy_dictionary_match(spark, sf_dir):
    """The nearest other dictionary entry within two edits of each type of four letters or more (two edits are most of a shorter one).

    Words meet by what is left of them after up to two deletions, so no word is compared with a whole block.
    """
    w = word_counts(spark, sf_dir).where(F.length("word") >= LEAST_FUZZY).select("corpus", "word")
    a = w.select("word").distinct().select("word", F.explode(deletions(F.col("word"))).alias("v"))
    b = dictionary(spark, sf_dir).where(F.length("entry") >= LEAST_FUZZY).select("entry", F.explode(deletions(F.col("entry"))).alias("v"))
    p = a.join(b, "v").where("word <> entry").where(F.abs(F.length("word") - F.length("entry")) <= 2).select("word", "entry").distinct()
    p = p.withColumn("d", F.levenshtein("word", "entry")).where("d <= 2")
    best = p.groupBy("word").agg(F.min(F.struct("d", "entry")).alias("m"))
    return w.join(best, "word").select("corpus", "word", F.col("m.d").cast("long").alias("distance"), "m.entry")


@analysis(oracle=f"""with {sql.COUNTS}, {ENTRIES}, a as (select corpus, word, s, unnest(list_distinct(list_transform(range(1, length(s) + 1), lambda i: s[:i - 1] || s[i + 1:]))) as v from (select corpus, word, translate(word, 'aeiou', '') as s from counts) where length(s) >= 3),
    b as (select entry, s as t, unnest(list_distinct(list_transform(range(1, length(s) + 1), lambda i: s[:i - 1] || s[i + 1:]))) as v from (select entry, translate(entry, 'aeiou', '') as s from d) where length(s) >= 3),
    p as (select distinct corpus, word, entry, length(s) - (s <> t)::int as lcs from a join b using (v) where length(s) = length(t))
    select corpus, word, max(lcs)::int as lcs, max_by(entry, (lcs, entry)) as entry from p group by corpus, word""")
def lcs_match(spark, sf_dir):
    """Each type's best dictionary entry by the longest common subsequence of their skeletons, of as many consonants.

    Skeletons of k consonants that share a subsequence of k - 1 are the same less one consonant each, so they meet by
    an equi-join; words without such an entry have none.
    """
    less = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c)))))
    w = word_counts(spark, sf_dir).select("corpus", "word", T.skeleton(F.col("word")).alias("s")).where(F.length("s") >= 3)
    b = dictionary(spark, sf_dir).select("entry", T.skeleton(F.col("entry")).alias("t")).where(F.length("t") >= 3)
    p = w.withColumn("v", F.explode(less("s"))).join(b.withColumn("v", F.explode(less("t"))), "v").where(F.length("s") == F.length("t"))
    p = p.select("corpus", "word", "entry", (F.length("s") - (F.col("s") != F.col("t")).cast("int")).alias("lcs"))
    best = p.groupBy("corpus", "word").agg(F.max(F.struct("lcs", "entry")).alias("m"))
    return best.select("corpus", "word", "m.lcs", "m.entry")


@analysis(oracle=f"""with {sql.COUNTS}, t as (select corpus, n, length(word) as k, word[:length(word) // 3] as head, word[length(word) - length(word) // 3 + 1:] as tail from counts)
    select corpus, count(distinct head) as heads, count(distinct tail) as tails, sum(n)::bigint as n from t where k >= 3 group by corpus""")
def word_thirds(spark, sf_dir):
    t = word_counts(spark, sf_dir).where(F.length("word") >= 3).select("corpus", "n", T.thirds(F.col("word")).alias("t"))
    return t.groupBy("corpus").agg(F.count_distinct("t.head").alias("heads"), F.count_distinct("t.tail").alias("tails"), F.sum("n").alias("n"))


@analysis(oracle=f"""with {sql.COUNTS}, s as (select corpus, n, unnest(regexp_extract_all(word, '([^aeiouyàâäáåæéèêëíìîïóòôöøœúùûü]*[aeiouyàâäáåæéèêëíìîïóòôöøœúùûü]+(?:[^aeiouyàâäáåæéèêëíìîïóòôöøœúùûü]+$)?|^[^aeiouyàâäáåæéèêëíìîïóòôöøœúùûü]+$)', 1)) as syllable from counts)
    select corpus, syllable, sum(n)::bigint as n from s group by corpus, syllable qualify row_number() over (partition by corpus order by sum(n) desc, syllable) <= 30""")
def syllables(spark, sf_dir):
    s = word_counts(spark, sf_dir).select("corpus", "n", F.explode(T.syllables(F.col("word"))).alias("syllable"))
    s = s.groupBy("corpus", "syllable").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "syllable")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 30").drop("r")


@analysis(oracle=f"""with {sql.COUNTS} select corpus, count(*) as types, count(distinct translate(word, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) as plain_types from counts group by corpus""")
def diacritic_strip(spark, sf_dir):
    return word_counts(spark, sf_dir).groupBy("corpus").agg(F.count("*").alias("types"), F.count_distinct(T.plain_letters(F.col("word"))).alias("plain_types"))


@analysis(oracle=f"""with {sql.COUNTS}, g as (select corpus, n, regexp_extract_all(word, '(c[tkpf]h|[cstkpf]h|.)', 1) as g from counts),
    t as (select corpus, n, unnest(list_transform(range(1, len(g) - 1), lambda i: g[i] || g[i + 1] || g[i + 2])) as trigram from g where len(g) >= 3)
    select corpus, trigram, sum(n)::bigint as n from t group by corpus, trigram qualify row_number() over (partition by corpus order by sum(n) desc, trigram) <= 20""")
def glyph_trigrams(spark, sf_dir):
    g = word_counts(spark, sf_dir).select("corpus", "n", F.explode(T.ngrams(T.glyphs(F.col("word")), 3)).alias("g"))
    t = g.groupBy("corpus", F.array_join("g", "").alias("trigram")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "trigram")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 20").drop("r")


@analysis(oracle="""with s as (select p_partkey, p_size, case when p_size <= 58 or p_size between 65 and 66 then 'herbal-A' when p_size between 67 and 73 then 'zodiac' when p_size between 75 and 84 then 'bio'
      when p_size between 85 and 86 then 'cosmo' when p_size in (88, 89) or p_size between 99 and 102 then 'pharma' when p_size between 87 and 102 then 'herbal-B' when p_size between 103 and 116 then 'text' else 'unknown' end as section,
      case when p_size between 103 and 116 then 'recipe' when p_size between 75 and 84 then 'balneo' when p_size between 67 and 73 then 'astro' when p_size between 85 and 86 then 'cosmo' else 'herbal' end as section_2
      from (select p_partkey, p_size * 3 as p_size from part))
    select section, section_2, count(*) as n, min(p_size) as low, max(p_size) as high from s group by all""")
def section_case_number(spark, sf_dir):
    p = C.table(spark, sf_dir, "part").select((F.col("p_size") * 3).alias("p"))
    s = p.groupBy(T.section_by_number(F.col("p")).alias("section"), T.section_by_number_2(F.col("p")).alias("section_2"))
    return s.agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


@analysis(oracle=f"""with {sql.COUNTS}, g as (select corpus, n, regexp_extract_all(word, '(c[tkpf]h|[cstkpf]h|.)', 1) as g from counts),
    e as (select corpus, n, unnest(g[:-2]) as a, unnest(g[2:]) as b from g where len(g) >= 2),
    j as (select corpus, a, b, sum(n)::double as n from e group by all),
    m as (select corpus, sum(n) as t, log2(sum(n)) - sum(n * log2(n)) / sum(n) as hj from j group by corpus),
    x as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as hx from (select corpus, a, sum(n) as n from j group by all) group by corpus),
    y as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as hy from (select corpus, b, sum(n) as n from j group by all) group by corpus)
    select corpus, round(hx + hy - hj, 6) as mi, round(hj - hx, 6) as h_next from m join x using (corpus) join y using (corpus)""")
def glyph_pair_information(spark, sf_dir):
    """Mutual information and conditional entropy of neighbouring glyphs."""
    g = word_counts(spark, sf_dir).select("corpus", "n", F.explode(T.ngrams(T.glyphs(F.col("word")), 2)).alias("g"))
    j = g.groupBy("corpus", F.col("g")[0].alias("a"), F.col("g")[1].alias("b")).agg(F.sum("n").alias("n"))
    m = stats.mutual_information(j, ["corpus"], "a", "b").select("corpus", "mi")
    return m.join(stats.conditional_entropy(j, ["corpus"], "a", "h_next"), "corpus").select("corpus", r6("mi"), r6("h_next"))
