"""Control corpora: encodings of every corpus's words, and generated texts, each with what the fingerprint sees of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import encodings as E
from quillon.functions import text as T
from quillon.operators import nulls, sequential, stats
from quillon.plans import sql
from quillon.plans.information import r6
from quillon.plans.vocabulary import word_counts
from quillon.registry import analysis
from quillon.sources import corpus as C

SUB = E.substitution("sub")
VERBOSE = E.codes(E.ALPHABET, "verbose", (2,))
POOL = E.codes(E.ALPHABET, "words", (3,))
PAIRS = E.codes([a + b for a in E.ALPHABET for b in E.ALPHABET], "pairs", (4,))
FIRST, INNER, LAST = (E.codes(E.ALPHABET, f"place{k}", (2,)) for k in range(3))
VOWEL_CODES = E.codes(E.VOWELS, "vowels", (2,))


def types(spark, sf_dir) -> DataFrame:
    """(corpus, word, n): encodings work on types, not on tokens. Letters that a scheme doesn't know stay as they are."""
    return word_counts(spark, sf_dir).select("corpus", "word", "n")


def counted(words: DataFrame) -> DataFrame:
    return words.groupBy("corpus", "word").agg(F.count("*").alias("types"), F.sum("n").alias("n"))


def encoded(spark, sf_dir, f) -> DataFrame:
    return counted(types(spark, sf_dir).select("corpus", f(F.col("word")).alias("word"), "n"))


WORDS = f"with {sql.COUNTS}, w as (select corpus, word, n from counts)"
LETTERS = WORDS + ", l as (select corpus, word, n, length(word) as k, generate_subscripts(cs, 1) - 1 as i, unnest(cs) as c from (select *, string_split(word, '') as cs from w))"
COUNTED = " select corpus, word, count(*) as types, sum(n)::bigint as n from e group by corpus, word"


def by_letter(expr: str) -> str:
    return LETTERS + f", e as (select corpus, word as old, n, string_agg({expr}, '' order by i) as word from l group by corpus, word, n)" + COUNTED


def by_word(expr: str) -> str:
    return WORDS + f", e as (select corpus, {expr} as word, n from w)" + COUNTED


def sql_map(table: dict[str, str], key: str = "c") -> str:
    return "coalesce(map {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}[" + key + "], " + key + ")"


def sql_pick(n: int, seed: str) -> str:
    return f"('0x' || substring(md5('{seed}|' || word || '|' || i), 1, 8))::bigint % {n}"


@analysis(oracle=by_word(f"translate(word, '{''.join(SUB)}', '{''.join(SUB.values())}')"))
def substitution_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.translate(w, SUB))


@analysis(oracle=by_letter(sql_map(VERBOSE)))
def verbose_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.verbose(w, VERBOSE))


@analysis(oracle=by_word("case when translate(word, 'aeiou', '') <> '' then translate(word, 'aeiou', '') else word[1] end"))
def abjad_drop(spark, sf_dir):
    return encoded(spark, sf_dir, E.abjad)


@analysis(oracle=by_letter(f"c || {sql_pick(3, 'homophonic')}"))
def homophonic_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, E.homophonic)


@analysis(oracle=WORDS + ", e as (select corpus, unnest(string_split(regexp_replace(word, '([aeiou])([^aeiou])', '\\1 \\2', 'g'), ' ')) as word, n from w)" + COUNTED)
def syllabic_split(spark, sf_dir):
    return counted(types(spark, sf_dir).select("corpus", F.explode(E.syllabic_split(F.col("word"))).alias("word"), "n"))


@analysis(oracle=LETTERS + f", e as (select corpus, {sql_map(POOL)} as word, n from l)" + COUNTED)
def word_per_letter(spark, sf_dir):
    return counted(types(spark, sf_dir).select("corpus", F.explode(E.word_per_letter(F.col("word"), POOL)).alias("word"), "n"))


@analysis(oracle=LETTERS + ", e as (select corpus, word as old, n, string_agg(c, '' order by md5('anagram|' || word || '|' || i)) as word from l group by corpus, word, n)" + COUNTED)
def anagram_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, E.anagram)


def sql_units(units: str, table: dict[str, str]) -> str:
    m = sql_map(table, "u")
    cut = f", u as (select corpus, word as old, n, unnest({units}) as u, generate_subscripts({units}, 1) as i from w)"
    return WORDS + cut + f", e as (select corpus, old, n, string_agg({m}, '' order by i) as word from u group by corpus, old, n)" + COUNTED


@analysis(oracle=sql_units("regexp_extract_all(word, '(..|.)', 1)", PAIRS))
def bigram_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.pairs_to_symbols(w, PAIRS))


@analysis(oracle=sql_units("case when length(word) > 1 then list_transform(range(1, length(word)), lambda i: word[i:i + 1]) else [word] end", PAIRS))
def overlap_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.pairs_to_symbols(w, PAIRS, overlap=True))


@analysis(oracle=by_letter(f"case when i = 0 then {sql_map(FIRST)} when i = k - 1 then {sql_map(LAST)} else {sql_map(INNER)} end"))
def positional_verbose(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.positional(w, FIRST, INNER, LAST))


@analysis(oracle=by_letter(f"case when c in ('a', 'e', 'i', 'o', 'u') then case when i = 0 then {sql_map(FIRST)} when i = k - 1 then {sql_map(LAST)} else {sql_map(INNER)} end else {sql_map(INNER)} end"))
def vowel_variants(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.positional(w, FIRST, INNER, LAST, only=E.VOWELS))


@analysis(oracle=by_letter(f"case floor(i * 3 / k)::int when 0 then {sql_map(FIRST)} when 1 then {sql_map(INNER)} else {sql_map(LAST)} end"))
def zone_cipher(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.zones(w, (FIRST, INNER, LAST)))


@analysis(oracle=by_letter(f"case when i = 0 then 'q' else '' end || {sql_map(VERBOSE)} || case when i = k - 1 then 'y' else '' end"))
def graduated_verbose(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.graduated(w, VERBOSE))


@analysis(oracle=by_letter(f"case when c in ('a', 'e', 'i', 'o', 'u') then (['o', 'ai', 'e'])[({sql_pick(3, 'pool')}) + 1] else {sql_map(VERBOSE)} end"))
def pooled_verbose(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.pooled(w, ("o", "ai", "e"), VERBOSE))


@analysis(share=0.5, oracle=by_letter(f"case when c in ('a', 'e', 'i', 'o', 'u') and ({sql_pick(1_000_000, 'expand')}) / 1000000.0 < 0.5 then {sql_map(VOWEL_CODES)} else c end"))
def vowel_expansion(spark, sf_dir, share=0.5):
    return encoded(spark, sf_dir, lambda w: E.vowel_expansion(w, share, VOWEL_CODES))


@analysis(most=4, oracle=by_word("substring(word, 1, 4)"))
def truncated_words(spark, sf_dir, most=4):
    return encoded(spark, sf_dir, lambda w: E.truncate(w, most))


@analysis(oracle=by_word(f"translate(word, '{E.ALPHABET}', '{''.join('odaykelchr'[i % 10] for i in range(26))}')"))
def restricted_alphabet(spark, sf_dir):
    return encoded(spark, sf_dir, lambda w: E.to_alphabet(w, "odaykelchr"))


def _sql_abbreviation(density: float) -> str:
    """The first ending, then the first beginning, as E.abbreviate() has them."""
    ends = "case " + " ".join(f"when ends_with(word, '{a}') and length(word) > {len(a) + 1} then ['{b}', word[:length(word) - {len(a)}]]" for a, b in E.ENDINGS) + " else ['', word] end"
    starts = "case " + " ".join(f"when starts_with(x[2], '{a}') and length(x[2]) > {len(a)} then '{b}' || substring(x[2], {len(a) + 1}) || x[1]" for a, b in E.BEGINNINGS) + " else x[2] || x[1] end"
    drawn = "('0x' || substring(md5('abbreviate|' || word || '|0'), 1, 8))::bigint % 1000000 / 1000000.0"
    return f"x as (select *, {ends} as x from w), ab as (select corpus, word as old, n, case when {drawn} < {density} then {starts} else word end as word from x)"


@analysis(density=0.7, oracle=WORDS + ", " + _sql_abbreviation(0.7) + COUNTED.replace(" from e", " from ab"))
def abbreviated_words(spark, sf_dir, density=0.7):
    return encoded(spark, sf_dir, lambda w: E.abbreviate(w, density))


def ranked(words: DataFrame, top: int) -> DataFrame:
    """(corpus, word, r): the `top` most frequent of each corpus, ranked from 0; Spark keeps only these while it sorts."""
    c = words.groupBy("corpus", "word").agg(F.sum("n").alias("n"))
    r = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "word"))
    return c.withColumn("r", r - 1).where(F.col("r") < top).select("corpus", "word", "r")


def code_maps(words: DataFrame, codes: list[str], name: str = "table") -> DataFrame:
    """(corpus, table): each corpus's most frequent words to the codes in their order; a row a corpus."""
    r = ranked(words, len(codes)).withColumn("code", F.get(F.array(*map(F.lit, codes)), F.col("r")))
    return r.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("word", "code"))).alias(name))


@analysis(top=20, oracle=WORDS + ", t as (select corpus, word, row_number() over (partition by corpus order by n desc, word) as r from w), e as (select w.corpus, case when r <= 20 then 'z' || lpad(r::varchar, 2, '0') else w.word end as word, n from w join t using (corpus, word))" + COUNTED)
def abbreviation_codes(spark, sf_dir, top=20):
    """The most frequent words as codes by their rank."""
    w = types(spark, sf_dir)
    m = code_maps(w, [f"z{k + 1:02}" for k in range(top)])
    j = w.join(F.broadcast(m), "corpus")  # a row a corpus
    return counted(j.select("corpus", F.coalesce(F.element_at("table", F.col("word")), F.col("word")).alias("word"), "n"))


def numbered_codes(n: int, seed: str, sizes=(2,)) -> list[str]:
    """Codes by rank."""
    return list(E.codes(list(map(str, range(n))), seed, sizes).values())


TOP_SYLLABLES, TOP_PARTS = 80, 60
SYLLABLE_CODES = numbered_codes(TOP_SYLLABLES, "syllables")
TUNED_CODES = numbered_codes(TOP_SYLLABLES // 2, "short") + numbered_codes(TOP_SYLLABLES - TOP_SYLLABLES // 2, "long", (3,))
ONSET_CODES, RIME_CODES = numbered_codes(TOP_PARTS, "onsets"), numbered_codes(TOP_PARTS, "rimes")
_V = "aeiouyàâäáåæéèêëíìîïóòôöøœúùûü"
SYLLABLES = WORDS + f", sy as (select corpus, word, n, unnest(s) as s, generate_subscripts(s, 1) as i from (select *, regexp_extract_all(word, '([^{_V}]*[{_V}]+(?:[^{_V}]+$)?|^[^{_V}]+$)', 1) as s from w))"


def _sql_codes(name: str, source: str, value: str, codes: list[str]) -> str:
    """A CTE (corpus, x, code): the most frequent values of a CTE with corpus and n, and the codes by rank."""
    told = "[" + ", ".join(f"'{c}'" for c in codes) + "]"
    return f""", {name} as (select corpus, x, ({told})[r] as code from (select corpus, {value} as x, row_number() over (partition by corpus order by sum(n) desc, {value}) as r
      from {source} where {value} <> '' group by corpus, {value}) where r <= {len(codes)})"""


def _sql_syllabic(codes: list[str]) -> str:
    return SYLLABLES + _sql_codes("t", "sy", "s", codes) + ", e as (select sy.corpus, word as old, n, string_agg(coalesce(code, s), '' order by i) as word from sy left join t on t.corpus = sy.corpus and t.x = sy.s group by sy.corpus, word, n)" + COUNTED


def _syllabic(spark, sf_dir, codes: list[str]) -> DataFrame:
    w = types(spark, sf_dir).withColumn("s", T.syllables(F.col("word"))).where(F.size("s") > 0)
    m = code_maps(w.select("corpus", F.explode("s").alias("word"), "n"), codes)
    j = w.join(F.broadcast(m), "corpus")  # a row a corpus
    told = F.transform("s", lambda x: F.coalesce(F.element_at("table", x), x))
    return counted(j.select("corpus", F.array_join(told, "").alias("word"), "n"))


@analysis(oracle=_sql_syllabic(SYLLABLE_CODES))
def syllabic_encoding(spark, sf_dir):
    """Each corpus's most frequent syllables as codes of two letters; the rest stay."""
    return _syllabic(spark, sf_dir, SYLLABLE_CODES)


@analysis(oracle=_sql_syllabic(TUNED_CODES))
def tuned_syllabic_encoding(spark, sf_dir):
    """Frequent syllables get codes of two letters, less frequent ones of three."""
    return _syllabic(spark, sf_dir, TUNED_CODES)


@analysis(oracle=SYLLABLES + ", p as (select *, regexp_extract(s, '^([^aeiou]*)', 1) as o, substring(s, length(regexp_extract(s, '^([^aeiou]*)', 1)) + 1) as m from sy)"
          + _sql_codes("a", "p", "o", ONSET_CODES) + _sql_codes("b", "p", "m", RIME_CODES)
          + ", e as (select p.corpus, word as old, n, string_agg(coalesce(a.code, o) || coalesce(b.code, m), '' order by i) as word from p left join a on a.corpus = p.corpus and a.x = p.o left join b on b.corpus = p.corpus and b.x = p.m group by p.corpus, word, n)" + COUNTED)
def onset_rime_encoding(spark, sf_dir):
    """The consonants before a syllable's vowel and the rest, coded apart by each corpus's tables."""
    w = types(spark, sf_dir).withColumn("s", T.syllables(F.col("word"))).where(F.size("s") > 0)

    def cut(x):
        onset = F.regexp_extract(x, f"^([^{E.VOWELS}]*)", 1)
        return F.struct(onset.alias("o"), F.substring(x, F.length(onset) + 1, F.length(x)).alias("m"))

    w = w.withColumn("p", F.transform("s", cut))
    parts = w.select("corpus", F.explode("p").alias("p"), "n")
    for c, codes, name in (("o", ONSET_CODES, "a"), ("m", RIME_CODES, "b")):
        own = code_maps(parts.select("corpus", F.col(f"p.{c}").alias("word"), "n").where("word <> ''"), codes, name)
        w = w.join(F.broadcast(own), "corpus")  # a row a corpus
    told = F.transform("p", lambda x: F.concat(F.coalesce(F.element_at("a", x["o"]), x["o"]), F.coalesce(F.element_at("b", x["m"]), x["m"])))
    return counted(w.select("corpus", F.array_join(told, "").alias("word"), "n"))


SCHEMES = {
    "plain": lambda w: w,
    "substitution": lambda w: E.translate(w, SUB),
    "verbose": lambda w: E.verbose(w, VERBOSE),
    "abjad": E.abjad,
    "homophonic": E.homophonic,
    "anagram": E.anagram,
    "bigram": lambda w: E.pairs_to_symbols(w, PAIRS),
    "positional": lambda w: E.positional(w, FIRST, INNER, LAST),
    "zones": lambda w: E.zones(w, (FIRST, INNER, LAST)),
    "expansion": lambda w: E.vowel_expansion(w, 0.5, VOWEL_CODES),
    "expansion+truncation": lambda w: E.truncate(E.vowel_expansion(w, 0.5, VOWEL_CODES), 6),
    "truncation": lambda w: E.truncate(w, 4),
    "abbreviation": lambda w: E.abbreviate(w, 0.7),
}
# what the tournament's schemes are in SQL: by letter, or by word
_EXPANSION = f"case when c in ('a', 'e', 'i', 'o', 'u') and ({sql_pick(1_000_000, 'expand')}) / 1000000.0 < 0.5 then {sql_map(VOWEL_CODES)} else c end"
SQL_LETTERS = {
    "verbose": sql_map(VERBOSE),
    "homophonic": f"c || {sql_pick(3, 'homophonic')}",
    "positional": f"case when i = 0 then {sql_map(FIRST)} when i = k - 1 then {sql_map(LAST)} else {sql_map(INNER)} end",
    "zones": f"case floor(i * 3 / k)::int when 0 then {sql_map(FIRST)} when 1 then {sql_map(INNER)} else {sql_map(LAST)} end",
    "expansion": _EXPANSION,
}
SQL_WORDS = {
    "plain": "word",
    "substitution": f"translate(word, '{''.join(SUB)}', '{''.join(SUB.values())}')",
    "abjad": "case when translate(word, 'aeiou', '') <> '' then translate(word, 'aeiou', '') else word[1] end",
    "truncation": "substring(word, 1, 4)",
}


def _sql_schemes() -> str:
    parts = [f"select corpus, '{k}' as scheme, {x} as word, n from w" for k, x in SQL_WORDS.items()]
    parts += [f"select corpus, '{k}', string_agg({x}, '' order by i), n from l group by corpus, word, n" for k, x in SQL_LETTERS.items()]
    parts.append("select corpus, 'anagram', string_agg(c, '' order by md5('anagram|' || word || '|' || i)), n from l group by corpus, word, n")
    parts.append(f"select corpus, 'expansion+truncation', substring(string_agg({_EXPANSION}, '' order by i), 1, 6), n from l group by corpus, word, n")
    units = "regexp_extract_all(word, '(..|.)', 1)"
    parts.append(f"select corpus, 'bigram', string_agg({sql_map(PAIRS, 'u')}, '' order by i), n from (select corpus, word, n, unnest({units}) as u, generate_subscripts({units}, 1) as i from w) group by corpus, word, n")
    parts.append("select corpus, 'abbreviation', word, n from ab")
    return LETTERS + ", " + _sql_abbreviation(0.7) + ", s as (select corpus, scheme, word, sum(n)::double as n from (" + " union all ".join(parts) + ") group by all)"


NAMES = ("mean_wlen", "types", "h_word", "h_char", "ic")
TOURNAMENT = _sql_schemes() + """,
    a as (select corpus, scheme, sum(n * length(word)) / sum(n) as mean_wlen, count(*)::double as types, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h_word from s group by all),
    ch as (select corpus, scheme, c, sum(n) as n from (select corpus, scheme, n, unnest(string_split(word, '')) as c from s) group by all),
    b as (select corpus, scheme, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h_char, sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) as ic from ch group by all),
    m as (select * from a join b using (corpus, scheme)),
    long as (select corpus, scheme, unnest(['mean_wlen', 'types', 'h_word', 'h_char', 'ic']) as feature, unnest([mean_wlen, types, h_word, h_char, ic]) as v from m),
    spread as (select corpus, feature, stddev_pop(v) as sd, max(v) filter (scheme = 'plain') as target from long group by all),
    d as (select corpus, scheme, sqrt(avg(pow((v - target) / sd, 2))) as distance from long join spread using (corpus, feature) where sd > 1e-12 group by all)
    select corpus, scheme, """ + ", ".join(f"round({n}, 6) as {n}" for n in NAMES) + ", round(distance, 6) as distance from m join d using (corpus, scheme)"


def scheme_metrics(words: DataFrame) -> DataFrame:
    """(corpus, scheme, word, n) to each scheme's metrics and its distance from plain text in them."""
    by = ["corpus", "scheme"]
    chars = words.select(*by, "n", F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("c")).groupBy(*by, "c").agg(F.sum("n").alias("n"))
    a = words.groupBy(*by).agg((F.sum(F.col("n") * F.length("word")) / F.sum("n")).alias("mean_wlen"), F.count("*").cast("double").alias("types"), stats.plogp().alias("h_word"))
    m = a.join(stats.entropy(chars, by, "h_char"), by).join(stats.coincidence(chars, by), by)
    long = m.unpivot(by, list(NAMES), "feature", "v")
    spread = long.groupBy("corpus", "feature").agg(F.stddev_pop("v").alias("sd"), F.max(F.when(F.col("scheme") == "plain", F.col("v"))).alias("target"))
    d = long.join(F.broadcast(spread), ["corpus", "feature"]).where("sd > 1e-12")  # a row a corpus and feature
    d = d.groupBy(*by).agg(F.sqrt(F.avg(F.pow((F.col("v") - F.col("target")) / F.col("sd"), F.lit(2.0)))).alias("distance"))
    return m.join(d, by).select(*by, *(r6(n) for n in NAMES), r6("distance"))


@analysis(oracle=TOURNAMENT)
def encoding_model_tournament(spark, sf_dir):
    """Every scheme's words by mean length, types, entropies and coincidence, and the distance to plain text in them.

    All schemes are one table keyed by corpus and scheme, from a single count of the words.
    """
    w = types(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(k).alias("scheme"), f(F.col("word")).alias("word")) for k, f in SCHEMES.items()))
    all_ = w.select("corpus", "n", F.explode(each).alias("x"))
    return scheme_metrics(all_.groupBy("corpus", "x.scheme", "x.word").agg(F.sum("n").alias("n")))


SWEEP = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


@analysis(oracle=LETTERS + """, sh(share) as (values """ + ", ".join(f"({x}::double)" for x in SWEEP) + f"""),
    e as (select corpus, share, n, string_agg(case when c in ('a', 'e', 'i', 'o', 'u') and ({sql_pick(1_000_000, 'expand')}) / 1000000.0 < share then {sql_map(VOWEL_CODES)} else c end, '' order by i) as word from l, sh group by corpus, share, word, n),
    s as (select corpus, share, word, sum(n)::double as n from e group by all)
    select corpus, share, count(*) as types, round(sum(n * length(word)) / sum(n), 6) as mean_wlen, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as h_word from s group by all""")
def expansion_sweep(spark, sf_dir):
    """Vowel expansion over a grid of shares, all in one job: a sweep of an encoder's parameter."""
    w = types(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(x).alias("share"), E.vowel_expansion(F.col("word"), x, VOWEL_CODES).alias("word")) for x in SWEEP))
    s = w.select("corpus", "n", F.explode(each).alias("x")).groupBy("corpus", "x.share", "x.word").agg(F.sum("n").alias("n"))
    return s.groupBy("corpus", "share").agg(F.count("*").alias("types"), F.round(F.sum(F.col("n") * F.length("word")) / F.sum("n"), 6).alias("mean_wlen"), F.round(stats.plogp(), 6).alias("h_word"))


@analysis(most=6, oracle=LETTERS + f", e as (select corpus, word as old, n, substring(string_agg({_EXPANSION}, '' order by i), 1, 6) as word from l group by corpus, word, n)" + COUNTED)
def combined_layers(spark, sf_dir, most=6):
    """Two encoders one after the other: vowels expanded by chance, then words cut short."""
    return encoded(spark, sf_dir, lambda w: E.truncate(E.vowel_expansion(w, 0.5, VOWEL_CODES), most))


# Pairs of letters written as one sign.
COLLAPSED = {"ch": "1", "th": "2", "sh": "3", "ei": "4", "ou": "5", "er": "6", "en": "7", "qu": "8"}


@analysis(oracle=sql_units("regexp_extract_all(word, '(ch|th|sh|ei|ou|er|en|qu|.)', 1)", COLLAPSED))
def bigram_collapse(spark, sf_dir):
    """Frequent pairs of letters as one sign each, from the left."""
    return encoded(spark, sf_dir, lambda w: E.phonetic(w, COLLAPSED))


# Marks of abbreviation by rule: the letters that they stand for, and where.
MARKS = (("start", "con", "9"), ("start", "per", "p"), ("end", "us", "9"), ("end", "um", "3"), ("end", "ing", "g"), ("any", "er", "2"), ("any", "an", "a"), ("any", "en", "e"))


@analysis(oracle=by_word("replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '^con', '9'), '^per', 'p'), 'us$', '9'), 'um$', '3'), 'ing$', 'g'), 'er', '2'), 'an', 'a'), 'en', 'e')"))
def mark_rule_abbreviation(spark, sf_dir):
    """Marks by place, one rule after the other: suspension at the ends, contraction inside."""
    return encoded(spark, sf_dir, lambda w: E.positional_rules(w, MARKS))


# Letter groups and the sounds that they are read as, longest first.
SOUNDS = {"sch": "S", "ch": "x", "ph": "f", "th": "t", "qu": "kv", "ck": "k", "c": "k", "z": "ts", "v": "f", "w": "v", "y": "i"}


@analysis(oracle=sql_units("regexp_extract_all(word, '(sch|ch|ck|ph|qu|th|c|v|w|y|z|.)', 1)", SOUNDS))
def phonetic_mapping(spark, sf_dir):
    """Words by sound: the longest letter group that fits, from the left."""
    return encoded(spark, sf_dir, lambda w: E.phonetic(w, SOUNDS))


# How the signs 9, 4 and 2 are read by place.
READINGS = (("start", "9", "con"), ("end", "9", "us"), ("any", "9", "com"), ("end", "4", "orum"), ("any", "2", "er"))


@analysis(oracle=WORDS + ", " + _sql_abbreviation(1.0) + """, e as (select corpus, replace(regexp_replace(replace(regexp_replace(regexp_replace(word, '^9', 'con'), '9$', 'us'), '9', 'com'), '4$', 'orum'), '2', 'er') as word, n from ab)""" + COUNTED)
def positional_rule_decode(spark, sf_dir):
    """Abbreviated words read again by rules that go by place; what the rules can't tell comes out otherwise."""
    return encoded(spark, sf_dir, lambda w: E.positional_rules(E.abbreviate(w, 1.0), READINGS))


@analysis(oracle=WORDS + """, e as (select corpus, unnest(['plain', 'abjad', 'abbrev4']) as kind, unnest([word, case when translate(word, 'aeiou', '') <> '' then translate(word, 'aeiou', '') else word[1] end, substring(word, 1, 4)]) as word, n from w)
    select corpus, kind, word, count(*) as types, sum(n)::bigint as n from e group by all""")
def variant_transforms(spark, sf_dir):
    """The forms on which language models are compared: plain, without vowels, and the first four letters."""
    w = types(spark, sf_dir).select("corpus", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), E.variant(F.col("word"), k).alias("word")) for k in ("plain", "abjad", "abbrev4")))).alias("x"))
    return w.groupBy("corpus", "x.kind", "x.word").agg(F.count("*").alias("types"), F.sum("n").alias("n"))


# Replacements of the bench, one after the other.
PIPELINE = (("ck", "k"), ("qu", "kw"), ("x", "ks"), ("ph", "f"), ("ee", "i"), ("oo", "u"))


@analysis(oracle=by_word("replace(replace(replace(replace(replace(replace(word, 'ck', 'k'), 'qu', 'kw'), 'x', 'ks'), 'ph', 'f'), 'ee', 'i'), 'oo', 'u')"))
def substitution_pipeline(spark, sf_dir):
    """A list of replacements, each over what the one before it left."""

    def all_of(w):
        for a, b in PIPELINE:
            w = F.replace(w, F.lit(a), F.lit(b))
        return w

    return encoded(spark, sf_dir, all_of)


@analysis(oracle=f"""with {sql.LINES}, s as (select corpus, doc_id, line_no, words, ('0x' || substring(md5(corpus || '|' || doc_id || '|' || line_no), 1, 6))::bigint % 5 + 6 as k from lines)
    select corpus, sum(ceil(len(words) / k))::bigint as lines, sum(len(words))::bigint as tokens, max(k)::int as widest from s group by corpus""")
def pseudo_lines(spark, sf_dir):
    """Lines cut anew into pieces of six to ten words, the size drawn for each line."""
    s = C.lines(spark, sf_dir).withColumn("k", C.pseudo_lines())
    pieces = s.select("corpus", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("words"), F.col("k")), lambda i: F.slice("words", i, F.col("k")))).alias("words"))
    return pieces.groupBy("corpus").agg(F.count("*").alias("lines"), F.sum(F.size("words")).cast("long").alias("tokens"), F.max("k").alias("widest"))


def sql_draw(n: str, *parts: str) -> str:
    """A number below n from the hash of the parts."""
    return f"('0x' || substring(md5({" || '|' || ".join(parts)}), 1, 8))::bigint % {n}"


def drawn(n, *parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n).cast("int")


_THIRDS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(("head", "middle", "tail")))
GENERATED = " select corpus, rep::int as rep, sum(n)::bigint as tokens, count(*) as types, round(sum(n * length(word)) / sum(n), 4) as mean_wlen, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) as h_word from (select corpus, rep, word, count(*)::double as n from g group by all) group by corpus, rep"


@analysis(n=4000, reps=3, jump=7, oracle=WORDS + f""", p as (select corpus, n, unnest([word[:length(word) // 3], word[length(word) // 3 + 1:length(word) - length(word) // 3], word[length(word) - length(word) // 3 + 1:]]) as x, unnest([0, 1, 2]) as col from w where length(word) >= 3),
    r as (select corpus, col, x, row_number() over (partition by corpus, col order by sum(n) desc, x) - 1 as r from p where x <> '' group by corpus, col, x), t as (select * from r where r < 30), size as (select corpus, col, count(*) as size from t group by all),
    ats as materialized (select rep, i, ({sql_draw('30', "'grille'", 'rep', '(i // 7)')} + i % 7) % 30 as a from (select unnest(range(0, 4000)) as i), (select unnest(range(0, 3)) as rep)),
    g as (select t.corpus, rep, i, string_agg(x, '' order by t.col) as word from ats cross join size join t on t.corpus = size.corpus and t.col = size.col and t.r = (a + t.col) % size group by t.corpus, rep, i)""" + GENERATED)
def grille_rows(spark, sf_dir, n=4000, reps=3, jump=7):
    """Words of a grille over each corpus's most frequent beginnings, middles and ends: it moves a row a word, and jumps every `jump` words."""
    rows = 30
    w = types(spark, sf_dir).where(F.length("word") >= 3).select("corpus", "n", T.thirds(F.col("word")).alias("t"))
    tables = None
    for c in ("head", "middle", "tail"):
        r = ranked(w.select("corpus", F.col(f"t.{c}").alias("word"), "n").where("word <> ''"), rows)
        own = r.groupBy("corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias(c))
        tables = own if tables is None else tables.join(own, "corpus")
    i, rep = F.col("i"), F.col("rep")
    places = spark.range(n * reps).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).cast("int").alias("rep"))
    at = places.withColumn("a", (drawn(rows, "grille", rep, F.floor(i / jump)) + i % jump) % rows)
    j = at.crossJoin(F.broadcast(tables))  # a row a corpus
    word = F.concat(*(F.get(c, ((F.col("a") + k) % F.size(c)).cast("int")) for k, c in enumerate(("head", "middle", "tail"))))
    return generated(j.select("corpus", "rep", word.alias("word")))


def generated(tokens: DataFrame) -> DataFrame:
    """What is counted of generated replicates."""
    c = tokens.groupBy("corpus", "rep", "word").agg(F.count("*").alias("n"))
    return c.groupBy("corpus", "rep").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.sum(F.col("n") * F.length("word")) / F.sum("n"), 4).alias("mean_wlen"),
        F.round(stats.plogp(), 4).alias("h_word"),
    )


@analysis(n=4000, reps=3)
def self_citation(spark, sf_dir, n=4000, reps=3):
    """Words copied from the last ones and changed, from each corpus's most frequent words; a replicate is sequential."""
    start = {}
    for r in ranked(types(spark, sf_dir), 20).orderBy("corpus", "r").collect():  # twenty rows a corpus
        start.setdefault(r.corpus, []).append(r.word)
    parts = [sequential.per_replicate(spark, reps, sequential.copy_and_change, "rep int, ord int, word string", n=n, start=words).withColumn("corpus", F.lit(corpus)) for corpus, words in start.items()]
    out = parts[0] if parts else spark.createDataFrame([], "rep int, ord int, word string, corpus string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return generated(out)


MOST_LETTERS = 24
_CUM = """, tr as (select corpus, a, b, sum(n)::bigint as n from (select corpus, n, case when i = 0 then ' ' else word[i] end as a, c as b from l union all select corpus, n, word[-1], ' ' from w) group by all),
    cum as materialized (select corpus, a, b, sum(n) over (partition by corpus, a order by b) as upto, coalesce(sum(n) over (partition by corpus, a order by b rows between unbounded preceding and 1 preceding), 0) as since, sum(n) over (partition by corpus, a) as total from tr)"""


@analysis(n=2000, reps=2, oracle=LETTERS.replace("with ", "with recursive ", 1) + _CUM + f""",
    chain as (select corpus, rep, i, 0 as k, ' ' as state, '' as word from (select distinct corpus from w), (select unnest(range(0, 2000)) as i), (select unnest(range(0, 2)) as rep)
      union all select d.corpus, rep, i, k + 1, b, word || b from (select *, {sql_draw('1000000000', "'markov'", 'corpus', 'rep', 'i', 'k')} as u from chain where k < 24 and (k = 0 or state <> ' ')) d
        join cum on cum.corpus = d.corpus and cum.a = d.state and u >= since * 1000000000 // total and u < upto * 1000000000 // total),
    g as (select corpus, rep, i, rtrim(max_by(word, k)) as word from chain group by corpus, rep, i)""" + GENERATED)
def markov_source(spark, sf_dir, n=2000, reps=2):
    """Words drawn letter by letter from each corpus's transitions; words are drawn apart from each other."""
    w = types(spark, sf_dir)
    told = F.concat(F.array(F.lit(" ")), E.letters(F.col("word")), F.array(F.lit(" ")))
    two = w.select("corpus", "n", told.alias("u")).select(
        "corpus", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("u") - 1), lambda i: F.struct(F.element_at("u", i).alias("a"), F.element_at("u", i + 1).alias("b")))).alias("x")
    )
    t = two.groupBy("corpus", "x.a", "x.b").agg(F.sum("n").alias("n"))  # an alphabet squared
    own = Window.partitionBy("corpus", "a")
    t = t.select("corpus", "a", "b", F.sum("n").over(own.orderBy("b")).alias("upto"), F.sum("n").over(own).alias("total"))
    row = t.groupBy("corpus", "a").agg(F.array_sort(F.collect_list(F.struct(F.expr("upto * 1000000000 div total").alias("upto"), "b"))).alias("next"))
    tables = row.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("a", "next"))).alias("table"))
    places = spark.range(n * reps).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).cast("int").alias("rep")).repartition(8)
    j = places.crossJoin(F.broadcast(tables))  # a row a corpus
    start = F.struct(F.lit(" ").alias("state"), F.lit("").alias("word"), F.lit(False).alias("over"))

    def step(a, k):
        u = drawn(1_000_000_000, "markov", F.col("corpus"), F.col("rep"), F.col("i"), k)
        b = F.filter(F.element_at("table", a["state"]), lambda x: x["upto"] > u)[0]["b"]
        return F.when(a["over"], a).otherwise(F.struct(b.alias("state"), F.concat(a["word"], b).alias("word"), (b == " ").alias("over")))

    word = F.aggregate(F.sequence(F.lit(0), F.lit(MOST_LETTERS - 1)), start, step)["word"]
    return generated(j.select("corpus", "rep", F.rtrim(word).alias("word")))


@analysis(n=20000, oracle=LETTERS + f""", c as (select corpus, c, sum(n)::bigint as n from l group by all), cum as materialized (select corpus, c, sum(n) over (partition by corpus order by c) as upto, coalesce(sum(n) over (partition by corpus order by c rows between unbounded preceding and 1 preceding), 0) as since, sum(n) over (partition by corpus) as total from c),
    p as (select corpus, i, unnest(range(1, ({sql_draw('7', "'length'", 'i')})::bigint + 3)) as k from (select unnest(range(0, 20000)) as i), (select distinct corpus from w)),
    d as (select corpus, i, k, {sql_draw('1000000000', "'unigram'", 'corpus', 'i', 'k')} as u from p),
    g as (select d.corpus, 0 as rep, i, string_agg(c, '' order by k) as word from d join cum on cum.corpus = d.corpus and u >= since * 1000000000 // total and u < upto * 1000000000 // total group by d.corpus, i)""" + GENERATED)
def unigram_text(spark, sf_dir, n=20000):
    """A text of drawn letters and lengths for each corpus: each place's letter by the corpus's cumulative shares."""
    l = types(spark, sf_dir).select("corpus", "n", F.explode(E.letters(F.col("word"))).alias("c")).groupBy("corpus", "c").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("corpus")  # an alphabet
    cum = l.select("corpus", "c", F.sum("n").over(own.orderBy("c")).alias("upto"), F.sum("n").over(own).alias("total"))
    cum = cum.withColumn("upto", F.expr("upto * 1000000000 div total"))
    packed = cum.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("upto", "c"))).alias("letters"))
    words = spark.range(n).withColumn("k", drawn(7, "length", F.col("id")) + 2).repartition(8).crossJoin(F.broadcast(packed))  # a row a corpus
    pick = lambda i: F.filter("letters", lambda x: x["upto"] > drawn(1_000_000_000, "unigram", F.col("corpus"), F.col("id"), i))[0]["c"]
    told = F.transform(F.sequence(F.lit(1), F.col("k")), pick)
    return generated(words.select("corpus", F.lit(0).alias("rep"), F.array_join(told, "").alias("word")))


@analysis(width=60, oracle=f"""with {sql.LINES}, d as (select corpus, doc_id, flatten(list(words order by line_no)) as w from lines group by corpus, doc_id),
    r as (select corpus, doc_id, list_reduce(list_transform(w, lambda x: {{'l': 1, 'u': length(x), 'm': 0::bigint}}), lambda a, x: case when a.u + 1 + x.u > 60 then {{'l': a.l + 1, 'u': x.u, 'm': greatest(a.m, a.u)}} else {{'l': a.l, 'u': a.u + 1 + x.u, 'm': a.m}} end) as s from d)
    select corpus, doc_id, s.l::bigint as lines, greatest(s.m, s.u)::bigint as widest from r""")
def justified_lines(spark, sf_dir, width=60):
    """Documents' words filled into lines of `width` characters; a document is a group."""
    from quillon.operators.sequential import justified

    docs = C.lines(spark, sf_dir).groupBy("corpus", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "words"))), lambda x: x["words"])).alias("words"))

    def fill(batches):
        import pandas as pd

        for b in batches:
            rows = [(c, d, len(x), max(map(len, (" ".join(l) for l in x)))) for c, d, w in zip(b.corpus, b.doc_id, b.words) for x in [justified(list(w), width)]]
            yield pd.DataFrame(rows, columns=["corpus", "doc_id", "lines", "widest"])

    return docs.mapInPandas(fill, "corpus string, doc_id long, lines long, widest long")


@analysis(strength=1.0)
def line_discipline(spark, sf_dir, strength=1.0):
    """Lines whose words are drawn place by place with their corpus's affinity of first letters to places."""
    lines = C.lines(spark, sf_dir)
    t = C.tokens(lines).select("corpus", F.substring("word", 1, 1).alias("c"), F.least("pos", F.lit(4)).alias("p"))
    n = t.groupBy("corpus", "c", "p").agg(F.count("*").alias("n"))
    w = Window.partitionBy
    rel = n.select("corpus", "c", "p", (F.col("n") * F.sum("n").over(w("corpus")) / (F.sum("n").over(w("corpus", "c")) * F.sum("n").over(w("corpus", "p")))).alias("w"))
    weight: dict[str, dict] = {}
    for r in rel.collect():  # an alphabet by five places for each corpus
        weight.setdefault(r.corpus, {})[r.c, r.p] = float(r.w)

    def place(batches):
        import pandas as pd

        from quillon.operators.sequential import place_by_class

        for b in batches:
            out = [place_by_class(list(w), weight[c], strength, (d, l)) for c, d, l, w in zip(b.corpus, b.doc_id, b.line_no, b.words)]
            yield pd.DataFrame({"corpus": b.corpus, "doc_id": b.doc_id, "line_no": b.line_no, "words": out})

    placed = lines.drop("source").mapInPandas(place, "corpus string, doc_id long, line_no long, words array<string>")
    t = C.tokens(placed)
    return t.groupBy("corpus", F.least("pos", F.lit(4)).alias("place"), F.substring("word", 1, 1).alias("cls")).agg(F.count("*").alias("n"))


def broken_tables(spark, sf_dir) -> dict[str, dict[str, list[str]]]:
    """For each corpus, letters to their strings: rare letters, by their code lengths, have two of several signs."""
    l = types(spark, sf_dir).select("corpus", "n", F.explode(E.letters(F.col("word"))).alias("c")).groupBy("corpus", "c").agg(F.sum("n").alias("n"))
    weights: dict[str, dict[str, float]] = {}
    for r in l.collect():  # an alphabet a corpus
        weights.setdefault(r.corpus, {})[r.c] = float(r.n)
    mid, long = (E.codes(E.ALPHABET, f"broken{k}", (k,), "odaykelchrinst") for k in (2, 3))
    out = {}
    for corpus, own in weights.items():
        lengths = {c: len(code) for c, code in sequential.huffman(own).items()}
        out[corpus] = {c: [mid[c], long[c]] if lengths.get(c, 9) > 4 else [c, mid[c]] for c in E.ALPHABET}
    return out


@analysis()
def rule_broken_encoding(spark, sf_dir):
    """Letters as strings of one to three signs, with word breaks by rule: sequential in a word, parallel over words."""
    table = broken_tables(spark, sf_dir)

    def encode(batches):
        import pandas as pd

        from quillon.operators.sequential import broken

        for b in batches:
            rows = [(c, w, n) for c, word, n in zip(b.corpus, b.word, b.n) for w in broken(word, table[c], (word,))]
            yield pd.DataFrame(rows, columns=["corpus", "word", "n"])

    return counted(types(spark, sf_dir).mapInPandas(encode, "corpus string, word string, n long"))


@analysis(oracle="""with r as (select i, i % 3 as dialect, ('0x' || substring(md5('det|' || i), 1, 6))::bigint % 10 as u from range(6000) t(i)),
    s as (select ['food', 'water', 'stone'][dialect + 1] as section, case when u < 7 then 'm' || dialect else 'm' || ((dialect + 1) % 3) end as marker from r)
    select section, marker, count(*) as n from s group by all""")
def synthetic_determinatives(spark, sf_dir):
    """A made corpus whose markers follow their section seven times in ten."""
    r = spark.range(6000).withColumn("d", (F.col("id") % 3).cast("int"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("det|"), F.col("id").cast("string"))), 1, 6), 16, 10).cast("long") % 10
    section = F.get(F.array(*map(F.lit, ("food", "water", "stone"))), F.col("d"))
    marker = F.concat(F.lit("m"), F.when(u < 7, F.col("d")).otherwise((F.col("d") + 1) % 3).cast("string"))
    return r.select(section.alias("section"), marker.alias("marker")).groupBy("section", "marker").agg(F.count("*").alias("n"))
