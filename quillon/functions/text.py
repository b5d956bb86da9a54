"""Column expressions over words and lines of text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets and affix lists of the transliteration, in the order in which they are tried.
BENCH_GALLOWS = ("cth", "ckh", "cph", "cfh")
GALLOWS = (*BENCH_GALLOWS, "tch", "kch", "pch", "fch", "tsh", "ksh", "psh", "fsh", "t", "k", "f", "p")
PREFIXES = ("qo", "q", "so", "do", "o", "d", "s", "y")
GRAMMAR_PREFIXES = ("qo", "so", "do", "q", "o", "d", "y")
EDGE_PREFIXES = ("qo", "lch", "lsh", "sh", "ch", "so", "do", "q", "o", "d", "y", "l")
EDGE_SUFFIXES = ("aiin", "ain", "iin", "in", "ar", "or", "al", "ol", "dy", "y")
SUFFIXES = ("aiin", "ain", "iin", "in", "ar", "or", "al", "ol", "edy", "ody", "eedy", "dy", "sy", "ey", "y")
SUFFIXES_LONG_FIRST = ("aiin", "ain", "iin", "in", "ar", "or", "al", "ol", "eedy", "edy", "ody", "dy", "ey", "y")
TWO_LETTERS = ("ch", "sh", "th", "kh", "ph", "fh")
# The five ordered slots of a chunk; glyphs of slots 2 and 4 may run up to three times where marked.
SLOT_1, SLOT_5 = ("ch", "sh", "y"), ("y", "p", "f", "k", "l", "r", "s", "t", "cth", "ckh", "cph", "cfh", "n", "m")
SLOT_2_RUNS, SLOT_2, SLOT_3, SLOT_4_RUNS, SLOT_4 = "e", ("q", "a"), "o", "i", "d"
MOST_CHUNKS = 6

#: Units, the longest first.
GLYPH = "|".join((*BENCH_GALLOWS, *TWO_LETTERS, "."))

WORD = r"([\p{L}]+)"
# The patterns of the transliterations' markup.
TAG, ALTERNATIVES, BREAKS = "<[^>]*>", r"\[([^:\[\]]*)(?::[^\[\]]*)+\]", r"[.\s,;]+"


def words(line: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), 1)


def clean_ivtff(text: Column, comma_break: bool = True, least: int = 1) -> Column:
    """Words of a transliterated line.

    Inline tags and comments part words; of alternative readings the first counts; "!" is padding and goes; a word with
    anything but a to z is dropped whole. A comma is an uncertain space: it parts words, or with comma_break false it
    joins them.
    """
    t = F.regexp_replace(F.regexp_replace(text, TAG, "."), ALTERNATIVES, "$1")
    t = F.replace(t, F.lit("!"), F.lit(""))
    if not comma_break:
        t = F.replace(t, F.lit(","), F.lit(""))
    parts = F.split(F.lower(t), BREAKS)
    return F.filter(parts, lambda w: w.rlike("^[a-z]+$") & (F.length(w) >= least))


def clean_generic(text: Column, comma_break: bool = True) -> Column:
    """As clean_ivtff for any alphabet: words keep all characters but those that mark illegible signs.

    A numbered sign "@123;" stays as one unit; glyphs of such texts are units of "@digits;" or single characters.
    """
    t = F.regexp_replace(F.regexp_replace(text, TAG, "."), ALTERNATIVES, "$1")
    t = F.regexp_replace(t, "[!{}']", "")
    if not comma_break:
        t = F.replace(t, F.lit(","), F.lit(""))
    parts = F.split(F.regexp_replace(t, "@([0-9]+);", "@$1\u0001"), r"[.\s,]+")
    kept = F.filter(parts, lambda w: (w != "") & ~w.rlike("[%*?]"))
    return F.transform(kept, lambda w: F.replace(w, F.lit("\u0001"), F.lit(";")))


def clean_word(word: Column) -> Column:
    """The letters a to z of a word."""
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def extract_words(text: Column) -> Column:
    """Words of a marked-up line the older way: marks are cut out of words, which stay."""
    t = F.regexp_replace(F.regexp_replace(text, r"@\d+;", ""), "<[^>]*>", "")
    return F.filter(F.transform(F.split(t, r"[.\s,]+"), clean_word), lambda w: w != "")


def locus_type(locus: Column) -> Column:
    """The letter after "," and one of @ + * = & ~ / ! in a locus such as f1r.1,@P0; null without one."""
    kind = F.regexp_extract(locus, r",.([A-Z])", 1)
    return F.when(kind != "", kind)


def html_words(html: Column) -> Column:
    """Words of a page's visible text: scripts, styles, comments and tags are cut, common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return words(t)


def glyphs(word: Column, lower: bool = True) -> Column:
    """Units of a word: bench signs of three letters, signs of two, single letters; the leftmost longest first."""
    return F.regexp_extract_all(F.lower(word) if lower else word, F.lit(f"({GLYPH})"), 1)


def map_units(word: Column, table: dict[str, str], other: str | None = None) -> Column:
    """Each unit of the word through the table, longest keys first; units that it lacks as they are, or as `other`."""
    keys = sorted(table, key=lambda k: (-len(k), k))
    units = F.regexp_extract_all(word, F.lit("(" + "|".join([*keys, "."]) + ")"), 1)
    mapped = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(units, lambda u: F.coalesce(F.element_at(mapped, u), u if other is None else F.lit(other)))


def _without(word: Column, part: str) -> Column:
    """The word after `part` is taken out until none is left; taking one out can make another where it stood."""
    if len(part) == 1:
        return F.replace(word, F.lit(part), F.lit(""))
    times = F.sequence(F.lit(1), F.greatest(F.floor(F.length(word) / len(part)).cast("int"), F.lit(1)))  # each takes one at least
    return F.aggregate(times, word, lambda a, _: F.replace(a, F.lit(part), F.lit("")))


def strip_gallows(word: Column) -> Column:
    """The word without its gallows, each taken out in list order until none is left."""
    for g in GALLOWS:
        word = _without(word, g)
    return word


def gallows(word: Column) -> Column:
    """The gallows that strip_gallows takes out, in its order, repeated ones repeated."""
    return stripped(word)["taken"]


def stripped(word: Column) -> Column:
    """(rest, taken): strip_gallows() and gallows() at once, each step from the one before it."""
    start = F.struct(word.alias("rest"), F.array().cast("array<string>").alias("taken"))

    def step(a: Column, g: Column) -> Column:
        times = F.sequence(F.lit(1), F.greatest(F.floor(F.length(a["rest"]) / F.length(g)).cast("int"), F.lit(1)))
        rest = F.aggregate(times, a["rest"], lambda x, _: F.replace(x, g, F.lit("")))
        n = ((F.length(a["rest"]) - F.length(rest)) / F.length(g)).cast("int")
        return F.struct(rest.alias("rest"), F.concat(a["taken"], F.array_repeat(g, n)).alias("taken"))

    return F.aggregate(F.array(*map(F.lit, GALLOWS)), start, step)


def gallows_base(word: Column) -> Column:
    """The first of t, k, p, f that a word holds, else null."""
    return F.coalesce(*(F.when(F.contains(word, F.lit(g)), F.lit(g)) for g in "tkpf"))


def collapse_e(word: Column) -> Column:
    return F.regexp_replace(word, "e+", "e")


def collapsed(word: Column) -> Column:
    return collapse_e(strip_gallows(word))


def _first(word: Column, affixes: Sequence[str], test, other: Column) -> Column:
    out = None
    for a in affixes:
        out = F.when(test(word, a), F.lit(a)) if out is None else out.when(test(word, a), F.lit(a))
    return out.otherwise(other)


def prefix(word: Column, affixes: Sequence[str] = EDGE_PREFIXES, spare: int = 0, other: str = "X") -> Column:
    """The first listed prefix that the word has with more than `spare` letters after it, else `other`."""
    return _first(word, affixes, lambda w, a: F.startswith(w, F.lit(a)) & (F.length(w) >= len(a) + spare), F.lit(other))


def suffix(word: Column, affixes: Sequence[str] = EDGE_SUFFIXES, spare: int = 0, other: str = "X") -> Column:
    return _first(word, affixes, lambda w, a: F.endswith(w, F.lit(a)) & (F.length(w) >= len(a) + spare), F.lit(other))


def morphology(word: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """(prefix, root, suffix): the first prefix that leaves two letters, then the first suffix that leaves one."""
    p = prefix(word, PREFIXES, 2, "")
    rest = F.substring(word, F.length(p) + 1, F.length(word))
    s = suffix(rest, suffixes, 1, "")
    root = F.substring(rest, F.lit(1), F.length(rest) - F.length(s))
    return F.struct(p.alias("prefix"), root.alias("root"), s.alias("suffix"))


def decompose(word: Column) -> Column:
    """A word's whole analysis: original, stripped, collapsed, prefix, root, suffix, gallows."""
    m = morphology(collapsed(word))
    return F.struct(
        word.alias("original"), strip_gallows(word).alias("stripped"), collapsed(word).alias("collapsed"),
        m["prefix"].alias("prefix"), m["root"].alias("root"), m["suffix"].alias("suffix"), gallows(word).alias("gallows"),
    )


#: One character for each glyph that takes several letters, none of which is a lower-case letter.
ONE = dict(zip((*BENCH_GALLOWS, *TWO_LETTERS), "TKPFCSHJVW"))


def _class(glyph_list: Sequence[str]) -> str:
    return "[" + "".join(ONE.get(g, g) for g in glyph_list) + "]"


#: The slots over glyphs written as one character each.
SLOTS = (
    _class(SLOT_1), f"(?:{SLOT_2_RUNS}{{1,3}}|{_class(SLOT_2)})", SLOT_3, f"(?:{SLOT_4_RUNS}{{1,3}}|{SLOT_4})", _class(SLOT_5),
)
#: A chunk: any of the slots, in order; the first that is filled decides where it starts.
CHUNK = "|".join(s + "".join(f"{later}?" for later in SLOTS[i + 1 :]) for i, s in enumerate(SLOTS))
STARTS = "[" + "".join(dict.fromkeys("".join(ONE.get(g, g) for g in (*SLOT_1, SLOT_2_RUNS, *SLOT_2, SLOT_3, SLOT_4_RUNS, SLOT_4, *SLOT_5)))) + "]"


def chunks(word: Column) -> Column:
    """(chunks, unparsed): the word's glyphs cut into chunks of five ordered slots, and those that fit no slot.

    chunks are arrays of glyphs, six at most; what follows the sixth is unparsed.
    """
    one = F.lower(word)
    for glyph, char in ONE.items():
        one = F.replace(one, F.lit(glyph), F.lit(char))
    # every piece is a chunk or, where none starts, a single glyph
    stepped = F.regexp_extract_all(one, F.lit(f"({CHUNK}|.)"), 1)
    back = F.create_map(*(F.lit(x) for kv in ONE.items() for x in (kv[1], kv[0])))

    def units(piece: Column) -> Column:
        return F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(back, c), c))

    fits = F.transform(stepped, lambda p: p.rlike(f"^{STARTS}"))
    # a chunk counts while fewer than MOST_CHUNKS chunks stand before it
    state = F.aggregate(
        F.arrays_zip(stepped.alias("p"), fits.alias("f")),
        F.struct(F.array().cast("array<array<string>>").alias("c"), F.array().cast("array<string>").alias("u")),
        lambda a, x: F.when(
            x["f"] & (F.size(a["c"]) < MOST_CHUNKS),
            F.struct(F.array_append(a["c"], units(x["p"])).alias("c"), a["u"].alias("u")),
        ).otherwise(F.struct(a["c"].alias("c"), F.concat(a["u"], units(x["p"])).alias("u"))),
    )
    return F.struct(state["c"].alias("chunks"), state["u"].alias("unparsed"))


def skeleton(word: Column, vowels: str = "aeiou") -> Column:
    return F.translate(word, vowels, "")


def cv_pattern(word: Column, vowels: str = "aeiou") -> Column:
    """V for each vowel, C for every other character."""
    return F.regexp_replace(F.regexp_replace(word, f"[^{vowels}]", "C"), f"[{vowels}]", "V")


def masked(word: Column, mark: str = "_") -> Column:
    """The word with each of its characters masked in turn: structs (pos, frame, char)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.filter(
        F.transform(
            places,
            lambda i: F.struct(
                i.alias("pos"),
                F.concat(F.substring(word, F.lit(1), i - 1), F.lit(mark), F.substring(word, i + 1, F.length(word))).alias("frame"),
                F.substring(word, i, F.lit(1)).alias("char"),
            ),
        ),
        lambda x: x["char"] != "",
    )


def thirds(word: Column) -> Column:
    """(head, middle, tail) of a word: a third each, the middle taking what is over; short words have empty parts."""
    k = F.floor(F.length(word) / 3).cast("int")
    return F.struct(
        F.substring(word, F.lit(1), k).alias("head"),
        F.substring(word, k + 1, F.length(word) - 2 * k).alias("middle"),
        F.when(k > 0, F.substring(word, F.length(word) - k + 1, k)).otherwise(F.lit("")).alias("tail"),
    )


def variants(word: Column, swaps: Sequence[tuple[str, str]]) -> Column:
    """The word and its forms under each swap, without repeats."""
    return F.array_distinct(F.array(word, *(F.replace(word, F.lit(a), F.lit(b)) for a, b in swaps)))


def syllables(word: Column, vowels: str = "aeiouyàâäáåæéèêëíìîïóòôöøœúùûü") -> Column:
    """Runs of consonants with the vowels after them; closing consonants stay with the last syllable."""
    v, c = f"[{vowels}]", f"[^{vowels}]"
    return F.regexp_extract_all(word, F.lit(f"({c}*{v}+(?:{c}+$)?|^{c}+$)"), 1)


def plain_letters(word: Column) -> Column:
    """Latin letters without their diacritics, for the marks of western European languages."""
    return F.translate(word, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def ngrams(units: Column, n: int) -> Column:
    """All runs of n units, as arrays."""
    return F.when(
        F.size(units) >= n, F.transform(F.sequence(F.lit(1), F.size(units) - n + 1), lambda i: F.slice(units, i, n))
    ).otherwise(F.array().cast("array<array<string>>"))


def runs(word: Column) -> Column:
    """Runs of one character: structs (char, length)."""
    return F.transform(
        F.regexp_extract_all(word, F.lit(r"((.)\2*)"), 1),
        lambda r: F.struct(F.substring(r, 1, 1).alias("char"), F.length(r).alias("length")),
    )


# The twelve ordered slots and the tokens of each, in the order in which they are tried.
TWELVE_SLOTS = (
    ("d", "l", "q", "s"), ("o", "y"), ("l", "r"), ("f", "k", "p", "t"), ("ch", "sh"), ("cth", "ckh", "cph", "cfh"),
    ("eee", "ee", "e"), ("d", "s"), ("o", "a"), ("iii", "ii", "i"), ("d", "l", "m", "n", "r"), ("y",),
)


def twelve_slots(word: Column) -> Column:
    """(slots, rest): what each of twelve optional slots takes from the word in order, and what is left."""
    pattern = "^" + "".join(f"({'|'.join(s)})?" for s in TWELVE_SLOTS) + "(.*)$"
    found = [F.regexp_extract(word, pattern, i + 1) for i in range(len(TWELVE_SLOTS) + 1)]
    return F.struct(F.array(*found[:-1]).alias("slots"), found[-1].alias("rest"))


def position_bin(i: Column, n: Column) -> Column:
    """p1, p2, three interior thirds m1 to m3, pL-1, pL, for place i (from 0) of n >= 5."""
    third = F.least(F.floor((i - 2) * 3 / F.greatest(n - 4, F.lit(1))), F.lit(2))
    return (
        F.when(i == 0, "p1").when(i == 1, "p2").when(i == n - 1, "pL").when(i == n - 2, "pL-1")
        .otherwise(F.concat(F.lit("m"), (third + 1).cast("int").cast("string")))
    )


def quintile_bin(i: Column, n: Column) -> Column:
    return F.concat(F.lit("P"), F.least(F.floor(i * 5 / F.greatest(n - 1, F.lit(1))), F.lit(4)).cast("int").cast("string"))


def word_features(word: Column) -> Column:
    """Array of (feature, value): length up to 7+, first and last character, whether it holds a gallows."""
    n = F.length(word)
    return F.array(
        F.struct(F.lit("len").alias("feature"), F.when(n < 7, n.cast("string")).otherwise("7+").alias("value")),
        F.struct(F.lit("first").alias("feature"), F.substring(word, 1, 1).alias("value")),
        F.struct(F.lit("last").alias("feature"), F.substring(word, -1, 1).alias("value")),
        F.struct(F.lit("gallows").alias("feature"), F.when(word.rlike("[tkpf]"), "1").otherwise("0").alias("value")),
    )


def section_by_number(n: Column) -> Column:
    """Sections by folio number; the first range that holds counts."""
    return (
        F.when((n <= 58) | n.between(65, 66), "herbal-A").when(n.between(67, 73), "zodiac").when(n.between(75, 84), "bio")
        .when(n.between(85, 86), "cosmo").when(n.isin(88, 89) | n.between(99, 102), "pharma")
        .when(n.between(87, 102), "herbal-B").when(n.between(103, 116), "text").otherwise("unknown")
    )


def section_by_number_2(n: Column) -> Column:
    """The second, coarser scheme."""
    return (
        F.when(n.between(103, 116), "recipe").when(n.between(75, 84), "balneo").when(n.between(67, 73), "astro")
        .when(n.between(85, 86), "cosmo").otherwise("herbal")
    )
