"""Encodings of words as column expressions: the control corpora that statistics are held against.

Where a scheme needs chance, it is a hash of a seed and of what it decides about, so a corpus is the same on any number of
machines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
VOWELS = "aeiou"
CONSONANTS = "".join(c for c in ALPHABET if c not in VOWELS)


def order_by_hash(items: Sequence[str], seed: str) -> list[str]:
    """The items in an order drawn by a seed."""
    import hashlib

    return sorted(items, key=lambda x: hashlib.md5(f"{seed}|{x}".encode()).hexdigest())


def substitution(seed: str, alphabet: str = ALPHABET) -> dict[str, str]:
    """A random one-to-one alphabet."""
    return dict(zip(alphabet, order_by_hash(alphabet, seed)))


def codes(items: Sequence[str], seed: str, sizes: tuple[int, ...] = (2,), letters: str = "odaykelchr") -> dict[str, str]:
    """A code of its own for each item: words over `letters` in drawn order, `sizes` taken in turn."""
    import itertools

    pools = {n: iter(order_by_hash(["".join(x) for x in itertools.product(letters, repeat=n)], f"{seed}{n}")) for n in set(sizes)}
    return {x: next(pools[sizes[i % len(sizes)]]) for i, x in enumerate(items)}


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def pick(word: Column, i: Column, n: int, seed: str) -> Column:
    """A number below n for the i-th letter of a word."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), word, i.cast("string"))), 1, 8), 16, 10).cast("long")
    return (h % n).cast("int")


def chance(word: Column, i: Column, seed: str) -> Column:
    return pick(word, i, 1_000_000, seed) / 1_000_000.0


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def translate(word: Column, table: dict[str, str]) -> Column:
    """One-to-one letters."""
    return F.translate(word, "".join(table), "".join(table.values()))


def verbose(word: Column, table: dict[str, str]) -> Column:
    """Each letter as a string of several."""
    m = literal_map(table)
    return F.array_join(F.transform(letters(word), lambda c: F.coalesce(F.element_at(m, c), c)), "")


def abjad(word: Column) -> Column:
    """Vowels dropped; a word of vowels alone keeps its first."""
    out = F.translate(word, VOWELS, "")
    return F.when(out != "", out).otherwise(F.substring(word, 1, 1))


def homophonic(word: Column, fan_out: int = 3, seed: str = "homophonic") -> Column:
    """Each letter with one of `fan_out` marks."""
    return F.array_join(F.transform(letters(word), lambda c, i: F.concat(c, pick(word, i, fan_out, seed).cast("string"))), "")


def syllabic_split(word: Column) -> Column:
    """A word of its own from each consonant that follows a vowel: an array."""
    return F.split(word, f"(?<=[{VOWELS}])(?=[^{VOWELS}])")


def word_per_letter(word: Column, table: dict[str, str]) -> Column:
    """Each letter as a word: an array."""
    m = literal_map(table)
    return F.transform(letters(word), lambda c: F.coalesce(F.element_at(m, c), c))


def anagram(word: Column, seed: str = "anagram") -> Column:
    """The letters in an order drawn for the word."""
    keyed = F.transform(letters(word), lambda c, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), word, i.cast("string"))).alias("k"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")


def pairs_to_symbols(word: Column, table: dict[str, str], overlap: bool = False) -> Column:
    """Pairs of letters as symbols, side by side or overlapping; an odd last letter and unknown pairs stay."""
    m = literal_map(table)
    units = (
        F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array(word))
        if overlap
        else F.regexp_extract_all(word, F.lit("(..|.)"), 1)
    )
    return F.array_join(F.transform(units, lambda u: F.coalesce(F.element_at(m, u), u)), "")


def syllabic(word: Column, table: dict[str, str]) -> Column:
    """Syllables as codes; unknown ones stay."""
    m = literal_map(table)
    return F.array_join(F.transform(T.syllables(word), lambda s: F.coalesce(F.element_at(m, s), s)), "")


def onset_rime(word: Column, onsets: dict[str, str], rimes: dict[str, str]) -> Column:
    """The consonants before a syllable's vowel and the rest, coded apart."""
    a, b = literal_map(onsets), literal_map(rimes)

    def one(s: Column) -> Column:
        onset = F.regexp_extract(s, f"^([^{VOWELS}]*)", 1)
        rime = F.substring(s, F.length(onset) + 1, F.length(s))
        return F.concat(F.coalesce(F.element_at(a, onset), onset), F.coalesce(F.element_at(b, rime), rime))

    return F.array_join(F.transform(T.syllables(word), one), "")


def positional(word: Column, first: dict[str, str], inner: dict[str, str], last: dict[str, str], only: str = "") -> Column:
    """Letters coded by place in the word: first, last, between; `only` restricts this to some letters."""
    a, b, c = literal_map(first), literal_map(inner), literal_map(last)
    n = F.length(word)

    def one(x: Column, i: Column) -> Column:
        own = F.when(i == 0, F.element_at(a, x)).when(i == n - 1, F.element_at(c, x)).otherwise(F.element_at(b, x))
        return F.when(x.isin(*only), F.coalesce(own, x)).otherwise(F.coalesce(F.element_at(b, x), x)) if only else F.coalesce(own, x)

    return F.array_join(F.transform(letters(word), one), "")


def zones(word: Column, tables: Sequence[dict[str, str]]) -> Column:
    """Letters coded by zone: the word cut into as many equal parts as there are tables."""
    maps, n = [literal_map(t) for t in tables], F.length(word)

    def one(x: Column, i: Column) -> Column:
        z = F.floor(i * len(maps) / n)
        out = F.element_at(maps[-1], x)
        for k in range(len(maps) - 2, -1, -1):
            out = F.when(z == k, F.element_at(maps[k], x)).otherwise(out)
        return F.coalesce(out, x)

    return F.array_join(F.transform(letters(word), one), "")


def graduated(word: Column, table: dict[str, str], marks: tuple[str, str] = ("q", "y")) -> Column:
    """A verbose code with a mark before the first letter and one after the last."""
    return F.concat(F.lit(marks[0]), verbose(word, table), F.lit(marks[1]))


def pooled(word: Column, shared: Sequence[str], unique: dict[str, str], seed: str = "pool") -> Column:
    """Vowels from a shared pool by chance, consonants by codes of their own."""
    pool, m = F.array(*map(F.lit, shared)), literal_map(unique)
    return F.array_join(
        F.transform(
            letters(word),
            lambda c, i: F.when(c.isin(*VOWELS), F.get(pool, pick(word, i, len(shared), seed))).otherwise(F.coalesce(F.element_at(m, c), c)),
        ),
        "",
    )


def vowel_expansion(word: Column, share: float, table: dict[str, str], seed: str = "expand") -> Column:
    """Each vowel becomes two characters with a chance of `share`."""
    m = literal_map(table)
    return F.array_join(
        F.transform(
            letters(word),
            lambda c, i: F.when(c.isin(*VOWELS) & (chance(word, i, seed) < share), F.coalesce(F.element_at(m, c), c)).otherwise(c),
        ),
        "",
    )


def truncate(word: Column, most: int) -> Column:
    return F.substring(word, 1, most)


# Scribal abbreviations of endings and beginnings, longest first.
ENDINGS = (("tionem", "9"), ("orum", "4"), ("arum", "4"), ("tion", "9"), ("ment", "m"), ("ing", "g"), ("bus", "b"), ("que", "q"), ("er", "2"), ("us", "9"), ("um", "3"))
BEGINNINGS = (("inter", "i"), ("trans", "t"), ("con", "9"), ("com", "9"), ("per", "p"), ("pre", "p"), ("pro", "p"))


def abbreviate(word: Column, density: float = 1.0, seed: str = "abbreviate") -> Column:
    """The first ending that the word has, then the first beginning, as signs, for a share `density` of the words."""
    end, rest = F.lit(""), word
    for a, b in reversed(ENDINGS):
        hit = F.endswith(word, F.lit(a)) & (F.length(word) > len(a) + 1)
        end = F.when(hit, F.lit(b)).otherwise(end)
        rest = F.when(hit, F.substring(word, F.lit(1), F.length(word) - len(a))).otherwise(rest)
    out = F.concat(rest, end)
    for a, b in reversed(BEGINNINGS):
        out = F.when(F.startswith(rest, F.lit(a)) & (F.length(rest) > len(a)), F.concat(F.lit(b), F.substring(rest, F.lit(len(a) + 1), F.length(rest)), end)).otherwise(out)
    return F.when(chance(word, F.lit(0), seed) < density, out).otherwise(word)


def coded(word: Column, table: dict[str, str]) -> Column:
    """Whole words as codes, unknown ones as they are."""
    return F.coalesce(F.element_at(literal_map(table), word), word)


def to_alphabet(word: Column, alphabet: str) -> Column:
    """Any letter as one of a smaller alphabet, by its place in the larger one."""
    return F.translate(word, ALPHABET, "".join(alphabet[i % len(alphabet)] for i in range(26)))


def variant(word: Column, kind: str) -> Column:
    """plain, abjad, or the first four letters."""
    return {"plain": word, "abjad": abjad(word), "abbrev4": truncate(word, 4)}[kind]


def phonetic(word: Column, table: dict[str, str]) -> Column:
    """Longest-first replacement of letter groups."""
    return F.array_join(T.map_units(word, table), "")


def positional_rules(word: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Signs read by their place: (place, sign, reading), place start, end or any; the first rule that fits each place."""
    out = word
    for place, sign, reading in rules:
        pattern = {"start": f"^{sign}", "end": f"{sign}$", "any": sign}[place]
        out = F.regexp_replace(out, pattern, reading)
    return out
