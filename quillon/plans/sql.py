"""DuckDB SQL that the oracles share: documents as lines, tokens, pairs and characters, written apart from the plans."""

LINES = """
lines as (
  select corpus, source, doc_id, line_no, words from (
    select lang as corpus, source, doc_id, generate_subscripts(ls, 1) - 1 as line_no,
           regexp_extract_all(lower(unnest(ls)), '([\\p{L}]+)', 1) as words
    from (select *, string_split(text, chr(10)) as ls from documents))
  where len(words) > 0)"""

TOKENS = LINES + """,
tokens as (
  select corpus, source, doc_id, line_no, generate_subscripts(words, 1) - 1 as pos, len(words) as line_len,
         unnest(words) as word from lines)"""

COUNTS = TOKENS + """,
counts as (select corpus, word, count(*) as n from tokens group by all)"""

ORDERED = TOKENS + """,
ordered as (
  select *, row_number() over (partition by corpus order by doc_id, line_no, pos) - 1 as ord from tokens)"""

CHARS = TOKENS + """,
chars as (
  select corpus, doc_id, line_no, pos, generate_subscripts(cs, 1) - 1 as i, unnest(cs) as c
  from (select *, string_split(word, '') as cs from tokens))"""

PAIRS = LINES + """,
pairs as (
  select corpus, doc_id, line_no, i as pos, words[i] as a, words[i + 1] as b
  from (select *, unnest(range(1, len(words))) as i from lines))"""

#: Entropy in bits of a column of counts in a group.
H = "coalesce(-sum({n} / {t} * log2({n} / {t})), 0)"


def entropy_of(source: str, by: str, value: str, out: str) -> str:
    """A CTE body: entropy of `value` by group, from shares."""
    return (
        f"select {by}, -sum(p * log2(p)) as {out} from (select {by}, {value}, count(*) * 1.0 / sum(count(*)) over "
        f"(partition by {by}) as p from {source} group by {by}, {value}) group by {by}"
    )


#: DuckDB's levenshtein counts bytes: letters beyond ASCII are first written as ASCII characters that no word has.
ALPHABET = """
far as (select c, row_number() over (order by c) as i from (select distinct unnest(string_split(word, '')) as c from counts) where unicode(c) > 127),
alphabet as (select coalesce(string_agg(c, '' order by i), '') as f, coalesce(string_agg(chr((i + 32)::int), '' order by i), '') as g from far where i <= 64)"""


def distance(a: str, b: str) -> str:
    """Edit distance in characters; `alphabet` must be among the tables."""
    return f"levenshtein(translate({a}, f, g), translate({b}, f, g))"


def replaced(value: str, pairs) -> str:
    """A list of replacements, one after the other."""
    for x, y in pairs:
        value = f"replace({value}, '{x}', '{y}')"
    return value
