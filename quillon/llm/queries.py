"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontam, licenses, line_dedup, ngram_join, packing, quality, secret_scan, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op2_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits: words put in after a quarter, a word replaced halfway, a cut at three quarters."""
    docs = _read(spark, sf_dir, "documents")
    n = F.length(F.coalesce(F.col("text"), F.lit("")))

    def edit(at: Column, length: int, text: str) -> Column:
        return F.struct(at.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(text).alias("text"))

    edits = F.array(
        edit(F.floor(n / 4), 0, " some words,\n put in"), edit(F.floor(n / 2), 5, "Edited"), edit(F.floor(n * 3 / 4), 40, "")
    )
    return token_counts.count(docs.select("doc_id", "text", edits.alias("edits")))


def _digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(_digest("base"), 256).alias("base_sha256"),
        _digest("spans").alias("spans"),
        F.round(F.array_max(F.transform("spans", lambda x: x["guesses"])), 3).alias("most_guesses_log10"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"),
    )


def _chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return told.unionByName(extra)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.expand(_chat_rows(spark, sf_dir)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents"), words=4, percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("dropped").cast("long").alias("n_dropped"),
        "n_near",
        F.array_join("dropped", ",").alias("dropped_lines"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, sentences=True).select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.to_json("sentences").alias("sentences"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_edit_aware_token_counts,
        op3_secret_scan,
        op4_benchmark_decontamination,
        op5_chat_formatting,
        op6_ngram_jaccard_join,
        op7_line_dedup,
        op8_toxicity,
        op9_license_scan,
        op10_harmonic_packing,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
l as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
f as (
  select w.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from w left join l using (doc_id) left join r using (doc_id)),
m as (
  select *, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as measure,
         unnest([n_symbols * 100000 // (word_chars + n_symbols + 1), n_dup_lines * 100000 // (n_dup_lines + n_words + 1),
                 n_repeat_words * 100000 // (n_words + 1), word_chars * 1000 // (n_words + 1)]) as v from f),
d as (select *, case when v < 64 then 0 else floor(log2(v))::bigint end as p from m),
b as (  -- the largest value of v's bucket: 32 buckets a doubling
  select *, case when v < 64 then v else ((v >> (p - 5)) + 1) * (1 << (p - 5)) - 1 end as e from d),
s as (select lang, source, measure, e, count(*) as n from b where n_words > 0 group by all),
own as (
  select lang, source, measure, max(total) as total, min(e) filter (upto * 4 >= total) as q1, min(e) filter (upto * 4 >= total * 3) as q3
  from (select *, sum(n) over (partition by lang, source, measure order by e) as upto, sum(n) over (partition by lang, source, measure) as total from s) group by all),
bl as (
  select lang, measure, max(total) as total, min(e) filter (upto * 4 >= total) as q1, min(e) filter (upto * 4 >= total * 3) as q3
  from (select *, sum(n) over (partition by lang, measure order by e) as upto, sum(n) over (partition by lang, measure) as total
        from (select lang, measure, e, sum(n) as n from s group by all)) group by all),
ev as (
  select measure, min(e) filter (upto * 4 >= total) as q1, min(e) filter (upto * 4 >= total * 3) as q3
  from (select *, sum(n) over (partition by measure order by e) as upto, sum(n) over (partition by measure) as total
        from (select measure, e, sum(n) as n from s group by all)) group by all),
q as (
  select own.lang, own.source, own.measure,
         case when own.total >= 200 then own.q1 when bl.total >= 200 then bl.q1 else ev.q1 end as q1,
         case when own.total >= 200 then own.q3 when bl.total >= 200 then bl.q3 else ev.q3 end as q3
  from own left join bl using (lang, measure) left join ev using (measure)),
z as (select *, greatest(q3 - q1, q3 // 8, map {'symbols': 500, 'dup_lines': 750, 'repeats': 2500, 'word_length': 0}[measure]) as spread from q),
x as (
  select b.doc_id, b.measure, v, q1 - 4 * spread as low, q3 + 4 * spread as high
  from b left join z on z.lang = b.lang and z.source = b.source and z.measure = b.measure),
y as (
  select doc_id, string_agg(measure, ',' order by array_position(['symbols', 'dup_lines', 'repeats', 'word_length'], measure)) as failed
  from x where v > high or measure = 'word_length' and v < low group by doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and failed is null as kept, coalesce(failed, '') as failed
from f left join y using (doc_id)"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
with b as (select item_id, {_WORDS} as w from benchmark where text is not null),
win as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select *, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
d as (select doc_id, coalesce({_WORDS}, []) as w, coalesce(text, '') as text from documents),
p as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from win) where len(w) >= k),
hit as (select doc_id, i, p.k, item_id from p join win on win.k = p.k and win.g = array_to_string(w[i:i + p.k - 1], ' ')),
j as (select distinct doc_id, unnest(range(i, i + k)) as j from hit),
places as (select doc_id, count(*) as n from j group by doc_id),
its as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id),
gaps as (  -- what stands before each word, and the words' own lengths, add up to their places
  select doc_id, w, regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as g from d where doc_id in (select doc_id from j)),
ats as (
  select doc_id, k, sum(length(w[k]) + length(g[k])) over (partition by doc_id order by k) as upto, length(w[k]) as own
  from (select *, unnest(range(1, len(w) + 1)) as k from gaps)),
isle as (select j.doc_id, j, upto - own as s, upto as e, j - row_number() over (partition by j.doc_id order by j) as run from j join ats on ats.doc_id = j.doc_id and ats.k = j.j),
runs as (select doc_id, min(s)::bigint as s, max(e)::bigint as e from isle group by doc_id, run),
told as (select doc_id, string_agg(s || ':' || e, ',' order by s) as spans from runs group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(places.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, places.n is not null as contaminated, coalesce(spans, '') as spans
from d left join places using (doc_id) left join its using (doc_id) left join told using (doc_id)"""

OP5_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (  -- an escaped text is longer by its backslashes, its "</" and each "#" after a "#"
  select *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</', ''))) // 2
              + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: length(x) - 1)), 0) as t,
            length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '</', ''))) // 2
              + coalesce(list_sum(list_transform(regexp_extract_all(role, '#+'), lambda x: length(x) - 1)), 0) + (length(role) - length(replace(role, chr(10), ''))) as r
  from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(t + r + 13)::bigint as formatted_chars
from e group by conv_id"""

OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach as (select doc_id, doc_id as r from w union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.r as component_id
from w left join n using (doc_id) join (select doc_id, min(r) as r from reach group by doc_id) m using (doc_id)"""

#: DuckDB's levenshtein counts bytes, so other letters than ASCII are first written as unused ASCII characters.
OP7_SQL = r"""
with l as (
  select doc_id, no - 1 as line_no, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as no from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))),
k as (select line, min({'d': doc_id, 'n': line_no}) as first, length(line) as len from l where line <> '' group by line),
c as (select distinct unnest(string_split(line, '')) as c from k),
far as (select c, row_number() over (order by c) as i from c where unicode(c) > 127),
free as (select x, row_number() over (order by x) as i from (select unnest(range(1, 128)) as x) where chr(x::int) not in (select c from c)),
t as (select coalesce(string_agg(c, '' order by i), '') as f, coalesce(string_agg(chr(x::int), '' order by i), '') as g from far left join free using (i)),
p as (select k.*, translate(line, f, g) as s from k, t where len >= 10),
q as (select *, unnest([-2, -1, 0, 1, 2]) as shift from p),
near as (
  select distinct q.line from q join p on p.len = q.len + q.shift
  where p.first < q.first and abs(shift) <= least(p.len, q.len) // 10 and levenshtein(p.s, q.s) <= least(2, least(p.len, q.len) // 10)),
gone as (
  select l.doc_id, l.line_no, near.line is not null as near from l join k using (line) left join near on near.line = l.line
  where near.line is not null or l.doc_id <> first.d or l.line_no <> first.n)
select d.doc_id, count(gone.doc_id) as n_dropped, count(*) filter (near) as n_near, coalesce(string_agg(line_no::varchar, ',' order by line_no), '') as dropped_lines
from (select distinct doc_id from documents) d left join gone using (doc_id) group by d.doc_id"""



def _op9_sql() -> str:
    """The same index as rows: votes by aligned place, mandatory phrases in the text's vocabulary words."""
    plain = {t: [w for w in text.split() if w not in licenses.COMMON] for t, (_, text) in enumerate(licenses.TEMPLATES)}
    posts = ", ".join(f"('{w}', {t}, {i})" for t, (_, text) in enumerate(licenses.TEMPLATES) for i, w in enumerate(text.split()) if w in plain[t])
    sizes = ", ".join(f"({t}, '{licenses.TEMPLATES[t][0]}', {len(set(w))})" for t, w in plain.items())
    phrases = ", ".join(f"('{label}', '{' '.join(w for w in p.split() if w not in licenses.COMMON)}')" for label, ps in licenses.MANDATORY.items() for p in ps)
    base = " union all ".join(
        f"select doc_id, i, '{label}' as label from seq where " + " and ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split())) for p, label in licenses.BASE
    )
    vocabulary = ", ".join(f"'{w}'" for w in licenses.VOCABULARY)
    return f"""
with d as (select doc_id, {_WORDS.replace("(text", "(coalesce(text, '')")} as ws from documents),
tok as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from d),
seq as (select doc_id, i, w as w0, lead(w) over x as w1, lead(w, 2) over x as w2 from tok window x as (partition by doc_id order by i)),
bs as ({base}),
bases as (select doc_id, count(*) as n, min(i) as a, max(i) as b, list_sort(list(distinct label)) as labels from bs group by doc_id),
hits as (select * from tok where w in ({vocabulary})),
told as (
  select doc_id, string_agg(case when i - before <= 3 then ' ' else ' | ' end || w, '' order by i) || ' ' as t
  from (select *, lag(i) over (partition by doc_id order by i) as before from hits) group by doc_id),
posts(w, template, p) as (values {posts}),
sizes(template, label, size) as (values {sizes}),
phrases(label, phrase) as (values {phrases}),
votes as (select doc_id, template, i - p as place, count(distinct w) as agree from hits join posts using (w) group by all),
cand as (select doc_id, label, max(least(1.0::double, agree / least(size, {licenses.FULL}))) as share from votes join sizes using (template) where agree >= least({licenses.AGREE}, size) group by all),
sure as (select distinct cand.* from cand join told using (doc_id) join phrases using (label) where contains(t, ' ' || phrase || ' ')),
found as (select doc_id, list(label) as labels, max(share) as share from sure group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, b::bigint as last_word,
       array_to_string(coalesce(bases.labels, []), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(found.labels, [])))), ',') as labels,
       case when n is not null then 1.0 else coalesce(share, 0.0) end::double as score
from d left join bases using (doc_id) left join found using (doc_id)"""


OP9_SQL = _op9_sql()

#: Queries that train, tokenise or judge by a method SQL lacks are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_license_scan": OP9_SQL,
}
