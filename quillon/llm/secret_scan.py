"""Secrets in text: fixed patterns, and password-like values in credential contexts judged by their guess cost."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_texts

# The base patterns and the lengths that their matches need.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs are taken, so asking for 16 drops the same runs as a later check
KINDS = ("assign", "access", "hex", "guess")

#: What may name a credential, and how its value follows: after ":" or "=", after "is", or as the second half of a URL's
#: user part. Wider than ASSIGN; the guess cost decides.
CONTEXT = re.compile(
    r"(?:(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|bearer)"
    r"(?:[\"']?\x20*[:=]\x20*|(?P<bare>\x20is\x20|\x20))[\"']?|://[^\s:/@]+:)(?P<value>[^\s\"'<>,;@]+)"
)
#: What follows a credential's name without ":" or "=" in running text: words in one case or capitalised, and numbers,
#: joined by signs as in "well-being" or "and/or", without a run of consonants that no word has. These are not scored there.
PROSE = re.compile(r"(?:[^\W\d_]?(?:(?![A-Z])[^\W\d_])*|[A-Z]+|\d+)(?:[-'’./_]+(?:[^\W\d_]?(?:(?![A-Z])[^\W\d_])*|[A-Z]+|\d+))*")
#: No word of running text has so many consonants in a row.
HARD = re.compile("[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{9}")
#: Values shorter than this are never reported.
SHORT = 8
#: log10 of guesses from which a value counts as a secret.
ENOUGH = 8.0

# Words that people build passwords from, most frequent first.
WORDS = (
    "password pass admin user root test guest login welcome master secret token key access letmein hello love monkey"
    " dragon sunshine princess shadow baseball football hockey soccer summer winter spring autumn january february march"
    " april june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
    " changeme default example sample demo temp server database mysql oracle postgres redis service system manager"
    " private public account company office internet computer windows linux google london paris berlin madrid the and"
    " for you not with this that from have what your none null true false string value here xxxx todo redacted"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
# The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4@31!0$57", "aaeiiosst")


def _neighbours() -> dict[str, str]:
    """Keys beside each key: left and right in its row, and those above and below."""
    at = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {c: "".join(d for d, (v, u) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1) for c, (y, x) in at.items()}


BESIDE = _neighbours()
DATE = re.compile(r"(?:19|20)\d\d(?:[-./_]?(?:0[1-9]|1[0-2])(?:[-./_]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:19|20)\d\d")


def alphabet(value: str) -> int:
    """How many characters a guesser by brute force tries at each place."""
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    n = sum(size for test, size in kinds if any(map(test, value)))
    return max(10, n + 33 * any(not c.isalnum() for c in value))


def runs(value: str) -> list[tuple[int, int, int]]:
    """Start, end and least period of each maximal stretch that holds its period twice or more, in values of any length.

    Such a stretch is found at a place whose longest Lyndon word, under the order of characters or its reverse, is as long as
    its period; suffixes are compared by hashes of their beginnings, so the work grows with the length and its logarithm.
    What the hashes find is then compared itself.
    """
    n, sums, powers, prime, base = len(value), [], [], (1 << 61) - 1, 1_000_003 * 998_244_353

    def same(i: int, j: int, size: int) -> bool:
        if size <= 256:
            return value[i : i + size] == value[j : j + size]
        if not sums:
            sums.append(0), powers.append(1)
            for c in value:
                sums.append((sums[-1] * base + ord(c) + 1) % prime), powers.append(powers[-1] * base % prime)
        return (sums[i + size] - sums[j + size] - (sums[i] - sums[j]) * powers[size]) % prime == 0

    def alike(i: int, j: int, most: int, step: int) -> int:
        """How many characters, `most` at most, from i and j on, or back from those before them, are the same."""
        k, size, grows = 0, 1, True
        while size:
            if k + size <= most and (same(i + k, j + k, size) if step > 0 else same(i - k - size, j - k - size, size)):
                k, size = k + size, size * 2 if grows else size // 2
            else:
                grows, size = False, size // 2
        return k

    found = set()
    for reverse in (False, True):
        after = [0] * n  # where the next smaller suffix starts
        ahead: dict[int, tuple[int, int]] = {}  # by distance: the last place compared, and how much was alike there
        back: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                at, known = ahead.get(j - i, (n - j + i, 0))
                k = alike(i, j, at - i, 1)
                k += known if k == at - i else 0
                ahead[j - i] = i, k
                if k == n - j or (value[i + k] < value[j + k]) == reverse:
                    break
                j = after[j]
            after[i] = j
            k = ahead[j - i][1] if j < n else 0
            at, known = back.get(j - i, (n, -1))
            b = known - (at - i) if at - i <= known else alike(i, j, i, -1)
            back[j - i] = i, b
            if k + b >= j - i:
                found.add((i - b, j + k, j - i))
    return sorted((a, b, p) for a, b, p in found if value[a : b - p] == value[a + p : b])


def pieces(value: str) -> list[tuple[int, int, float, str]]:
    """Spans of the value that a guesser knows how to make: start, end, log10 of the guesses, kind."""
    low, n, out = value.lower(), len(value), []
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for text, extra in ((low, 0.0), (plain, 0.6)):
                if text[i:j] in RANK:
                    upper = sum(c.isupper() for c in value[i:j])
                    case = 0.0 if not upper else 0.3 if upper == 1 and value[i].isupper() or upper == j - i else upper * 0.5
                    out.append((i, j, math.log10(RANK[text[i:j]] + 1) + extra + case, "word"))
                    break
    for m in DATE.finditer(value):
        out.append((*m.span(), 2.1 if m.end() - m.start() == 4 else 4.5, "date"))
    i = 0
    while i < n:  # a repeated character
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            out.append((i, j, 1.5 + math.log10(j - i), "repeat"))
        i = j
    for i, end, period in runs(value):  # a repeated block costs the block and the count; blocks of several periods repeat too
        each = math.log10(alphabet(value[i : i + period]))
        for size in range(period * (1 + (period == 1)), (end - i) // 2 + 1, period):
            times = (end - i) // size
            out.append((i, i + times * size, size * each + math.log10(times), "repeat"))
    i = 0
    while i < n - 1:  # a walk over neighbouring keys
        j = i + 1
        while j < n and low[j] in BESIDE.get(low[j - 1], ""):
            j += 1
        if j - i >= 3:
            straight = sum(low[k] in "".join(ROWS) and low[k : k + 2] in "|".join(ROWS) for k in range(i, j - 1))
            out.append((i, j, 1.6 + (j - i) * 0.1 + (j - i - 1 - straight) * 0.5, "walk"))
        i = max(j - 1, i + 1)
    i = 0
    while i < n - 1:  # consecutive code points
        step = ord(low[i + 1]) - ord(low[i])
        j = i + 1
        while abs(step) == 1 and j < n and ord(low[j]) - ord(low[j - 1]) == step:
            j += 1
        if j - i >= 3:
            out.append((i, j, 1.3 + math.log10(j - i), "sequence"))
        i = max(j - 1, i + 1)
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest way to cut the value into known pieces and brute-force spans.

    Dynamic programming over prefixes: best[j] is the least cost of the first j characters, each further piece of a cut
    costing 0.3 for its place. A brute-force span costs its alphabet per character and 0.5 once.
    """
    return _remembered(value) if len(value) <= 256 else _cost(value)


def _cost(value: str) -> float:
    n, each = len(value), math.log10(alphabet(value))
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost, _ in pieces(value):
        ending[j].append((i, cost + 0.3))
    best = [0.0] + [math.inf] * n  # of any cut
    brute = [math.inf] * (n + 1)  # of cuts that end in a brute-force span
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + 0.5) + each
        best[j] = min([brute[j], *(best[i] + cost for i, cost in ending[j])])
    return best[n]


_remembered = lru_cache(maxsize=50_000)(_cost)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' whole matches that are long enough, by start, then kind as in KINDS."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def guess_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Values in credential contexts that would cost a guesser ENOUGH, where no base span stands.

    What is not reported may itself name a credential ("auth token = ..."), so the search goes on at its start.
    """
    out, at = [], 0
    while m := CONTEXT.search(text, at):
        value = m["value"].rstrip(".:!?)]}")
        start, end = m.start("value"), m.start("value") + len(value)
        at = start
        if len(value) < SHORT or any(a < end and start < b for _, a, b in taken) or m["bare"] and PROSE.fullmatch(value) and not HARD.search(value):
            continue
        if (cost := guess_cost(value)) >= ENOUGH:
            out.append(("guess", start, end, cost))
            at = m.end()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its secrets as doc_id, base and spans, arrays of (kind, start, end, guesses).

    base: the fixed patterns assign, access and hex, leftmost and non-overlapping per kind, whole matches. spans: these
    and the kind guess: values of at least SHORT characters after a credential's name, in running text other than plain
    words and numbers, whose cheapest cut into words, dates, repeats, keyboard walks, sequences and brute-force spans takes 10 ** ENOUGH guesses
    or more, and which touch no base span. Places are code points, ends exclusive; both arrays are ordered by start,
    then kind. `guesses` is log10 of the guesses, null for base spans.

    docs: doc_id and text are read, others ignored. A null or empty text has no spans; repeated rows give a row each;
    an empty table gives none. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))
    names = ("kind", "start", "end", "guesses")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                own = base_spans(text)
                more = [(*x, None) for x in own] + guess_spans(text, own)
                base.append([dict(zip(names, (*x, None))) for x in own])
                spans.append([dict(zip(names, x)) for x in sorted(more, key=lambda x: (x[1], KINDS.index(x[0])))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"]
            )

    span = "array<struct<kind:string,start:long,end:long,guesses:double>>"
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(own, task, f"doc_id long, base {span}, spans {span}")
