"""The parts that need no Spark, against plain restatements."""

import random
import re
from collections import Counter as Multiset

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe, chat, decontam, packing, quality, secret_scan, token_counts

TEXT = st.text(alphabet=st.sampled_from("ab' \n\t.,9sreé\\#</turn>$|=:"), max_size=60)


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(bpe.default_path())


def test_every_common_character_has_the_same_ids_in_both_libraries(slow):
    b = bpe.load()
    for code in [*range(0x250), *range(0x2010, 0x2028)]:
        for text in (chr(code), f"a{chr(code)}b", f" {chr(code)} ", f"\n{chr(code)}{chr(code)}9", f"{chr(code)}'s"):
            assert b.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids, hex(code)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_ids(text):
    b = bpe.load()
    assert b.ids(text).tolist() == b.slow.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_text(slow):
    assert bpe.load().ids("a<|endoftext|>b").tolist() == slow.encode("a<|endoftext|>b", add_special_tokens=False).ids


#: With bits of a special token and characters that the libraries' tables may tell apart.
ODD = st.lists(st.sampled_from(["<|endof", "text|>", "<|endoftext|>", " ", "\n", "a", "9", "\U0001f600", "“", "ａ", "٣", "!", "'s", "\u2003"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=60)))
def test_pieces_are_those_of_tokenizers(text):
    b = bpe.load()
    assert "".join(b.pieces(text)) == text
    assert sum(map(b.piece_tokens, b.pieces(text))) == len(b.slow.encode(text, add_special_tokens=False).ids)


@settings(max_examples=600, deadline=None)
@given(text=st.one_of(TEXT, ODD), edits=st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), st.one_of(TEXT, ODD)), max_size=5), leaf=st.integers(1, 5))
def test_edited_counts_are_those_of_the_edited_text(text, edits, leaf):
    was = token_counts.LEAF, token_counts.GROWN
    token_counts.LEAF, token_counts.GROWN = leaf, 4 * leaf
    try:
        coder = token_counts.Coder()
        tree = token_counts.TokenTree.of(text, coder)
        for start, length, new in edits:
            tree.edit(start, length, new)
            text = text[:start] + new + text[start + length :]
            assert tree.text() == text
            assert tree.n_chars == len(text)
            pieces = coder.pieces(text)
            assert tree.lens() == list(map(len, pieces)) and tree.counts() == coder.counts(pieces)
            assert tree.n_tokens == len(bpe.load().slow.encode(text, add_special_tokens=False).ids)
    finally:
        token_counts.LEAF, token_counts.GROWN = was


def test_an_edit_of_a_long_text_encodes_little_again():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(20_000))
    tree = token_counts.TokenTree.of(text, token_counts.Coder())
    for _ in range(50):
        at, n, new = r.randrange(len(text)), r.randint(0, 30), "x y" * r.randint(0, 5)
        tree.edit(at, n, new)
        text = text[:at] + new + text[at + n :]
    assert tree.text() == text
    assert tree.n_tokens == len(bpe.load().ids(text))
    assert 0 < tree.encoded_chars < 50 * 100


@given(text=TEXT)
def test_escapes_are_reversible_and_hide_control_strings(text):
    told = chat.escape(text)
    assert chat.unescape(told) == text
    assert "##" not in told and "</" not in told
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@given(turns=st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_parse_reads_back_what_was_formatted(turns):
    told = "".join(chat.OPEN + chat.escape_role(r) + chat.BREAK + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(told)] == turns


def plain_measure(text):
    words = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Multiset(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@settings(max_examples=300)
@given(text=st.text(alphabet=st.sampled_from("ab \n\t\r\x0b#|é "), max_size=60))
def test_measure(text):
    assert quality.measure(text) == plain_measure(text)


@given(n=st.integers(1, 5000))
def test_cut(n):
    lengths = packing.cut(n, 1024)
    assert sum(lengths) == n and all(0 < x <= 1024 for x in lengths)


def test_packer_wastes_little():
    r = random.Random(2)
    packer, placed, total = packing.Packer(1024, 0), [], 0
    for doc in range(3000):
        n = r.randint(1, 3000)
        total += n
        start = 0
        for length in packing.cut(n, 1024):
            placed += packer.add(length, (doc, start))
            start += length
    placed += packer.finish()
    fill = Multiset()
    for sequence, at, length, _ in placed:
        assert fill[sequence] == at
        fill[sequence] += length
    assert sum(fill.values()) == total and max(fill.values()) <= 1024
    assert total / (1024 * len(fill)) > 0.97


def plain_hits(text, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            part = v[k : k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(item))
    return len(w), hit, found


@settings(max_examples=300, deadline=None)
@given(
    text=st.text(alphabet=st.sampled_from("abA .é\n"), max_size=50),
    items=st.lists(st.text(alphabet=st.sampled_from("aBé ."), max_size=14), max_size=5),
    limit=st.sampled_from([1, 10, 10_000]),
)
def test_hits(text, items, limit):
    n, hit, found = decontam.hits(None, text)
    for b in decontam.blocks(list(enumerate(items)), 3, limit):
        _, own, told = decontam.hits(decontam.automaton(b), text)
        hit, found = own if hit is None else hit if own is None else hit | own, found | told
    assert (n, set() if hit is None else set(np.flatnonzero(hit).tolist()), found) == plain_hits(text, list(enumerate(items)), 3)
    for span in [] if hit is None else decontam.spans(text, hit):
        assert text[span["start"] : span["end"]].strip(" .\n") == text[span["start"] : span["end"]] != ""


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("password") < 1 and cost("password1999") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4
    assert cost("xK9#mQ2$vL7p") > 15 and cost("hunter2hunter2hunter2") < cost("hunter2") + 3
    assert cost("a" * 5000) < 6 and cost("xK9#mQ2$vL7pTr5&wB3z" * 40) < cost("xK9#mQ2$vL7pTr5&wB3z") + 4
    # whole values, not beginnings: the end makes the beginning cheaper or dearer
    assert cost("a" * 119 + "wednesday333") < 9 < cost("a" * 119 + "wednkzQ9!xe33")


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.tuples(st.text(alphabet=st.sampled_from("ab\U0001f600"), min_size=1, max_size=9), st.integers(1, 5)), min_size=1, max_size=7))
def test_runs_hold_all_repeated_blocks(parts):
    value = "".join(t * n for t, n in parts)
    n, plain = len(value), set()
    for size in range(2, n // 2 + 1):
        for i in range(n - 2 * size + 1):
            if value[i : i + size] == value[i + size : i + 2 * size] and (i == 0 or value[i - 1] != value[i - 1 + size]):
                end = i
                while end + size < n and value[end] == value[end + size]:
                    end += 1
                plain.add((i, i + (end + size - i) // size * size, size))
    told = {(a, a + (b - a) // s * s, s) for a, b, p in secret_scan.runs(value) for s in range(p, (b - a) // 2 + 1, p) if s > 1}
    assert told == plain


def test_a_long_block_repeats_in_a_value_of_any_length():
    r = random.Random(3)
    block = "".join(r.choice("abcdefghijkmnopqrstuvwxyz") for _ in range(101))
    short, long = (secret_scan.guess_cost(block * n) for n in (600, 700))  # 60,600 and 70,700 characters
    assert long - short == pytest.approx(__import__("math").log10(7 / 6), abs=1e-6)


@settings(max_examples=200, deadline=None)
@given(value=st.text(alphabet=st.sampled_from("password12qaz9X#"), min_size=1, max_size=9))
def test_guess_cost_is_the_least_of_all_cuts(value):
    import math

    each, known = math.log10(secret_scan.alphabet(value)), secret_scan.pieces(value)

    def least(at, brute):
        if at == len(value):
            return 0.0
        ways = [each + (0 if brute else 0.5) + least(at + 1, True)]
        ways += [c + 0.3 + least(j, False) for i, j, c, _ in known if i == at]
        return min(ways)

    assert secret_scan.guess_cost(value) == pytest.approx(least(0, False))


def test_base_spans():
    text = 'x password: "abcdefghijkl" token=short passwd=token: abcdefghijklmnop AKIAABCDEFGHIJKLMN 0123456789abcdef ſecret=zzzzzzzzzzzzzzzz'
    found = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in found] == [
        ("assign", 'password: "abcdefghijkl'),
        ("access", "AKIAABCDEFGHIJKLMN"),
        ("hex", "0123456789abcdef"),
    ]
    more = secret_scan.guess_spans("the password is xK9mQ2vL7p, or password is password1", [])
    assert [x[:3] for x in more] == [("guess", 16, 26)]


def test_the_cost_decides_for_every_value():
    def found(text):
        return [text[a:b] for _, a, b, _ in secret_scan.guess_spans(text, [])]

    assert found("pwd: kT!zQ#wErPm and bearer XkQzPwVbNmTrLs here") == ["kT!zQ#wErPm", "XkQzPwVbNmTrLs"]
    assert found("auth token = kT!zQ#wErPm") == found("secret password is kT!zQ#wErPm") == ["kT!zQ#wErPm"]
    assert found("the secret understanding of Token Economies, a PASSWORD PROTECTED well-being, pass 1990-2000") == []
    assert found("pwd = passwordpassword, pwd = aaaaaaaaaaaa") == []
    tail = "a" * 1000 + "kT!zQ#wErPm9x"
    assert found(f"pwd = {tail}") == [tail] and found("pwd = " + "a" * 5000) == []
    assert found("https://user:XkQzPwVbNm@host") == ["XkQzPwVbNm"]
    assert found("https://" + "u" * 80 + ":XkQzPwVbNm@host") == found("pwd" + " " * 30 + "=   XkQzPwVbNm") == ["XkQzPwVbNm"]
    assert found("the password is xkqjzvwpmrtyhgfd") == ["xkqjzvwpmrtyhgfd"] and found("the Password is Angstschweiß") == []
    assert found("pASSWORD is xK9#qjZv2wP") == found("Password IS: xK9#qjZv2wP password is xK9#qjZv2wP") == ["xK9#qjZv2wP"]


def plain_base_spans(text):
    """Character by character, from the rule's words."""
    def run(at, ok):
        end = at
        while end < len(text) and text[end] in ok:
            end += 1
        return end

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = set(letters + letters.lower() + "0123456789+/_.=-")
    out = []
    at = 0
    while at < len(text):
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if "".join(c.lower() if c in letters else c for c in text[at : at + len(name)]) == name:
                i = at + len(name)
                i = run(i + (text[i : i + 1] in ('"', "'") and i < len(text)), " ")
                if text[i : i + 1] in (":", "=") and i < len(text):
                    i = run(i + 1, " ")
                    i += i < len(text) and text[i] in "\"'"
                    end = run(i, value)
                    if end > i:
                        if end - i >= 12:
                            out.append((at, 0, "assign", end))
                        at = end - 1
                        break
        at += 1
    for order, kind, head, ok, least in ((1, "access", "AKIA", set(letters + "0123456789"), 18), (2, "hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            if text.startswith(head, at) and (end := run(at + len(head), ok)) > at + len(head):
                if end - at >= least:
                    out.append((at, order, kind, end))
                at = end
            else:
                at += 1
    return [(k, a, e) for a, _, k, e in sorted(out)]


PARTS = ["password", "ApI_KeY", "apikey", "token", "Secret", ":", "=", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJ", "0123456789abcdef", "abcdefgh1234", "zz", "é", "\n", "ſ", "A1B2"]


@settings(max_examples=1500, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_against_a_plain_matcher(text):
    assert secret_scan.base_spans(text) == plain_base_spans(text)


@settings(max_examples=200, deadline=None)
@given(data=st.data())
def test_spans_of_built_texts(data):
    """Texts put together from contexts whose values are known."""
    text, expected = "", []
    for _ in range(data.draw(st.integers(0, 4))):
        text += data.draw(st.sampled_from(["some words here. ", "é\n", "a list: ", ""]))
        text += data.draw(st.sampled_from(["passphrase: ", "Bearer ", "my PWD='", "auth = ", "the credentials is ", "ftp://me:"]))
        value, hot = data.draw(st.sampled_from([("kT!zQ#wErPm9", True), ("Password1999", False), ("qwertyuiop", False), ("aaaaaaaaaaaaaaaa", False), ("Zx9$Lq2&Vb", True), ("short1!", False)]))
        if hot:
            expected.append((len(text), len(text) + len(value)))
        text += value + data.draw(st.sampled_from(["\n", "' ", " and then "]))
    assert [(a, b) for _, a, b, _ in secret_scan.guess_spans(text, [])] == expected
