"""Licence notices, found by a positional index of the templates' rare words; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as licence stewards publish them, in lower case, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"
               " http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
)

# The phrases of which a notice must hold one to bear the label.
MANDATORY: dict[str, tuple[str, ...]] = {
    "mit": ("mit license", "permission hereby granted free charge"),
    "apache": ("apache license", "apache org licenses license"),
    "gpl": ("gnu general public license",),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "bsd": ("redistribution use source binary forms", "bsd style license"),
    "mpl": ("mozilla public license",),
    "isc": ("permission use copy modify distribute software",),
    "cc-by": ("cc by 4 0", "creative commons attribution 4 0"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"),
    "cc-by-nd": ("cc by nd",),
    "cc0": ("waived copyright related neighboring rights",),
    "unlicense": ("free unencumbered software released public domain",),
    "reserved": ("rights reserved",),
}

# Template words too common in any text to be looked up.
COMMON = frozenset("a all and any are as at for following in into is it not of or provided that the this to under with you".split())

#: How many of a template's words must agree on one place: for the full score, and for a candidate.
FULL, AGREE = 8, 3


def _index() -> dict[str, list[tuple[int, int]]]:
    """Word to (template, position), for the words that are looked up."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text) in enumerate(TEMPLATES):
        for i, w in enumerate(text.split()):
            if w not in COMMON:
                out.setdefault(w, []).append((t, i))
    return out


INDEX = _index()
VOCABULARY = sorted(set(INDEX) | {w for p, _ in BASE for w in p.split()})


def _at(hits: str, phrase: str) -> Column:
    """Word positions at which a phrase of vocabulary words stands consecutively.

    `hits` holds a text's vocabulary words in order with their positions, so consecutive words are consecutive hits.
    """
    words = phrase.split()

    def here(h: Column, j: Column) -> Column:
        own = h["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            later = F.get(F.col(hits), j + k)
            own = own & F.coalesce((later["w"] == w) & (later["i"] == h["i"] + k), F.lit(False))
        return own

    return F.transform(F.filter(hits, here), lambda h: h["i"])


def _told(hits: str) -> Column:
    """The vocabulary words as one string; "|" where more than two other words, none of them looked up, are left out."""

    def piece(h: Column, j: Column) -> Column:
        before = F.get(F.col(hits), j - 1)["i"]
        return F.concat(F.when(F.coalesce(h["i"] - before <= 3, F.lit(False)), F.lit(" ")).otherwise(F.lit(" | ")), h["w"])

    return F.concat(F.array_join(F.transform(hits, piece), ""), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (positions), base_labels, labels, score, matches.

    The texts are read once: words after A-Z became a-z, the number of them, and the few that occur in a template, with
    their positions, go to a table. Every one of them is looked up in the templates' postings, however many there are in
    a text and however common they are; template and text position give the place at which the template would begin,
    and a candidate is a place on which AGREE different words agree (or all that a shorter
    template has). A candidate whose label's mandatory phrase isn't in the text is dropped. The vocabulary is fixed, so
    the index is the same few rows for any corpus.

    score: 1 where a base phrase stands; else the most words that agree on a place of a template, as a share of FULL or
    of all that a shorter template has.

    docs: doc_id and text are read, others ignored. A null or empty text has no words, no labels and the score 0.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), 0)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), i)))
    found = read.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.transform(places, lambda i: F.struct(i.cast("long").alias("i"), F.get("words", i).alias("w"))).alias("hits"),
    )
    texts = scratch.table(found, "hits")
    some = texts.where(F.size("hits") > 0)

    # a bit for each different word of a template, so that a place's words are counted by one merged number
    words_of = [list(dict.fromkeys(w for w in text.split() if w not in COMMON)) for _, text in TEMPLATES]
    rows = [(w, t, p, 1 << words_of[t].index(w)) for w, posts in INDEX.items() for t, p in posts]
    postings = docs.sparkSession.createDataFrame(rows, "w string, template int, p long, bit long")
    size_rows = [(t, label, len(words_of[t]), min(AGREE, len(words_of[t]))) for t, (label, _) in enumerate(TEMPLATES)]
    templates = docs.sparkSession.createDataFrame(size_rows, "template int, label string, size int, least int")

    looked_up = some.select("row", F.explode("hits").alias("h")).join(F.broadcast(postings), F.col("h.w") == F.col("w"))
    aligned = (
        looked_up.groupBy("row", "template", (F.col("h.i") - F.col("p")).alias("place"))
        .agg(F.bit_count(F.bit_or("bit")).alias("agree"))
        .join(F.broadcast(templates), "template")
        .where(F.col("agree") >= F.col("least"))
        .groupBy("row", "label")
        .agg(
            F.max(F.least(F.lit(1.0), F.col("agree") / F.least(F.col("size"), F.lit(FULL)))).alias("share"),
            F.count("*").alias("places"),
        )
        .groupBy("row")  # at most one entry for each label
        .agg(F.collect_list(F.struct("label", "share", "places")).alias("candidates"))
    )
    held = F.create_map(
        *(
            x
            for label, phrases in MANDATORY.items()
            for x in (
                F.lit(label),
                F.array(*(F.contains(F.col("told"), F.lit(" " + " ".join(w for w in p.split() if w not in COMMON) + " ")) for p in phrases)),
            )
        )
    )
    joined = texts.join(aligned, "row", "left").withColumn("told", _told("hits"))
    base = F.array_sort(F.flatten(F.array(*(_at("hits", p) for p, _ in BASE))))
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(_at("hits", p)) > 0, F.lit(k)) for p, k in BASE))))
    verified = F.filter(
        F.coalesce("candidates", F.array().cast("array<struct<label:string,share:double,places:bigint>>")),
        lambda c: F.exists(F.element_at(held, c["label"]), lambda x: x),
    )
    return (
        joined.select("doc_id", "n_words", base.alias("base"), base_labels.alias("base_labels"), verified.alias("matches"))
        .withColumn("labels", F.array_sort(F.array_union("base_labels", F.transform("matches", lambda c: c["label"]))))
        .withColumn(
            "score",
            F.when(F.size("base") > 0, F.lit(1.0)).otherwise(
                F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("matches", lambda c: c["share"])), F.lit(0.0)))
            ),
        )
    )
