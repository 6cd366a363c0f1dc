r"""License scans with a positional rare-token index, in DataFrame functions only.

Every text becomes its words and the licence words among them; how many documents hold
each licence word gives its IDF.  A text that holds all words of a key phrase is looked up by
the two of them with the highest IDF: each place of such a word, less its place in the
template, proposes where the template would begin.  What the postings of both words propose,
their intersection by relative position, is verified: the mandatory key phrase must stand
there, word for word.  A base phrase then counts.  A template's label is given where at least
SHARE of its words are at their places; the score of a text is the highest such share among
the templates whose key phrase stands, 0 if none does.

As the key phrase is mandatory and both of its rare words are looked up in the whole text,
no place of it goes unproposed.

Cases: null or empty text: no words, no labels, score 0. Null doc_ids and repeated rows are
kept; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases: each place counts.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Label, wording of the notice or of the licence's own text, mandatory key phrase in it.
TEMPLATES = [
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "developed by the apache software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("artistic-2.0", "this package is licensed under the artistic license 2 0", "artistic license"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials mentioning features"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsl-1.1", "use of this software is governed by the business source license 1 1", "business source license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("cecill-2.1", "governed by the cecill license under french law and abiding by the rules of distribution of free software", "governed by the cecill license"),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("eupl-1.2", "licensed under the eupl european union public licence version 1 2", "european union public licence"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "and without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and or distribute"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl-2.0", "under the terms of the gnu library general public license as published by the free software foundation", "gnu library general public license"),
    ("lppl-1.3", "this work may be distributed and or modified under the conditions of the latex project public license", "latex project public license"),
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit-0", "licensed under the mit no attribution license", "mit no attribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("ms-pl", "licensed under the microsoft public license ms pl", "microsoft public license"),
    ("ncsa", "released under the university of illinois ncsa open source license", "illinois ncsa open source license"),
    ("odbl-1.0", "made available under the open database license", "open database license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "developed by the openssl project"),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    ("public-domain", "this work has been released into the public domain", "released into the public domain"),
    ("python-2.0", "this license agreement is between the python software foundation and the individual or organization", "between the python software foundation"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    ("sspl-1.0", "subject to the terms of the server side public license version 1", "server side public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies of this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("zpl-2.1", "licensed under the zope public license zpl version 2 1", "zope public license"),
]
SHARE = 0.75
#: More words than any notice has: a proposal begins less than that before the text.
LONGEST = 1 << 10


class Notice:
    """A template, or a base phrase, which is its own key."""

    def __init__(self, number: int, label: str, text: str, key: str, base: bool):
        self.number, self.label, self.base = number, label, base
        self.words, self.key = text.split(), key.split()
        self.key_at = next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)

    def rare(self, idf: dict[str, float]) -> list[tuple[str, int]]:
        """The two words of the key phrase with the highest IDF, and their places in the notice."""
        places = {w: self.key_at + i for i, w in reversed(list(enumerate(self.key)))}
        return sorted(places.items(), key=lambda x: (-idf[x[0]], x))[:2]


def notices() -> list[Notice]:
    every = [(label, text, text, True) for label, text in BASE] + [(*t, False) for t in TEMPLATES]
    return [Notice(i, *t) for i, t in enumerate(every)]


def key_words() -> list[str]:
    return sorted({w for n in notices() for w in n.key})


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, present (words of key phrases), possible (numbers of the notices all whose key words are present), words (only where some are)."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    rows = rows.withColumn("present", F.array_intersect("words", strings(key_words())))
    # long words first, as they are likely to be missing
    keys = F.array(*[F.struct(F.lit(n.number).alias("notice"), strings(sorted(set(n.key), key=lambda w: (-len(w), w))).alias("key")) for n in notices()])
    possible = F.transform(F.filter(keys, lambda k: F.forall(k["key"], lambda w: F.array_contains("present", w))), lambda k: k["notice"])
    rows = rows.withColumn("possible", F.when(F.size("present") > 1, possible).otherwise(F.array().cast("array<int>")))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", "possible", F.when(F.size("possible") > 0, F.col("words")).alias("words"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    made = materialize(index(docs), "licence-words")
    n = made.count()
    seen = {r["word"]: r["n"] for r in made.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per key word at most
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in key_words()}
    every = notices()
    hit = made.filter("words is not null")
    at = F.sequence(F.lit(0), F.size("words") - 1)

    def proposed(turn: int) -> Column:
        """Where the postings of the rarest, or second rarest, key words would have notices begin: a number each."""
        posted = [(x.number, *x.rare(idf)[turn]) for x in every]
        postings = F.array(*[F.struct(F.lit(i).alias("notice"), F.lit(w).alias("word"), F.lit(p).alias("at")) for i, w, p in posted])
        mine = F.filter(postings, lambda p: F.array_contains("possible", p["notice"]))
        # mine and its words are bound by lambdas of their own: in the inner ones the optimizer would work them out for every word
        coded = F.transform(F.array(mine), lambda m: F.transform(F.array(F.array_distinct(F.transform(m, lambda p: p["word"]))), lambda looked: F.flatten(F.transform(F.filter(at, lambda i: F.array_contains(looked, F.get("words", i))), lambda i: F.transform(F.filter(m, lambda p: p["word"] == F.get("words", i)), lambda p: F.shiftleft(p["notice"].cast("long"), 40) + (i - p["at"] + LONGEST).cast("long"))))))
        return F.flatten(F.flatten(coded))

    # of numbers an intersection is found by hash, of structs pair by pair
    both = F.array_intersect(proposed(0), proposed(1))
    starts = F.transform(both, lambda x: F.struct(F.shiftright(x, 40).cast("int").alias("notice"), (x.bitwiseAND((1 << 40) - 1) - LONGEST).cast("int").alias("start")))
    hit = hit.withColumn("proposed", starts)
    content = F.array(*[strings(x.words) for x in every])
    keys = F.array(*[F.struct(F.lit(x.key_at).alias("at"), strings(x.key).alias("words")) for x in every])

    def same(start: Column, wanted: Column) -> Column:
        """Whether all wanted words stand at start and after it."""
        return (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(wanted)) == wanted)

    def share(p: Column) -> Column:
        wanted = F.get(content, p["notice"])
        there = F.transform(wanted, lambda w, i: F.when((p["start"] + i >= 0) & (F.get("words", F.greatest(p["start"] + i, F.lit(0))) == w), 1.0).otherwise(0.0))
        return F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.size(wanted)

    hit = hit.withColumn("stands", F.filter("proposed", lambda p: same(p["start"] + F.get(keys, p["notice"])["at"], F.get(keys, p["notice"])["words"])))
    n_base, labels = len(BASE), strings([x.label for x in every])
    hit = hit.withColumn("base", F.filter("stands", lambda p: p["notice"] < n_base))
    hit = hit.withColumn("judged", F.transform(F.filter("stands", lambda p: p["notice"] >= n_base), lambda p: F.struct(p["notice"].alias("notice"), share(p).alias("share"))))
    name = lambda found: F.array_distinct(F.transform(found, lambda p: F.get(labels, p["notice"])))
    line = lambda names: F.array_join(F.array_sort(names), ",")
    places = F.transform("base", lambda p: p["start"])
    found = hit.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        line(name(F.col("base"))).alias("base_labels"),
        line(F.array_union(name(F.col("base")), name(F.filter("judged", lambda p: p["share"] >= SHARE)))).alias("labels"),
        F.coalesce(F.array_max(F.transform("judged", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
    none = F.lit(None).cast("long")
    rest = made.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return found.unionByName(rest)
