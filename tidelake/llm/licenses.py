"""License scans by diagonal voting.

All k-grams of a text's words are hashed and those that occur in a template are
looked up among the template's positions. A pair of equal k-grams at text position
p and template position q votes for the diagonal p - q. Each diagonal voted for is
verified word by word: the words of the text around it are aligned with the
template's (longest common subsequence, so a word changed, added or left out costs
one word at most), and a span counts if enough of the template's words are aligned
and the words that tell the licence from others stand in it. Of overlapping spans
the one with most aligned words stays. DataFrame operations only; the templates are
a fixed list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import ascii_lower, materialise

# Phrases that name a licence, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices of public licences, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
K = 3
#: Words that may stand added before a diagonal's start; a span counts from COVER of the template's words on.
DRIFT, COVER = 4, 0.75
_MORE = r"(?:share ?alike|non ?commercial|no ?deriv)"
# For each template what must stand among the words of a span, one space around each, so that a licence is not taken for another.
NAMED = (
    r" mit ",
    r" mit ",
    r"",
    r" apache (?:[^ ]+ )?license (?:[^ ]+ )?2 ",
    r" apache (?:[^ ]+ )?license (?:[^ ]+ )?2 ",
    r" gnu general public license (?:[^ ]+ ){0,2}(?:version |v ?)3 ",
    r" gnu general public license ",
    r" (?:are|is) permitted ",
    r" mozilla public license (?:[^ ]+ )?2 ",
    rf" attribution (?!{_MORE})",
    rf" attribution share ?alike (?!{_MORE})",
    rf" attribution non ?commercial (?!{_MORE})",
    r" waived ",
)
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a template, as ``word_array`` gives them."""
    return [w for w in re.split(_BETWEEN, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")


def _k(n: int) -> int:
    """Length of the grams that vote for a template of n words: some gram stays whole when as many words change as COVER lets."""
    changed = int(n * (1 - COVER))
    return min(K, -(-(n - changed) // (changed + 1)))


def _grams() -> dict[int, dict[str, list[tuple[int, int]]]]:
    """By length of gram, the (template, position) pairs of every gram."""
    out: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for t, (_, text) in enumerate(TEMPLATES):
        w = words_of(text)
        k = _k(len(w))
        for i in range(len(w) - k + 1):
            out.setdefault(k, {}).setdefault(" ".join(w[i : i + k]), []).append((t, i))
    return out


def _starts(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    wanted = phrase.split(" ")

    def at(i):
        found = F.get(words, i) == wanted[0]
        for d, w in enumerate(wanted[1:], 1):
            found &= F.coalesce(F.get(words, i + d), F.lit("")) == w
        return found

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at)


def _votes(words: Column, k: int, vocabulary: list[str], hashes: list[int]) -> Column:
    """Positions of the k-grams whose hash is a template's; the first word is looked up before anything is hashed."""
    n = F.size(words)

    def at(i):
        return F.get(words, i).isin(vocabulary) & F.xxhash64(*(F.get(words, i + d) for d in range(k))).isin(hashes)

    return F.when(n >= k, F.filter(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<int>"))


def _diagonals(words: Column, positions: Column, k: int, places: Column) -> Column:
    """The diagonal and template of each vote, as one number: diagonal * len(TEMPLATES) + template."""

    def at(i):
        found = F.filter(F.split(F.coalesce(places[F.concat_ws(" ", F.slice(words, i + 1, k))], F.lit("")), " "), lambda x: x != "")
        return F.transform(found, lambda x: i.cast("bigint") * len(TEMPLATES) + x.cast("bigint"))

    return F.flatten(F.transform(positions, at))


def _of_template(values: list, kind: str | None = None) -> Column:
    return F.array(*(F.lit(v).cast(kind) if kind else F.lit(v) for v in values))


def _added(n: Column) -> Column:
    """How many words may stand among a template's n."""
    return F.greatest(F.floor(n / 2).cast("int"), F.lit(DRIFT))


def _masks(templates: list[list[str]]) -> Column:
    """For each template a map from its words to their positions, as bits."""
    maps = []
    for w in templates:
        if len(w) > 62:
            raise ValueError("a template's positions are bits of one bigint: 62 words at most")
        bits: dict[str, int] = {}
        for i, x in enumerate(w):
            bits[x] = bits.get(x, 0) | 1 << i
        maps.append(F.str_to_map(F.lit(",".join(f"{x}:{b}" for x, b in bits.items())), F.lit(","), F.lit(":")).cast("map<string,bigint>"))
    return F.array(*maps)


def _aligned(masks: Column, full: Column) -> Column:
    """(n, at): how many words are aligned at most, and after how many of the text's words that is first so.

    The bit-parallel longest common subsequence: a zero bit of v is a row where the
    score rises, and adding carries each match to the next one.
    """
    start = F.struct(full.alias("v"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s, mask):
        u = s["v"].bitwiseAND(mask)
        v = (s["v"] + u).bitwiseOR(s["v"] - u).bitwiseAND(full)
        n = F.bit_count(full.bitwiseXOR(v))
        return F.struct(v.alias("v"), (s["i"] + 1).alias("i"), n.alias("n"), F.when(n > s["n"], s["i"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(masks, start, lambda s, mask: F.when(mask == 0, F.struct(s["v"].alias("v"), (s["i"] + 1).alias("i"), s["n"].alias("n"), s["at"].alias("at"))).otherwise(step(s, mask)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans). Documents: uid, doc_id, n_words, starts (of base phrases, by phrase). Spans: uid, label, first, last (words), cover.

    Null and empty texts have no words. uid tells rows of equal id apart; other
    columns are ignored and an empty table gives empty results.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.col(text_column))
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("doc_id"), text.alias("low"), word_array(F.col(text_column)).alias("w"))
    none = F.array().cast("array<int>")
    starts = [F.when(F.col("low").contains(max(p.split(" "), key=len)), _starts(F.col("w"), p)).otherwise(none).alias(f"s{i}") for i, (p, _) in enumerate(PHRASES)]
    templates = [words_of(text) for _, text in TEMPLATES]
    sizes = [len(w) for w in templates]
    votes = []
    for k, grams in sorted(_grams().items()):
        vocabulary = sorted({g.split(" ")[0] for g in grams})
        hashes = [r[0] for r in spark.range(1).select(F.explode(F.array(*(F.xxhash64(*map(F.lit, g.split(" "))) for g in sorted(grams))))).collect()]
        places = F.str_to_map(F.lit(",".join(f"{g}:{' '.join(str(t - q * len(TEMPLATES)) for t, q in at)}" for g, at in grams.items())), F.lit(","), F.lit(":"))
        met = _diagonals(F.col("w"), _votes(F.col("w"), k, vocabulary, hashes), k, places)
        votes.append(met)

    def around(x):
        """The words near a diagonal: DRIFT before its start, and after its end as many as half the template."""
        template = F.pmod(x, F.lit(len(TEMPLATES))).cast("int")
        diagonal = F.floor((x - template) / len(TEMPLATES)).cast("int")
        n, first = F.get(_of_template(sizes), template), F.greatest(diagonal - DRIFT, F.lit(0))
        until = diagonal + n + _added(n)
        return F.struct(template.alias("template"), first.alias("from"), F.slice(F.col("w"), first + 1, until - first).alias("words"))

    def named(words, template):
        return F.regexp_like(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.get(_of_template(list(NAMED)), template))

    def masked(c, words, templates):
        masks = F.get(_masks(templates), c["template"])
        return F.transform(words, lambda x: F.coalesce(masks[x], F.lit(0).cast("bigint")))

    def forward(c):
        return F.struct(c["template"].alias("template"), c["from"].alias("from"), c["words"].alias("words"), _aligned(masked(c, c["words"], templates), full(c)).alias("there"))

    def backward(c):
        words = F.reverse(F.slice(c["words"], F.lit(1), c["there"]["at"]))
        length = _aligned(masked(c, words, [w[::-1] for w in templates]), full(c))["at"]
        return F.struct(c["template"].alias("template"), c["from"].alias("from"), c["words"].alias("words"), c["there"].alias("there"), length.alias("length"))

    full = lambda c: F.get(_of_template([(1 << n) - 1 for n in sizes], "bigint"), c["template"])
    size = lambda c: F.get(_of_template(sizes), c["template"])
    enough = lambda c: c["there"]["n"] >= COVER * size(c)
    close = lambda c: (c["length"] <= size(c) + _added(size(c))) & named(F.slice(c["words"], c["there"]["at"] - c["length"] + 1, c["length"]), c["template"])
    # The steps of a row: diagonals voted for, the words around each, those with the licence's name; then the alignment there and back.
    kept = materialise(
        source.withColumn("votes", F.array_distinct(F.concat(*votes))).select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), *starts, F.filter(F.transform("votes", around), lambda x: named(x["words"], x["template"])).alias("near")), "license"
    )
    found = kept.select("uid", F.explode(F.filter(F.transform(F.filter(F.transform("near", forward), enough), backward), close)).alias("c"))
    end = F.col("c.from") + F.col("c.there.at")
    spans = found.select("uid", "c.template", (end - F.col("c.length")).cast("long").alias("first"), (end - 1).cast("long").alias("last"), F.col("c.there.n").alias("aligned"), (F.col("c.there.n") / size(F.col("c"))).alias("cover")).distinct()
    spans = _best(spans)
    return kept.drop("near"), spans.select("uid", F.get(_of_template([label for label, _ in TEMPLATES]), F.col("template")).alias("label"), "first", "last", "cover")


def _best(spans: DataFrame) -> DataFrame:
    """Spans that overlap no better one that stays; better is more aligned words, then a greater share, then an earlier place."""
    order = Window.partitionBy("uid").orderBy("first", "last", "template")
    apart = F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((-F.col("aligned")).alias("a"), (-F.col("cover")).alias("c"), "first", "last", "template", "cover")
    none = F.array().cast("array<struct<a:int,c:double,first:bigint,last:bigint,template:int,cover:double>>")
    stays = F.aggregate("all", none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"])), kept).otherwise(F.concat(kept, F.array(x))))
    best = spans.groupBy("uid", "group").agg(F.array_sort(F.collect_list(one)).alias("all")).select("uid", F.explode(stays).alias("x"))
    return best.select("uid", "x.first", "x.last", "x.template", "x.cover")


def license_labels(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null and empty texts have no words, no labels and a score of 0. Rows of equal id
    stay apart; other columns are ignored; an empty table gives no rows.
    """
    kept, spans = scan(docs, id_column, text_column)
    found = spans.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    every = F.concat(*(f"s{i}" for i in range(len(PHRASES))))
    base = F.filter(F.array(*(F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return kept.join(found, "uid", "left").select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", none)))), ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
