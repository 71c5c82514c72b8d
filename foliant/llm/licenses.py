"""Licence scan: notices compared with templates by the Dice coefficient over word bigrams. DataFrame functions only, and no shuffle."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, read_table

#: Notices as licences and their authors word them (public texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
THRESHOLD = 0.8
_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted(set(map(" ".join, zip(words, words[1:], strict=False))))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and notices: array<struct<line, license, dice>> of every row.

    A unit is a line (from 1), or the whole text (line 0) if it has several. Units and templates are normalised: A-Z lowered, runs of other characters than letters and digits made a space.
    A unit is a notice of a template if 2 * common / (own + template's) of their distinct word bigrams is threshold at least; of one licence's templates the best counts. Two bounds prune before that:
    of sizes (own between m * t / (2 - t) and m * (2 - t) / t for a template of m), and of contents (own has one of the template's longest bigrams, so many that it must share one).

    Notices that are wrapped over lines or share theirs with other words are found in windows of the text's words, from a template's lower size to its upper one, that begin and end with bigrams of the template (others only add to own);
    a text is searched if it has as many of a template's bigrams as the lower size. Of overlapping windows, of any licence, the closest stays (ties: the shortest, then the first), with the line on which it begins;
    of these, windows that touch a line which is a notice, or lie in a whole text which is one, do not count again. A line has one notice of a licence.

    Null and empty texts, and units of fewer than two words, have no notice. Rows with null ids, repeated rows and rows of one id are returned each. Other columns are ignored.
    """
    t = threshold
    made = [(name, b) for name, text in templates if (b := _bigrams(text))]
    low, high = (lambda m: math.ceil(m * t / (2 - t) - 1e-9)), (lambda m: math.floor(m * (2 - t) / t + 1e-9))
    first = lambda b: sorted(b, key=lambda x: (-len(x), x))[: len(b) - low(len(b)) + 1]
    rare = sorted({x for _, b in made for x in first(b)})
    known = F.expr("array(" + ", ".join(f"named_struct('license', {_quoted(n)}, 'low', {low(len(b))}, 'high', {high(len(b))}, 'bigrams', array({', '.join(map(_quoted, b))}))" for n, b in made) + ")")
    least, most = min(low(len(b)) for _, b in made), max(high(len(b)) for _, b in made)
    plain = F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _NOT_WORD, " ")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.split(plain, "\n", -1).alias("lines"))
    texts = texts.select("doc_id", "lines", F.when(F.size("lines") > 1, 0).otherwise(1).alias("whole"))
    lines = F.col("lines")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.array_join(lines, " ")), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    words = F.transform(units, lambda u, i: F.struct(i.alias("line"), F.filter(F.split(u, " ", -1), lambda w: w != "").alias("w")))
    # at least so many distinct bigrams need as many words; more words than most distinct bigrams may repeat them
    some = F.filter(words, lambda u: (F.size(u["w"]) > least) & F.arrays_overlap(u["w"], F.array(*(F.lit(w) for w in sorted({x.split(" ")[0] for x in rare})))))
    pairs = F.transform(some, lambda u: F.struct(u["line"].alias("line"), F.array_distinct(F.zip_with(F.slice(u["w"], 1, F.size(u["w"]) - 1), F.slice(u["w"], 2, F.size(u["w"]) - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("b")))
    shared = F.filter(pairs, lambda u: (F.size(u["b"]).between(least, most) | ((u["line"] == F.col("whole")) & (F.size(u["b"]) >= least))) & F.arrays_overlap(u["b"], F.array(*(F.lit(x) for x in rare))))

    def against(u: Column) -> Column:
        m = lambda k: F.size(k["bigrams"])
        sized = F.filter(known, lambda k: (F.size(u["b"]) * (2 - t) >= m(k) * t - 1e-9) & (F.size(u["b"]) * t <= m(k) * (2 - t) + 1e-9))
        scored = F.transform(sized, lambda k: F.struct(u["line"].alias("line"), k["license"].alias("license"), (F.lit(2.0) * F.size(F.array_intersect(u["b"], k["bigrams"])) / (F.size(u["b"]) + m(k))).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= t)

    close = F.filter("shared", lambda u: F.size(u["b"]).between(least, most))
    near = F.flatten(F.transform(F.filter("shared", lambda u: u["line"] == F.col("whole")), lambda u: F.filter(known, lambda k: F.size(F.array_intersect(u["b"], k["bigrams"])) >= k["low"])))
    found = texts.select("doc_id", "lines", "whole", shared.alias("shared"))
    found = found.select("doc_id", "lines", F.flatten(F.transform(close, against)).alias("found"), near.alias("near"))
    found = found.select("doc_id", F.concat("found", F.when(F.size("near") > 0, F.expr(_windows(t))).otherwise(F.expr("array()"))).alias("found"))
    best = F.filter("found", lambda s: ~F.exists("found", lambda o: (o["line"] == s["line"]) & (o["license"] == s["license"]) & (o["dice"] > s["dice"])))
    return found.select("doc_id", F.array_sort(F.array_distinct(best)).alias("notices"))


def _windows(t: float) -> str:
    """Notices within lines or across them, of the templates of near: array<struct<line, license, dice>>. x is the text's bigrams with their lines, and hits are the places (from 1) of a template's bigrams."""
    words = "flatten(transform(lines, (l, i) -> transform(filter(split(l, ' ', -1), w -> w <> ''), w -> struct(i + 1 AS line, w))))"
    pairs = "zip_with(slice(ws, 1, size(ws) - 1), slice(ws, 2, size(ws) - 1), (a, b) -> struct(a.line AS first, b.line AS last, concat_ws(' ', a.w, b.w) AS b))"
    hits = "filter(transform(x, (y, i) -> IF(array_contains(k.bigrams, y.b), i + 1, 0)), i -> i > 0)"
    spans = "flatten(transform(hits, (h, a) -> transform(filter(slice(hits, a + k.low, k.high - k.low + 1), e -> e - h < k.high), e -> struct(h, e))))"
    own = "array_distinct(transform(slice(x, s.h, s.e - s.h + 1), y -> y.b))"
    dice = f"transform(array({own}), o -> 2.0D * size(array_intersect(o, k.bigrams)) / (size(o) + size(k.bigrams)))[0]"
    scored = f"transform({spans}, s -> struct(-({dice}) AS d, s.e - s.h AS n, s.h AS h, s.e AS e, k.license AS license, x[s.h - 1].first AS first, x[s.e - 1].last AS last))"
    every = f"flatten(transform(near, k -> flatten(transform(array({hits}), hits -> {scored}))))"
    close = f"filter({every}, s -> -s.d >= {t}D)"
    kept = f"aggregate(array_sort({close}), cast(array() AS array<struct<d: double, n: int, h: int, e: int, license: string, first: int, last: int>>), (a, s) -> IF(exists(a, o -> o.h <= s.e AND s.h <= o.e), a, concat(a, array(s))))"
    free = f"filter({kept}, s -> NOT exists(found, f -> f.line = 0 OR f.line BETWEEN s.first AND s.last))"
    return f"flatten(transform(array({words}), ws -> flatten(transform(array({pairs}), x -> transform({free}, s -> struct(s.first AS line, s.license AS license, -s.d AS dice))))))"


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: how many notices it has, the licences, and the closest one with its coefficient and line (ties: by name, then line)."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    ranked = F.get(F.array_sort(F.transform("notices", lambda n: F.struct((-n["dice"]).alias("d"), n["license"].alias("license"), n["line"].alias("line")))), 0)
    found = found.withColumn("best", ranked)
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"]))), ",").alias("licenses"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.col("best.line").cast("long").alias("line"))


QUERIES = {"op6_licenses": op6_licenses}


def _sql() -> str:
    rows = ", ".join(f"({i}, {_quoted(n)}, [{', '.join(map(_quoted, _bigrams(x)))}])" for i, (n, x) in enumerate(TEMPLATES))
    return f"""
WITH k(i, license, kb) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS p FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(string_split(p, chr(10))) + 1)) AS line, unnest(string_split(p, chr(10))) AS x FROM d UNION ALL SELECT doc_id, 0, replace(p, chr(10), ' ') FROM d WHERE contains(p, chr(10))),
w AS (SELECT doc_id, line, list_filter(string_split(x, ' '), lambda y: y <> '') AS w FROM u),
b AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i+1]))) AS b FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, line, license, max(2.0::DOUBLE * len(list_intersect(b, kb)) / (len(b) + len(kb))) AS dice FROM b, k WHERE list_has_any(b, kb) GROUP BY 1, 2, 3),
h AS (SELECT * FROM s WHERE dice >= {THRESHOLD}),
g AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, (list(struct_pack(l := license, d := dice, n := line) ORDER BY dice DESC, license, line))[1] AS best FROM h GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(licenses, '') AS licenses, best.l AS license, best.d AS dice, CAST(best.n AS BIGINT) AS line FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = {"op6_licenses": _sql()}
