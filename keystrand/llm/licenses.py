"""License scans with DataFrame functions only.

Every line of a file, every paragraph of it, and the file as a whole is a candidate notice. Its sparse TF-IDF vector is compared
by cosine with those of license templates: notices, titles, tags, standard headers and short license texts. Only units with an
anchor word are vectorised: without one of a template's anchors the cosine can't reach the threshold (Cauchy-Schwarz over the
template's lightest words). Files that are license texts as a whole, or begin with a license's title, license their
directory; files without a notice of their own inherit from the nearest ancestor directory by path joins.

A notice depends on the text alone, so texts are known by hash and length: copies are vectorised together (their counts
scale all alike) and no row has to be numbered.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, read_table

#: Names of the GNU licenses and their versions' dates (fixed values).
GNU = {
    "GPL-2.0": ("General Public License", "program", "2", "June 1991"), "GPL-3.0": ("General Public License", "program", "3", "29 June 2007"),
    "LGPL-2.1": ("Lesser General Public License", "library", "2.1", "February 1999"), "LGPL-3.0": ("Lesser General Public License", "library", "3", "29 June 2007"),
    "AGPL-3.0": ("Affero General Public License", "program", "3", "19 November 2007"),
}
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
#: Notices, headers and short texts of common licenses (fixed values, as their stewards word them).
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Use of this source code is governed by a BSD 2-Clause license.", REDISTRIBUTION],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD 3-Clause license.",
        REDISTRIBUTION + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        f"of the Software. {WARRANTY}",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: First lines of license texts (fixed values).
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International", "CC0-1.0": "CC0 1.0 Universal",
    "ISC": "ISC License", "MIT": "The MIT License", "MPL-2.0": "Mozilla Public License Version 2.0",
}


def all_templates() -> list[tuple[str, str, bool]]:
    """(license, text, whether it is a title)."""
    out = [(name, text, False) for name, texts in TEMPLATES.items() for text in texts]
    out += [(name, f"SPDX-License-Identifier: {name}", False) for name in TEMPLATES if name != "Proprietary"]
    for name, (kind, thing, version, date) in GNU.items():
        out.append((name, f"GNU {kind} Version {version}, {date}", True))
        out.append((name, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", False))
    return out + [(name, text, True) for name, text in TITLES.items()]


TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.75
#: Words of ordinary prose, the commonest and others: they become anchors only where a template can't do without.
COMMONEST = frozenset("a an and are as at be but by do for from in is it not of on or that the this to was with you".split())
COMMON = frozenset(
    "a above all an and any are as at be both but by can code copies copy either every fee following for form free from general if in into is it its later law may must name no not of on or "
    "other out own person program public rights shall software source subject such terms than that the their these this to under use version was will with without work works you your".split()
)
#: Keys up to which a table of notices or directories is broadcast.
MAX_BROADCAST_KEYS = 200_000


def weights(templates: list[tuple[str, str, bool]] | None = None) -> tuple[list[tuple[str, float]], list[tuple[int, str, float]], float]:
    """(token, idf) of all template tokens, (template's number, token, unit-length TF-IDF weight), and the idf of other tokens."""
    bags = [re.findall(TOKEN, text.lower()) for _, text, _ in templates or all_templates()]
    n = len(bags)
    tokens = sorted({t for bag in bags for t in bag})
    idf = {t: math.log((1 + n) / (1 + sum(t in bag for bag in bags))) + 1 for t in tokens}
    parts = []
    for k, bag in enumerate(bags):
        raw = {t: bag.count(t) * idf[t] for t in set(bag)}
        length = math.sqrt(sum(v * v for v in raw.values()))
        parts += [(k, t, v / length) for t, v in sorted(raw.items())]
    return sorted(idf.items()), parts, math.log(1 + n) + 1


def anchors(parts: list[tuple[int, str, float]], threshold: float) -> list[str]:
    """Tokens of which a unit needs one to reach the threshold with any template."""
    found: set[str] = set()
    for name in {p[0] for p in parts}:
        light = 0.0
        for _, w, token in sorted((0 if t in COMMONEST else 1 if t in COMMON else 2, w, t) for n, t, w in parts if n == name):
            light += w * w
            if light >= threshold * threshold:
                found.add(token)
    return sorted(found)


def _anchored(body: Column, words: list[str]) -> Column:
    return F.rlike(ascii_lower(body), F.lit(r"(^|[^a-z0-9])(" + "|".join(map(re.escape, words)) + r")([^a-z0-9]|$)"))


KEY = ["_hash", "_size"]


def text_key(text: Column) -> list[Column]:
    """Hash and length: what a text is known by."""
    return [F.xxhash64(text).alias("_hash"), F.length(text).alias("_size")]


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it is small enough."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_KEYS else df


def notices(files: DataFrame, templates: list[tuple[str, str, bool]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(_hash, _size, license, cosine, whole) from rows (text): the best template of each text that reaches the threshold.

    whole: the text as such is a license's, or it begins with a license's title, on its
    first line or first two lines that aren't blank. Ties go to the whole
    text, then to the license's name.
    """
    spark = files.sparkSession
    templates = templates or all_templates()
    idf, parts, other = weights(templates)
    words = anchors(parts, threshold)
    idf_table = F.broadcast(spark.createDataFrame(idf, "token string, idf double"))  # as long as the templates
    part_table = F.broadcast(spark.createDataFrame([(k, templates[k][0], templates[k][2], t, w) for k, t, w in parts], "template int, license string, title boolean, token string, weight double"))
    text = F.col("text")
    lines, blocks = F.split(text, "\n"), F.split(F.regexp_replace(text, r"\n[ \t\r]*(?=\n)", "\n"), "\n\n+")
    shown = F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"[ \t\r]", "")) > 0)
    none = F.array().cast("array<string>")
    head = F.when(F.size(shown) > 2, F.array_join(F.slice(shown, 1, 2), "\n")).otherwise("")  # what is the whole text isn't looked at again
    paragraphs = F.when(F.size(blocks) > 1, F.filter(blocks, lambda x: F.instr(x, "\n") > 0)).otherwise(none)
    units = files.where(_anchored(text, words)).select(*text_key(text), F.posexplode(F.concat(F.array(text, head), F.when(F.size(shown) > 1, shown).otherwise(none), paragraphs)).alias("unit", "body"))
    units = units.where((F.col("unit") == 0) | _anchored(F.col("body"), words))
    tokens = units.select(*KEY, "unit", F.explode(F.regexp_extract_all(ascii_lower(F.col("body")), F.lit(TOKEN), F.lit(0))).alias("token"))
    vector = tokens.groupBy(*KEY, "unit", "token").agg(F.count("*").alias("tf")).join(idf_table, "token", "left").select(*KEY, "unit", "token", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x"))
    vector = cut(vector, "license-vectors")
    length = vector.groupBy(*KEY, "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = vector.join(part_table, "token").groupBy(*KEY, "unit", "template", "license", "title").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(length, [*KEY, "unit"]).select(*KEY, "unit", "license", "title", F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    whole = (F.col("unit") == 0) | ((F.col("unit") < 3) & F.col("title"))  # units 1 and 2 are the first two lines and the first
    best = scored.groupBy(*KEY).agg(F.min(F.struct(-F.col("cosine"), F.col("unit") > 0, F.col("license"))).alias("b"), F.max(whole).alias("whole"))
    return best.select(*KEY, F.col("b.license").alias("license"), (-F.col("b.col1")).alias("cosine"), "whole")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str, bool]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `files` but the text, plus license, cosine and basis (header, file, directory or null).

    Null and empty texts have no notice but inherit; null paths don't inherit; paths without a slash lie in the root, whose license
    goes to all relative paths. Among several license files of a directory the most frequent license counts, then the first by
    name. Directories may be nested to any depth, texts be of any length. Repeated rows are judged alike; an empty table
    gives an empty result; own columns replace columns of the same name, and other names can't clash.
    """
    keep = [c for c in files.columns if c not in (text_col, "license", "cosine", "basis")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = cut(notices(files.select(text.alias("text")), templates, threshold), "license-notices")
    path = F.col(f"`{path_col}`")
    directory = F.when(path.isNotNull(), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    slim = files.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_pad")).alias("_row"), directory.alias("_dir"), *text_key(text))
    rows = slim.join(_small(own), KEY, "left")
    licensed = rows.where("whole").groupBy(F.col("_dir").alias("_at"), "license").agg(F.count("*").alias("n"))
    licensed = cut(licensed.groupBy("_at").agg(F.min(F.struct(-F.col("n"), F.col("license"))).alias("b")).select("_at", F.col("b.license").alias("_inherited")), "license-directories")
    steps = F.split("_dir", "/")
    above = slim.select("_dir").where("_dir IS NOT NULL").distinct().select("_dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("up"))
    above = above.select("_dir", "up", F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - F.col("up"), F.lit(0))), "/").alias("_at"))
    above = above.where((F.col("_at") != "") | ~F.startswith("_dir", F.lit("/")))  # the root of relative paths has no name
    nearest = above.join(_small(licensed), "_at").groupBy("_dir").agg(F.min_by("_inherited", "up").alias("_inherited"))
    nearest = cut(nearest.withColumnRenamed("_dir", "_of"), "license-nearest")
    out = rows.join(_small(nearest), F.col("_dir") == F.col("_of"), "left")
    basis = F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").when(F.col("_inherited").isNotNull(), "directory")
    return out.select("_row.*", F.coalesce("license", "_inherited").alias("license"), "cosine", basis.alias("basis")).drop("_pad")


def document_paths(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return documents.select("doc_id", path.alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(read_table(spark, sf_dir, "documents"))).select("doc_id", "path", "license", "cosine", "basis")


def sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for op2_licenses."""
    templates = all_templates()
    idf, parts, other = weights()
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    idf_rows = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf)
    part_rows = ", ".join(f"({k}, '{templates[k][0]}', {str(templates[k][2]).lower()}, '{t}', {w!r}::DOUBLE)" for k, t, w in parts)
    path = "coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '.txt'"
    return rf"""
WITH idf(token, idf) AS (VALUES {idf_rows}),
part(template, license, title, token, weight) AS (VALUES {part_rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {path} AS path, regexp_extract({path}, '^(.*)/[^/]*$', 1) AS dir FROM documents),
split AS (SELECT rid, text, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[ \t\r]', '', 'g')) > 0) AS shown,
  string_split_regex(regexp_replace(text, '\n([ \t\r]*\n)+', chr(10) || chr(10), 'g'), '\n\n+') AS blocks FROM d),
bodies AS (SELECT rid, list_concat([text, CASE WHEN len(shown) > 2 THEN array_to_string(shown[1:2], chr(10)) ELSE '' END], CASE WHEN len(shown) > 1 THEN shown ELSE [] END, CASE WHEN len(blocks) > 1 THEN list_filter(blocks, lambda x: contains(x, chr(10))) ELSE [] END) AS b FROM split),
unit AS (SELECT rid, unnest(range(0, len(b))) AS unit, unnest(b) AS body FROM bodies),
tok AS (SELECT rid, unit, unnest(regexp_extract_all({lower % 'body'}, '{TOKEN}')) AS token FROM unit),
vec AS (SELECT rid, unit, token, count(*) * coalesce(any_value(idf), {other!r}::DOUBLE) AS x FROM tok LEFT JOIN idf USING (token) GROUP BY 1, 2, 3),
len AS (SELECT rid, unit, sqrt(sum(x * x)) AS length FROM vec GROUP BY 1, 2),
cosine AS (SELECT rid, unit, license, title, round(sum(x * weight) / any_value(length), 9) AS cosine
  FROM vec JOIN part USING (token) JOIN len USING (rid, unit) GROUP BY rid, unit, template, license, title),
hit AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, unit > 0, license) AS r, bool_or(unit = 0 OR unit < 3 AND title) OVER (PARTITION BY rid) AS whole FROM cosine WHERE cosine >= {threshold}),
own AS (SELECT rid, license, cosine, whole FROM hit WHERE r = 1),
licensed AS (SELECT dir AS dir_at, license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, license) AS r FROM d JOIN own USING (rid) WHERE whole GROUP BY dir, license),
nearest AS (SELECT q.dir, min_by(l.license, -length(l.dir_at)) AS inherited FROM (SELECT DISTINCT dir FROM d) q
  JOIN licensed l ON l.r = 1 AND (q.dir = l.dir_at OR l.dir_at <> '' AND starts_with(q.dir, l.dir_at || '/') OR l.dir_at = '' AND NOT starts_with(q.dir, '/')) GROUP BY 1)
SELECT doc_id, path, coalesce(license, inherited) AS license, cosine,
  CASE WHEN whole THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'directory' END AS basis
FROM d LEFT JOIN own USING (rid) LEFT JOIN nearest USING (dir)
"""
