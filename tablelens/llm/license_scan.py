"""License scan: sparse TF-IDF cosine of file parts to licence templates, then inheritance down the directories.

Every line of every text, every run of neighbouring candidate lines, and for each template every window of as many
words as it has, across line breaks, is compared with the templates. The words of a template that carry most of its
weight are its anchors: a part without an anchor cannot reach the threshold, so dropping such parts loses nothing. A
file without a licence of its own takes that of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.session import materialize

THRESHOLD = 0.6
WORD_GAP = "[^a-z0-9]+"
BLOCK = 256  # first words of windows that one row holds; the windows reach into the words after them

# fixed values: wording of common licence statements, and names of licence files
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, text.lower()) if w]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def template_weights(counts: dict[str, int], total: int, templates=TEMPLATES) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequency of the template words, and unit vectors of the templates."""
    import math

    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for _, text in templates for w in words_of(text)}
    vectors = []
    for _, text in templates:
        raw: dict[str, float] = {}
        for w in words_of(text):
            raw[w] = raw.get(w, 0.0) + idf[w]
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({w: x / norm for w, x in raw.items()})
    return idf, vectors


def anchors(idf: dict[str, float], vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Words of which every part with cosine >= ``threshold`` has one: the rest of a template is too short a vector.

    The rarest words are taken first, so that few other lines have one.
    """
    out: set[str] = set()
    for vector in vectors:
        rest = 1.0
        for w, x in sorted(vector.items(), key=lambda p: (-idf[p[0]], -p[1], p[0])):
            if rest < threshold * threshold * 0.999:
                break
            out.add(w)
            rest -= x * x
    return out


def _parts(files: DataFrame, anchor_words: set[str]) -> DataFrame:
    """Candidate parts ``_k1, _k2, _part, _text``: lines with an anchor, and runs of two or more such lines."""
    hit = r"(?i)(?<![A-Za-z0-9])(" + "|".join(sorted(map(re.escape, anchor_words))) + r")(?![A-Za-z0-9])"
    lines = F.transform(F.split(F.col("_text"), "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    found = files.select("_k1", "_k2", F.inline(F.filter(lines, lambda x: x["line"].rlike(hit))))
    found = found.dropDuplicates(["_k1", "_k2", "at"])
    order = Window.partitionBy("_k1", "_k2").orderBy("at")
    runs = found.withColumn("_run", F.col("at") - F.row_number().over(order))
    joined = runs.groupBy("_k1", "_k2", "_run").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_lines"))
    joined = joined.where(F.size("_lines") > 1)
    several = joined.select("_k1", "_k2", (-F.col("_lines")[0]["at"] - 1).alias("_part"), F.array_join(F.col("_lines")["line"], " ").alias("_text"))
    return found.select("_k1", "_k2", F.col("at").alias("_part"), F.col("line").alias("_text")).unionByName(several)


def _window_scores(files: DataFrame, idf: dict[str, float], vectors: list[dict[str, float]], unseen: float, threshold: float, templates) -> DataFrame:
    """``_k1, _k2, _name, _score`` of the nearest window for each template and block of words.

    The windows of a template have as many words as it has; a shorter text is one window. A cosine is at most the
    length of the template's vector over the words that both have: blocks and windows below that are left out. A
    window without an anchor of its template is below it, so only windows around anchors are looked at.
    """
    sizes = [len(words_of(text)) for _, text in templates]
    bound, reach = threshold * threshold * 0.999, BLOCK + max(sizes) - 1
    table = lambda v: F.create_map(*[F.lit(x) for w, y in v.items() for x in (w, float(y))])
    held = [sorted(anchors(idf, [v], threshold)) for v in vectors]
    given = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"), table(v).alias("y"), F.array(*map(F.lit, a)).alias("a")) for (name, _), n, v, a in zip(templates, sizes, vectors, held)])
    weight = table(idf)
    shared = lambda y, words: F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(y[w] * y[w], F.lit(0.0)))

    def cosine(window: Column) -> Column:
        """Of words in order: the r-th of equal ones adds 2r - 1 squares, so that t of them add t^2."""

        def step(a: Column, v: Column) -> Column:
            r = F.when(a["w"] == v["w"], a["r"] + 1.0).otherwise(1.0)
            return F.struct(v["w"].alias("w"), r.alias("r"), (a["norm"] + v["x"] * v["x"] * (2.0 * r - 1.0)).alias("norm"), (a["dot"] + v["x"] * v["y"]).alias("dot"))

        begin = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("r"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("dot"))
        return F.aggregate(F.array_sort(window), begin, step, lambda a: a["dot"] / F.sqrt(a["norm"]))

    words = files.select("_k1", "_k2", _words(F.col("_text")).alias("_w"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / BLOCK).cast("int"))
    blocks = words.where(F.size("_w") > 0).select("_k1", "_k2", F.posexplode(F.transform(numbers, lambda b: F.slice("_w", b * BLOCK + 1, reach))).alias("_b", "_w"))
    blocks = blocks.where(F.arrays_overlap("_w", F.array(*map(F.lit, sorted(set().union(*held))))))
    blocks = blocks.withColumn("_in", F.array_intersect("_w", F.array(*map(F.lit, sorted(idf)))))
    fits = lambda t: F.arrays_overlap(F.col("_in"), t["a"]) & (shared(t["y"], F.col("_in")) >= bound)
    likely = blocks.select("_k1", "_k2", "_b", "_w", F.explode(F.filter(given, fits)).alias("_t"))
    n, y = F.col("_t.n"), F.col("_t.y")
    # a block with fewer words than a window is a whole text or holds no first word
    likely = likely.where((F.size("_w") >= n) | (F.col("_b") == 0))
    last = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.size("_w") - n + 1))
    places = F.transform("_w", lambda w, i: F.when(F.array_contains("_t.a", w), i + 1))
    around = F.transform(F.array_compact(places), lambda p: F.struct(F.greatest(F.lit(1), p - n + 1).alias("a"), F.least(last, p).alias("b")))
    around = F.transform(F.filter(around, lambda x: x["a"] <= x["b"]), lambda x: F.sequence(x["a"], x["b"]))
    likely = likely.withColumn("_s", F.array_distinct(F.flatten(around)))
    firsts = F.filter("_s", lambda s: shared(y, F.array_intersect(F.slice("_w", s, n), F.map_keys(y))) >= bound)
    likely = likely.withColumn("_s", firsts).where(F.size("_s") > 0)
    weighed = F.transform("_w", lambda w: F.struct(w.alias("w"), F.coalesce(weight[w], F.lit(float(unseen))).alias("x"), F.coalesce(y[w], F.lit(0.0)).alias("y")))
    likely = likely.select("_k1", "_k2", "_t", "_s", weighed.alias("_x"))
    scores = F.transform("_s", lambda s: cosine(F.slice("_x", s, n)))
    return likely.select("_k1", "_k2", F.col("_t.name").alias("_name"), F.round(F.array_max(scores), 6).alias("_score")).where(F.col("_score") >= threshold)


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``_k1, _k2, own_license, own_score`` of the files ``(_k1, _k2, _text)`` in which a licence is found.

    A word's weight follows its document frequency over all files; words outside the templates weigh as unseen
    ones. Of several licences the nearest counts, at a tie the first by name.
    """
    spark = files.sparkSession
    known = sorted({w for _, text in templates for w in words_of(text)})
    seen = files.select(F.explode(F.array_intersect(_words(F.col("_text")), F.array(*map(F.lit, known)))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word
    total = files.count()
    idf, vectors = template_weights(counts, total, templates)
    unseen = template_weights({}, total, (("", "x"),))[0]["x"]
    anchor_words = anchors(idf, vectors, threshold)
    hit = r"(?<![a-z0-9])(" + "|".join(sorted(map(re.escape, anchor_words))) + r")(?![a-z0-9])"
    files = files.where(F.lower("_text").rlike(hit))
    parts = _parts(files, anchor_words)
    words = parts.select("_k1", "_k2", "_part", F.explode(_words(F.col("_text"))).alias("_word"))
    counted = words.groupBy("_k1", "_k2", "_part", "_word").agg(F.count(F.lit(1)).alias("_tf"))
    weights = spark.createDataFrame([(w, float(x)) for w, x in idf.items()], "w string, idf double")
    entries = [(w, i, name, x) for i, ((name, _), v) in enumerate(zip(templates, vectors)) for w, x in v.items()]
    # both tables are as small as the templates
    weighed = counted.join(F.broadcast(weights), F.col("_word") == F.col("w"), "left").withColumn("_x", F.col("_tf") * F.coalesce("idf", F.lit(unseen)))
    lengths = weighed.groupBy("_k1", "_k2", "_part").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    vectors_df = spark.createDataFrame(entries, "w2 string, _template int, _name string, _y double")
    dots = weighed.where("idf is not null").join(F.broadcast(vectors_df), F.col("_word") == F.col("w2"))
    dots = dots.groupBy("_k1", "_k2", "_part", "_template", "_name").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    scored = dots.join(lengths, ["_k1", "_k2", "_part"]).withColumn("_score", F.round(F.col("_dot") / F.col("_norm"), 6)).where(F.col("_score") >= threshold)
    scored = scored.select("_k1", "_k2", "_name", "_score").unionByName(_window_scores(files, idf, vectors, unseen, threshold, templates))
    best = scored.groupBy("_k1", "_k2").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_name").alias("n"))).alias("_b"))
    return best.select("_k1", "_k2", F.col("_b.n").alias("own_license"), (-F.col("_b.s")).alias("own_score"))


def _parent(path: Column) -> Column:
    """Directory of a path; NULL at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def license_scan(files: DataFrame, id_col: str, path_col: str, text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, own_license, own_score, license, license_from`` per row of ``files``.

    ``license`` is the file's own one, or else that of the licence file in the nearest directory above;
    ``license_from`` names that directory. Directories are resolved among themselves and only then joined to the
    files. NULL and empty texts have no licence; a NULL path inherits nothing; repeated rows get equal results;
    of several licence files in one directory the nearest to a template counts; an empty table gives no rows.
    """
    rows = files.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_k1": F.xxhash64("doc_id", "path", "_text"), "_k2": F.xxhash64("_text", "path", "doc_id", F.lit(2))})
    own = materialize(own_licences(rows.select("_k1", "_k2", "_text"), threshold, templates))
    light = materialize(rows.select("doc_id", "path", "_k1", "_k2").join(own, ["_k1", "_k2"], "left").withColumn("_dir", _parent(F.col("path"))))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILES)
    given = light.where(named & F.col("own_license").isNotNull() & F.col("_dir").isNotNull())
    given = given.groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("n"))).alias("_b"))
    given = given.select("_at", F.col("_b.n").alias("_given"))
    # the ancestors of every directory, itself included
    dirs = light.where("_dir is not null").select("_dir").distinct()
    steps = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("_up"))
    near = above.join(given, F.col("_up") == F.col("_at")).groupBy("_dir").agg(F.max_by(F.struct("_given", "_up"), F.length("_up")).alias("_near"))
    near = materialize(near.withColumnRenamed("_dir", "_d"))
    met = light.join(near, F.col("_dir") == F.col("_d"), "left")
    inherits = F.col("own_license").isNull() & F.col("_near").isNotNull()
    return met.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", F.col("_near._given")).alias("license"),
        F.when(inherits, F.col("_near._up")).alias("license_from"),
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """The documents as a file tree ``source/a/b/name``: 4096 ids to a directory ``a``, 64 to a ``b``.

    The table has no paths. The first of 16 documents of a directory ``b`` is named as its licence file, the first
    document of a directory ``a`` as that directory's.
    """
    i = F.col("doc_id")
    a, b = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 4096).cast("string")), F.floor(i / 64).cast("string")
    name = F.when(i % 4096 == 0, F.concat_ws("/", a, F.lit("LICENSE"))).when(i % 16 == 0, F.concat_ws("/", a, b, F.concat(F.lit("LICENSE-"), i.cast("string"))))
    return docs.select("doc_id", F.when(i.isNotNull(), F.coalesce(name, F.concat_ws("/", a, b, F.concat(i.cast("string"), F.lit(".txt"))))).alias("path"), "text")


_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
_W = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
SQL = rf"""
WITH f AS (SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id // 4096) AS a, '/' || (doc_id // 64) AS b, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, CASE WHEN doc_id % 4096 = 0 THEN a || '/LICENSE' WHEN doc_id % 16 = 0 THEN a || b || '/LICENSE-' || doc_id ELSE a || b || '/' || doc_id || '.txt' END AS path,
  CASE WHEN doc_id % 4096 = 0 THEN a ELSE a || b END AS dir, a, doc_id % 16 = 0 AS lic, text FROM f),
tp AS (SELECT * FROM (VALUES {_VALUES}) t(i, name, txt)),
tw AS (SELECT i, name, w, count(*) AS c FROM (SELECT i, name, unnest({_W.format('txt')}) AS w FROM tp) GROUP BY ALL),
vo AS (SELECT DISTINCT w FROM tw),
dfc AS (SELECT w, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_W.format('text')}) AS w FROM f) JOIN vo USING (w) GROUP BY w),
nn AS (SELECT count(*) AS n FROM f),
idf AS (SELECT w, ln((1.0 + (SELECT n FROM nn)) / (1 + coalesce(n, 0))) + 1 AS idf FROM vo LEFT JOIN dfc USING (w)),
tv AS (SELECT i, name, w, c * idf AS x FROM tw JOIN idf USING (w)),
tn AS (SELECT i, sqrt(sum(x * x)) AS norm FROM tv GROUP BY i),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln_no FROM f),
lw AS (SELECT doc_id, ln_no, unnest({_W.format('line')}) AS w FROM ln),
lc AS (SELECT doc_id, ln_no, w, count(*) AS tf FROM lw GROUP BY ALL),
lx AS (SELECT doc_id, ln_no, w, tf * coalesce(idf, ln(1.0 + (SELECT n FROM nn)) + 1) AS x, idf IS NOT NULL AS k FROM lc LEFT JOIN idf USING (w)),
lm AS (SELECT doc_id, ln_no, sqrt(sum(x * x)) AS norm FROM lx GROUP BY ALL),
dt AS (SELECT lx.doc_id, lx.ln_no, tv.i, tv.name, sum(lx.x * tv.x) AS dot FROM lx JOIN tv USING (w) GROUP BY ALL),
sc AS (SELECT dt.doc_id, name, round(dot / (lm.norm * tn.norm), 6) AS s FROM dt JOIN lm USING (doc_id, ln_no) JOIN tn USING (i)),
ow AS (SELECT doc_id, name, s FROM sc WHERE s >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, name) = 1),
gv AS (SELECT dir, name FROM p JOIN ow USING (doc_id) WHERE lic QUALIFY row_number() OVER (PARTITION BY dir ORDER BY s DESC, name) = 1)
SELECT p.doc_id, p.path, ow.name AS own_license, ow.s AS own_score, coalesce(ow.name, g2.name, g1.name) AS license,
  CASE WHEN ow.name IS NULL THEN CASE WHEN g2.name IS NOT NULL THEN p.dir WHEN g1.name IS NOT NULL THEN p.a END END AS license_from
FROM p LEFT JOIN ow ON p.doc_id = ow.doc_id LEFT JOIN gv g2 ON p.dir = g2.dir LEFT JOIN gv g1 ON p.a = g1.dir"""
