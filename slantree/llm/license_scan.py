"""License scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

DataFrame operations only.  A header is a line with a licence cue.  Its words
and those of the templates are weighted by idf over all headers of the table;
only the templates' vocabulary needs idf values, so that table is bounded by
the templates.  Notices wrapped over up to NOTICE_LINES lines are scored like
headers, and the whole texts of licence files are held against full licence
texts, weighted by idf over all licence files.  Files without a licence of
their own inherit the one of the nearest ancestor directory that holds a
licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantree.llm.durable import written

CUE = "(?i)licen[cs]e|copyright|spdx|creative commons|public domain|all rights reserved"
#: The cue where a line break, with the next line's comment sign, stands for its space.
WRAPPED_CUE = CUE.replace(" ", r"[\s#*/;-]+")
#: A notice is looked for in runs of up to so many adjacent lines.
NOTICE_LINES = 4
LICENCE_FILE = r"(?i)(^|/)licen[cs]e[^/]*$"
WORD = "[a-z0-9]+"
THRESHOLD = 0.7
#: Licences and typical header statements (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is free software under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """Licences and their whole texts.

    BSD-2-Clause is BSD-3-Clause without its third clause.  The AGPL-3.0 has
    the words of the GPL-3.0 but for its name and one section; here only the
    name is replaced.
    """
    texts = {f.name[:-4]: f.read_text("utf-8") for f in resources("slantree.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    texts["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n", "", texts["BSD-3-Clause"], flags=re.S)
    texts["AGPL-3.0"] = re.sub(r"(?i)gnu\s+general", "GNU Affero General", texts["GPL-3.0"])
    return tuple(sorted(texts.items()))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def headers(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per line with a cue, of every whole text: id, line number from 0, line."""
    near = df.where(F.col(text_col).rlike(CUE)).select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return near.where(F.col("line").rlike(CUE))


def notices(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per run of 2 to NOTICE_LINES adjacent lines with a cue, joined by spaces: id, line_no (null), line."""
    run = "transform(sequence(0, size(_l) - n), i -> array_join(slice(_l, i + 1, n), ' '))"
    runs = F.expr(f"flatten(transform(filter(sequence(2, {NOTICE_LINES}), n -> n <= size(_l)), n -> {run}))")
    near = df.where(F.col(text_col).rlike(WRAPPED_CUE)).select(F.col(id_col), F.split(text_col, "\n").alias("_l"))
    return near.select(id_col, F.lit(None).cast("int").alias("line_no"), F.explode(runs).alias("line")).where(F.col("line").rlike(WRAPPED_CUE))


def match_headers(lines: DataFrame, templates=TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """Best template of each distinct header line or notice: line, license, score (cosine, 6 decimals).

    idf = ln((1 + headers) / (1 + headers with the word)) + 1 over all headers,
    repeated ones included; rows without a line number (notices) do not count.
    Words outside the templates weigh as unseen ones.  Ties go to the first
    licence by name.
    """
    # Equal lines are counted first: a line that half the table holds is one row from here on.
    distinct = named(lines.groupBy("line").agg(F.count("line_no").alias("copies")), "lines").withColumn("words", words_of(F.col("line")))
    return distinct.join(match(distinct, templates), "name").select("line", "license", "score")


def named(df: DataFrame, what: str) -> DataFrame:
    """`df` with a number per row (`name`), fixed by writing the table."""
    return written(df.withColumn("name", F.monotonically_increasing_id()), what)


def squares(words: Column, vocabulary: Sequence[str]) -> Column:
    """The sum of squared counts of the words outside the vocabulary, within the row: runs of the sorted words."""
    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    # (k + 1)^2 - k^2 = 2 k + 1 for the next word of a run of k.
    run = lambda s, w: F.when(s["word"] == w, s["run"]).otherwise(0.0)
    step = lambda s, w: F.struct(w.alias("word"), (run(s, w) + 1.0).alias("run"), (s["total"] + 2.0 * run(s, w) + 1.0).alias("total"))
    return F.aggregate(F.array_sort(F.filter(words, lambda w: ~w.isin(*vocabulary))), start, step, lambda s: s["total"])


def match(distinct: DataFrame, templates) -> DataFrame:
    """Best template of each row of name, copies and words: name, license, score.

    Only words of the templates are shuffled, as numbers; what the others add
    to a norm is known within the row, since all of them weigh the same.
    """
    spark = distinct.sparkSession
    counted = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    words = sorted(set().union(*counted))
    codes = F.broadcast(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, code int"))
    inside = distinct.select("name", "copies", F.explode(F.filter("words", lambda w: w.isin(*words))).alias("word")).join(codes, "word")
    terms = written(inside.groupBy("name", "code").agg(F.count("*").alias("n"), F.first("copies").alias("copies")), "terms")
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    df = {r["code"]: r["df"] for r in terms.groupBy("code").agg(F.sum("copies").alias("df")).collect()}  # bounded by the templates
    idf = [math.log((1 + total) / (1 + df.get(k, 0))) + 1 for k in range(len(words))]
    unseen = math.log(1.0 + total) + 1
    weights = [[c[w] * idf[k] for c in counted] for k, w in enumerate(words)]
    norms = [math.sqrt(sum(row[t] ** 2 for row in weights)) for t in range(len(templates))]
    columns = ", ".join(f"w{t} double" for t in range(len(templates)))
    weighted = F.broadcast(spark.createDataFrame([(k, idf[k], *row) for k, row in enumerate(weights)], f"code int, idf double, {columns}"))
    own = F.col("n") * F.col("idf")
    sums = terms.join(weighted, "code").groupBy("name").agg(F.sum(own * own).alias("inside"), *[F.sum(own * F.col(f"w{t}")).alias(f"dot{t}") for t in range(len(templates))])
    norm = F.sqrt(F.col("inside") + F.lit(unseen**2) * F.col("outside"))
    scores = [F.when(F.col(f"dot{t}") > 0, F.struct((-F.round(F.col(f"dot{t}") / (norm * F.lit(norms[t])), 6)).alias("score"), F.lit(name).alias("license"))) for t, (name, _) in enumerate(templates)]
    best = distinct.select("name", squares(F.col("words"), words).alias("outside")).join(sums, "name").select("name", F.array_min(F.array_compact(F.array(*scores))).alias("best"))
    return best.select("name", F.col("best.license").alias("license"), (-F.col("best.score")).alias("score"))


def own_licenses(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, templates=TEMPLATES, licence_file: Column | None = None
) -> DataFrame:
    """id, own_license, own_score, n_headers; only ids that have headers, notices or a licence text.

    The best header, notice or, in rows of `licence_file`, whole text decides;
    a document whose best score is below `threshold` has a null licence and the
    score of its best header.  Rows with a null id count for idf but give no row.
    """
    lines = written(headers(df, text_col, id_col).union(notices(df, text_col, id_col)), "headers")
    scored = lines.join(match_headers(lines, templates, id_col), "line", "left").where(F.col(id_col).isNotNull())
    scored = scored.where(F.col("line_no").isNotNull() | (F.col("score") >= threshold)).select(id_col, "line_no", "license", "score")
    if licence_file is not None:
        texts = df.where(licence_file & F.col(text_col).isNotNull()).select(id_col, F.unhex(F.md5(text_col)).alias("key"), text_col)
        distinct = named(texts.groupBy("key").agg(F.count("*").alias("copies"), F.any_value(text_col).alias("text")), "licence_files")
        held = match(distinct.withColumn("words", words_of(F.col("text"))), full_texts()).where(F.col("score") >= threshold).join(distinct.select("name", "key"), "name")
        scored = scored.union(texts.select(id_col, "key").join(held, "key").where(F.col(id_col).isNotNull()).select(id_col, F.lit(None).cast("int"), "license", "score"))
    best = scored.groupBy(id_col).agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("score"), "license")).alias("best"), F.countDistinct("line_no").alias("n_headers"))
    score = -F.col("best.score")
    return best.select(id_col, F.when(score >= threshold, F.col("best.license")).alias("own_license"), (score + 0.0).alias("own_score"), "n_headers")


def parent(path: Column) -> Column:
    """The directory of a path; the root's is empty."""
    return F.regexp_replace(path, "/[^/]*$", "")


def inherit(files: DataFrame, path_col: str = "path", license_col: str = "own_license", is_licence_file: Column | None = None) -> DataFrame:
    """Add `inherited_license` and `inherited_from` (a directory) to files without a licence of their own.

    A directory is licensed by the licence files in it (several: the most
    frequent licence, then the first by name).  The nearest ancestor is found on
    distinct directories, joined once per ancestor path, and joined back to the
    files by directory.  A null path inherits nothing.
    """
    licence_file = is_licence_file if is_licence_file is not None else F.col(path_col).rlike(LICENCE_FILE)
    placed = files.withColumn("_dir", parent(F.col(path_col)))
    held = placed.where(licence_file & F.col(license_col).isNotNull()).groupBy("_dir", F.col(license_col).alias("_license")).agg(F.count("*").alias("n"))
    licensed = held.groupBy(F.col("_dir").alias("_ancestor")).agg(F.min(F.struct((-F.col("n")).alias("n"), "_license")).alias("_b")).select("_ancestor", F.col("_b._license").alias("_license"))
    parts = F.split("_dir", "/")
    ancestors = placed.where(F.col("_dir").isNotNull()).select("_dir").distinct().select("_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_ancestor"))
    nearest = ancestors.join(licensed, "_ancestor").groupBy("_dir").agg(F.max(F.struct(F.length("_ancestor").alias("n"), "_ancestor", "_license")).alias("_near"))
    none = F.col(license_col).isNull()
    joined = placed.join(nearest, "_dir", "left")
    return joined.withColumns({"inherited_license": F.when(none, F.col("_near._license")), "inherited_from": F.when(none, F.col("_near._ancestor"))}).drop("_dir", "_near")


def scan(files: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """id, path, own_license, own_score, n_headers, inherited_license, inherited_from, license of every row.

    Null and empty texts have no header (score 0).  Repeated rows with one id
    share their best header.  `license` is the own one, else the inherited one.
    """
    own = own_licenses(files, text_col, id_col, threshold, licence_file=F.col(path_col).rlike(LICENCE_FILE))
    known = files.select(id_col, path_col).join(own, id_col, "left").withColumns({"own_score": F.coalesce("own_score", F.lit(0.0)), "n_headers": F.coalesce("n_headers", F.lit(0).cast("long"))})
    return inherit(known, path_col).withColumn("license", F.coalesce("own_license", "inherited_license"))
