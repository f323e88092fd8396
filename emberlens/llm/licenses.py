"""Licence scans: TF-IDF cosine of notices to templates, then inheritance down directories
(DataFrame functions only).

One pass over the whole texts takes out the notices: sentences and lines with a word that
speaks of licences. Equal notices are counted before the shuffle and scored once. Terms
are weighted by term frequency times ``ln((1 + notices) / (1 + notices with the term)) + 1``
over all notices of the corpus, and a notice takes the template of largest cosine, if it is
``THRESHOLD`` or more. A file's licence is that of its best notice.

Blocks are what notices cannot hold: the whole text, runs of comment lines, block comments
and paragraphs of more than one line, with comment marks stripped and lines joined, and their
joined sentences that are no notice already. They are scored in the same way, weighted over the
blocks of the corpus, against full licence texts, standard headers and ``TEMPLATES``; a full text
is met only by a block with its title. A block's licence, or one named by an SPDX identifier
(cosine 1), goes before those of single notices of no greater cosine, full texts before all
notices, and any of them before "All rights reserved."; with a full text the file is a licence file.

A licence file is one named like LICENSE, COPYING or NOTICE, or one whose words are notices
to ``COVERAGE`` or more. Files without a notice of their own inherit from the licence file in
the nearest directory above them: their distinct directories are joined, by path, with the
directories that hold a licence file.

Defined results: null text is empty; a null path is the root; ties go to the name first in
order; repeated rows are scanned one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import documents, looked_up, staged, text_or_empty

THRESHOLD, COVERAGE = 0.75, 0.9

#: The notices that licences ask for, by their SPDX names.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPEAKS = "licen[cs]e|copyright|rights reserved|public domain|redistribution|spdx|cc0"
BREAK = r"\n|(?<=[.!?])\s+(?=[A-Z])"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"


#: Full texts in ``license_texts`` and the words that tell each from its variants.
TITLES = {
    "Apache-2.0": "apache license version 2.0, january 2004",
    "BSD-2-Clause": "",
    "BSD-3-Clause": "neither the name",
    "CC-BY-SA-4.0": "attribution-sharealike 4.0 international",
    "CC0-1.0": "cc0 1.0 universal",
    "GPL-2.0": "gnu general public license version 2, june 1991",
    "GPL-3.0": "gnu general public license version 3, 29 june 2007",
    "ISC": "",
    "LGPL-2.1": "gnu lesser general public license version 2.1, february 1999",
    "LGPL-3.0": "gnu lesser general public license version 3, 29 june 2007",
    "MIT": "",
    "MPL-2.0": "mozilla public license version 2.0",
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
HEADERS = (
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+!?|#+!?|--+|;+|%+|<!--|dnl\b|rem\b)[ \t]?|[ \t]*(?:\*/|-->)[ \t]*$"
COMMENT = r"^[ \t]*(?:/\*|\*|//|#|--|;|%|<!--|dnl\b|rem\b)"
SPDX = r"(?i)spdx-license-identifier:([^\n]*)"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def notices(files: DataFrame, path: Column, id_col: str, text_col: str) -> DataFrame:
    """``rid, id, path, notices, blocks, named, words`` per row: the notices in lower case without outer blanks."""
    text = text_or_empty(text_col)
    parts = F.transform(F.split(text, BREAK), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    found = F.filter(parts, lambda x: x.rlike(SPEAKS))
    has = F.lower(text).rlike(SPEAKS)
    none = F.array().cast("array<string>")
    return files.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.when(has, found).otherwise(none).alias("notices"),
        F.when(has, blocks(text, found)).otherwise(none).alias("blocks"),
        F.when(has, identifiers(text)).otherwise(none).alias("named"),
        F.when(has, F.size(F.split(F.trim(text), r"\s+"))).otherwise(0).alias("words"),
    )


def full_texts() -> list[tuple[str, str, str]]:
    """``license, body, title`` of what blocks are scored against; the title is empty where none is needed."""
    folder = Path(__file__).parent / "license_texts"
    whole = [(name, (folder / f"{name}.txt").read_text(), title) for name, title in TITLES.items()]
    return whole + [(name, body, "") for name, body in HEADERS + TEMPLATES]


def _joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARK, " "), r"\s+", " "))


def blocks(text: Column, found: Column) -> Column:
    """The distinct blocks of a text, in lower case, that speak of licences and are not among its notices."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    runs = F.split(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.lower(x).rlike(COMMENT), x).otherwise(F.lit("\x01"))), "\n"), "\x01+")
    inner = F.transform(F.split(text, r'/\*|<!--|"""'), lambda x: F.element_at(F.split(x, r"\*/|-->"), 1))
    parts = F.concat(F.array(text), runs, inner, F.split(text, r"\n[ \t]*\n"))
    parts = F.filter(parts, lambda x: F.trim(x).contains("\n") & F.lower(x).rlike(SPEAKS))
    whole = F.transform(parts, _joined)
    each = F.flatten(F.transform(whole, lambda x: F.split(x, BREAK)))
    made = F.transform(F.concat(whole, each), lambda x: F.lower(F.trim(x)))
    return F.array_except(F.filter(made, lambda x: x.rlike(SPEAKS)), found)


def identifiers(text: Column) -> Column:
    """Names of known licences after SPDX-License-Identifier, without -only, -or-later and +."""
    known = sorted({name for name, _, _ in full_texts()})
    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.split(x, r"[\s()]+")))
    named = F.transform(named, lambda x: F.lower(F.regexp_replace(x, r"(?i)(-only|-or-later|\+)$", "")))
    return F.filter(F.array(*[F.lit(name) for name in known]), lambda name: F.array_contains(named, F.lower(name)))


def score_notices(
    rows: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, titles: dict[str, str] | None = None
) -> DataFrame:
    """``notice, license, score`` for the distinct notices that meet a template and hold its title, if it has one."""
    spark = rows.sparkSession
    distinct = staged(rows.select(F.explode("notices").alias("notice")).groupBy("notice").agg(F.count(F.lit(1)).alias("n")), "notices")
    # Terms go by number: a block may be as long as its file.
    distinct = staged(distinct.withColumn("at", F.monotonically_increasing_id()), "numbered")
    total = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    terms = distinct.select("at", "n", F.explode(_terms(F.col("notice"))).alias("term"))
    terms = terms.groupBy("at", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    seen = terms.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.col("tf") * (F.log((F.lit(1.0) + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)
    weighed = terms.join(seen, "term").select("at", "term", weight.alias("w"))
    norms = weighed.groupBy("at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # Templates are a parameter of fixed size.
    given = spark.createDataFrame(list(templates), "license string, body string")
    given = given.select("license", F.explode(_terms(F.col("body"))).alias("term")).groupBy("license", "term").agg(F.count(F.lit(1)).alias("tf"))
    given = given.join(seen, "term", "left").select("license", "term", weight.alias("v"))
    sizes = given.groupBy("license").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = weighed.join(F.broadcast(given), "term").groupBy("at", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)
    scored = dots.join(norms, "at").join(F.broadcast(sizes), "license").select("at", "license", cosine.alias("score"))
    scored = scored.where(F.col("score") >= threshold).join(distinct.select("at", "notice"), "at")
    for license, title in (titles or {}).items():
        if title:
            scored = scored.where((F.col("license") != license) | F.regexp_replace("notice", r"\s+", " ").contains(title))
    best = scored.groupBy("notice").agg(F.min(F.struct((-F.col("score")).alias("worse"), "license")).alias("b"))
    return best.select("notice", F.col("b.license").alias("license"), (-F.col("b.worse")).alias("score"))


def score_blocks(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``notice, license, score, whole`` for the distinct blocks that meet a full text or a header."""
    given = full_texts()
    keyed = tuple((f"{at:03d}", body) for at, (_, body, _) in enumerate(given))
    titled = {f"{at:03d}": title for at, (_, _, title) in enumerate(given)}
    name = F.create_map(*[F.lit(x) for at, (license, _, _) in enumerate(given) for x in (f"{at:03d}", license)])
    met = score_notices(rows.select(F.col("blocks").alias("notices")), keyed, threshold, titled)
    return met.select("notice", name[F.col("license")].alias("license"), "score", (F.col("license") < f"{len(TITLES):03d}").alias("whole"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherit(wanting: DataFrame, granting: DataFrame) -> DataFrame:
    """For each ``dir`` of ``wanting``, what the nearest directory at or above it grants.

    ``granting`` has one row per ``dir``. The root is the empty string.
    """
    parts = F.split("dir", "/")
    up = F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")),
    )
    above = wanting.select("dir").distinct().select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above")
    met = above.join(granting.withColumnRenamed("dir", "above"), "above")
    near = met.groupBy("dir").agg(F.max(F.struct("depth", "above", "license", "score")).alias("g"))
    return near.select("dir", F.col("g.above").alias("from"), F.col("g.license").alias("license"), F.col("g.score").alias("score"))


def scan(
    files: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id, path, license, score, basis, licenses, inherited_from`` for every row.

    ``basis`` is ``file``, ``header``, ``inherited`` or ``none``.
    """
    rows = staged(notices(files, path, id_col, text_col), "files")
    scored = score_notices(rows, templates, threshold)
    each = rows.select("rid", F.explode("notices").alias("notice"))
    size = F.size(F.split("notice", r"\s+"))
    own = (
        looked_up(each, scored, "notice", "rid")
        .groupBy("rid")
        .agg(
            F.min(F.struct((-F.col("score")).alias("worse"), "license")).alias("b"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),  # at most the templates
            F.sum(size).alias("covered"),
        )
        .select("rid", F.col("b.license").alias("own"), (-F.col("b.worse")).alias("own_score"), "licenses", "covered")
    )
    held = looked_up(rows.select("rid", F.explode("blocks").alias("notice")), score_blocks(rows, threshold), "notice", "rid")
    held = held.select("rid", "license", "score", "whole")
    spdx = rows.select("rid", F.explode("named").alias("license"), F.lit(1.0).alias("score"), F.lit(False).alias("whole"))
    held = held.union(spdx).groupBy("rid").agg(
        # "All rights reserved." is in many licences.
        F.min(F.struct((F.col("license") == "Proprietary").alias("plain"), (-F.col("score")).alias("worse"), "license")).alias("b"),
        F.collect_set("license").alias("blocks"),  # at most the templates
        F.max("whole").alias("whole"),
    )
    general = (F.col("own") == "Proprietary") & ~F.col("b.plain")
    first = F.col("b").isNotNull() & (F.col("own").isNull() | F.col("whole") | general | (-F.col("b.worse") >= F.col("own_score")))
    own = own.join(held, "rid", "full").select(
        "rid",
        F.when(first, F.col("b.license")).otherwise(F.col("own")).alias("own"),
        F.when(first, -F.col("b.worse")).otherwise(F.col("own_score")).alias("own_score"),
        F.when(F.col("blocks").isNull(), F.col("licenses")).otherwise(
            F.array_join(F.array_sort(F.array_union("blocks", F.filter(F.split(F.coalesce("licenses", F.lit("")), ","), lambda x: x != ""))), ",")
        ).alias("licenses"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    whole = rows.select("rid", "id", "path", "words", _directory(F.col("path")).alias("dir")).join(own, "rid", "left")
    is_file = F.col("own").isNotNull() & (named | F.col("whole") | (F.col("covered") >= COVERAGE * F.col("words")))
    whole = staged(whole.withColumn("is_file", is_file), "scanned")
    granting = whole.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("worse"), F.col("own").alias("license"))).alias("g"))
    granting = granting.select("dir", F.col("g.license").alias("license"), (-F.col("g.worse")).alias("score"))
    given = inherit(whole.where("own is null"), granting)
    basis = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("license").isNotNull(), "inherited").otherwise("none")
    mine = F.col("own").isNotNull()
    return looked_up(whole, given, "dir", "rid", "left").select(
        "id",
        "path",
        F.coalesce("own", "license").alias("license"),
        F.coalesce("own_score", "score").alias("score"),
        basis.alias("basis"),
        "licenses",
        F.when(~mine, F.col("from")).alias("inherited_from"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the directory that is their source."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return scan(documents(spark, sf_dir), path).withColumnRenamed("id", "doc_id")


_VALUES = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES)
#: RE2 has no look-around: sentence ends become line breaks first.
OP1_SQL = rf"""
WITH f AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, coalesce(source, '') AS dir,
                  coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS part FROM f),
each AS (SELECT doc_id, trim(regexp_replace(lower(part), '\s+', ' ', 'g'), ' ') AS notice FROM p
         WHERE regexp_matches(lower(part), '{SPEAKS}')),
d AS (SELECT notice, count(*) AS n FROM each GROUP BY notice),
total AS (SELECT coalesce(sum(n), 0) AS n FROM d),
terms AS (SELECT notice, n, term, count(*) AS tf FROM (SELECT notice, n, unnest(regexp_extract_all(notice, '{TERM}')) AS term FROM d) GROUP BY ALL),
seen AS (SELECT term, sum(n) AS df FROM terms GROUP BY term),
weighed AS (SELECT notice, term, tf * (ln((1.0 + (SELECT n FROM total)) / (1.0 + df)) + 1.0) AS w FROM terms JOIN seen USING (term)),
norms AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY notice),
t AS (SELECT * FROM (VALUES {_VALUES}) v(license, body)),
tt AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM t) GROUP BY ALL),
given AS (SELECT license, term, tf * (ln((1.0 + (SELECT n FROM total)) / (1.0 + coalesce(df, 0))) + 1.0) AS v FROM tt LEFT JOIN seen USING (term)),
sizes AS (SELECT license, sqrt(sum(v * v)) AS size FROM given GROUP BY license),
scored AS (SELECT notice, license, round(sum(w * v) / (any_value(norm) * any_value(size)), 6) AS score
           FROM weighed JOIN given USING (term) JOIN norms USING (notice) JOIN sizes USING (license) GROUP BY notice, license),
best AS (SELECT notice, license, score FROM scored WHERE score >= {THRESHOLD}
         QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, license) = 1),
hits AS (SELECT doc_id, license, score, len(string_split(notice, ' ')) AS size FROM each JOIN best USING (notice)),
own AS (SELECT doc_id, arg_min(license, (-score, license)) AS own, max(score) AS own_score,
               string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, sum(size) AS covered FROM hits GROUP BY doc_id),
whole AS (SELECT f.*, own.*  EXCLUDE (doc_id),
                 own IS NOT NULL AND covered >= {COVERAGE} * len(regexp_split_to_array(trim(text, ' '), '\s+')) AS is_file
          FROM f LEFT JOIN own USING (doc_id)),
granting AS (SELECT dir, arg_min(own, (-own_score, own)) AS license, max(own_score) AS score FROM whole WHERE is_file GROUP BY dir)
SELECT doc_id, path, coalesce(own, license) AS license, coalesce(own_score, score) AS score,
       CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       licenses, CASE WHEN own IS NULL AND license IS NOT NULL THEN dir END AS inherited_from
FROM whole LEFT JOIN granting USING (dir)
"""
