"""License scans: sparse TF-IDF cosine of headers and licence files to templates, inherited down the folders.

Templates are license headers and full license texts. Three kinds of word runs of a text become sparse vectors of
TF-IDF weights, (1 + log tf) * idf, and are compared by cosine:

* the whole text with all templates: at the threshold the file is a licence file and speaks for its folder;
* every line that holds a telling word, with all templates;
* windows of a template's length, across lines or inside a line that is no license as a whole, with that template:
  one starts where a telling word of the template stands in the text. Templates of up to ``LOOSE_WORDS`` words have
  each telling word as anchor, longer ones each telling word with a neighbour.

A telling word is one that names a license ("licen", "gpl", "permission", ...); a run without any is no license, and texts
without any are not looked at further. Headers count only where version and variant words agree ("version 3", "lesser",
"nc"); full texts are told apart by their similarity alone. What is accepted has to be within ``MARGIN`` of the
most similar template of the same run, so a template refused for its marks does not bring forward a far weaker one.

Files without a license of their own take that of the nearest folder above them that has a licence file, found by
joining each folder with its ancestors.

All steps are DataFrame expressions and joins. The templates are a parameter of a few rows; their words bound what is
broadcast. Equal texts, lines and windows are compared once, so a header that a third of all files carry is
one row after map-side combining.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from math import log, sqrt
from pkgutil import get_data

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialise, work_path

# fixed values: usual names, headers and marks of licenses
_GNU_END = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. "
    "You should have received a copy of the GNU {kind}General Public License along with this {what}. "
    "If not, see <https://www.gnu.org/licenses/>."
)
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{end}"
_LATER = "; either version {v} of the License, or (at your option) any later version. "


def _gnu(name: str, kind: str, short: str, version: str, dated: str) -> list[tuple[str, str]]:
    what = "library" if kind in ("Lesser ", "Library ") else "program"
    plain = version.removesuffix(".0")
    names = {"what": what, "kind": kind}
    return [
        (name, f"GNU {kind}General Public License Version {plain}, {dated}"),
        (name, f"This work is licensed under the GNU {kind}General Public License, version {plain}."),
        (name, f"GNU {kind}General Public License v{version}"),
        (name, f"GNU {kind}General Public License version {plain}"),
        (name, f"Licensed under the {short} version {plain}"),
        (name, f"Released under the {short}v{plain}"),
        (name, (_GNU.format(mark=":", end=_LATER.format(v=plain), **names) + _GNU_END.format(**names))),
        (name, _GNU.format(mark=":", end=_LATER.format(v=plain), **names)),
        (name, _GNU.format(mark=";", end=f" version {plain}.", **names)),
        (name, f"SPDX-License-Identifier: {name}-only"),
        (name, f"SPDX-License-Identifier: {name}-or-later"),
        (name, f"SPDX-License-Identifier: {name}"),
    ]


def _cc(parts: str) -> list[tuple[str, str]]:
    words = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    full, short = "-".join(words[p] for p in parts.split("-")), parts.upper()
    name = f"CC-{short}-4.0"
    return [
        (name, f"Licensed under CC {short} 4.0."),
        (name, f"Creative Commons {full} 4.0 International License"),
        (name, f"This work is licensed under a Creative Commons {full} 4.0 International License."),
        (name, f"https://creativecommons.org/licenses/{parts}/4.0/"),
        (name, f"SPDX-License-Identifier: {name}"),
    ]


HEADERS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    ("MIT", "SPDX-License-Identifier: MIT"),
    *_gnu("GPL-2.0", "", "GPL", "2.0", "June 1991"),
    *_gnu("GPL-3.0", "", "GPL", "3.0", "29 June 2007"),
    *_gnu("LGPL-2.0", "Library ", "LGPL", "2.0", "June 1991"),
    *_gnu("LGPL-2.1", "Lesser ", "LGPL", "2.1", "February 1999"),
    *_gnu("LGPL-3.0", "Lesser ", "LGPL", "3.0", "29 June 2007"),
    *_gnu("AGPL-3.0", "Affero ", "AGPL", "3.0", "19 November 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3"),
    *_cc("by"),
    *_cc("by-sa"),
    *_cc("by-nd"),
    *_cc("by-nc"),
    *_cc("by-nc-sa"),
    *_cc("by-nc-nd"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-1.1", "SPDX-License-Identifier: MPL-1.1"),
    ("EPL-2.0", "Eclipse Public License Version 2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)
FULL = (
    "Apache-2.0 MIT ISC BSD-2-Clause BSD-3-Clause Unlicense GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 "
    "CC0-1.0 GFDL-1.2 GFDL-1.3 Artistic-1.0"
).split()
TEMPLATES: tuple[tuple[str, str], ...] = HEADERS + tuple((name, get_data(__name__, f"license_texts/{name}.txt").decode()) for name in FULL)


def _version(version: str, *shorts: str) -> list[str]:
    plain = version.removesuffix(".0")
    return [f"{s}{v}" for s in ("", "v", *shorts, *[f"{s}v" for s in shorts]) for v in sorted({version, plain})]


_LESSER, _AFFERO = ["lesser", "library", "lgpl"], ["affero", "agpl"]
_LGPL, _AGPL, _GPL = ([f"{s}{v}{n}" for v in ("", "v") for n in ("2", "2.0", "2.1", "3", "3.0")] for s in ("lgpl", "agpl", "gpl"))
_CC = {"by": ["by", "attribution"], "nc": ["nc", "noncommercial", "commercial"], "sa": ["sa", "sharealike"], "nd": ["nd", "noderivatives", "noderivs"]}


def _cc_marks(parts: str) -> tuple[list[list[str]], list[str]]:
    have = parts.split("-")
    return [_version("4.0"), *[_CC[p] for p in have]], [w for p in _CC if p not in have for w in _CC[p]]


# per license: of each list a word must be there; words that must not
MARKS: dict[str, tuple[list[list[str]], list[str]]] = {
    "Apache-2.0": ([_version("2.0", "apache", "license"), ["apache", *_version("2.0", "apache")[4:]]], []),
    "GPL-1.0": ([_version("1.0", "gpl")], _LESSER + _AFFERO + _LGPL + _AGPL),
    "GPL-2.0": ([_version("2.0", "gpl")], _LESSER + _AFFERO + _LGPL + _AGPL),
    "GPL-3.0": ([_version("3.0", "gpl")], _LESSER + _AFFERO + _LGPL + _AGPL),
    "LGPL-2.0": ([_version("2.0", "lgpl"), _LESSER + _LGPL], _AFFERO + _AGPL),
    "LGPL-2.1": ([_version("2.1", "lgpl"), _LESSER + _LGPL], _AFFERO + _AGPL),
    "LGPL-3.0": ([_version("3.0", "lgpl"), _LESSER + _LGPL], _AFFERO + _AGPL),
    "AGPL-3.0": ([_version("3.0", "agpl"), _AFFERO + _AGPL], []),
    **{f"CC-{p.upper()}-4.0": _cc_marks(p) for p in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")},
    "MPL-1.1": ([_version("1.1", "mpl")], []),
    "MPL-2.0": ([_version("2.0", "mpl")], []),
    "EPL-2.0": ([_version("2.0", "epl")], []),
    "GFDL-1.2": ([_version("1.2", "gfdl")], []),
    "GFDL-1.3": ([_version("1.3", "gfdl")], []),
}
# parts of the words that name a license
TELLING = ("licen", "permission", "redistribution", "unencumbered", "commons", "spdx", "gpl")
WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
THRESHOLD = 0.7
MARGIN = 0.05
LOOSE_WORDS = 60  # templates up to this length are looked for at every telling word of theirs
DECIMALS = 6


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and dots that begin and end with a letter or digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)*)"), F.lit(1))


def telling(word: str) -> bool:
    return any(part in word for part in TELLING)


def tells(word: Column) -> Column:
    return F.regexp_like(word, F.lit("|".join(TELLING)))


class Bank:
    """The templates' words, weights and anchors."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.words = [WORD.findall(text.lower()) for _, text in templates]
        of = Counter(w for words in self.words for w in set(words))
        self.idf = {w: log((len(templates) + 1) / (n + 0.5)) for w, n in of.items()}
        self.rare = log((len(templates) + 1) / 0.5)  # a word of no template
        self.weights = []
        for words in self.words:
            raw = {w: (1 + log(n)) * self.idf[w] for w, n in Counter(words).items()}
            norm = sqrt(sum(v * v for v in raw.values())) or 1.0
            self.weights.append({w: v / norm for w, v in raw.items()})

    def anchors(self) -> list[tuple[str, int, int, int]]:
        """(anchor, template, its place, the template's length): the first place of each anchor."""
        out = []
        for t, words in enumerate(self.words):
            first: dict[str, int] = {}
            for at, w in enumerate(words):
                if not telling(w):
                    continue
                near = [w] if len(words) <= LOOSE_WORDS else [" ".join(words[i : i + 2]) for i in (at - 1, at) if 0 <= i < len(words) - 1]
                for anchor in near:
                    first.setdefault(anchor, at)
            out += [(anchor, t, at, len(words)) for anchor, at in first.items()]
        return out


def weigh(runs: DataFrame, bank: Bank) -> DataFrame:
    """(key, word, weight) of runs (key, words), each key once; the weights of a key have norm 1."""
    spark = runs.sparkSession
    idf = F.broadcast(spark.createDataFrame(list(bank.idf.items()) or [("", 0.0)], "word string, idf double"))
    # all words of a run stay in the task that the run is dealt to
    counted = runs.select("key", "words").repartition("key").select("key", F.explode("words").alias("word"))
    counted = counted.groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    raw = counted.join(idf, "word", "left").select(
        "key", "word", ((1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(bank.rare))).alias("raw"), F.col("idf").isNotNull().alias("known")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("key")))
    return raw.withColumn("weight", F.col("raw") / norm).where("known").select("key", "word", "weight")


def scan(
    df: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, path, own_license, similarity, licence_file, license, inherited_from) for every row of ``df``.

    ``path`` is the slash-separated path of a row; a null path stands alone and inherits nothing. Of equally near
    templates the smaller license name wins; of several licence files in a folder the one with the greatest similarity, then
    the smaller name, then the smaller path. Null and empty texts have no license of their own. Rows that repeat an id are
    answered each. Further columns are ignored.
    """
    spark = df.sparkSession
    bank = Bank(templates)
    low = F.lower(F.col(text_col))
    asks = reduce(lambda a, b: a | b, [F.contains(low, F.lit(part)) for part in TELLING])
    files = df.select(F.col(id_col).alias("doc"), path.alias("path"), F.when(asks, F.col(text_col)).alias("text"))
    files = files.withColumn("text_key", F.when(F.col("text").isNotNull(), F.sha2("text", 256)))
    # texts with a telling word, equal ones once
    store = work_path(spark, "license-texts")
    held = files.where("text_key is not null").select("text_key", "text").dropDuplicates(["text_key"])
    held.write.option("compression", "zstd").parquet(store)
    texts = spark.read.parquet(store)
    files = materialise(files.drop("text"))

    known = spark.createDataFrame(
        [(t, name, t < len(HEADERS) or templates is not TEMPLATES, *MARKS.get(name, ([], []))) for t, (name, _) in enumerate(templates)],
        "template int, license string, marked boolean, must array<array<string>>, never array<string>",
    )
    weights = [(t, w, v) for t, of in enumerate(bank.weights) for w, v in of.items() if v]
    weights = F.broadcast(spark.createDataFrame(weights or [(-1, "", 0.0)], "template int, word string, theirs double"))
    marks = F.array(*[F.lit(w) for w in sorted({w for must, never in MARKS.values() for ws in [*must, never] for w in ws})])
    of_words = lambda words: F.sha2(F.array_join(words, " "), 256)
    similar = F.round(F.sum(F.col("weight") * F.col("theirs")), DECIMALS).alias("similarity")

    def accepted(near: DataFrame, runs: DataFrame) -> DataFrame:
        """(key, said): the best agreeing template of each run, as (-similarity, license)."""
        spoken = runs.select("key", F.array_intersect("words", marks).alias("marks"))
        agree = ~F.col("marked") | (F.forall("must", lambda any_word: F.arrays_overlap(any_word, "marks")) & ~F.arrays_overlap("never", "marks"))
        near = near.withColumn("top", F.max("similarity").over(Window.partitionBy("key")))
        fit = near.join(F.broadcast(known), "template").join(spoken, "key")
        fit = fit.where(agree & (F.col("similarity") >= F.col("top") - MARGIN))
        return fit.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("far"), F.col("license").alias("own_license"))).alias("said"))

    def nearest_of(runs: DataFrame) -> DataFrame:
        near = weigh(runs, bank).join(weights, "word").groupBy("key", "template").agg(similar)
        return materialise(accepted(near.where(F.col("similarity") >= threshold), runs))

    # whole texts, and lines with a telling word
    whole = nearest_of(texts.select(F.col("text_key").alias("key"), words_of(F.col("text")).alias("words"))).withColumnRenamed("key", "text_key")
    rest = texts.join(whole.select("text_key"), "text_key", "left_anti")
    lines = rest.select("text_key", F.posexplode(F.split("text", "\n")).alias("line", "of_line"))
    lines = lines.where(tells(F.lower("of_line"))).select("text_key", "line", words_of(F.col("of_line")).alias("words"))
    lines = lines.withColumn("key", of_words(F.col("words")))
    by_line = nearest_of(lines.select("key", "words").dropDuplicates(["key"]))
    spoken = materialise(lines.select("text_key", "line", "key").join(by_line, "key").select("text_key", "line", "said"))

    # windows, but for telling words in lines that are licenses: places first, words once they are known
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    streams = rest.select("text_key", F.flatten(numbered).alias("stream"))
    near = F.transform(
        "stream",
        lambda s, k: F.struct(
            s["w"].alias("w"),
            k.alias("k"),
            s["line"].alias("line"),
            F.get("stream", k - 1)["w"].alias("before"),
            F.get("stream", k + 1)["w"].alias("after"),
        ),
    )
    hits = streams.select("text_key", F.explode(F.filter(near, lambda s: tells(s["w"]))).alias("hit")).select("text_key", "hit.*")
    pair = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.concat_ws(" ", x, y))
    around = F.array_distinct(F.array(F.col("w"), pair(F.col("before"), F.col("w")), pair(F.col("w"), F.col("after"))))
    hits = hits.select("text_key", "k", "line", F.explode(around).alias("anchor"))
    anchors = spark.createDataFrame(bank.anchors() or [("", -1, 0, 0)], "anchor string, template int, place int, n int")
    begun = hits.join(F.broadcast(anchors), "anchor").select("text_key", "line", "template", "n", F.greatest(F.col("k") - F.col("place"), F.lit(0)).alias("start"))
    begun = begun.join(spoken.select("text_key", "line"), ["text_key", "line"], "left_anti")
    begun = begun.select("text_key", "template", "n", "start").distinct()
    words = rest.select("text_key", F.flatten(F.transform(F.split("text", "\n"), lambda x: words_of(x))).alias("words"))
    cut = F.slice("words", F.col("start") + 1, F.col("n"))
    windows = words.join(begun, "text_key").select("text_key", "template", cut.alias("words"))
    windows = windows.select("text_key", "template", of_words(F.col("words")).alias("key"), "words")
    store = work_path(spark, "license-windows")
    windows.dropDuplicates(["text_key", "template", "key"]).write.option("compression", "zstd").parquet(store)
    windows = spark.read.parquet(store)
    runs = windows.select("key", "words").dropDuplicates(["key"])
    pairs = windows.select("key", "template").distinct()
    near = weigh(runs, bank).join(pairs, "key").join(weights, ["template", "word"]).groupBy("key", "template").agg(similar)
    by_window = materialise(accepted(near.where(F.col("similarity") >= threshold), runs))

    parts = spoken.select("text_key", "said").unionByName(windows.select("text_key", "key").distinct().join(by_window, "key").select("text_key", "said"))
    parts = parts.groupBy("text_key").agg(F.min("said").alias("said")).withColumn("licence_file", F.lit(False))
    best = whole.withColumn("licence_file", F.lit(True)).unionByName(parts).select(
        "text_key", F.col("said.own_license").alias("own_license"), (-F.col("said.far")).alias("similarity"), "licence_file"
    )
    rows = files.select("doc", "path", "text_key")
    # rows that are not compared skip the join
    silent = rows.where("text_key is null").select(
        "doc", "path", F.lit(None).cast("string").alias("own_license"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("licence_file")
    )
    best = materialise(rows.where("text_key is not null").join(best, "text_key", "left").drop("text_key"))

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    speakers = (
        best.where("licence_file and path is not null")
        .select(folder.alias("folder"), F.struct((-F.col("similarity")).alias("far"), "own_license", "path").alias("said"))
        .groupBy("folder")
        .agg(F.min("said").alias("said"))
        .select("folder", F.col("said.own_license").alias("license"), F.col("said.path").alias("source"))
    )
    # every folder with each of its ancestors, itself included; folders are far fewer than files
    folders = files.where("path is not null").select(folder.alias("start")).distinct()
    parts = F.split("start", "/")
    above = folders.select(
        "start", F.explode(F.sequence(F.lit(0), F.when(F.col("start") == "", 0).otherwise(F.size(parts)))).alias("depth")
    ).select("start", "depth", F.array_join(F.slice(F.split("start", "/"), F.lit(1), F.col("depth")), "/").alias("folder"))
    nearest = (
        above.join(speakers, "folder")
        .groupBy("start")
        .agg(F.max_by(F.struct("license", "source"), "depth").alias("given"))
        .select(F.col("start").alias("folder"), F.col("given.license").alias("given"), F.col("given.source").alias("source"))
    )
    every = best.unionByName(silent).withColumn("folder", folder).join(nearest, "folder", "left")
    return every.select(
        F.col("doc").alias(id_col),
        "path",
        "own_license",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("source")).alias("inherited_from"),
    )


def document_path(id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> Column:
    """A path for rows that have none: source, language, 1 024 ids per folder, 64 per inner folder, file name."""
    doc = F.col(id_col)
    return F.concat_ws(
        "/",
        F.coalesce(F.col(source_col), F.lit("unknown")),
        F.coalesce(F.col(lang_col), F.lit("und")),
        F.floor(doc / 1024).cast("string"),
        F.floor(F.pmod(doc, F.lit(1024)) / 64).cast("string"),
        F.concat(doc.cast("string"), F.lit(".txt")),
    )
