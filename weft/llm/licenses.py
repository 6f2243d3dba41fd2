"""License scans: a trained paragraph classifier, in DataFrame functions and Spark ML only.

Word n-grams of a paragraph are hashed to a sparse vector, and a multinomial logistic regression, trained here on license notices and
on other paragraphs, names a family. A calibrated threshold sends unsure paragraphs to the unknown class, and comparison
with the templates of all families confirms the rest.

A paragraph is a line, or one that does not end a sentence with the lines after it that a notice could reach, so that wrapped notices are found too.
Each operand of a license expression (``MIT OR Apache-2.0``) is a paragraph of its own. Headings and short names are known where they are the whole paragraph,
or stand in a phrase that grants; sentences that take a grant back are left out before a paragraph is judged.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, bounded_sample, cut

UNKNOWN = "unknown"
#: Short notices by family, in the words in which they are commonly given, and the family's names in the SPDX list.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "This software is distributed under the Apache License 2.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Distributed under the GPL, version 2 or later.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Distributed under the LGPL, version 2.1 or later.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Distributed under the AGPL, version 3 or later.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "EPL": [
        "Released under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    ],
    "Zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "EUPL": ["Licensed under the European Union Public License, version 1.2."],
    "WTFPL": ["Released under the Do What The Fuck You Want To Public License."],
    "Artistic-2.0": ["This program is released under the Artistic License 2.0."],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
}
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "ISC": ["ISC"], "EPL": ["EPL-2.0"], "Zlib": ["Zlib"], "BSL-1.0": ["BSL-1.0"],
    "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"], "MPL": ["MPL-2.0"], "public-domain": ["CC0-1.0", "Unlicense"],
    "EUPL": ["EUPL-1.2"], "WTFPL": ["WTFPL"], "Artistic-2.0": ["Artistic-2.0"], "OFL": ["OFL-1.1"],
}
#: Short names in common use.
NAMES = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache", "Apache 2.0"], "GPL": ["GPL", "GNU GPL", "GPLv2", "GPLv3"], "LGPL": ["LGPL", "GNU LGPL", "LGPLv2.1", "LGPLv3"],
    "AGPL": ["AGPL", "GNU AGPL", "AGPLv3"], "BSD": ["BSD", "BSD 2-Clause", "BSD 3-Clause"], "ISC": ["ISC"], "EPL": ["EPL 2.0"], "Zlib": ["zlib"],
    "BSL-1.0": ["Boost Software"], "MPL": ["MPL 2.0"], "public-domain": ["CC0", "CC0 1.0", "Unlicense"], "EUPL": ["EUPL"], "WTFPL": ["WTFPL"],
    "Artistic-2.0": ["Artistic 2.0"], "OFL": ["SIL Open Font"],
    "CC-BY": ["CC BY 2.0", "CC BY 3.0", "CC BY 4.0"], "CC-BY-SA": ["CC BY-SA 2.0", "CC BY-SA 3.0", "CC BY-SA 4.0"], "CC-BY-ND": ["CC BY-ND 3.0", "CC BY-ND 4.0"],
    "CC-BY-NC": ["CC BY-NC 3.0", "CC BY-NC 4.0"], "CC-BY-NC-SA": ["CC BY-NC-SA 3.0", "CC BY-NC-SA 4.0"], "CC-BY-NC-ND": ["CC BY-NC-ND 3.0", "CC BY-NC-ND 4.0"],
}
#: Names that mean something else where they stand alone.
AMBIGUOUS = ["MIT", "Apache", "BSD", "ISC", "zlib", "Boost Software", "Artistic 2.0", "SIL Open Font"]
#: Headings are whole paragraphs; phrases may stand within one. Both need every word of the name, and their own word for the license.
HEADINGS = ["{}", "{} License", "License: {}"]
PHRASES = ["Licensed under {}.", "Licensed under the {} license.", "Released under the {} license.", "This project uses the {} license."]
#: Sentences that speak of licenses but grant none.
DECOYS = [
    "The driver showed a license and registration to the officer.",
    "Her fishing license expires at the end of the year.",
    "The software company raised its license fees again this year.",
    "A licensed electrician must approve the work.",
    "The public library is open to the general public on Sunday.",
    "He gave permission to copy the notes of the meeting.",
    "The museum is free of charge for any person under twelve.",
    "The common attribution of the painting is wrong.",
    "The version of the story that he told was not true.",
    "We do not know under which license this was released.",
    "Which license is better, the MIT License or the Apache License?",
    "The court judged the terms of the license.",
]
#: Words by which a notice grants, and words before them that take the grant back.
GRANTS = "licensed released distributed dedicated available permitted granted governed subject free provided".split()
DENIALS = "not never neither nor no isn aren wasn cannot unless false untrue wrong previously formerly until before".split()
#: Words between them over which the denial does not reach, and after which a sentence says something else.
TURNS = "and but now".split()
#: Framing words set around templates in training, so that a notice within a line is known too.
FRAMES = ["{}", "Copyright 2020 the authors. {}", "{} All other rights reserved.", "See the file for details. {}", "Note: {} Thanks."]

#: Paragraphs of the corpus in the training set, at most; which ones is decided by a hash of the paragraph.
TRAINING_PARAGRAPHS = 2_000
FEATURES = 1 << 14
#: Share of a template's words and word pairs that a paragraph must hold.
TEMPLATE_SHARE = 0.6
#: Words of templates that are in most other paragraphs too.
COMMON = "the of a and to in is by any this that with or it for under you are may not at use".split()
#: Words after a notice's first line are read up to so many times the words of the longest template, however many lines they take.
REACH = 1.5
#: Share of the unknown paragraphs held out from the fit that the threshold turns away.
TURNED_AWAY = 0.99


def notices() -> dict[str, list[str]]:
    """All templates by family, those with SPDX names included."""
    return {k: [*ts, *[_IDENTIFIER + name for name in SPDX[k]]] for k, ts in TEMPLATES.items()}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


_IDENTIFIER = "SPDX-License-Identifier: "


class Named(NamedTuple):
    """A template made of a short name: ``must`` are words without which it says nothing; of a ``heading`` the paragraph holds nothing else."""

    text: str
    must: list[str]
    heading: bool


def named() -> dict[str, list[Named]]:
    """Headings and phrases of all short names, by family."""
    out: dict[str, list[Named]] = {k: [] for k in TEMPLATES}
    for family, names in NAMES.items():
        for name in names:
            base, _, version = name.rpartition(" ")
            dated = [f"{base} License {version}"] if version[0].isdigit() else []
            for frame in [*HEADINGS, *dated, *PHRASES]:
                if frame == "{}" and name in AMBIGUOUS:
                    continue
                own = _words_of(frame.format(name))
                must = [w for w in own if w in _telling_name(name) or w in ("license", "licensed")]
                out[family].append(Named(frame.format(name), must, frame not in PHRASES))
    for family, names in SPDX.items():
        out[family] += [Named(_IDENTIFIER + name, ["license", "identifier", *_telling_name(name)], False) for name in names]
    return out


def _telling_name(name: str) -> list[str]:
    """Words of a name without its version."""
    return [w for w in _words_of(name) if not w.isdigit() and w not in ("only", "or", "later")]


class Classifier(NamedTuple):
    families: list[str]
    model: LogisticRegressionModel
    threshold: float


_BETWEEN = r"[^\p{L}\p{N}]+"


#: A license expression: names without blanks, joined by OR or AND.
_HEAD = r"^\W*+(?:(?:SPDX-License-Identifier|Licen[sc]e)\s*+:)?\s*+[(]*+"
_EXPRESSION = _HEAD + r"[A-Za-z][\w.+-]*+[)]*+(?:\s++(?:OR|AND)\s++[(]*+[A-Za-z][\w.+-]*+[)]*+)++\W*+$"


def words(text: Column) -> Column:
    """Words in lower case; licence is written license."""
    return F.filter(F.split(F.replace(ascii_lower(text), F.lit("licence"), F.lit("license")), _BETWEEN), lambda w: w != "")


def grams(w: Column) -> Column:
    """Distinct words and neighbouring pairs of words."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i.cast("int")), F.element_at(w, (i + 1).cast("int")))
    )
    return F.array_distinct(F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w))


def vectors(paragraphs: DataFrame, text: str = "paragraph") -> DataFrame:
    """``paragraphs`` with grams and their sparse binary vector ``features``. The grams are a generated row, so that no filter on them moves below and makes
    them anew for each template."""
    bound = paragraphs.withColumn("grams", F.explode(F.transform(F.array(words(F.col(text))), grams)))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(bound)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, number of the first line from 0, lines and paragraph: a row for each line, and for each that does
    not end a sentence another one of it and the next ones, up to a line without words or the reach of a notice that begins in it (REACH); those only that
    hold a telling word of any template. All others hold too little of every template to be confirmed. A line that is a license expression gives
    a row for each of its operands instead, whose paragraph is the operand told as an SPDX identifier.
    """
    rest = [c for c in docs.columns if c not in (text, "number", "lines", "paragraph")]
    split = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    telling = F.lit(told_words())
    told = lambda lines: F.transform(
        lines, lambda line: F.arrays_overlap(F.split(ascii_lower(line), _BETWEEN), telling) | line.rlike(_EXPRESSION)
    )
    sizes = lambda lines: F.transform(lines, lambda line: F.size(words(line)))
    units = let(split, lambda lines: let(told(lines), lambda marks: F.when(F.exists(marks, lambda m: m), let(sizes(lines), lambda n: _units(lines, marks, n)))))
    each = docs.select(*rest, F.explode(units).alias("u"))
    return each.select(*rest, F.col("u.number").alias("number"), F.col("u.lines").alias("lines"), F.col("u.paragraph").alias("paragraph"))


def reach() -> int:
    """Words after its first line that a notice can have."""
    return int(REACH * max(len(re.findall(r"\w+", t)) for ts in notices().values() for t in ts))


def _units(lines: Column, marks: Column, sizes: Column) -> Column:
    """Structs (number, lines, paragraph) of the lines of one text; ``marks`` tell which hold a telling word, ``sizes`` how many words."""
    most = reach()
    unit = lambda n, size, value: F.struct(n.alias("number"), size.cast("int").alias("lines"), value.alias("paragraph"))
    start = F.struct(F.lit(1).alias("lines"), F.lit(0).alias("words"), F.lit(True).alias("on"))

    def take(held: Column, size: Column) -> Column:
        on = held["on"] & (size > 0) & (held["words"] < most)
        return F.struct((held["lines"] + on.cast("int")).alias("lines"), (held["words"] + F.when(on, size).otherwise(0)).alias("words"), on.alias("on"))

    def wrapped(n: Column) -> Column:
        # Each line that is taken has a word, so no more than ``most`` are asked.
        taken = F.aggregate(F.slice(sizes, n + 2, most), start, take)["lines"]
        joined = lambda size: F.when(
            (size > 1) & F.exists(F.slice(marks, n + 1, size), lambda m: m), unit(n, size, F.array_join(F.slice(lines, n + 1, size), " "))
        )
        return let(taken, joined)

    def operands(line: Column, n: Column) -> Column:
        names = F.split(F.regexp_replace(F.regexp_replace(line, _HEAD, ""), "[()]", ""), r"\s+(?:OR|AND)\s+")
        return F.transform(names, lambda name: unit(n, F.lit(1), F.concat(F.lit(_IDENTIFIER), name)))

    def units(line: Column, n: Column) -> Column:
        return F.when(line.rlike(_EXPRESSION), operands(line, n)).otherwise(others(line, n))

    def others(line: Column, n: Column) -> Column:
        alone = F.when(F.element_at(marks, n + 1), unit(n, F.lit(1), line))
        wraps = (F.element_at(sizes, n + 1) > 0) & ~line.rlike(r"""[.!?:;]["')\]]*\s*$""")
        return F.array_compact(F.array(alone, F.when(wraps & F.exists(F.slice(marks, n + 1, most + 1), lambda m: m), wrapped(n))))

    return F.flatten(F.transform(lines, units))


def _words_of(template: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", template.lower()) if w]


def told_words() -> list[str]:
    """Words of which a paragraph has one if it can be confirmed by any template."""
    out = set(telling_words([t for ts in notices().values() for t in ts]))
    for t in (t for ts in named().values() for t in ts):
        out.add(min(t.must, key=lambda w: (w not in ("license", "licensed"), w in COMMON, -len(w), w)))
    return sorted(out | {w.replace("license", "licence") for w in out})


def _grams_of(template: str) -> list[str]:
    own = _words_of(template)
    return sorted({*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))})


def telling_words(templates: list[str]) -> list[str]:
    """Words such that a paragraph without any of them cannot hold TEMPLATE_SHARE of a template's grams: those of its longest
    and least common words without which too few grams are left."""
    out = set()
    for template in templates:
        grams = _grams_of(template)
        left, most = grams, TEMPLATE_SHARE * len(grams)
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < most:
                break
            left = [g for g in left if word not in g.split()]
            out.add(word)
    return sorted(out)


def _templates() -> Column:
    """All templates as an array of structs; ``must`` are words without which one says nothing, ``heading`` is true where it is the whole paragraph."""
    full = [(k, t, [], False) for k, ts in TEMPLATES.items() for t in ts]
    short = [(k, *t) for k, ts in named().items() for t in ts]
    rows = [{"family": k, "grams": _grams_of(t), "must": sorted(set(must)), "heading": heading} for k, t, must, heading in [*full, *short]]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,grams:array<string>,must:array<string>,heading:boolean>>")


def _similarities() -> Column:
    """Array of struct(similarity, family), one for each template: the share of its grams that the row's grams hold, of a heading the share of both
    that both hold, and 0 where a word is missing that it must have."""

    def share(t: Column) -> Column:
        both = F.size(F.array_intersect(t["grams"], F.col("grams")))
        share = both / F.when(t["heading"], F.size("grams") + F.size(t["grams"]) - both).otherwise(F.size(t["grams"]))
        whole = F.size(F.array_except(t["must"], F.col("grams"))) == 0
        return F.struct(F.when(whole, share).otherwise(0.0).alias("similarity"), t["family"].alias("family"))

    return F.transform(_templates(), share)


def _confirmed(family: Column) -> Column:
    """Similarity of the family's closest template, null where it is under TEMPLATE_SHARE or another family has a closer one."""

    def judge(alike: Column) -> Column:
        own = F.array_max(F.filter(alike, lambda x: x["family"] == family))["similarity"]
        return F.when(own >= F.greatest(F.lit(TEMPLATE_SHARE), F.array_max(alike)["similarity"]), own)

    return let(_similarities(), judge)


#: From a denial to the end of its sentence, or to a turn, if a grant comes after it.
_DENIED = (
    rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(DENIALS)})(?![\p{{L}}\p{{N}}])(?:(?![.!?;]\s|\b(?:{'|'.join(TURNS)})\b).){{0,200}}?"
    rf"(?<!\p{{L}})(?:{'|'.join([*GRANTS, 'uses'])})(?!\p{{L}})(?:(?![.!?;]\s|\b(?:{'|'.join(TURNS)})\b).)*+"
)


def standing(text: Column) -> Column:
    """Text without what takes a grant back: ``not ... licensed under ...``, ``previously released ...``, up to the end of the sentence or a turn in it."""
    return F.regexp_replace(text, _DENIED, " ")


def train(docs: DataFrame, text: str = "text", sample: int = TRAINING_PARAGRAPHS) -> Classifier:
    """Classifier fitted to the templates in their frames, short names as they are, and for the unknown class to decoys and at most ``sample``
    paragraphs of ``docs``, half of them with telling words, that hold too little of any template to be a notice. A quarter of the decoys
    and corpus paragraphs, and of the framed templates, is held out from the fit. The threshold lies halfway between the family probability that TURNED_AWAY of the
    first stay under and the one that as many of the second reach, or at the former where they overlap.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(TEMPLATES)]
    rows = [(f.format(t), families.index(k), f != FRAMES[0]) for k, ts in notices().items() for t in ts for f in FRAMES]
    rows += [(t.text, families.index(k), False) for k, ts in named().items() for t in ts if not t.text.startswith(_IDENTIFIER)]
    rows += [(f.format(t), 0, True) for t in DECOYS for f in FRAMES]
    given = spark.createDataFrame(rows, "paragraph string, label int, may_test boolean")
    lines = docs.select(F.explode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("paragraph")).filter(r"paragraph rlike '\\S'")
    # Nearly every document has a line or more, so their number is a safe lower bound for that of the lines, of which one in some dozens is told.
    count = docs.count()
    some = lines.filter(F.pmod(F.xxhash64("paragraph"), F.lit(max(1, count // (20 * sample)))) == 0)
    hard = paragraphs(some, "paragraph").filter("lines = 1").select("paragraph")
    hard = hard.orderBy(F.xxhash64("paragraph"), "paragraph").limit(sample // 2)
    others = cut(hard.union(bounded_sample(lines, sample // 2, count, "paragraph")))
    best = F.array_max(_similarities())["similarity"]
    others = vectors(others).filter(best < TEMPLATE_SHARE).select("paragraph", F.lit(0).alias("label"), F.lit(True).alias("may_test"))
    ready = vectors(cut(given.unionByName(others))).withColumn("label", F.col("label").cast("double"))
    ready = ready.withColumn("held", F.col("may_test") & (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0))
    ready = ready.withColumn("weight", F.when(F.col("label") == 0, F.lit(0.2)).otherwise(F.lit(1.0)))
    fit = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, maxIter=60)
    model = fit.fit(ready.filter("NOT held").coalesce(2))
    chance = F.array_max(F.slice(vector_to_array("probability"), 2, len(families)))
    tried = model.transform(ready.filter("held")).select("label", chance.alias("chance"))
    unknown = F.percentile(F.when(F.col("label") == 0, F.col("chance")), F.lit(TURNED_AWAY))
    known = F.percentile(F.when(F.col("label") > 0, F.col("chance")), F.lit(1 - TURNED_AWAY))
    above, below = tried.agg(F.coalesce(unknown, F.lit(0.0)), F.coalesce(known, F.lit(1.0))).first()
    return Classifier(families, model, max(above, (above + below) / 2))


def scan(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """A row for each paragraph of ``docs`` that a license family is found in: the columns of ``docs`` but the text, number,
    lines, paragraph, family, probability and similarity (share of the closest template's grams).

    The classifier's family must have a template that the paragraph holds TEMPLATE_SHARE of, and no other family one that it holds more of; what
    takes a grant back is not read (:func:`standing`). Paragraphs that hold none of the telling words of any template are not judged, as they could not be confirmed.
    Of lines and wrapped notices of one family that overlap the line is given, or else what holds most of the template in the fewest lines.
    Null and empty texts have no paragraphs. Repeated rows each give theirs. Columns named like the added ones are replaced.
    """
    added = {
        "number", "lines", "paragraph", "grams", "features", "family", "probability", "similarity", "place", "prediction", "rawPrediction", "chance", "alike", "row", "inside", "opens",
        "notice", "nth", "stands", "verdict",
    }
    rest = [c for c in docs.columns if c != text and c not in added]
    each = paragraphs(docs.select(*rest, text, F.monotonically_increasing_id().alias("row")), text)
    judged = classifier.model.transform(vectors(each.withColumn("stands", standing(F.col("paragraph"))), "stands"))
    # The verdict is a generated row, so that filters on it are not moved below the model and do not run it again.
    verdict = F.struct(F.col("prediction").cast("int").alias("place"), vector_to_array("probability").alias("chances"))
    found = judged.select(*rest, "row", "number", "lines", "paragraph", "grams", F.explode(F.array(verdict)).alias("verdict"))
    found = found.withColumn("place", F.col("verdict.place")).withColumn("chance", F.element_at("verdict.chances", F.col("place") + 1))
    found = found.filter((F.col("place") > 0) & (F.col("chance") >= classifier.threshold))
    found = found.withColumn("family", F.element_at(F.lit(classifier.families), F.col("place") + 1))
    found = found.withColumn("similarity", _confirmed(F.col("family"))).filter("similarity IS NOT NULL")
    near = Window.partitionBy("row", "family").orderBy("number")
    last = F.col("number") + F.col("lines") - 1
    next_line = F.min(F.when(F.col("lines") == 1, F.col("number"))).over(near.rangeBetween(0, Window.unboundedFollowing))
    kept = found.withColumn("inside", F.coalesce(next_line <= last, F.lit(False))).filter("lines = 1 OR NOT inside")
    # Wrapped ones that overlap one after the other are one notice, and what holds most of it in the fewest lines is given.
    before = F.max(F.when(F.col("lines") > 1, last)).over(near.rangeBetween(Window.unboundedPreceding, -1))
    opens = (F.col("lines") == 1) | before.isNull() | (before < F.col("number"))
    kept = kept.withColumn("opens", opens.cast("int")).withColumn("notice", F.sum("opens").over(near.orderBy("number", "lines")))
    best = Window.partitionBy("row", "family", "notice", F.when(F.col("lines") == 1, F.col("number"))).orderBy(F.desc("similarity"), "lines", "number")
    kept = kept.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    return kept.select(*rest, "number", "lines", "paragraph", "family", F.round("chance", 6).alias("probability"), "similarity")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, number of the first line, lines, family, probability and template similarity of every license notice found."""
    docs = docs.select("doc_id", "text")
    return scan(docs, train(docs)).select(
        "doc_id", F.col("number").cast("long").alias("paragraph_no"), "lines", "family", "probability", F.round("similarity", 6).alias("similarity")
    )
