"""Licence scans: a trained paragraph classifier with template confirmation, in DataFrame operations only.

A text's paragraphs are its runs of lines up to an empty one. Every line is looked at, alone and together with
the two lines after it in its paragraph, since notices are wrapped. Lines that hold a cue word, and all those that can agree with a
template or name a licence at all (see may_agree()), are judged by sparse word n-gram logistic regression. Its classes are the
licence families and "unknown". Families are taught by notices made from templates and name forms, "unknown" by
ordinary sentences with the same words and by all judged lines of the corpus that are unlike the templates, but for a third. A family is predicted only above a
threshold calibrated on that third, and only counts once the paragraph agrees with
a template or names the licence in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline as Steps
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

# Notices by family, and words of which every notice holds at least one.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "This document is confidential and proprietary. All rights reserved. No license is granted."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
}
# What notices call a family, with two words at least and the longest form that no other family has.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "GNU AGPL", "Affero GPL"],
    "apache-2.0": ["Apache License", "Apache 2.0", "Apache-2.0", "Apache licence"],
    "bsd": ["BSD 3-Clause", "BSD 2-Clause", "BSD License", "BSD licence"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "Creative Commons Attribution-ShareAlike"],
    "gpl": ["GNU General Public License", "GPL-3.0", "GPL-2.0", "GNU GPL", "GPL v3", "GPL v2", "GPL version 3"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"],
    "mit": ["MIT License", "MIT licence", "MIT-licensed", "Identifier: MIT"],
    "mpl": ["Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "proprietary": ["All rights reserved", "proprietary and confidential"],
    "public-domain": ["released into the public domain", "dedicated to the public domain", "CC0 1.0", "in the public domain"],
}
PHRASES = ["Licensed under {}", "Released under the {}", "Distributed under {}", "This file is under the terms of the {}", "License: {}", "SPDX-License-Identifier: {}", "Available under the {} license.", "The code is covered by the {}, see LICENSE."]
# Ordinary sentences with the words that notices hold.
ORDINARY = [
    "A plain story about a licence to fish in the river.", "The driver lost his licence for a year after the race.", "She renewed her driving license at the town hall.", "He asked permission to enter the garden.",
    "Permission was granted by the guard at the gate.", "The copyright of the song was disputed in court.", "Copyright law is a course in the third year.", "They redistributed the land among the farmers.",
    "The party wants to redistribute income by taxes.", "A licensed guide leads the tour at noon.", "The shop is licensed to sell beer and wine.", "The museum holds the rights, reserved seats are sold at the door.",
    "The film entered the list of works that anybody may copy.", "Without the permission of her parents she could not travel.", "The council may license taxis and buses.", "His fishing licence was checked by the warden.",
    "The redistribution of seats followed the election.", "Ask for permission before taking pictures.", "The licensing hours of the pub end at midnight.", "A hunting license costs more for visitors.",
]
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "rights reserved")
UNKNOWN = "unknown"
#: Lines that one task of the fit takes.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class LicenceFit:
    """background: the most that all judged lines of the corpus, which teach "unknown", weigh together, in notices; each counts as often
    as it stands there. mistaken: share of the different held-back lines that the threshold may let
    through. agree: least share of the template's or the paragraph's word pairs in common. strange: lines of the corpus that agree
    with no template by so much are taken as unknown.
    """

    background: float = 3000.0
    features: int = 1 << 14
    mistaken: float = 0.002
    agree: float = 0.6
    strange: float = 0.3


def has_cue(text: Column) -> Column:
    """Whether a text holds a cue in any case; it is lower-cased once."""

    def held(low: Column) -> Column:
        out = low.contains(CUES[0])
        for cue in CUES[1:]:
            out = out | low.contains(cue)
        return out

    return bound(F.lower(text), held)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs_of(words: Column) -> Column:
    """Neighbouring words joined by a space; the only word of a shorter list."""

    def made(own: Column) -> Column:
        return F.when(F.size(own) < 2, own).otherwise(F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: F.concat_ws(" ", F.get(own, i), F.get(own, i + 1))))

    return bound(words, made)


def with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_w", words_of(F.col("paragraph"))).withColumn("_grams", F.concat("_w", pairs_of(F.col("_w"))))


def taught() -> dict[str, list[str]]:
    """Notices of each family, by rule: templates, their beginnings and ends, and phrases around its names."""
    out: dict[str, list[str]] = {UNKNOWN: ["", *ORDINARY]}
    for family, notices in TEMPLATES.items():
        made = [phrase.format(name) for name in NAMES[family] for phrase in PHRASES]
        for notice in notices:
            own = notice.split()
            half = max(3, len(own) * 2 // 3)
            made += [notice, " ".join(own[:half]), " ".join(own[-half:]), "Note: " + notice, notice + " See the file for details."]
        out[family] = list(dict.fromkeys(made))
    return out


def unknown_lines(units: DataFrame, p: LicenceFit) -> DataFrame:
    """paragraph, n, held: the different paragraphs of all judged lines that agree with no template by p.strange, and how often they stand in the corpus."""
    each = units.where(F.length(F.trim("paragraph")) > 0).groupBy("paragraph").agg(F.count("*").alias("n")).withColumn("_mine", F.array_distinct(pairs_of(words_of(F.col("paragraph")))))
    return each.where(best_agreement(F.col("_mine")) < p.strange).select("paragraph", "n", (F.pmod(F.xxhash64("paragraph"), F.lit(3)) == 0).alias("held"))


def train_licences(units: DataFrame, p: LicenceFit) -> tuple[list[str], PipelineModel, float]:
    """Classes, model and the calibrated threshold. units: paragraph of every judged line of the corpus (see notice_units()), all of which are used."""
    spark, names = units.sparkSession, [UNKNOWN, *sorted(TEMPLATES)]
    lines = cut_lineage(unknown_lines(units, p))
    code = lambda c: (F.array_position(F.array(*[F.lit(x) for x in names]), c) - 1).cast("double")
    notices = spark.createDataFrame([(family, text, False) for family, texts in taught().items() for text in texts], "family string, paragraph string, held boolean")
    # A third of the ordinary sentences is held back too, by hash.
    notices = notices.withColumn("held", (F.col("family") == UNKNOWN) & (F.pmod(F.xxhash64("paragraph"), F.lit(3)) == 0))
    # However large the corpus is, its lines weigh no more than p.background notices.
    total, different = lines.where("not held").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    share = min(1.0, p.background / max(1, total))
    rows = notices.where("not held").select("family", "paragraph", F.lit(1.0).alias("_weight")).unionByName(lines.where("not held").select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.col("n") * share).alias("_weight")))
    rows = with_grams(rows.groupBy("family", "paragraph").agg(F.sum("_weight").alias("_weight"))).select(code(F.col("family")).alias("_label"), "_weight", "_grams")
    # Every task of every step of the fit hands on a gradient as large as the model, so there are no more tasks than rows ask for.
    rows = cut_lineage(rows.coalesce(4 + different // TASK_ROWS))
    steps = [HashingTF(inputCol="_grams", outputCol="_f", numFeatures=p.features, binary=True), LogisticRegression(featuresCol="_f", labelCol="_label", weightCol="_weight", probabilityCol="_p", family="multinomial", regParam=0.001, maxIter=60, standardization=False)]
    model = Steps(stages=steps).fit(rows)
    known = F.lit(1.0) - F.get(vector_to_array("_p"), F.lit(0))
    held = notices.where("held").select("paragraph").union(lines.where("held").select("paragraph"))
    cut = model.transform(with_grams(held)).agg(F.percentile_approx(known, 1 - p.mistaken, 10_000)).first()[0]
    return names, model, min(0.95, max(0.5, float(cut or 0)))


def word_pairs(text: str) -> list[str]:
    own = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:], strict=False)))


def shares_of(mine: Column, family: str) -> Column:
    """The best share of common word pairs of a paragraph (mine) with a template of the family, of the shorter one's; 1 if it names the licence in full."""
    shares = []
    for notice in TEMPLATES[family]:
        pairs = word_pairs(notice)
        shares.append(F.size(F.array_intersect(mine, F.array(*map(F.lit, pairs)))) / F.greatest(F.lit(1), F.least(F.size(mine), F.lit(len(pairs)))))
    for name in NAMES[family]:
        pairs = word_pairs(name)
        shares.append(F.when(F.size(F.array_intersect(F.array(*map(F.lit, pairs)), mine)) == len(pairs), 1.0).otherwise(0.0))
    return F.greatest(*shares)


def agreement(mine: Column, family: Column) -> Column:
    out = F.lit(0.0)
    for name in TEMPLATES:
        out = F.when(family == name, shares_of(mine, name)).otherwise(out)
    return out


def best_agreement(mine: Column) -> Column:
    return F.greatest(*[shares_of(mine, name) for name in TEMPLATES])


def telling_pairs() -> tuple[list[str], list[str], int]:
    """The word pairs of all templates, one pair of each name (its longest, which is seldom elsewhere), and the pairs of the shortest template."""
    templates = [word_pairs(notice) for notices in TEMPLATES.values() for notice in notices]
    own = {max(word_pairs(name), key=len) for names in NAMES.values() for name in names}
    return sorted({pair for pairs in templates for pair in pairs}), sorted(own), min(map(len, templates))


# Pairs of the templates that ordinary English has everywhere, and marks that texts seldom hold.
EVERYDAY = {"of the", "and the", "to the", "in the", "that the", "with the", "by the", "it and", "of this", "to this", "and or", "this is", "under the"}
RARE_MARK, EVERYDAY_MARK = "\x01", "\x02"


def pattern_of(pairs: list[str]) -> str:
    """Java pattern of the first word of each pair that stands in a lower-cased text; beginnings in common are looked at once."""

    def tree(ends: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for end in ends:
            by.setdefault(end[:1], []).append(end[1:])
        out = [first + tree(rest) if first else "" for first, rest in sorted(by.items(), reverse=True)]
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    first: dict[str, list[str]] = {}
    for pair in pairs:
        first.setdefault(pair.split()[0], []).append(pair.split()[1])
    part = r"\p{L}\p{N}"
    return f"(?<![{part}])" + tree([f"{word}(?=[^{part}]+{tree(ends)}(?![{part}]))" for word, ends in first.items()])


def marked_lines(text: Column) -> Column:
    """Lines of the lower-cased text, marked where a pair of telling_pairs() begins."""
    every, own, _ = telling_pairs()
    out = F.regexp_replace(F.lower(text), pattern_of(sorted({*every, *own} - EVERYDAY)), f"$0{RARE_MARK}")
    return F.split(F.regexp_replace(out, pattern_of(sorted(EVERYDAY)), f"$0{EVERYDAY_MARK}"), "\n")


def most_pairs(least: float) -> int:
    """How many different pairs a text has at most that agrees with a template by everyday pairs alone."""
    held = [(sum(pair in EVERYDAY for pair in pairs), len(pairs)) for pairs in (word_pairs(n) for notices in TEMPLATES.values() for n in notices)]
    return max((10**9 if c >= least * n else int(c / least + 1e-9)) for c, n in held)


def has_few_words(line: Column, least: float) -> Column:
    """False only where the line's first words are more different ones than most_pairs() can be made of."""
    most = most_pairs(least) + 2  # words are one more than pairs, and an empty one may come first
    return F.size(F.array_distinct(F.slice(F.split(F.lower(line), r"[^\p{L}\p{N}]+", 3 * most), 1, 3 * most - 1))) <= most


def may_agree(text: Column, least: float) -> Column:
    """False only where agreement() is below least for every family, so that a classifier's word would not count.

    A template of n word pairs needs least of min(n, the text's pairs) in common, so no fewer than least of the shortest template's; a
    name needs all its pairs, so its longest.
    """
    every, first, shortest = telling_pairs()
    array = lambda pairs: F.array(*map(F.lit, pairs))

    def may(mine: Column) -> Column:
        return F.arrays_overlap(mine, array(first)) | (F.size(F.array_intersect(mine, array(every))) >= F.greatest(F.lit(1), F.least(F.size(mine), F.lit(shortest))) * least)

    return bound(F.array_distinct(pairs_of(words_of(text))), may)


def notice_units(text: Column, least: float) -> Column:
    """array of (line, block, paragraph): each line with a cue or that may agree, alone or in its window, by itself and with the two lines after it up to an empty one; block is the line where its paragraph begins."""

    def units(lines: Column) -> Column:
        blank = lambda i: F.coalesce(F.trim(F.get(lines, i)) == "", F.lit(True))
        second = lambda i: F.when(~blank(i + 1), F.get(lines, i + 1))
        third = lambda i: F.when(~blank(i + 1) & ~blank(i + 2), F.get(lines, i + 2))
        window = lambda line, i: F.concat_ws(" ", line, second(i), third(i))
        # What the line has by itself its window has too, but a short line may agree where its window does not.
        # Only a rare pair, or everyday pairs in a line of few words, can make either agree.
        near = lambda marks, i, mark: F.concat_ws("", *[F.get(marks, i + k) for k in range(3)]).contains(mark)
        telling = lambda marks, line, i: near(marks, i, RARE_MARK) | (near(marks, i, EVERYDAY_MARK) & has_few_words(line, least))
        judged = lambda marks, line, i: has_cue(line) | (telling(marks, line, i) & (may_agree(line, least) | may_agree(window(line, i), least)))
        cued = bound(marked_lines(text), lambda marks: F.filter(F.transform(lines, lambda line, i: F.when((F.trim(line) != "") & judged(marks, line, i), i)), lambda i: i.isNotNull()))
        empty = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) == "", i)), lambda i: i.isNotNull())
        last_before = lambda ends, i: F.coalesce(F.array_max(F.filter(ends, lambda e: e < i)), F.lit(-1))
        alone = lambda i, before: F.struct(i.alias("line"), before.alias("block"), F.get(lines, i).alias("paragraph"))
        wrapped = lambda i, before: F.struct(i.alias("line"), before.alias("block"), F.concat_ws(" ", F.get(lines, i), second(i), third(i)).alias("paragraph"))
        both = lambda i, before: F.when(blank(i + 1), F.array(alone(i, before))).otherwise(F.array(alone(i, before), wrapped(i, before)))
        return bound(cued, lambda at: bound(empty, lambda ends: F.flatten(F.transform(at, lambda i: bound(last_before(ends, i), lambda before: both(i, before))))))

    return bound(F.split(text, "\n"), units)


def licence_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LicenceFit | None = None) -> DataFrame:
    """(id_col, text_hash, line, block, family, probability, agreement): one row for each paragraph and family that is a confirmed notice.

    text_hash is xxhash64 of the text, which with the id names a row. line is the notice's first line that was judged, block that before its paragraph.
    """
    p = params or LicenceFit()
    text = F.col(text_col).cast("string")
    lines = cut_lineage(docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), F.inline(notice_units(text, p.agree))))
    names, model, cut = train_licences(lines, p)
    scored = model.transform(with_grams(lines)).withColumn("_q", F.slice(vector_to_array("_p"), 2, len(names)))
    family = F.get(F.array(*[F.lit(x) for x in names[1:]]), (F.array_position("_q", F.array_max("_q")) - 1).cast("int"))
    chance = F.lit(1.0) - F.get(vector_to_array("_p"), F.lit(0))
    out = scored.select(id_col, "text_hash", F.col("line").cast("long").alias("line"), F.col("block").cast("long").alias("block"), F.array_distinct(pairs_of(F.col("_w"))).alias("_mine"), family.alias("family"), chance.alias("probability")).where(F.col("probability") >= cut)
    out = out.withColumn("agreement", agreement(F.col("_mine"), F.col("family"))).where(F.col("agreement") >= p.agree).drop("_mine")
    return out.groupBy(id_col, "text_hash", "block", "family").agg(F.min("line").alias("line"), F.max("probability").alias("probability"), F.max("agreement").alias("agreement")).select(id_col, "text_hash", "line", "block", "family", "probability", "agreement")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LicenceFit | None = None) -> DataFrame:
    """(id_col, n_notices, families) for every row of docs; families are comma-joined in order, unknown for none.

    Null and empty texts have no notice. Rows with a null or repeated id are each judged by their own text;
    other columns are ignored. An empty table gives no rows.
    """
    found = licence_notices(docs.select(id_col, text_col), id_col, text_col, params).groupBy(F.col(id_col).alias("_id"), "text_hash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"))
    out = docs.select(id_col, F.xxhash64(F.col(text_col).cast("string")).alias("_hash")).join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left")
    return out.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("f", F.lit(UNKNOWN)).alias("families"))
