"""The cheap look at lines loses none that agree with a template or name a licence."""

import random

from pyspark.sql import functions as F

from emberline.llm import license as L


def test_lines_without_a_telling_pair_agree_with_nothing(spark):
    rng, words = random.Random(7), sorted({w for p in L.telling_pairs()[0] for w in p.split()} | {w for names in L.NAMES.values() for n in names for w in n.split()})
    notices = [n for group in (L.TEMPLATES, L.NAMES) for texts in group.values() for n in texts]
    rows = ["", "of the", "OF, the", "of thé", "ofthe", "MIT  LICENSE", "éof the", "the law of the land and the sea in the public eye", *notices, *map(str.upper, notices)]
    for _ in range(1500):
        own = rng.choice(notices).split() if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 8))
        rows.append(rng.choice(["", "¿", "x "]) + "".join(w + rng.choice([" ", " ", ", ", "-", "\t", "\U0001d400 "]) for w in own[rng.randint(0, 3) :]))
    rows += [" ".join(["of the", "in the", "to the"] * 40), "it and\nthe by this", "seen under\nthe gnu\n\ngeneral public license"]
    lines = F.posexplode(F.split("t", "\n")).alias("i", "line")
    agreed = lambda c: L.best_agreement(F.array_distinct(L.pairs_of(L.words_of(c)))) >= 0.6
    table = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    asked = table.select("k", lines).where(agreed(F.col("line"))).select("k", "i")
    got = {(r.k, r.line) for r in table.select("k", F.inline(L.notice_units(F.col("t"), 0.6))).collect()}
    want = {(r.k, r.i) for r in asked.collect()}
    assert len(want) > 100 and not want - got
    # A window agrees where its lines do not.
    assert (rows.index("it and\nthe by this"), 0) in got
    assert L.most_pairs(0.6) < 10


def test_plain_lines_are_not_judged_pair_by_pair(spark):
    """Before, every line and window was held against every template."""
    text = "the law of the land and the sea in the wide field was that the court with the seal by the river"
    one = spark.createDataFrame([(text,), ("under the Apache License",)], "t string")
    found = one.select(L.marked_lines(F.col("t"))[0].contains(L.RARE_MARK).alias("rare"), L.has_few_words(F.col("t"), 0.6).alias("few")).collect()
    assert [(r.rare, r.few) for r in found] == [(False, False), (True, True)]
