"""Licence scan: a trained paragraph classifier, confirmed against templates.

Texts are cut at blank lines and sentence ends into blocks.  A paragraph is a line of a block or a
run of its adjacent lines, as long as a notice wrapped over them can be; lines with nothing but
marks count as blank, and comment marks are no words.  Of hits of one family that share lines, the
one with the fewest lines counts, the first of these if several.  A multinomial logistic
regression over hashed word 1- to 3-grams (presence, not counts) names the licence family, with a
class of its own for all other text.  It learns from the templates, whole, cut to their windows
and set after ordinary words, and from the ordinary paragraphs of all texts that it can meet: the
distinct ones that are not set aside before it (see below) and hold less than half of every template.
One half of these teaches, with a bounded weight together; the threshold on the probability is
calibrated on the other half, which it has not seen: at most the stated share of them, counted as
often as they occur, passes it.  A prediction stands if, further, enough of a template of that family is
found in the paragraph.  Paragraphs in which the comparison cannot find that much, because they
hold none of a few words without which no template reaches it, are set aside before; the result is
the same.

Defined results: a null, empty or licence-free text has no families, no hits and score 0.
Ties between families go to the first by name.  Repeated rows are scanned alike.  Without any
such ordinary paragraph the threshold is a half.  Other columns pass through; input columns named
like a result column are replaced.  All of the main path is DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import without, written

RESULT = ("licences", "n_hits", "score", "evidence")
OTHER = "other"

# Notices by which licences are granted, by family.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License version 3"],
    "apache": [
        "licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": [
        "released under the BSD License",
        "licensed under the BSD 3-Clause License",
        "redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc0": ["released under CC0 1.0", "dedicated to the public domain under the CC0 1.0 Universal waiver"],
    "gpl": [
        "this work is licensed under the GNU General Public License, version 3",
        "redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3"],
    "mit": [
        "released under the MIT License",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0"],
}
FAMILIES = [OTHER, *sorted(TEMPLATES)]


# English function words, too common to tell a notice by.
COMMON = {
    "a", "an", "and", "any", "as", "by", "from", "in", "is", "it", "may", "not", "of", "on", "or", "the",
    "this", "to", "under", "with", "without", "you", "your",
}


def tokens(text: Column) -> Column:
    """Lower-case words and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: str) -> Column:
    """Word 1-, 2- and 3-grams of the column ``words``, once each."""
    def of(width: int) -> Column:
        last = F.size(F.col(words)) - width
        made = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.concat_ws(" ", F.slice(F.col(words), i + 1, F.lit(width))),
        )
        return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def paragraphs(docs: DataFrame, *keys: str, least: float | None = None) -> DataFrame:
    """keys, place (block, first line, lines), text and words of each paragraph that holds a word.

    With ``least``, only those that ``possible`` leaves.
    """
    text = F.regexp_replace("text", r"\r\n?", "\n")
    cut = F.split(text, r"(?<=[.!?;])\s+|\n[^\p{L}\p{N}]*\n")
    blocks = docs.select(*keys, F.posexplode(cut).alias("block", "body"))
    if least is not None:
        blocks = blocks.where(possible_text(F.col("body"), least))
    # Comment marks that are words.
    said = lambda line: tokens(F.regexp_replace(line, r"(?i)^\s*(?:rem|dnl)\s+", ""))
    lines = F.transform(F.split("body", r"\n+"), lambda x: F.struct(x.alias("line"), said(x).alias("words")))
    blocks = blocks.select(*keys, "block", F.filter(lines, lambda x: F.size(x["words"]) > 0).alias("lines"))
    blocks = blocks.where(F.size("lines") > 0)
    # A notice of so many words has fewer lines; all its lines but the ends are its words alone.
    longest = max(len(re.split(r"[\W_]+", t)) for texts in TEMPLATES.values() for t in texts)
    ahead = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.slice("lines", i, longest))
    starts = blocks.select(*keys, "block", F.posexplode(ahead).alias("first", "ahead"))
    between = F.aggregate(
        F.slice("ahead", F.lit(2), F.greatest(F.col("n") - 2, F.lit(0))), F.lit(0), lambda a, x: a + F.size(x["words"])
    )
    runs = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("ahead")))).where(between <= longest - 2)
    held = F.slice("ahead", F.lit(1), F.col("n"))
    rows = runs.select(
        *keys, F.struct("block", "first", F.col("n").alias("lines")).alias("place"),
        F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("paragraph"),
        F.flatten(F.transform(held, lambda x: x["words"])).alias("words"),
    )
    return rows if least is None else rows.where(possible("words", least))


def fewest_lines(hits: DataFrame) -> DataFrame:
    """Of ``hits`` (key_, place, family, ...) of a family that share lines, those with the fewest."""
    flat = hits.withColumn("size", F.col("place.lines")).withColumn("first", F.col("place.first"))
    line = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1))
    same = "key_", "family", "place.block"
    covered = flat.withColumn("line", line).withColumn("least", F.min("size").over(W.partitionBy(*same, "line")))
    kept = covered.groupBy("key_", "family", "place").agg(
        F.min("least").alias("least"), *[F.any_value(c).alias(c) for c in ("size", "first", "p", "paragraph")]
    ).where(F.col("least") == F.col("size"))
    # What is left and overlaps is of one size; the first of a chain stands for it.
    earlier = F.lag("first").over(W.partitionBy(*same).orderBy("first"))
    kept = kept.withColumn("gap", F.col("first") - earlier)
    return kept.where(F.col("gap").isNull() | (F.col("gap") >= F.col("size")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(f), text) for f in sorted(TEMPLATES) for text in TEMPLATES[f]]
    listed = F.array(*[F.struct(F.lit(float(n)).alias("label"), F.lit(t).alias("text")) for n, t in rows])
    return spark.range(1).select(F.explode(listed).alias("t")).select("t.*").withColumn("words", tokens(F.col("text")))


def found_share(words: str, family: Column) -> Column:
    """Largest share of a template's 3-grams (all words, if shorter) that the paragraph holds."""
    def three(of: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(of) - 3, F.lit(0))),
            lambda i: F.concat_ws(" ", F.slice(of, i + 1, F.lit(3))),
        )

    cases = F.lit(0.0)
    for n, name in enumerate(FAMILIES[1:], 1):
        shares = []
        for text in TEMPLATES[name]:
            wanted = F.array_distinct(three(tokens(F.lit(text))))
            shares.append(F.size(F.array_intersect(wanted, three(F.col(words)))) / F.size(wanted))
        best = F.greatest(*shares) if len(shares) > 1 else shares[0]
        cases = F.when(family == n, best).otherwise(cases)
    return cases


def _anchors(least: float) -> list[str]:
    """Words of which every paragraph holds one that has ``least`` of some template.

    Words are added, the longest uncommon first, until the 3-grams without any of them are too few.
    """
    chosen: set[str] = set()
    for text in (t for name in sorted(TEMPLATES) for t in TEMPLATES[name]):
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        runs = {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}
        for word in sorted(set(words), key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if sum(not chosen & set(r) for r in runs) < least * len(runs):
                break
            chosen.add(word)
    return sorted(chosen)


def possible(words: str, least: float) -> Column:
    """A cheap condition that every paragraph meets which the template comparison confirms."""
    return F.arrays_overlap(F.col(words), F.array(*[F.lit(a) for a in _anchors(least)]))


def possible_text(text: Column, least: float) -> Column:
    held = F.lit(False)
    for anchor in _anchors(least):
        held = held | F.lower(text).contains(anchor)
    return held


def _features(buckets: int) -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True)


def train(
    docs: DataFrame, *, buckets: int = 1 << 12, false_share: float = 1e-3, least: float = 0.6,
    most_ordinary: float = 2000.0, around: float = 20.0,
) -> tuple[LogisticRegressionModel, float, int]:
    """Model, threshold and buckets; learns from every paragraph of ``docs`` that ``scan`` with ``least`` classifies.

    A row made of a template weighs 1, a distinct ordinary paragraph 1 or less, so that all together
    weigh ``most_ordinary`` at most.  Each of these is also set before one of the templates, dealt by
    its hash; a template with what is set before it weighs ``around`` at most.
    """
    spark = docs.sparkSession
    texts = docs.where(possible_text(F.col("text"), least)).select("text")
    plain = paragraphs(texts, least=least).groupBy("words").agg(F.count(F.lit(1)).alias("times"))
    plain = written(plain.withColumn("h", F.xxhash64("words", F.lit("paragraph"))), "licences-plain")
    held = F.greatest(*[found_share("words", F.lit(n)) for n in range(1, len(FAMILIES))])
    plain = written(plain.where(held < 0.5), "licences-plain")
    learn = plain.where(F.pmod("h", F.lit(2)) == 0)
    share = F.least(F.lit(1.0), F.lit(most_ordinary) / F.lit(max(learn.count(), 1)))
    whole = _templates(spark).select("label", "words", F.row_number().over(W.orderBy("label", "words")).alias("place"))
    whole = whole.withColumn("weight", F.lit(1.0))
    count = sum(len(texts) for texts in TEMPLATES.values())
    dealt = (F.pmod(F.shiftright("h", 1), F.lit(count)) + 1).cast("int").alias("place")
    noise = learn.select(F.slice("words", 1, 6).alias("noise"), dealt)
    shares = noise.groupBy("place").agg(F.least(F.lit(1.0), F.lit(around) / F.count(F.lit(1))).alias("weight"))
    mixed = noise.join(F.broadcast(whole.drop("weight").join(shares, "place")), "place").select(
        "label", F.concat("noise", "words").alias("words"), "weight"
    )
    # Windows over a template that keep two thirds of it stand for cut and reworded notices.
    size = F.greatest(F.ceil(F.size("words") * 2 / 3).cast("int"), F.lit(3))
    windows = whole.select(
        "label", "words", "weight", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("at"),
        size.alias("size"),
    ).select("label", F.slice("words", F.col("at"), F.col("size")).alias("words"), "weight")
    rows = learn.select(F.lit(0.0).alias("label"), "words", share.alias("weight"))
    rows = rows.unionByName(whole.drop("place")).unionByName(windows).unionByName(mixed)
    hashed = _features(buckets)
    model = LogisticRegression(
        family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=60, standardization=False, weightCol="weight",
    ).fit(written(
        hashed.transform(rows.withColumn("grams", grams("words"))).select("label", "features", "weight"), "licences-train"
    ))
    unseen = plain.where(F.pmod("h", F.lit(2)) != 0).withColumn("grams", grams("words"))
    other = vector_to_array("probability")[0]
    scored = model.transform(hashed.transform(unseen)).select(
        F.greatest(1 - other, F.lit(0.5)).alias("p"), "times"
    )
    # Nothing below a half can be the threshold, so only values above it are told apart.
    threshold = scored.agg(F.percentile("p", 1 - false_share, F.col("times")).alias("t")).first()["t"]
    return model, threshold or 0.5, buckets


def scan(docs: DataFrame, model: LogisticRegressionModel, threshold: float, buckets: int, least: float = 0.6) -> DataFrame:
    """Add licences (families, ascending), n_hits, score (best probability) and evidence."""
    base = without(docs, *RESULT, "key_")
    key = F.sha2("text", 256)
    # The comparison would refuse all others, whatever the classifier says.
    texts = base.where(possible_text(F.col("text"), least)).select(key.alias("key_"), "text")
    rows = paragraphs(texts, "key_", least=least).withColumn("grams", grams("words"))
    # Written at each step, or the filters below would repeat the model's expressions.
    rows = written(_features(buckets).transform(written(rows, "licences-rows")).drop("grams"), "licences-features")
    p = vector_to_array("probability")
    scored = model.transform(rows).select("key_", "place", "paragraph", "words", "prediction", p.alias("p"))
    scored = written(scored, "licences-scored")
    licence = F.col("prediction").cast("int")
    hits = scored.where((licence > 0) & (1 - F.col("p")[0] >= threshold))
    hits = hits.where(found_share("words", licence) >= least)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    # Equal texts share a key: their paragraphs agree, so one of each place is enough.
    hits = hits.groupBy("key_", "place").agg(
        F.any_value(F.struct(F.get(names, licence).alias("family"), (1 - F.col("p")[0]).alias("p"), "paragraph")).alias("x")
    )
    hits = fewest_lines(written(hits.select("key_", "place", "x.*"), "licences-hits"))
    found = hits.groupBy("key_").agg(
        F.array_sort(F.collect_set("family")).alias("licences"),
        F.count(F.lit(1)).alias("n_hits"),
        F.max("p").alias("score"),
        F.max_by("paragraph", F.struct(F.col("p"), -F.col("place.block"), -F.col("first"))).alias("evidence"),
    )
    return base.withColumn("key_", key).join(found, "key_", "left").select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "evidence",
    )
