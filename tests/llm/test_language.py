"""Language of texts: the Viterbi pass against a plain loop, held-out texts, spans, odd rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quadrat.llm import language

DOCS = "doc_id bigint, text string, lang string"
SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "acht"], "ru": ["при", "вет", "дом", "ка"]}


def speak(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(words))


def corpus(n: int = 240) -> list[tuple]:
    rng = random.Random(2)
    return [(i, speak(rng, lang, 30), lang) for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]


def plain_path(scores: np.ndarray, penalty: float) -> list[int]:
    """Best labels by a loop over words and pairs of labels; ties to the first label."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        step, origin = [], []
        for b in range(len(row)):
            best = int(np.argmax(value))
            from_best = value[best] - np.float32(penalty)
            stay = value[b]
            origin.append(best if from_best > stay else b)
            step.append(max(from_best, stay) + row[b])
        back.append(origin)
        value = step
    path = [int(np.argmax(value))]
    for origin in reversed(back):
        path.append(origin[path[-1]])
    return path[::-1]


def test_viterbi_equals_a_plain_loop():
    draw = np.random.default_rng(5)
    for k in (2, 3, 200):
        model = language.Model([f"l{i:03d}" for i in range(k)], np.zeros((1, k), np.float32), np.ones((1, k), bool))
        labeller = language.Labeller(model, 4.0, 1000)
        # Whole numbers, so that sums are exact and ties occur.
        labeller.scores = -draw.integers(0, 9, (50, k)).astype(np.float32)
        counts = np.array([0, 1, 7, 30, 2, 30, 0, 12])
        flat = draw.integers(0, 50, counts.sum())
        starts = np.cumsum(counts) - counts
        path = labeller._viterbi(flat, starts, counts)
        for start, count in zip(starts, counts):
            if count:
                want = plain_path(labeller.scores[flat[start : start + count]], 4.0)
                assert path[start : start + count].tolist() == want


def test_held_out_texts_and_mixed_spans(spark):
    frame = spark.createDataFrame(corpus(), DOCS)
    model = language.fit(frame, F.col("doc_id") % 4 != 0)
    rows = language.identify(frame, model).where("doc_id % 4 = 0").collect()
    assert rows and all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in rows)
    rng = random.Random(9)
    mixed = " ".join([speak(rng, "aa", 12), speak(rng, "bb", 20), speak(rng, "ru", 8)])
    row = language.identify(spark.createDataFrame([(1, mixed, None)], DOCS), model).first()
    assert [(s["first_word"], s["words"], s["lang"]) for s in row["spans"]] == [(0, 12, "aa"), (12, 20, "bb"), (32, 8, "ru")]
    assert row["lang_pred"] == "bb" and 0.3 < row["score"] < 0.9


def test_odd_rows_and_clashing_columns(spark):
    docs = corpus()
    extra = [
        (None, docs[0][1], None), (5, docs[5][1], "ru"), (900, None, "aa"), (901, "", "bb"), (902, " 12 ... 3", None),
        (903, docs[1][1] + " 你好 12", None), (904, "你好 世界", None), (905, ("kato " * 300_000), None),
        (906, "ka" * 200_000, None), (907, "ка " * 3, None),
    ]
    frame = spark.createDataFrame(docs + extra, DOCS).withColumn("Score", F.lit("clash")).withColumn("spans", F.lit(1))
    got = language.identify(frame, language.fit(frame)).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    for doc_id in (900, 901, 902):
        assert (by[doc_id]["lang_pred"], by[doc_id]["score"], by[doc_id]["spans"]) == ("und", 0.0, [])
    # A script that no learned language uses has no say.
    assert by[903]["lang_pred"] == "bb" and by[903]["score"] > 0.9
    assert (by[904]["lang_pred"], by[904]["score"]) == ("aa", 0.0)
    assert by[905]["lang_pred"] == by[906]["lang_pred"] == "aa" and by[907]["lang_pred"] == "ru"
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 5}) == 1


def test_nothing_learned(spark):
    frame = spark.createDataFrame(corpus(6), DOCS)
    assert language.fit(frame.limit(0)) is None and language.fit(frame, F.lit(False)) is None
    assert {(r["lang_pred"], r["score"]) for r in language.identify(frame, None).collect()} == {("und", 0.0)}
    assert language.identify(frame.limit(0), language.fit(frame)).count() == 0


def test_every_label_is_learned(spark):
    """More labels than a byte can number, each with letters of its own."""
    letters = [chr(0x4E00 + 10 * i) for i in range(150)]
    docs = [(i, f"{x}{x}{x} {x}{x} {x}{x}{x}{x}", f"l{i:03d}") for i, x in enumerate(letters)]
    frame = spark.createDataFrame(docs, DOCS)
    rows = language.identify(frame, language.fit(frame)).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 148
