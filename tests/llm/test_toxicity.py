"""Exact neighbours against all pairs, copies of examples with rare words, and odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import toxicity
from quadrat.session import noting

DOCS = "doc_id bigint, text string"


def dense(vectors, terms: int) -> np.ndarray:
    made = np.zeros((len(vectors), terms))
    for row, (t, w) in zip(made, vectors):
        row[t] = w
    return made


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.5, 0.9])
def test_nearest_equals_all_pairs(floor):
    draw = np.random.default_rng(3)
    terms, k = 60, 7
    vectors = []
    for i in range(500):
        # Some examples are equal, so that similarities tie.
        if i % 5 == 4:
            vectors.append(vectors[draw.integers(len(vectors))])
            continue
        t = np.sort(draw.choice(terms, draw.integers(0, 12), replace=False))
        w = draw.random(len(t)) + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.Postings.of(np.ones(terms), vectors)
    every = dense(vectors, terms)
    for i in range(0, 500, 3):
        t, w = vectors[i]
        if not len(t):
            continue
        share = draw.choice([1.0, 0.8, 0.4])  # the rest of the norm is unseen words
        cosine = every @ dense([(t, w * share)], terms)[0]
        kth = np.sort(cosine)[-k]
        wanted = np.nonzero((cosine > 0) & (cosine >= max(kth, floor) - 1e-12))[0]
        found, similarity = index.nearest(t, w * share, k, floor)
        if floor == 0:
            assert set(wanted) == set(found)
        else:
            above = np.nonzero(cosine >= floor + 1e-9)[0]
            best = above[np.argsort(-cosine[above], kind="stable")][:k]
            assert set(found) >= set(best[cosine[best] > kth + 1e-12]) and set(found) <= set(
                np.nonzero(cosine >= floor - 1e-9)[0]
            )
        assert np.allclose(similarity, cosine[found])


def test_copies_of_examples_with_rare_words_are_caught(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    abuse = ["".join(rng.choices("klmnopqrst", k=7)) for _ in range(80)]
    # Every abusive word is in a few toxic texts only; no word piece is shared.
    docs, labels = [], []
    for i in range(1200):
        toxic = int(i % 6 == 0)
        words = rng.choices(plain, k=60)
        if toxic:
            words[10:12] = [abuse[(i // 6 + j * 37) % 80] for j in (0, 1)]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    copies = [(10_000 + i, docs[i][1]) for i in range(0, 1200, 6)] + [(20_000 + i, docs[i][1]) for i in range(1, 1200, 6)]
    index, marked = toxicity.fit_and_mark(
        spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    )
    got = {r["doc_id"]: r for r in toxicity.vote(marked, index).collect()}
    held = dict(zip(index.ids.tolist(), index.labels.tolist()))
    assert len(held) > 800
    for doc_id, _ in copies:
        origin = doc_id % 10_000
        if origin in held:
            first = got[doc_id]["neighbours"][0]
            assert first["doc_id"] == origin and abs(first["similarity"] - 1) < 1e-9
            assert got[doc_id]["is_toxic"] == held[origin]
        assert got[doc_id]["toxicity"] == got[origin]["toxicity"]


def test_odd_rows_repeats_and_clashing_columns(spark):
    bad = "you utter slimewit and grubface go away"
    docs = [(i, f"{bad} number{i % 7}" if i % 2 else f"a calm note about garden number{i % 7}", "x") for i in range(400)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "123 ...", "x"), (None, bad, "x"), (3, docs[3][1], "x")]
    docs += [(1003, "calm garden " * 200_000, "x"), (1004, "z" * 300_000, "x")]
    labels = [(i, i % 2) for i in range(400)] + [(4, 0), (None, 1), (5, None), (1000, 1), (5000, 1)]
    frame = spark.createDataFrame(docs, DOCS + ", Toxicity string")
    rows = toxicity.score(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r for r in rows}
    for doc_id in (1000, 1001, 1002, 1004):
        assert got[doc_id]["neighbours"] == [] and got[doc_id]["toxicity"] == got[1000]["toxicity"]
    assert got[None]["is_toxic"] == 1 and got[1003]["is_toxic"] == 0
    assert all(got[i]["is_toxic"] == i % 2 for i in range(400))
    assert len({r["toxicity"] for r in rows if r["doc_id"] == 3}) == 1
    # Ties in similarity: the smaller ids first.
    for row in rows:
        near = [(-round(n["similarity"], 9), n["doc_id"]) for n in row["neighbours"]]
        close = [n for n in near if n[0] == -1.0]
        assert close == sorted(close) or row["doc_id"] in (None, 1003)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_one_label_or_none(spark, labels):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(5)], DOCS)
    rows = toxicity.score(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(rows) == 5 and all(0 <= r["toxicity"] <= 1 for r in rows)


def test_texts_are_read_as_a_plain_loop_reads_them():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeß", k=rng.randint(1, 9))) for _ in range(300)]
    terms = sorted({t for w in words[:40] for t in toxicity.terms_of(w)})
    known = sorted(words[:200])
    odd = [" \x1c\x85 x y", "", None, "123 ... ", " a-b  İx ", "ab" * 3000 + " ab", "İİİ ẞ"]
    texts = odd + [" ".join(rng.choice(["", "-", "###"]) + rng.choice(words).title() for _ in range(50)) for _ in range(60)]
    read = toxicity._Reader(terms, known).read(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        chunks = (text or "").split()
        held = Counter(terms.index(t) for c in chunks for t in toxicity.terms_of(c) if t in terms)
        a, b = read.term_ends[i : i + 2]
        assert list(zip(read.terms[a:b], read.term_counts[a:b])) == sorted(held.items())
        said = Counter(w for w in map(toxicity.word_of, chunks) if w)
        a, b = read.word_ends[i : i + 2]
        assert list(zip(read.words[a:b], read.word_counts[a:b])) == sorted(
            (known.index(w), n) for w, n in said.items() if w in known
        )
        assert np.isclose(read.other[i], sum((1 + np.log(n)) ** 2 for w, n in said.items() if w not in known))


def test_no_table_as_long_as_the_documents_is_written(spark):
    bad = "you utter slimewit and grubface go away"
    docs = [(i, bad if i % 3 == 0 else f"a calm note about garden number{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    with noting() as paths:
        rows = toxicity.score(spark.createDataFrame(docs, DOCS), labels).collect()
    assert len(rows) == 300 and all(r["is_toxic"] == int(r["doc_id"] % 3 == 0) for r in rows)
    assert paths and all(spark.read.parquet(p).count() <= 60 for p in paths)
