"""Centroid clustering, token alignment and line quality against plain loops, and at the edges."""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import alignment, centroids, line_quality, queries
from quadrat.llm.common import bucketed, byte_letters, crc_fold

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string"
SMALL = "/root/testdata/sf0.001"
WIDER = "/root/testdata/sf0.01"


# Centroids


def clustered(rng, n: int, groups: int, spread: float) -> np.ndarray:
    heads = rng.normal(size=(groups, 64))
    return (heads[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32)


def lloyd(rows, k: int = 8, rounds: int = 10):
    """Every distance of every round, in integers."""
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * float(c)) for c in v] for _, v in kept]

    def name(i):
        return hashlib.sha256(f"3:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), x[i]

    at = np.array(x, dtype=np.int64)
    heads = at[sorted(range(len(x)), key=name)[:k]]

    def nearest():
        d = ((at[:, None, :] - heads[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = nearest()
        heads = np.array([
            [int(s) // int((own == j).sum()) for s in at[own == j].sum(axis=0)] if (own == j).any() else heads[j]
            for j in range(len(heads))
        ])
    own, d = nearest()
    return sorted((str(kept[i][0]), int(own[i]), int(d[i])) for i in range(len(kept))), heads.tolist()


def vectors_with_odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v], 0, "clash") for i, v in enumerate(clustered(rng, 900, 12, 0.05))]
    fine = rows[5][1]
    odd = [
        None, [], fine[:-1], fine + [1.0], [float("nan")] + fine[1:], [float("inf")] + fine[1:], [None] + fine[1:],
        [0.0] * 64, [-0.0] * 64, [-3.5] * 64,
    ]
    rows += [(2000 + i, v, None, None) for i, v in enumerate(odd)]
    return [*rows, rows[7], rows[7], (rows[8][0], rows[9][1], 1, ""), (None, rows[10][1], 1, "")]


def test_centroids_equal_every_distance(spark):
    rows = vectors_with_odd_rows()
    found = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(5))
    want, heads = lloyd(rows)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.vectors.collect()) == want
    assert found.centroids == heads
    # Well apart, most vectors need no scan once the centroids have found their places.
    assert found.scanned[0] == len(want) and found.scanned[-1] < len(want) / 4


def test_few_vectors_and_none(spark):
    rows = vectors_with_odd_rows()[:3]
    found = centroids.cluster(spark.createDataFrame(rows, VECTORS))
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.vectors.collect()) == lloyd(rows)[0]
    none = centroids.cluster(spark.createDataFrame([], VECTORS))
    assert none.vectors.count() == 0 and none.centroids == []


def test_too_large_components_are_an_error(spark):
    rows = [(1, [1e6] * 64, 0, ""), (2, [0.0] * 64, 0, "")]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame(rows, VECTORS))


def test_large_integers_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 26), 1 << 26, (40, 64))
    c = rng.integers(-(1 << 26), 1 << 26, (3, 64))
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert centroids.squared(x, c).tolist() == plain


def test_loosening_bounds_every_loss_and_is_less_than_the_drift():
    rng = np.random.default_rng(1)
    gained = 0
    for _ in range(300):
        d = rng.integers(2, 6)
        old = rng.normal(size=(4, d)) * rng.choice([0.1, 1, 5])
        new = old + rng.normal(size=(4, d)) * rng.choice([0.05, 1, 3])
        radius = np.abs(rng.normal(size=4)) * rng.choice([0.1, 1, 3])
        most = centroids.loosening(old, new, radius)
        way = rng.normal(size=(200, d))
        way *= rng.random((200, 1)) ** 0.2 / np.linalg.norm(way, axis=1)[:, None]
        drift = np.linalg.norm(new - old, axis=1)
        for i in range(4):
            x = old[i] + way * radius[i]
            lost = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert np.delete(lost, i, axis=1).max() <= most[i] + 1e-9
            assert most[i] <= np.delete(drift, i).max() + 1e-9
            gained += most[i] < 0.9 * np.delete(drift, i).max()
    assert gained > 100


def test_rounds_shuffle_no_vectors(spark):
    made = centroids.points(spark.createDataFrame(vectors_with_odd_rows(), VECTORS), 64, 1024)
    points = bucketed(made, "test-points", "row", 4)
    state = bucketed(points.select("row", F.col("vec_id").alias("cluster")), "test-state", "row", 4)
    both = points.join(state.hint("merge"), "row")
    assert both.count() == points.count() > 900
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("test_")]


def test_centroid_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    frame = queries.op11_centroids(spark, SMALL)
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({queries.oracle_sql()['op11_centroids']})").fetchall())


# Alignment

A, B = (queries.vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def token_bytes():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    names = {v: k for k, v in a.get_vocab().items()}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def of_a(i):
        return bytes(letters[c] for c in names[i])

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode, of_a, of_b


def aligned(texts, together: bool):
    """One whole encoding of each text, and a plain merge."""
    encode_a, encode_b, of_a, of_b = token_bytes()
    made = []
    for text in texts:
        if not text:
            made.append(None)
            continue
        a, b = encode_a(text), encode_b(text)
        ends = []
        for ids, of in ((a, of_a), (b, of_b)):
            ends.append(list(itertools.accumulate(len(of(i)) for i in ids)))
        said = (" " + text).encode()
        if b"".join(map(of_a, a)) != said or b"".join(map(of_b, b)) != said:
            made.append(None)
            continue
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            x, y = ends[0][i], ends[1][j]
            if x == y or not together:
                links.append((a[i], b[j]))
            i, j = i + (x <= y), j + (y <= x)
        groups, at = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = bisect.bisect(ends[0], cut), bisect.bisect(ends[1], cut)
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            at = to
        made.append((len(a), len(b), len(groups), links, ";".join(groups)))
    seen = collections.Counter(link for d in made if d for link in d[3])
    top = collections.Counter()
    for (_, y), n in seen.items():
        top[y] = max(top[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (*d[:3], len(d[3]), sum(seen[x] == top[x[1]] for x in d[3]), sum(seen[x] for x in d[3]), d[4])
        for d in made
    ]


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    made: list[str | None] = [
        None, "", " ", "   ", "  lead", "trail  ", "a\n\n  b", " \t x y 　 z", "▁x ▁", "<s> </s><|endoftext|> hi",
        "é ́x ﬁ Ⅳ", "\x00\x01 a", "a\r\n b", "😀 👩‍👩‍👧 x", "it's  we'll 's", "same words", "same words",
    ]
    made += ["".join(rng.choices(" \n\t  ab.'sé́ 1|😀", k=rng.randrange(1, 30))) for _ in range(300)]
    words = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(400)]
    made += [" ".join(rng.choices(words, k=n)) for n in (30, 300, 9000)]
    return made


@pytest.mark.parametrize("together,work,block", [(True, 1 << 16, 1 << 21), (True, 7, 4000), (False, 50, 900)])
def test_alignment_equals_a_plain_merge(spark, together, work, block):
    texts = odd_texts()
    rows = [(i if i != 40 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, groups string, block int").repartition(3)
    got, counted = alignment.align(docs, A, B, together=together, work=work, block=block)
    want = sorted((str(r[0]), *w) for r, w in zip(rows, aligned(texts, together)))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == want
    assert counted.count() == counted.select("a_id", "b_id").distinct().count()


def test_long_texts_are_cut_only_where_both_sides_start_anew(monkeypatch):
    encode_a, encode_b, *_ = token_bytes()
    pair = alignment.Pair(A, B)
    texts = [t for t in odd_texts() if t and "▁" not in t] + ["x" + " " * 20_000 + "y\n" * 300]
    monkeypatch.setattr(alignment, "AT_ONCE", 40)
    assert max(len(pair.parts(t)) for t in texts) > 100
    for text, (a, b) in zip(texts, pair.encode(texts)):
        assert a.tolist() == encode_a(text) and b.tolist() == encode_b(text)


def test_alignment_of_no_documents(spark):
    got, counted = alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B)
    assert got.count() == 0 and counted.count() == 0


def test_crossings_part_the_merge_evenly_and_no_shared_end():
    rng = np.random.default_rng(6)
    for _ in range(200):
        top = int(rng.integers(2, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, top), rng.integers(0, top - 1), replace=False)), top) for _ in "ab")
        work = int(rng.integers(1, 9))
        i, j = alignment.crossings(a, b, work)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i + j) <= work + 1).all()
        for x, y in zip(i[1:-1], j[1:-1]):
            passed = max([0, *a[:x], *b[:y]])
            assert (a[x:] > passed).all() and (b[y:] > passed).all()


# Line quality


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(0)
    lines = line_quality.measured(["a b\nc d\n\nx y z", "", "one", None, "p\nq\nr\ns t", "  \n "])
    said, moves = rng.normal(size=len(lines)), rng.normal(size=(2, 2))
    good, pairs, total = line_quality.marginals(lines, said, moves)
    whole = 0.0
    for a, b in zip(lines.first[:-1], lines.first[1:]):
        if a == b:
            continue
        weight = {
            y: math.exp(sum(said[a + i] * v for i, v in enumerate(y)) + sum(moves[u, v] for u, v in itertools.pairwise(y)))
            for y in itertools.product((0, 1), repeat=int(b - a))
        }
        z = sum(weight.values())
        whole += math.log(z)
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
            for u, v in itertools.product((0, 1), repeat=2):
                if i:
                    some = sum(w for y, w in weight.items() if y[i - 1 : i + 1] == (u, v)) / z
                    assert pairs[a + i][u, v] == pytest.approx(some)
    assert total == pytest.approx(whole)
    assert lines.number.tolist() == [0, 1, 3, 0, 0, 1, 2, 3]


def test_gradient_of_the_potentials():
    rng = np.random.default_rng(3)
    lines = line_quality.measured(["Ab cd.\n### ### x\n\nThe end of it.", "One 12", "a | b | c\n\nB"])
    error, weights = rng.normal(size=len(lines)), rng.normal(size=line_quality.FEATURES)
    slope = line_quality._against(lines, error)
    assert slope @ weights == pytest.approx(error @ line_quality.potentials(lines, weights), rel=1e-5)


def test_measures_of_a_line():
    one = line_quality.measured(["The cat.\nx x x x"])
    other = line_quality.measured(["before", "The cat.\nx x x x", None])
    assert (one.ranges == other.ranges[1:3]).all() and np.allclose(one.shapes, other.shapes[1:3])
    # Of four equal words three repeat their neighbour.
    assert one.ranges[1, 5] == np.searchsorted(line_quality.RANGES, 0.75) and one.ranges[0, 5] == 0


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    labels = spark.read.parquet(f"{WIDER}/labels.parquet")
    rows = queries.op13_line_quality(spark, WIDER).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert queries.op13_line_quality(spark, WIDER).count() == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_quality_at_the_edges(spark):
    good = "A plain sentence of some words.\nAnd then another one, as plain."
    bad = "buy | buy | buy | buy\n### $$$ ### $$$\nwin | win | win"
    texts = [good.replace("plain", f"plain{i}") for i in range(60)] + [bad.replace("win", f"win{i}") for i in range(60)]
    mixed = good + "\n" + bad
    texts += [None, "", " \n\t ", good, good, bad, mixed, "long " * 50_000, "x\n" * 5_000]
    kind = "doc_id bigint, text string, quality string, is_good int, bad_lines int"
    rows = [(i, t, "clash", 0, 0) for i, t in enumerate(texts)] + [(None, good, None, None, None), (3, bad, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    marked = [(i, int(i < 60)) for i in range(120)] + [(5, 1), (None, 1), (6, None), (9999, 0)]
    labels = spark.createDataFrame(marked, "doc_id bigint, quality int")
    model = line_quality.fit(docs, labels, crc_fold("doc_id", 7) != 0)
    got = {(r["doc_id"], r["text"]): r for r in line_quality.score(docs, model).collect()}
    assert len(got) == len(rows)
    assert got[123, good]["is_good"] == 1 and got[125, bad]["is_good"] == 0
    assert got[123, good]["quality"] == got[124, good]["quality"] == got[None, good]["quality"]
    assert got[120, None]["quality"] == got[121, ""]["quality"] == got[122, " \n\t "]["quality"]
    assert [x["line"] for x in got[126, mixed]["bad_lines"]] == [2, 3, 4]
    none = docs.where("false")
    assert line_quality.score(none, model).count() == 0
    bare = line_quality.fit(docs, labels.where("quality = 1"))
    flat = {r["quality"] for r in line_quality.score(docs, bare).collect()}
    assert len(flat) == 1 and 0.9 < flat.pop() < 1
    nothing = line_quality.fit(none, labels.where("false"))
    assert {r["quality"] for r in line_quality.score(docs, nothing).collect()} == {0.5}
