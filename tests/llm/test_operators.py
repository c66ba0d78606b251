"""The text operators against brute force, and their defined results at the edges."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrat.llm import chat, jaccard, licences, mixing, neighbours, packing, queries, toxicity, vectors, warc
from quadrat.llm.grouping import components
from quadrat.session import noting

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


def corpus() -> list[tuple]:
    rng = random.Random(5)
    texts: list[str | None] = [None, "", "  ", "one two", "One  two", "same\nwords here only four"]
    for _ in range(30):
        base = words(rng, 120)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                copy[rng.randrange(120)] = "zz" + words(rng, 1)[0]
            texts.append(" ".join(copy))
    crowd = words(rng, 200)
    for i in range(60):
        copy = list(crowd)
        copy[i * 3] = f"x{i}"
        texts.append(" ".join(copy))
    texts.append(" ".join(words(rng, 30_000)))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, texts[7], None, None, None)]


def jaccard_links(rows) -> tuple[dict, dict]:
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 5 * common >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return links, groups


@pytest.mark.parametrize("limit", [256, 8])
def test_jaccard_join_equals_brute_force(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_links", F.lit("clash"))
    got = jaccard.similar_groups(docs, limit=limit).collect()
    links, groups = jaccard_links(rows)
    want = sorted((str(r[0]), n) for r, n in zip(rows, links))
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    heads = {tuple(sorted(map(str, g))): min((x for x in g if x is not None), default=None) for g in groups.values()}
    made: dict = {}
    for r in got:
        made.setdefault(r["class_id"], []).append(str(r["doc_id"]))
    assert {tuple(sorted(v)): k for k, v in made.items()} == heads


def test_copies_of_one_text_do_not_hide_missed_pairs(spark):
    rng = random.Random(12)
    crowd = words(rng, 200)
    texts = [" ".join(crowd)] * 1000
    for i in range(30):
        texts.append(" ".join([*crowd[: 5 * i], f"x{i}", *crowd[5 * i + 1 :]]))
    copied = len(texts)
    for _ in range(300):
        base = words(rng, 104)
        # 10 of 100 shingles differ: 90 of 110.
        texts += [" ".join(base), " ".join([*base[:30], "zz", *base[31:70], "zz", *base[71:]])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.similar_groups(docs, runs=2).collect()}
    assert [got[i] for i in range(copied, len(texts))] == [1] * 600


def test_a_run_counts_once_however_many_buckets_a_pair_shares():
    keys = [(7 << jaccard.RUN_BITS) | 3, (9 << jaccard.RUN_BITS) | 3, (11 << jaccard.RUN_BITS) | 4]
    table = pa.table({
        "key": pa.array([keys[0]] * 2), "buckets": pa.array([keys] * 2),
        "sketch": pa.array([[0] * jaccard.SKETCH_WORDS] * 2, pa.list_(pa.int64())),
    })
    _, _, hits = jaccard._candidates(table, np.zeros(2, dtype=int), np.array([-1, -2]), 0.8)
    assert hits.tolist() == [2]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint"), "t").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.similar_groups(docs).count() == 0
    assert mixing.mix(docs, queries.WEIGHTS).count() == 0
    assert packing.pack(docs, queries.vocabulary()).count() == 0
    assert licences.scan(docs, *licences.train(docs)).count() == 0
    assert toxicity.score(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0
    assert neighbours.nearest(empty).count() == 0
    assert chat.digest(chat.windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
    place = warc.archive_folder(spark)
    files = warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), place)
    assert warc.read(files, place).count() == 0


def test_mixture_targets_and_shares(spark):
    docs = spark.createDataFrame(corpus(), DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs, [[3.0, 3.0], [1.0, 1.0], [2.0, 2.0]], bucket_rows=8)
    rows = got.collect()
    assert len(rows) == len(corpus())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    total = sum(s for s, _ in sources.values())
    assert abs(sum(t for _, t in sources.values()) - 1.5 * total) < 1e-6 * total
    for name, (size, target) in sources.items():
        assert target <= 2 * size + 1e-6
        assert abs(sum(r["taken"] for r in rows if r["source"] == name) - target) <= 1
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, queries.WEIGHTS, bucket_rows=8).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in rows}


def test_curriculum_moves_late_sources_back(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 2}", 1) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), [[1.0, 0.0], [0.0, 1.0]], share=1.0, bucket_rows=16)
    mean = {r["source"]: r["m"] for r in got.groupBy("source").agg(F.avg("position").alias("m")).collect()}
    # Integrals of 1 - t and t: the mean moments are a third and two thirds.
    assert abs(mean["s0"] - 1 / 3) < 0.03 and abs(mean["s1"] - 2 / 3) < 0.03


def test_every_pass_has_its_own_moment(spark):
    rows = [(i, "w " * (5 + i % 7), "en", f"s{i % 3}", 1) for i in range(600)] + [(900, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    met = []
    for r in mixing.mix(docs, queries.WEIGHTS, bucket_rows=64).collect():
        assert len(r["positions"]) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
        assert r["positions"] == sorted(set(r["positions"])) and all(0 <= x <= 1 for x in r["positions"])
        assert not r["positions"] or r["positions"][0] == r["position"]
        met += [(x, r["doc_id"], r["source"], r["size"], r["target"]) for x in r["positions"]]
    # The weights are constant, so at any moment every source has met that share of its target.
    for moment in (0.25, 0.5, 0.75, 0.95):
        for source in ("s0", "s1", "s2"):
            target = next(t for _, _, s, _, t in met if s == source)
            assert abs(sum(n for x, _, s, n, _ in met if s == source and x < moment) / target - moment) < 0.02
    order = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert order == [doc for _, doc, *_ in sorted(met)]


def test_fill_finds_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        best = 0
        for take in itertools.product(*[range(n + 1) for n in counts.values()]):
            total = sum(t * length for t, length in zip(take, counts))
            best = max(best, total if total <= capacity else 0)
        taken = packing.fill(counts, capacity)
        assert sum(k * n for k, n in taken.items()) == best
        assert all(n <= counts[k] for k, n in taken.items())


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    got = packing.pack(spark.createDataFrame(rows, DOCS), queries.vocabulary(), capacity=256, group_windows=8).collect()
    coder = Tokenizer.from_file(queries.vocabulary())
    want: dict = {}
    for doc, text, *_ in rows:
        want.setdefault(doc, coder.encode(text or "", add_special_tokens=False).ids + [2])
    for p in got:
        ids = np.asarray(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        assert p["doc_tokens"] == len(want[p["doc_id"]])
    assert sum(p["length"] for p in got) == sum(len(want[r[0]]) for r in rows)
    sequences: dict = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(p["length"] for p in got) / (256 * len(sequences)) > 0.95


def test_archive_round_trip_over_small_splits(spark):
    rng = np.random.default_rng(1)
    noisy = "".join(chr(c) for c in rng.integers(32, 1500, 40_000))
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (5, None, None), (3, "x\r\ny", ""), (4, "u", noisy)]
    place = warc.archive_folder(spark)
    files = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), place)
    got = {r["page_id"]: r for r in warc.read(files, place, split=777).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert {k: r["kind"] for k, r in got.items()} == {1: "revisit", 2: "response", 3: "revisit", 4: "response", 5: "response"}
    assert got[1]["refers_to"] == got[2]["record_id"] and got[3]["refers_to"] == got[5]["record_id"]
    assert bytes(got[4]["payload"]) == noisy.encode()
    assert got[1]["digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_archive_keeps_records_with_long_headers(spark):
    rng = random.Random(6)
    long = "http://c/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300_000))
    rows = [(1, "http://a/" + "a" * 100_000, "same"), (2, "http://b/" + "b" * 70_000, "same"), (3, long, "other")]
    place = warc.archive_folder(spark)
    files = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), place)
    found = warc.read(files, place, split=7777)
    got = {r["page_id"]: r for r in found.collect()}
    assert {k: r["url"] for k, r in got.items()} == {k: url for k, url, _ in rows}
    assert got[1]["refers_to"] == got[2]["record_id"] and bytes(got[3]["payload"]) == b"other"
    assert warc.whole(found, files).count() == 3
    with pytest.raises(ValueError, match="3 records were written, 2 were read"):
        warc.whole(found.where("page_id < 3"), files)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 32))
    near = np.concatenate([b + rng.standard_normal((rng.integers(1, 30), 32)) * 0.12 for b in base])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None, *[1.0] * 31]), (9005, rows[0][1]), (9006, [1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")).collect()
    every = np.concatenate([near, near[:1]])
    ids = [r[0] for r in rows] + [9005]
    u = every / np.linalg.norm(every, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, 0)
    want = dict(zip(ids, (s >= 0.95).sum(axis=1)))
    made = {r["vec_id"]: r for r in got}
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * sum(want.values()) and all(made[i]["n_links"] <= n for i, n in want.items())
    assert all(made[i]["n_links"] == 0 and made[i]["kept"] for i in (9001, 9002, 9003, 9004, 9006))
    assert made[9005]["component_id"] == made[0]["component_id"]


def test_neighbour_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(20_000, None), (20_020, [0.0] * 24)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
    assert sorted(found) == list(range(0, 1500, 20))
    hit = 0
    for q, near in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(near.values()))
        assert list(sorted(near)) == list(range(1, 21))
    assert hit / (20 * len(found)) >= 0.9


def test_chat_reads_back(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|0|user|>x<|end|>\n", "a\\<\\|b", "\\\\", "", None, "<\\/s>", "[INST]" * 3]
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i + 1, ["user", "assistant"][i % 2], hard[i % 8]) for i in range(40)]
    rows += [(2, 0, "a|b c", "é" * 50), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "assistant", "w " * 500)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 60, 20)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss)
    assert made.where("conv_id = 1 AND span > 0 AND NOT startswith(formatted, '<|turn|0|system|>')").count() == 0


def test_licences_and_plain_text(spark):
    rng = random.Random(9)
    plain = [(i, " ".join(words(rng, 60)) + ".", "en", "s", 0) for i in range(60)]
    held = [
        (100, "Some words.\nReleased under the MIT License.", "en", "s", 0),
        (101, plain[0][1] + " This work is licensed under the GNU General Public License, version 3.", "en", "s", 0),
        (102, None, None, None, None), (103, "", None, None, None), (104, "license", None, None, None),
    ]
    docs = spark.createDataFrame(plain + held, DOCS)
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs, *licences.train(docs)).collect()}
    assert got[100] == ["mit"] and got[101] == ["gpl"]
    assert all(not v for k, v in got.items() if k not in (100, 101))


def test_wrapped_notices_are_found(spark):
    rng = random.Random(10)
    plain = [(i, " ".join(words(rng, 60)) + ".", "en", "s", 0) for i in range(60)]
    wrapped = {
        100: ("# tool\n#\n# licensed under the Apache License,\n# Version 2.0\n#\nimport os", ["apache"], 1),
        101: (" * licensed under a Creative Commons\r\n * Attribution 4.0 International License\r\n", ["cc-by"], 1),
        102: ("Released under the MIT License\nlicensed under CC BY 4.0\nReleased under the MIT License", ["cc-by", "mit"], 3),
        103: ("// licensed\n// under\n// the Apache\n// License, Version\n// 2.0\nint x", ["apache"], 1),
        104: ("licensed under the Apache\n\nLicense, Version 2.0", [], 0),
    }
    held = [(i, text, "en", "s", 0) for i, (text, _, _) in wrapped.items()]
    docs = spark.createDataFrame(plain + held, DOCS)
    got = {r["doc_id"]: (r["licences"], r["n_hits"]) for r in licences.scan(docs, *licences.train(docs)).collect()}
    assert {i: got[i] for i in wrapped} == {i: (names, n) for i, (_, names, n) in wrapped.items()}
    assert not any(got[i][0] for i in range(60))


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(words(rng, 30) + (["blorgish", "vexatious"] if bad else [])), "en", "s", 0))
        labels.append((i, int(bad)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "BLORGISH, vexatious!", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(0, 300, 5)]
    assert sum(got[i]["is_toxic"] == int(i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[902]["is_toxic"] == 1 and got[900]["is_toxic"] == got[901]["is_toxic"] == 0


def test_licence_classifier_learns_every_ordinary_paragraph_it_can_meet(spark):
    # More texts than a sample would hold, and the telling ones longer than it would take.
    near = "how to redistribute leaflets, and modify their terms of printing. "
    docs = [(i, f"{near}number{i} was {'licensed' if i % 2 else 'released'} under protest. " * 400, "en", "s", 0) for i in range(40)]
    docs += [(1000, "Released under the MIT License.", "en", "s", 0)]
    frame = spark.createDataFrame(docs, DOCS)
    with noting() as paths:
        found = licences.train(frame)
    learned = spark.read.parquet([p for p in paths if "licences-plain" in p][-1])
    words = {w for r in learned.collect() for w in r["words"]}
    assert {f"number{i}" for i in range(40)} <= words
    assert learned.agg(F.sum("times")).first()[0] >= 40 * 400
    got = {r["doc_id"]: r["licences"] for r in licences.scan(frame, *found).collect()}
    assert got == {i: [] for i in range(40)} | {1000: ["mit"]}
