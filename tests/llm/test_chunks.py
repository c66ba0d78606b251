"""Packing from known chunks, and archives of repeated rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quadrat.llm import packing, queries, warc


def test_packed_ids_equal_a_whole_encoding(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    odd = "aB é́'sß　 \x1c\x85\t\n1٣|Σςİ<😀"
    texts: list[str | None] = [None, "", " \n", "<|startoftext|> a<|endoftext|>b", "ΟΔΟΣ ΟΔΟΣ. Σ", "é ́e"]
    texts += ["".join(rng.choices(odd, k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choices(["the", "cat's", "x|y", "...", "<|endoftext|>", "İ"], k=500)) for _ in range(20)]
    texts += ["long" * 20_000, "w " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    coder = Tokenizer.from_file(queries.vocabulary())
    held = {r["doc_id"]: r for r in packing.tokenised(docs, queries.vocabulary(), 2).collect()}
    assert len(held) == len(texts)
    for i, text in enumerate(texts):
        ids = np.frombuffer(held[i]["ids"], dtype="<u4").tolist()
        assert ids == coder.encode(text or "", add_special_tokens=False).ids + [2], repr(text)[:80]
        assert held[i]["doc_tokens"] == len(ids)


def test_archive_of_repeated_rows_and_ids(spark, tmp_path):
    body = "<p>shared</p>"
    rows = [(i, f"u{i}", body) for i in range(300)] + [(299, "again", body), (299, "again", body)]
    rows += [(None, "none", body), (7, None, None), (8, "empty", ""), (9, "own", "<p>own</p>"), (9, "own", "<p>other</p>")]
    made = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    made.write.parquet(str(tmp_path / "pages.parquet"))
    stored = spark.read.parquet(str(tmp_path / "pages.parquet")).withColumn("key", F.lit("clash"))
    for name, pages in (("stored", stored), ("made", made)):
        place = str(tmp_path / name)
        files = warc.write(pages, place)
        got = warc.whole(warc.read(files, place), files).collect()
        assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
        shared = [r for r in got if r["digest"] == warc.base32(hashlib.sha1(body.encode()).digest())]
        heads = [r for r in shared if r["kind"] == "response"]
        assert len(shared) == 303 and len(heads) == 1 and heads[0]["page_id"] == 299
        assert {r["refers_to"] for r in shared} == {None, heads[0]["record_id"]}
        empty = sorted((r["page_id"], r["kind"]) for r in got if r["digest"] == warc.base32(hashlib.sha1(b"").digest()))
        assert empty == [(7, "revisit"), (8, "response")]
        assert sorted(r["payload"] for r in got if r["page_id"] == 9 and r["kind"] == "response") == [b"<p>other</p>", b"<p>own</p>"]
