"""What the pipeline and its mixing stage leave on disk."""

import re
from pathlib import Path

import corpus_pipeline
from quadrat.llm import mixing, queries
from quadrat.llm.common import written
from quadrat.session import shared_folder

DOCS = "doc_id long, text string, source string"


def _docs(spark, n=400):
    rows = [(i, " ".join(["w"] * (i % 7)) if i % 11 else None, "abc"[i % 3] if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_counts_without_texts(spark):
    """Windows and their shuffles hold numbers; a text moves for the join and for the order only."""
    out = mixing.mix(_docs(spark), queries.WEIGHTS, bucket_rows=16)
    plan = out._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "Window" not in re.findall(r"\(\d+\) (\w+)\n(?:Input|Output)[^\n]*text#", plan)
    moved = re.findall(r"\(\d+\) Exchange\nInput[^\n]*text#", plan)
    assert len(moved) <= 2
    assert out.count() == 400


def test_mixing_places_every_row_once(spark):
    got = mixing.mix(_docs(spark), queries.WEIGHTS, bucket_rows=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_a_stage_drops_the_tables_of_the_one_before(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}

    def stage(label):
        return label, lambda s, docs, _: written(docs, label)

    stages = corpus_pipeline.in_turn([stage("turn-a"), stage("turn-b")])
    docs = _docs(spark, 5)
    for number, (_, run) in enumerate(stages):
        run(spark, docs, "").write.parquet(f"{folder}/turn-out-{number}-{id(docs)}")
        docs = spark.read.parquet(f"{folder}/turn-out-{number}-{id(docs)}")
    new = {p.name for p in folder.iterdir()} - before
    assert [n for n in sorted(new) if n.startswith("turn-a")] == []
    assert len([n for n in new if n.startswith("turn-b")]) == 1
    assert docs.count() == 5
