"""Nearest neighbours by inner product: NN-descent graph, greedy graph search.

The graph starts from blocks of rows sorted by random projections.  A round joins every node
with its neighbours and a fixed number of nodes that name it; inside such a group all pairs
with a new member are scored, and pairs that beat the worst neighbour of either end are
proposed to it.  Rounds end when few neighbours change.  A search keeps a beam per query,
starts at entry points (and at the query's own node, if it is indexed) and expands the best open
nodes by joins with the graph.  Graph and beams use 16-bit codes, each vector with a scale of its
own, so that one long vector does not blur the others; the last beam is scored in double precision
on the original vectors.

Equal vectors form one class, which is one node of the graph.  A class keeps the smallest of its
ids, one more than a query asks for: no result can hold a larger one, because ties go to the smaller
id.  A class is searched once for all queries in it.

Every usable row is indexed.  ``entries`` is a fixed number of entry points, the smallest by a
hash of the id.  Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do vectors of another dimension than most, nor null ids; of rows
that repeat an id the largest vector counts.  Ties go to the smaller id.  Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import written
from quadrat.llm.vectors import matrix, usable

EDGE = "id bigint, other bigint, score float"


STEPS = 32767


def _encoded(v: np.ndarray) -> list[bytes]:
    """Of every vector its scale (float32) and components in steps of it (16 bits)."""
    scale = (np.abs(v).max(axis=1) / STEPS).astype(np.float32)
    # A scale too small for a float32 leaves a vector of nearly nothing.
    step = np.where(scale > 0, scale, np.float32(1)).astype(np.float64)
    whole = np.clip(np.rint(v / step[:, None]), -STEPS, STEPS).astype(np.int16)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale, whole)]


def _decoded(raw: list[bytes]) -> np.ndarray:
    if not raw:
        return np.zeros((0, 0), dtype=np.float32)
    held = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    scale = np.ascontiguousarray(held[:, :4]).view(np.float32)
    return np.ascontiguousarray(held[:, 4:]).view(np.int16).astype(np.float32) * scale


def _codes(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _decoded(lists.to_pylist())


def _first(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; tasks drop the others before the shuffle."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= F.lit(most)).drop("place")


def prepared(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame, int]:
    """Classes (id: their smallest, v, code, ids: their ``top`` + 1 smallest), rows (id, class); the dimension."""
    base = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where(usable() & F.col("id").isNotNull())
    stats = base.groupBy(F.size("embedding").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")
    )
    most = stats.orderBy(F.desc("n"), "d").first()
    dimension, unit = (most["d"], most["top"]) if most else (1, 1.0)
    base = base.where(F.size("embedding") == dimension).groupBy("id").agg(F.max("embedding").alias("v"))
    base = written(base, "neighbours-vectors")
    heads = base.groupBy("v").agg(F.min("id").alias("class"))
    held = _first(base, "v", ["id"], top + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = held.select(F.element_at("ids", 1).alias("id"), "v", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = pa.array(_encoded(matrix(batch.column("v")) / unit), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=["id", "v", "ids", "code"])

    schema = "id bigint, v array<double>, ids array<bigint>, code binary"
    members = base.join(heads, "v").select("id", "class")
    return written(classes.mapInArrow(run, schema), "neighbours-classes"), members, dimension


def _best(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int):
    """The k best different others of each id."""
    order = np.lexsort((others, -scores, ids))
    ids, others, scores = ids[order], others[order], scores[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, scores = ids[fresh], others[fresh], scores[fresh]
    start = np.ones(len(ids), dtype=bool)
    start[1:] = ids[1:] != ids[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
    kept = np.arange(len(ids)) - first < k
    return ids[kept], others[kept], scores[kept]


def _edges(ids, others, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores.astype(np.float32))],
        names=["id", "other", "score"],
    )


def _blocks(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if part.num_rows < 2:
                    continue
                ids, code = part.column("id").to_numpy(), _codes(part.column("code"))
                scores = code @ code.T
                np.fill_diagonal(scores, -np.inf)
                m = min(k, len(ids) - 1)
                near = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                yield _edges(np.repeat(ids, m), ids[near].ravel(), np.take_along_axis(scores, near, axis=1).ravel())

    return run


def _join_members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for members in batch.column("members"):
                m = members.values
                ids = m.field("w").to_numpy()
                if len(ids) < 2:
                    continue
                new = m.field("new").to_numpy(zero_copy_only=False)
                code = _codes(m.field("code"))
                scores = code @ code.T
                good = (scores > m.field("least").to_numpy()[:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(good, False)
                a, b = np.nonzero(good)
                made.append((ids[a], ids[b], scores[a, b]))
            if made:
                yield _edges(*_best(*(np.concatenate(x) for x in zip(*made)), k))

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each id; tasks keep k each before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _edges(*_best(*(batch.column(n).to_numpy() for n in ("id", "other", "score")), k))

    best = edges.mapInArrow(partial, EDGE).groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "other"))).alias("near")
    )
    return best.select("id", F.slice("near", 1, k).alias("near"))


def descend(rows: DataFrame, dimension: int, k: int, rounds: int = 12, change: float = 0.005) -> DataFrame:
    """Graph: id, near (array of far = -score, other), best first."""
    n = rows.count()
    draw = np.random.default_rng(11)
    start = None
    for _ in range(3):
        direction = F.array(*[F.lit(float(x)) for x in draw.standard_normal(dimension)])
        projection = F.aggregate(F.zip_with("v", direction, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        ordered = rows.select("id", "code", projection.alias("p")).repartitionByRange("p").sortWithinPartitions("p")
        made = ordered.select("id", "code").mapInArrow(_blocks(k, 256), EDGE)
        start = made if start is None else start.unionByName(made)
    graph = written(_top(start, k).withColumn("old", F.array().cast("array<bigint>")), "neighbours-graph")
    for _ in range(rounds):
        flat = graph.select("id", "old", F.explode("near").alias("e"), F.size("near").alias("held"),
                            F.element_at("near", -1)["far"].alias("worst"))
        new = ~F.array_contains("old", F.col("e.other"))
        edges = flat.select("id", F.col("e.other").alias("other"), new.alias("new"))
        # Of the nodes that name a node, its group takes k, new ones first, by a hash.
        reverse = _first(edges, "other", [F.desc("new"), F.xxhash64("id", "other"), "id"], k)
        reverse = reverse.select(F.col("other").alias("v"), F.col("id").alias("w"), "new")
        pairs = edges.select(F.col("id").alias("v"), F.col("other").alias("w"), "new").unionByName(reverse)
        pairs = pairs.groupBy("v", "w").agg(F.max("new").alias("new"))
        least = graph.select(
            F.col("id").alias("w"),
            F.when(F.size("near") >= k, -F.element_at("near", -1)["far"]).otherwise(F.lit(float("-inf")))
            .cast("float").alias("least"),
        )
        ends = rows.select(F.col("id").alias("w"), "code").join(least, "w")
        members = pairs.join(ends, "w").groupBy("v").agg(
            F.collect_list(F.struct("w", "new", "code", "least")).alias("members")
        )
        proposals = members.where(F.exists("members", lambda m: m["new"])).mapInArrow(_join_members(k), EDGE)
        present = graph.select("id", F.explode("near").alias("e")).select(
            "id", F.col("e.other").alias("other"), (-F.col("e.far")).cast("float").alias("score")
        )
        merged = _top(proposals.unionByName(present), k).join(
            graph.select("id", F.transform("near", lambda e: e["other"]).alias("old")), "id"
        )
        graph = written(merged, "neighbours-graph")
        changed = graph.select(
            F.sum(F.size(F.array_except(F.transform("near", lambda e: e["other"]), "old"))).alias("c")
        ).first()["c"]
        if (changed or 0) <= change * n * k:
            break
    return graph


def adjacency(graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """node, around: neighbours and nodes that name it, with their codes."""
    forward = graph.select("id", F.explode("near").alias("e")).select(
        "id", F.col("e.other").alias("other"), F.col("e.far").alias("far")
    )
    back = _first(forward, "other", ["far", "id"], k)
    back = back.select(F.col("other").alias("node"), F.col("id").alias("w"))
    every = forward.select(F.col("id").alias("node"), F.col("other").alias("w")).unionByName(back).distinct()
    codes = rows.select(F.col("id").alias("w"), "code")
    return written(
        every.join(codes, "w").groupBy("node").agg(F.collect_list(F.struct("w", "code")).alias("around")),
        "neighbours-adjacency",
    )


BEAM = "q bigint, code binary, ids array<bigint>, scores array<float>, open array<boolean>"


def _beam(q, code, ids, scores, open_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int64()), pa.array(code, pa.binary()), pa.array(ids, pa.list_(pa.int64())),
         pa.array(scores, pa.list_(pa.float32())), pa.array(open_, pa.list_(pa.bool_()))],
        names=["q", "code", "ids", "scores", "open"],
    )


def search(
    queries: DataFrame, rows: DataFrame, graph: DataFrame, top: int,
    *, k: int, beam: int = 80, width: int = 20, entries: int = 1024, starts: int = 8,
) -> DataFrame:
    """q, near (array of far = -score, vec_id): the ``top`` + 1 nearest ids found of each class in ``queries``.

    The class's own ids are among them.
    """
    near = adjacency(graph, rows, k)
    fixed = rows.select("id", "code").orderBy(F.xxhash64("id"), "id").limit(entries).collect()
    entry_ids = np.array([r["id"] for r in fixed], dtype=np.int64)
    entry_codes = [bytes(r["code"]) for r in fixed]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _decoded(entry_codes)
            code = _codes(batch.column("code"))
            scores, q = code @ table.T, batch.column("id").to_numpy()
            best = np.argsort(-scores, axis=1)[:, :starts]
            own = (code * code).sum(axis=1)
            ids = [[i, *[e for e in entry_ids[b].tolist() if e != i]] for i, b in zip(q.tolist(), best)]
            held = [[o, *[s for e, s in zip(entry_ids[b].tolist(), r[b].tolist()) if e != i]]
                    for i, o, b, r in zip(q.tolist(), own.tolist(), best, scores)]
            yield _beam(q, batch.column("code").to_pylist(), ids, held, [[True] * len(x) for x in ids])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                code = _decoded([batch.column("code")[i].as_py()])[0]
                ids = np.array(batch.column("ids")[i].as_py(), dtype=np.int64)
                scores = np.array(batch.column("scores")[i].as_py(), dtype=np.float32)
                open_ = np.array(batch.column("open")[i].as_py(), dtype=bool)
                open_[np.nonzero(open_)[0][:width]] = False
                found = batch.column("around")[i].values
                if found is not None and len(found):
                    around = found.flatten() if pa.types.is_list(found.type) else found
                    w, first = np.unique(around.field("w").to_numpy(), return_index=True)
                    fresh = ~np.isin(w, ids)
                    w, first = w[fresh], first[fresh]
                    if len(w):
                        got = _codes(around.field("code").take(pa.array(first))) @ code
                        ids = np.concatenate([ids, w])
                        scores = np.concatenate([scores, got.astype(np.float32)])
                        open_ = np.concatenate([open_, np.ones(len(w), dtype=bool)])
                order = np.lexsort((ids, -scores))[: beam + 1]
                for column, value in zip(out, (
                    batch.column("q")[i].as_py(), batch.column("code")[i].as_py(),
                    ids[order].tolist(), scores[order].tolist(), open_[order].tolist(),
                )):
                    column.append(value)
            yield _beam(*out)

    state = written(queries.select("id", "code").mapInArrow(begin, BEAM), "neighbours-beam")
    while not state.where(F.exists("open", lambda o: o)).isEmpty():
        pairs = F.filter(F.arrays_zip("ids", "open"), lambda e: e["open"])
        todo = state.select("q", F.explode(F.slice(pairs, 1, width)).alias("e"))
        got = todo.select("q", F.col("e.ids").alias("node")).join(near, "node").groupBy("q").agg(
            F.flatten(F.collect_list("around")).alias("around")
        )
        state = written(state.join(got, "q", "left").mapInArrow(step, BEAM), "neighbours-beam")

    exact = state.select("q", F.explode("ids").alias("w"))
    target = rows.select(F.col("id").alias("w"), F.col("v").alias("y"), F.col("ids").alias("found"))
    source = queries.select(F.col("id").alias("q"), F.col("v").alias("x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", matrix(batch.column("x")), matrix(batch.column("y")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q"), batch.column("found"), pa.array(s)], names=["q", "found", "score"]
                )

    scored = exact.join(target, "w").join(source, "q").select("q", "found", "x", "y")
    scored = scored.mapInArrow(score, "q bigint, found array<bigint>, score double")
    single = scored.select("q", (-F.col("score")).alias("far"), F.explode("found").alias("vec_id"))
    return single.groupBy("q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, top + 1).alias("near")
    )


def nearest(embeddings: DataFrame, every: int = 20, top: int = 20, k: int = 32, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of all rows whose vec_id is divisible by ``every``."""
    rows, members, dimension = prepared(embeddings, top)
    graph = descend(rows, dimension, k)
    asked = members.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("class").alias("q"))
    asked = written(asked, "neighbours-queries")
    classes = rows.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi")
    found = asked.join(search(classes, rows, graph, top, k=k, **options), "q")
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, top)
    return found.select("query_id", F.posexplode(others).alias("place", "e")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.far")).alias("score")
    )
