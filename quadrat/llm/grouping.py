"""Pairs within buckets, and connected components, as Spark joins.

Distances are metrics, so members of a group of near copies need not be compared with each other.
Members of large buckets have a leader and ``q``, their distance from it in steps of which
``STEPS`` make the limit, rounded up.  Two members of one leader whose steps add up to at most
``STEPS`` are linked for sure: such links are counted by sums over steps, connected through the
member with the fewest steps, and never compared.  All other pairs meet in cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import drop_copies, written


STEPS = 200
#: Members of one leader in bands of this many steps; the last two hold the limit and all others.
BAND = 25
OTHERS = STEPS // BAND + 1
#: Members of one leader are dealt over this many tasks before Spark splits hot partitions further.
SALTS = 16


def beside(rows: DataFrame, heads: DataFrame, *on: str) -> DataFrame:
    """``rows`` (id, ...) with the one row of ``heads`` that has the same ``on``, hot keys salted."""
    salt = F.pmod(F.xxhash64("id", F.lit("beside")), F.lit(SALTS)).cast("int")
    every = heads.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", salt).join(every, [*on, "salt"]).drop("salt")


def _head():
    """The member of a bucket with most copies gives its group a name, the same in every run."""
    return F.max(F.struct("copies", F.xxhash64("id", F.lit("head")).alias("h"), F.col("id").alias("leader")))


def spots(buckets: DataFrame, measure: Callable[[DataFrame], DataFrame], tile: int = 256) -> DataFrame:
    """``id``, ``leader``, ``q``, ``copies`` of members of large buckets within the limit of their leader.

    ``buckets``: key, id, n, copies.  ``measure`` gives id and ``q`` for rows (id, leader): steps from
    one point per leader, the leader itself or another, by the metric of the join.
    """
    large = buckets.where(F.col("n") > tile)
    heads = large.groupBy("key").agg(_head().alias("head"))
    chosen = beside(large, heads, "key").groupBy("id").agg(
        F.max("head").alias("head"), F.any_value("copies").alias("copies")
    )
    chosen = written(chosen.select("id", "head.leader", "copies"), "grouping-leaders")
    measured = measure(chosen.select("id", "leader")).select("id", F.col("q").cast("int").alias("q"))
    return written(chosen.join(measured.where(F.col("q") <= STEPS), "id"), "grouping-spots")


def sure_links(found: DataFrame) -> DataFrame:
    """Links of ``spots`` that need no comparison, as ``tally`` gives them."""
    bins = found.groupBy("leader", "q").agg(F.sum("copies").alias("c"))
    # At most STEPS + 1 rows of a leader: its running sums are one small array.
    sums = bins.groupBy("leader").agg(F.collect_list(F.struct("q", "c")).alias("bins"))
    within = F.aggregate(
        F.filter("bins", lambda b: b["q"] + F.col("at") <= STEPS), F.lit(0).cast("long"), lambda s, b: s + b["c"]
    )
    reach = sums.withColumn("at", F.explode(F.transform("bins", lambda b: b["q"]))).select(
        "leader", F.col("at").alias("q"), within.alias("reach")
    )
    own = F.when(F.col("q") * 2 <= STEPS, F.col("copies")).otherwise(0)
    counted = beside(found, reach, "leader", "q").select(
        F.col("id").alias("a"), F.lit(None).cast(found.schema["id"].dataType).alias("b"),
        (F.col("reach") - own).alias("links"),
    )
    # Whoever is linked for sure to any member is so to the one with the fewest steps.
    least = found.groupBy("leader").agg(F.min(F.struct("q", "id")).alias("least"))
    edges = beside(found, least, "leader").where((F.col("q") + F.col("least.q") <= STEPS) & (F.col("id") != F.col("least.id")))
    edges = edges.select(F.col("id").alias("a"), F.col("least.id").alias("b"), F.lit(0).alias("links"))
    rows = counted.where("links > 0").unionByName(edges)
    return rows.select("a", "b", F.col("links").cast("long").alias("links"), *[
        F.lit(0).cast("long").alias(c) for c in ("once", "twice")
    ])


def tiles(rows: DataFrame, found: DataFrame | None, tile: int = 256) -> DataFrame:
    """``rows`` (key, id, n: rows with this key, copies, ...) dealt so that pairs of one key meet.

    A key with more than ``tile`` rows (more than its ``room``, if ``rows`` have that column) is cut into
    bands by the steps from its leader, and bands into tiles by a hash of the id.  Every pair of tiles is a cell (key, low, high), but for
    tiles whose members are all linked for sure.  No cell holds more than about two tiles; pairs
    within a tile meet in the cell low = high, others only across ``mine``.  Partitions hold
    whole cells, in order, for ``chunks``.  Adds ``leader`` and ``q`` (null without a leader) of
    ``found``; None: ``rows`` have them.
    """
    if found is not None:
        rows = rows.join(found.select("id", "leader", "q"), "id", "left")
    rows = rows.withColumn("room", F.col("room") if "room" in rows.columns else F.lit(tile))
    large = rows.where(F.col("n") > F.col("room"))
    small = rows.where(F.col("n") <= F.col("room")).drop("n", "room").select(
        "*", *[F.lit(0).alias(c) for c in ("mine", "low", "high")]
    )
    # The bands follow the leader that most members of the bucket have.
    votes = large.where("leader IS NOT NULL").groupBy("key", "leader").agg(F.count(F.lit(1)).alias("v"))
    chief = votes.groupBy("key").agg(F.max(F.struct("v", "leader")).alias("chief"))
    members = large.select("key", "id", "leader", "q", "room")
    keys = members.select("key").distinct().join(chief.select("key", "chief.leader"), "key", "left")
    keys = keys.withColumnRenamed("leader", "chief")
    band = F.when(F.col("leader") == F.col("chief"), F.floor(F.col("q") / BAND)).otherwise(OTHERS).cast("int")
    placed = written(beside(members, keys, "key").select("key", "id", "room", band.alias("band")), "grouping-bands")
    counts = placed.groupBy("key").agg(*[
        F.ceil(F.sum(F.when(F.col("band") == b, 1).otherwise(0)) / F.max("room")).cast("int").alias(f"g{b}")
        for b in range(OTHERS + 1)
    ])
    from_, parts = F.lit(0), []
    for b in range(OTHERS + 1):
        parts.append(F.struct(from_.alias("from"), F.col(f"g{b}").alias("n")))
        from_ = from_ + F.col(f"g{b}")
    counts = counts.select("key", F.array(*parts).alias("tiles"))

    def top(b):
        return F.least(b * BAND + (BAND - 1), F.lit(STEPS))

    def partners(b: int):
        part = F.get("tiles", F.lit(b))
        alike = (F.col("band") != OTHERS) & (top(F.col("band")) + top(F.lit(b)) <= STEPS) & F.lit(b != OTHERS)
        return F.when((part["n"] > 0) & ~alike, F.sequence(part["from"], part["from"] + part["n"] - 1)).otherwise(
            F.array().cast("array<int>")
        )

    here = F.get("tiles", F.col("band"))
    mine = here["from"] + F.pmod(F.xxhash64("id", F.lit("tile")), here["n"]).cast("int")
    meets = beside(placed, counts, "key").select(
        "key", "id", mine.alias("mine"), F.flatten(F.array(*[partners(b) for b in range(OTHERS + 1)])).alias("others")
    )
    meets = meets.withColumn("other", F.explode("others")).select(
        "key", "id", "mine", F.least("other", "mine").alias("low"), F.greatest("other", "mine").alias("high")
    )
    return together(small.unionByName(large.drop("n", "room").join(meets, ["key", "id"])))


def unsure(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs (i, j) of rows with ``leader`` and ``q`` are not linked for sure."""
    codes = pc.dictionary_encode(table.column("leader")).combine_chunks()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.chunk(0) if codes.num_chunks else pa.array([], pa.string()).dictionary_encode()
    leader = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    q = table.column("q").fill_null(STEPS + 1).to_numpy()
    return lambda i, j: (leader[i] != leader[j]) | (q[i].astype(np.int64) + q[j] > STEPS)


def together(cells: DataFrame) -> DataFrame:
    return cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole cells at a time: rows, the cell of each row, and ``mine`` where it matters, else -row."""
    held: pa.Table | None = None

    def cells(table: pa.Table) -> np.ndarray:
        parts = [table.column(n).to_numpy() for n in ("key", "low", "high")]
        new = np.zeros(table.num_rows, dtype=bool)
        for part in parts:
            new[1:] |= part[1:] != part[:-1]
        return np.cumsum(new)

    def made(table: pa.Table, cell: np.ndarray):
        mine, low, high = (table.column(n).to_numpy() for n in ("mine", "low", "high"))
        return table, cell, np.where(low == high, -1 - np.arange(table.num_rows), mine)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not held.num_rows:
            continue
        cell = cells(held)
        end = int(np.searchsorted(cell, cell[-1]))
        if end:
            yield made(held.slice(0, end).combine_chunks(), cell[:end])
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield made(held, cells(held))
    del held
    drop_copies()


def meetings(cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, of rows that meet in a cell; one distance at a time."""
    i, step = np.arange(len(cell)), 1
    while True:
        i = i[i + step < len(cell)]
        i = i[cell[i] == cell[i + step]]
        if not len(i):
            return
        apart = side[i] != side[i + step]
        yield i[apart], i[apart] + step
        step += 1


def forest(i: list[int], j: list[int]) -> list[tuple[int, int]]:
    """Enough of the pairs (i, j) to connect what all of them connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for a, b in zip(i, j):
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            kept.append((a, b))
    return kept


FOUND = "a string, b string, links long, once long, twice long"


def tally(ids: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, copies: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    """Links of a chunk: per row the documents linked (b null), and a forest of the links."""
    linked = np.zeros(len(copies), dtype=np.int64)
    np.add.at(linked, i, copies[j])
    np.add.at(linked, j, copies[i])
    at = np.nonzero(linked)[0]
    once, twice = np.zeros(len(copies), dtype=np.int64), np.zeros(len(copies), dtype=np.int64)
    np.add.at(once, i, hits == 1)
    np.add.at(twice, i, hits == 2)
    tree = forest(i.tolist(), j.tolist())
    left = np.concatenate([at, np.array([a for a, _ in tree], dtype=np.int64)])
    right = pa.array([None] * len(at) + [b for _, b in tree], pa.int64())
    flat = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    none = np.zeros(len(tree), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [flat.take(pa.array(left)), flat.take(right), *[
            pa.array(np.concatenate([x[at], none])) for x in (linked, once, twice)
        ]],
        names=["a", "b", "links", "once", "twice"],
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """``id``, ``root``: the smallest id reachable over ``edges`` (a, b); linked ids only.

    Large-star and small-star rounds: each hangs neighbours below the smallest one, so the
    number of rounds grows with the logarithm of the size; edges never outgrow the input.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        label,
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        low = F.least("u", "m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), low.alias("v"))
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        links = written(small.where("u <> v").distinct(), label)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
