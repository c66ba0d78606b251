"""Embedding near-duplicates by randomised-rotation binary codes, and helpers for vectors.

A vector is scaled to length 1 and turned by random rotations; the signs are its binary code.
The code's stored correction factor (the inner product of the turned vector with its own code)
makes the estimate of an inner product with another turned vector unbiased, and gives its
confidence bound.  Windows of the code are bucket keys: vectors that agree on all bits of a
window meet in a cell.  There the estimate plus bound rules pairs out; the others are computed
exactly, in double precision, on the original vectors.

The number of windows follows from the threshold: a pair just at it misses all of them with
probability 1 - ``recall``, closer pairs far less often; a window has about log2(n) bits, so
unrelated vectors seldom meet however many there are.

Defined results: null vectors, zero vectors, and those with a null or non-finite component or of
another dimension than most link with nothing and are kept, each a component of its own.  Equal
vectors form one class.  An empty table gives an empty result; repeated rows and ids count as
vectors of their own; a component is named by its smallest id.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import written
from quadrat.llm.grouping import (
    FOUND, STEPS, beside, chunks, components, meetings, spots, sure_links, tally, tiles, unsure,
)


def usable(vector: str = "embedding"):
    """Condition: not null, finite everywhere, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def rotations(dimension: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random rotations side by side: dimension x bits or a little more."""
    draw = np.random.default_rng(seed)
    made = []
    while sum(m.shape[1] for m in made) < bits:
        q, r = np.linalg.qr(draw.standard_normal((dimension, dimension)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def window_keys(turned: np.ndarray, windows: int, width: int) -> np.ndarray:
    bits = (turned[:, : windows * width] > 0).reshape(len(turned), windows, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def windows_for(threshold: float, rows: int, recall: float) -> tuple[int, int]:
    """Number and width of the code windows for pairs at the threshold."""
    width = min(max(math.ceil(math.log2(max(rows, 2))), 8), 48)
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), width


def near_links(classes: DataFrame, dimension: int, threshold: float, recall: float, rows: int) -> DataFrame:
    """Links between classes (id, copies, embedding), as ``tally`` gives them."""
    windows, width = windows_for(threshold, rows, recall)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dimension, windows * width)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = window_keys(unit(matrix(batch.column("embedding"))) @ turn, windows, width)
            at = np.repeat(np.arange(len(codes)), windows)
            key = codes + (np.arange(windows, dtype=np.int64) << width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(key.ravel())], names=["id", "key"]
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dimension, windows * width)
        for table, cell, side in chunks(batches):
            whole = matrix(table.column("embedding"))
            length = unit(whole)
            turned = length @ turn
            codes = window_keys(turned, windows, width)
            mine = (table.column("key").to_numpy() >> width).astype(np.int64)
            sign = np.where(turned > 0, 1.0, -1.0)
            # Each rotation is an estimate with a factor of its own; the mean of them is used.
            parts = turned.shape[1] // dimension
            factor = np.abs(turned).reshape(len(turned), parts, dimension).sum(axis=2)
            stored = sign.reshape(len(turned), parts, dimension) / factor[:, :, None] / parts
            stored = stored.reshape(len(turned), -1)
            share = factor / math.sqrt(dimension)
            spread = np.sqrt(np.maximum(1 - share**2, 0) / share**2 / max(dimension - 1, 1))
            bound = 6 * np.sqrt((spread**2).sum(axis=1)) / parts
            left, right, hits = [], [], []
            unknown = unsure(table)
            for i, j in meetings(cell, side):
                keep = unknown(i, j)
                i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 14):
                    a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    same = codes[a] == codes[b]
                    new = same.argmax(axis=1) == mine[a]
                    a, b, seen = a[new], b[new], same[new].sum(axis=1)
                    estimate = np.einsum("ij,ij->i", stored[a], turned[b])
                    open_ = estimate + bound[a] >= threshold
                    a, b, seen = a[open_], b[open_], seen[open_]
                    exact = np.einsum("ij,ij->i", length[a], length[b]) >= threshold
                    left.append(a[exact])
                    right.append(b[exact])
                    hits.append(seen[exact])
            i, j, n = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right, hits))
            yield tally(table.column("id"), i, j, table.column("copies").to_numpy(), n)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (unit(matrix(batch.column(c))) for c in ("embedding", "head"))
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
                # Rounded up by more than the arc cosine of a rounded number can be wrong.
                q = np.ceil((angle + 1e-7) / math.acos(threshold) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(q)], names=["id", "q"])

    def measure(pairs: DataFrame) -> DataFrame:
        """Angle of members from their leaders in whole steps; angles are a metric."""
        heads = classes.select(F.col("id").alias("leader"), F.col("embedding").alias("head"))
        heads = heads.join(pairs.select("leader").distinct(), "leader", "left_semi")
        both = beside(pairs.join(classes.select("id", "embedding"), "id"), heads, "leader")
        return both.select("id", "embedding", "head").mapInArrow(angles, "id bigint, q int")

    codes = classes.select("id", "embedding").mapInArrow(keys, "id bigint, key bigint")
    codes = written(codes, "vectors-codes")
    sizes = codes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = codes.join(sizes, "key")
    known = spots(held.join(classes.select("id", "copies"), "id"), measure)
    cells = tiles(held.join(classes, "id"), known)
    links = cells.mapInArrow(verify, FOUND.replace("string", "long")).unionByName(sure_links(known))
    return written(links, "vectors-links")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    size = rows.where(usable()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = size["d"] if size else 1
    fine = usable() & (F.size("embedding") == dimension)
    # Adding 0.0 makes -0.0 equal to 0.0.
    same = F.when(fine, F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string")))))
    marked = written(rows.withColumn("same", F.coalesce(same, F.concat(F.lit("row-"), F.col("row")))), "vectors-rows")
    first = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    classes = marked.groupBy("same").agg(
        F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.any_value("embedding").alias("embedding")
    )
    classes = classes.withColumn("id", F.col("first.row"))
    classes = written(classes.withColumn("fine", ~F.col("same").startswith("row-")), "vectors-classes")
    good = classes.where("fine").select("id", "copies", "embedding")
    links = near_links(good, dimension, threshold, recall, good.count())
    reach = links.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("linked"))
    parts = components(links.where("b IS NOT NULL").select("a", "b"), "vectors-components")
    whole = classes.drop("embedding").join(parts, "id", "left").join(reach, "id", "left")
    whole = whole.withColumn("root", F.coalesce("root", "id"))
    heads = whole.groupBy("root").agg(F.min("first").alias("head"))
    whole = whole.join(heads, "root").select("same", "copies", "linked", "head")
    component = F.col("head.vec_id")
    return marked.join(whole, "same").select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
