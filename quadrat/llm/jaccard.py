"""Chosen-path join: all pairs of documents with similar sets of word 5-grams.

Documents with equal sets form a class, found exactly; classes are joined.  A run sends
every class down one random path: the first step is the smallest shingle under one of the
random orders (a sampled token of the set), so classes with Jaccard similarity s share it with
probability s.  Buckets above a limit are split again by 1 / threshold sampled tokens on
average, until they are small or keep half of their parent, which means they are alike; their
pairs are compared by brute force, in cells of bounded size, but for pairs of near copies
that their distances from a common leader link already (``grouping``).  Candidates pass a one-bit sketch,
five deviations wide, and are verified on whole sets.  The pairs of classes not seen are estimated
from those that one run and two runs saw (Chao); several buckets of one run count once.  They
are set against half the linked classes, not against links: a class counts once however many
copies or neighbours it has, so no large group makes up for pairs missed elsewhere.  While they
miss the target, the runs are doubled; past ``MOST_RUNS`` that is an error.

Words are runs of non-space characters, lower-cased.  Defined results: a text with one to four
words has one shingle, all its words; null, empty and blank texts link with nothing and are
groups of their own.  Repeated rows and ids are separate documents of one class.  A null doc_id
counts as a document, but is never a group's name unless the whole group lacks ids.  Other
columns pass through; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import drop_copies, without, written
from quadrat.llm.grouping import (
    FOUND, STEPS, beside, chunks, components, meetings, spots, sure_links, tally, tiles, together, unsure,
)

COORDINATES = 64
SKETCH_WORDS = 4
# The low bits of a bucket's key hold its run.
RUN_BITS = 10
MOST_RUNS = 256
#: A tile of a bucket holds so many classes or shingles, but no fewer classes than the limit of a bucket.
TILE = 2048
TILE_SHINGLES = 4 << 20
RESULT = ("class_id", "copy_id", "n_links", "kept")


def with_shingles(docs: DataFrame, width: int = 5) -> DataFrame:
    """Add ``grams``: distinct hashes of the word ``width``-grams, ascending; empty without a word."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    last = F.size(F.col("words_")) - width
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("words_"), i + j) for j in range(width)]),
    )
    found = F.when(F.size("words_") > 0, F.array_sort(F.array_distinct(grams)))
    grams = F.coalesce(found, F.array().cast("array<bigint>"))
    return docs.withColumn("words_", words).withColumn("grams", grams).drop("words_")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name, min-hash coordinates, and one bit of further ones, of each non-empty set."""
    draw = np.random.default_rng(20240607)
    total = COORDINATES + 64 * SKETCH_WORDS
    mask = draw.integers(0, 1 << 63, total, dtype=np.uint64)
    odd = draw.integers(0, 1 << 63, total, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    drop_copies()
    for whole in batches:
        whole = whole.filter(pc.greater(pc.list_value_length(whole.column("grams")), 0))
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            lists = batch.column("grams")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            at = ends - lengths
            least = np.empty((len(lengths), total), dtype=np.uint64)
            for i in range(total):
                least[:, i] = np.minimum.reduceat((flat ^ mask[i]) * odd[i], at)
            coordinates = (least[:, :COORDINATES] >> np.uint64(8)).astype(np.uint32).view(np.int32)
            bits = ((least[:, COORDINATES:] >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits, axis=1).view(np.int64)
            names = [hashlib.md5(flat[x:y].tobytes()).hexdigest() for x, y in zip(at.tolist(), ends.tolist())]
            rows = np.arange(len(lengths) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_"),
                    pa.array(names, pa.string()),
                    pa.ListArray.from_arrays(pa.array(rows * COORDINATES, pa.int32()), pa.array(coordinates.ravel())),
                    pa.ListArray.from_arrays(pa.array(rows * SKETCH_WORDS, pa.int32()), pa.array(packed.ravel())),
                    pa.array(lengths, pa.int32()),
                ],
                names=["row_", "id", "path", "sketch", "size"],
            )
    pa.default_memory_pool().release_unused()


def _key(run: Column, *parts: Column) -> Column:
    return F.shiftleft(F.shiftright(F.xxhash64(*parts), RUN_BITS), RUN_BITS).bitwiseOR(run)


def _paths(signed: DataFrame, runs: range, threshold: float, limit: int) -> DataFrame:
    """Final buckets of ``runs``: key, id, n (size of the bucket, at least 2), room (classes a tile of it holds)."""
    first = F.array(*[
        _key(F.lit(r).cast("long"), F.lit(r), F.get("path", F.lit(r % COORDINATES))) for r in runs
    ])
    rows = signed.select("id", "size", F.explode(first).alias("key"), F.lit(None).cast("long").alias("parent"))
    room = F.least(F.lit(TILE), F.floor(F.col("n") * TILE_SHINGLES / F.greatest("held", F.lit(1))))
    room = F.greatest(F.lit(limit), room).cast("int").alias("room")
    done = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).where("n > 1")
        rows = written(rows.join(sizes, "key"), "jaccard-level")
        # A bucket that keeps half of its parent is alike already: splitting on would not help.
        open_ = (F.col("n") > limit) & (F.col("parent").isNull() | (F.col("n") <= F.col("parent") / 2))
        small = rows.where(~open_).select("key", "id", "n", room)
        done = small if done is None else done.unionByName(small)
        large = rows.where(open_)
        if large.isEmpty():
            return done

        def child(node: Column, salt: str) -> Column:
            key = node["key"]
            pick = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(COORDINATES)).cast("int")
            run = key.bitwiseAND(F.lit((1 << RUN_BITS) - 1).cast("long"))
            return F.struct(_key(run, key, pick, F.get("path", pick)).alias("key"), node["n"].alias("parent"))

        def children(node: Column) -> Column:
            # A node samples one token, and a second one so often that 1 / threshold is the mean.
            second = F.pmod(F.xxhash64(node["key"], F.lit("more")), F.lit(1000)) < round(1000 * (1 / threshold - 1))
            return F.array_compact(F.array(child(node, "one"), F.when(second, child(node, "two"))))

        # A class meets its path once, with its buckets of all runs.
        nodes = large.groupBy("id").agg(
            F.any_value("size").alias("size"), F.collect_list(F.struct("key", "n")).alias("nodes")
        )
        rows = nodes.join(signed.select("id", "path"), "id").select(
            "id", "size", F.inline(F.array_distinct(F.flatten(F.transform("nodes", children))))
        )


def _candidates(table: pa.Table, cell: np.ndarray, side: np.ndarray, threshold: float, wanted=None):
    """Pairs of a chunk whose sketches agree and whose first common bucket is this one, and hits.

    ``hits``: the runs in which the pair shares a bucket.  ``wanted`` says which pairs to look at.
    """
    n = table.num_rows
    bits = 64 * SKETCH_WORDS
    p = (1 + threshold) / 2
    most = bits * (1 - p) + 5 * (bits * p * (1 - p)) ** 0.5
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, SKETCH_WORDS)
    key = table.column("key").to_numpy()
    buckets = [frozenset(k) for k in table.column("buckets").to_pylist()]
    left, right, hits = [], [], []
    for i, j in meetings(cell, side):
        if wanted is not None:
            keep = wanted(i, j)
            i, j = i[keep], j[keep]
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            both = buckets[a] & buckets[b]
            if min(both) == key[a]:
                left.append(a)
                right.append(b)
                hits.append(len({k & ((1 << RUN_BITS) - 1) for k in both}))
    return np.array(left, np.int64), np.array(right, np.int64), np.array(hits, np.int64)


def _needed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell, side in chunks(batches):
            i, j, _ = _candidates(table, cell, side, threshold, unsure(table))
            yield from table.take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell, side in chunks(batches):
            i, j, hits = _candidates(table, cell, side, threshold, unsure(table))
            lists = table.column("grams").combine_chunks()
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sets = [flat[at[k] : at[k + 1]] for k in range(table.num_rows)]
            holds = np.zeros(len(i), dtype=bool)
            for k, (a, b) in enumerate(zip(i, j)):
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) * (1 - 1e-9):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    # In whole millionths, so that 4 of 5 is exactly 0.8.
                    holds[k] = common * 1_000_000 >= round(threshold * 1_000_000) * (len(x) + len(y) - common)
            yield tally(table.column("id"), i[holds], j[holds], table.column("copies").to_numpy(), hits[holds])

    return run


def _steps(threshold: float, grams_of: Callable[[DataFrame], DataFrame]):
    """Distance of members from the centre of their leader's group, in whole steps rounded up.

    The centre is the set of shingles that more than half of the group hold, which for edited
    copies is the text they derive from; it holds at most twice a member's mean.  Jaccard
    distance is a metric, so it bounds distances between members though no document may equal it.
    """

    def measure(pairs: DataFrame) -> DataFrame:
        sets = written(pairs.join(grams_of(pairs.select("id")), "id"), "jaccard-grouped")
        sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
        counts = sets.select("leader", F.explode("grams").alias("id")).groupBy("leader", "id").agg(
            F.count(F.lit(1)).alias("holders")
        )
        centres = beside(counts, sizes, "leader").where(F.col("holders") * 2 > F.col("members"))
        centres = centres.groupBy("leader").agg(F.collect_list("id").alias("centre"))
        both = beside(sets, centres, "leader").select(
            "id", F.size("grams").alias("x"), F.size("centre").alias("y"),
            F.size(F.array_intersect("grams", "centre")).cast("long").alias("common"),
        )
        every = F.col("x") + F.col("y") - F.col("common")
        part = every * (1_000_000 - round(threshold * 1_000_000))
        whole = (every - F.col("common")) * (STEPS * 1_000_000)
        q = F.when(whole <= part * STEPS, F.ceil(whole / F.greatest(part, F.lit(1)))).otherwise(STEPS + 1)
        return both.select("id", q.alias("q"))

    return measure


def class_links(
    signed: DataFrame, grams_of: Callable[[DataFrame], DataFrame], threshold: float = 0.8,
    *, recall: float = 0.999, limit: int = 256, runs: int = 8,
) -> DataFrame:
    """Links between classes, as ``tally`` gives them; ``signed``: id, copies, path, sketch, size (shingles).

    Pairs that their distances from a common leader show to be linked are counted without meeting.
    Any other pair is handled in the first of the buckets that both members share.  Pairs first meet as
    sketches; shingles are made, by ``grams_of``, only for ids that have a candidate, and travel
    only to the cells where they have one.  Runs that are added join the buckets of those before, and
    the leaders stay.  A class is one row with the list of its buckets until it is dealt to them, so
    that joins have a row per class, however many runs and buckets there are.
    """
    buckets, known, done = None, None, 0
    while True:
        more = written(_paths(signed, range(done, runs), threshold, limit).distinct(), "jaccard-buckets")
        buckets, done = more if buckets is None else buckets.unionByName(more), runs
        lists = buckets.groupBy("id").agg(F.collect_list(F.struct("key", "n", "room")).alias("places"))
        held = written(signed.select("id", "copies", "sketch").join(lists, "id"), "jaccard-held")
        if known is None:
            large = F.filter("places", lambda place: place["n"] > limit)
            known = spots(held.select("id", "copies", F.inline(large)), _steps(threshold, grams_of), limit)
        placed = held.withColumn("buckets", F.col("places.key")).join(known.select("id", "leader", "q"), "id", "left")
        cells = tiles(placed.select("*", F.inline("places")).drop("places"), None, limit)
        need = written(cells.mapInArrow(_needed(threshold), cells.schema), "jaccard-need")
        sets = written(grams_of(need.select("id").distinct()), "jaccard-sets")
        links = written(
            together(need.join(sets, "id")).mapInArrow(_verify(threshold), FOUND).unionByName(sure_links(known)),
            "jaccard-links",
        )
        each = links.where("b IS NULL").groupBy("a").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"))
        seen = each.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"), F.count(F.lit(1)).alias("n")).first()
        once, twice = seen["once"] or 0, seen["twice"] or 0
        unseen = once * max(once - 1, 0) / (2 * (twice + 1))
        if seen["n"] / 2 * (1 - recall) >= unseen * recall:
            return links
        if runs >= MOST_RUNS:
            raise RuntimeError(f"{runs} runs miss about {unseen:.3g} pairs of {seen['n']} linked classes")
        runs = min(2 * runs, MOST_RUNS)


def similar_groups(docs: DataFrame, threshold: float = 0.8, width: int = 5, **search) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``class_id``, ``copy_id``, ``n_links`` and ``kept``.

    ``class_id``: smallest doc_id reachable by links; ``copy_id``: smallest doc_id with an equal
    set; ``n_links``: other documents linked directly, equal ones included; ``kept``: this row
    stays if one row of every group does.
    """
    base = without(docs, *RESULT, "grams", "id", "row_", "words_")
    marked = written(base.withColumn("row_", F.monotonically_increasing_id()), "jaccard-docs")
    kind = "row_ bigint, id string, path array<int>, sketch array<bigint>, size int"
    # Shingles go straight into sketches: they would fill more disk than the texts.
    grams = with_shingles(marked.select("row_", "text"), width).select("row_", "grams")
    named = written(grams.mapInArrow(_sketches, kind), "jaccard-named")
    # Equal sets have equal names, so any one of them stands for the class.
    signed = written(
        named.groupBy("id").agg(
            F.count(F.lit(1)).alias("copies"), F.min("row_").alias("row_"),
            *[F.any_value(c).alias(c) for c in ("path", "sketch", "size")],
        ),
        "jaccard-signed",
    )

    def grams_of(ids: DataFrame) -> DataFrame:
        rows = signed.select("id", "row_").join(ids, "id")
        return with_shingles(marked.select("row_", "text").join(rows, "row_"), width).select("id", "grams")

    # A text without words is a class of its own, named by its row.
    name = F.coalesce("id", F.concat(F.lit("row-"), F.col("row_")))
    every = marked.select("row_", "doc_id").join(named.select("row_", "id"), "row_", "left").withColumn("id", name)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")
    every = written(every, "jaccard-names")
    classes = written(
        every.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first")), "jaccard-classes"
    )
    links = class_links(signed, grams_of, threshold, **search)
    reach = links.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("linked"))
    parts = components(links.where("b IS NOT NULL").select("a", "b"), "jaccard-components")
    whole = (
        classes.join(parts, "id", "left").join(reach, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    heads = whole.groupBy("root").agg(F.min("first").alias("head"))
    whole = whole.join(heads, "root").select("id", "copies", "linked", "first", "head")
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    found = every.select("row_", "id").join(whole, "id").select(
        "row_",
        F.col("head.doc_id").alias("class_id"),
        F.col("first.doc_id").alias("copy_id"),
        n_links.alias("n_links"),
        (F.col("row_") == F.col("head.row_")).alias("kept"),
    )
    return marked.join(found, "row_").select(*[F.col(f"`{c}`") for c in base.columns], *RESULT)
