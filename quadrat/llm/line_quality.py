"""Document quality from a linear-chain conditional random field over its lines.

Every line that is not blank is labelled good or bad.  Its features are shares of kinds of
characters and words, repetition, and hashed word shapes, of its own and of the lines before and
after it; the field adds weights for the labels of neighbouring lines.  Forward-backward sums give
each line's probability of being good, and their mean, weighted by length, becomes the document's
score by a logistic curve.

Only documents are labelled.  Lines first take their document's label; after each fit, lines of a bad
document that the field finds good become good, except the worst one, and the field is fitted again:
a bad document may hold good lines.

The fit is bounded by parameters: at most ``most_documents`` labelled rows of each label, by a hash of
the id, of which ``most_lines`` lines are taken at most (whole documents, in that order, of at most
``longest`` lines each), and
``most_calibration`` further rows for the curve.  Scoring reads whole texts.

Defined results: a text without a line (null, empty, blank) scores the smoothed rate of label 1 among
such calibration rows.  Without labelled rows of both kinds every score is the smoothed rate of label 1.
A doc_id labelled twice is bad if any label says so; one that repeats in ``documents`` teaches its
smallest text; null ids and labels teach nothing.  Repeated rows are scored alike.  Other columns pass
through; input columns named like a result column are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import add_columns, extended, slices, without, worker_copy, written

RESULT = ("quality", "is_good", "bad_lines")
EVIDENCE = "array<struct<line: int, good: double>>"

LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, POINT, SYMBOL = range(7)
KINDS = 7
#: The marks of plain sentences.
POINTS = ".,;:!?'\"()-’“”«»¿¡…"
SHAPES = 64
#: Upper ends of the value ranges of a share, in order.
RANGES = np.array([0.0, 0.02, 0.1, 0.25, 0.5, 0.8, 0.999])
MEASURES = 16
OWN = MEASURES * (len(RANGES) + 1)
FEATURES = 3 * OWN + SHAPES + 2

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point, made once per process."""
    if not _kinds:
        by = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}

        def kind(code: int) -> int:
            letter = chr(code)
            if letter.isspace():
                return SPACE
            if letter in POINTS:
                return POINT
            category = unicodedata.category(letter)
            return by.get(category, OTHER_LETTER if category[0] in "LM" else SYMBOL)

        _kinds.append(np.fromiter(map(kind, range(sys.maxunicode + 1)), dtype=np.uint8))
    return _kinds[0]


def _shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


@dataclass
class Lines:
    """Lines of several texts: range of each text, number of each line, length, measures, shapes."""

    first: np.ndarray  # lines of text t: first[t] to first[t + 1]
    number: np.ndarray
    length: np.ndarray
    ranges: np.ndarray  # line x measure: range of its value
    shapes: np.ndarray  # line x shape: share of the words

    def __len__(self) -> int:
        return len(self.length)

    @cached_property
    def own(self) -> np.ndarray:
        """Numbers of the own features that each line has."""
        return np.arange(MEASURES) * (len(RANGES) + 1) + self.ranges

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are the first and the last of their text."""
        heads, tails = np.zeros(len(self), dtype=bool), np.zeros(len(self), dtype=bool)
        some = self.first[1:] > self.first[:-1]
        heads[self.first[:-1][some]] = True
        tails[self.first[1:][some] - 1] = True
        return heads, tails


def measured(texts: list[str | None]) -> Lines:
    """Lines that hold something besides space, of all texts together."""
    none = np.zeros(0, np.int64)
    joined = "\n".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = np.nonzero(codes == 10)[0]
    line_start = np.concatenate([[0], breaks + 1])
    line_end = np.concatenate([breaks, [len(codes)]])
    text_lines = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
    text_of_line = np.repeat(np.arange(len(texts)), text_lines)
    number = np.arange(len(line_start)) - np.repeat(np.cumsum(text_lines) - text_lines, text_lines)
    kind = kinds()[codes]
    filled = kind != SPACE
    line_of = np.repeat(np.arange(len(line_start)), line_end - line_start + 1)[: len(codes)]
    by_kind = np.bincount(line_of * KINDS + kind, minlength=len(line_start) * KINDS).reshape(-1, KINDS)
    by_kind[:-1, SPACE] -= 1
    # Words: runs without space.
    start = filled.copy()
    start[1:] &= ~filled[:-1]
    starts = np.nonzero(start)[0]
    if not len(starts):
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        return Lines(first, none, none, np.zeros((0, MEASURES), np.int8), np.zeros((0, SHAPES), np.float32))
    last = filled.copy()
    last[:-1] &= ~filled[1:]
    ends = np.nonzero(last)[0]
    size = ends - starts + 1
    word_line = line_of[starts]
    inside = np.nonzero(filled)[0]
    word_of = np.repeat(np.arange(len(starts)), size)
    place = (np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    odd = (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    first_in = np.cumsum(size) - size
    name = np.add.reduceat((codes[inside].astype(np.uint64) + np.uint64(1)) * odd, first_in)
    # A shape is a word's runs of one kind of character: which kinds, in which order.
    run = np.ones(len(inside), dtype=bool)
    run[1:] = (kind[inside][1:] != kind[inside][:-1]) | (word_of[1:] != word_of[:-1])
    runs = np.nonzero(run)[0]
    run_word = word_of[runs]
    run_first = np.searchsorted(run_word, np.arange(len(starts)))
    run_place = (np.arange(len(runs)) - run_first[run_word]).astype(np.uint64)
    mixed = (kind[inside][runs].astype(np.uint64) + np.uint64(1)) * (
        (run_place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) | np.uint64(1)
    )
    shape = (np.add.reduceat(mixed, run_first) >> np.uint64(40)).astype(np.int64) % SHAPES
    n_lines = len(line_start)
    words = np.bincount(word_line, minlength=n_lines)

    def per_line(flag: np.ndarray) -> np.ndarray:
        return np.bincount(word_line[flag], minlength=n_lines)

    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & (word_line[1:] == word_line[:-1])
    order = np.lexsort((name, word_line))
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = (name[order][1:] == name[order][:-1]) & (word_line[order][1:] == word_line[order][:-1])
    letter = kind <= OTHER_LETTER
    has_letter = np.add.reduceat(letter[inside].astype(np.int64), first_in) > 0
    chars = by_kind.sum(axis=1) - by_kind[:, SPACE]
    letters = by_kind[:, : OTHER_LETTER + 1].sum(axis=1)
    # Lines that say the same as another line of their text.
    said = np.bincount(word_line, weights=(name >> np.uint64(12)).astype(np.float64), minlength=n_lines)
    by_text = np.lexsort((said, text_of_line))
    twin = np.zeros(n_lines, dtype=bool)
    equal = (said[by_text][1:] == said[by_text][:-1]) & (text_of_line[by_text][1:] == text_of_line[by_text][:-1])
    twin[by_text[1:][equal]] = True
    twin[by_text[:-1][equal]] = True
    kept = np.nonzero(words > 0)[0]
    first_word = np.searchsorted(word_line, kept)
    last_word = np.searchsorted(word_line, kept, side="right") - 1
    values = np.stack([
        _shares(letters, chars)[kept],
        _shares(by_kind[:, UPPER], letters)[kept],
        _shares(by_kind[:, DIGIT], chars)[kept],
        _shares(by_kind[:, POINT], chars)[kept],
        _shares(by_kind[:, SYMBOL], chars)[kept],
        _shares(per_line(same), words)[kept],
        _shares(per_line(again), words)[kept],
        _shares(per_line(~has_letter), words)[kept],
        _shares(per_line(kind[ends] == SYMBOL), words)[kept],
        _shares(per_line(kind[ends] == POINT), words)[kept],
        _shares(per_line(size == 1), words)[kept],
        _shares(per_line(size > 20), words)[kept],
        np.minimum(np.log2(words[kept]) / 10, 1),
        np.minimum(_shares(chars, words)[kept] / 16, 1),
        twin[kept] * 1.0,
        ((kind[starts[first_word]] == UPPER) * 0.3 + (kind[ends[last_word]] == POINT) * 0.6),
    ], axis=1)
    ranges = np.searchsorted(RANGES, values, side="left").astype(np.int8)
    shapes = np.bincount(word_line * SHAPES + shape, minlength=n_lines * SHAPES).reshape(-1, SHAPES)[kept]
    shapes = (shapes / words[kept][:, None]).astype(np.float32)
    first = np.searchsorted(text_of_line[kept], np.arange(len(texts) + 1)).astype(np.int64)
    return Lines(first, number[kept], chars[kept], ranges, shapes)


def potentials(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """What speaks for good over bad in each line: own, previous and next line, shapes, edges."""
    heads, tails = lines.edges
    # One look at the ranges serves the line itself and its two neighbours.
    three = weights[: 3 * OWN].reshape(3, OWN).T[lines.own].sum(axis=1)
    said = three[:, 0] + lines.shapes @ weights[3 * OWN : 3 * OWN + SHAPES].astype(lines.shapes.dtype)
    said[1:] += np.where(heads[1:], 0, three[:-1, 1])
    said[:-1] += np.where(tails[:-1], 0, three[1:, 2])
    return said + weights[-2] * heads + weights[-1] * tails


def _against(lines: Lines, error: np.ndarray) -> np.ndarray:
    """Sums of the features of all lines, each line weighted by ``error``."""
    heads, tails = lines.edges
    flat = lines.own.ravel()
    # A line's ranges count for itself, for the line after it and for the line before it.
    after, before = np.append(error[1:], 0), np.append(0, error[:-1])
    after[tails], before[heads] = 0, 0
    parts = [np.bincount(flat, weights=np.repeat(e, MEASURES), minlength=OWN) for e in (error, after, before)]
    shapes = error.astype(lines.shapes.dtype) @ lines.shapes
    return np.concatenate([*parts, shapes, [error[heads].sum(), error[tails].sum()]])


def marginals(lines: Lines, said: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good of every line, of every pair of neighbouring labels, and log of the sums.

    Label 1 is good, with potential ``said``; label 0 has none.  ``moves[a, b]`` is the potential of b
    after a.  All texts step together, one line at a time, the longest first.
    """
    counts = np.diff(lines.first)
    order = np.argsort(-counts, kind="stable")
    starts, counts = lines.first[:-1][order], counts[order]
    n = len(said)
    pairs = np.zeros((n, 2, 2))
    if not n:
        return np.zeros(0), pairs, 0.0
    longest = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    top = np.maximum(said, 0)
    emit = np.exp(np.stack([-top, said - top], axis=1))
    total = float(top.sum())
    step = np.exp(moves - moves.max())
    total += float(moves.max()) * int(np.maximum(counts - 1, 0).sum())
    ahead, scale = np.zeros((n, 2)), np.ones(n)
    for t in range(longest):
        at = starts[: active[t]] + t
        now = emit[at] if not t else (ahead[at - 1] @ step) * emit[at]
        scale[at] = now.sum(axis=1)
        ahead[at] = now / scale[at][:, None]
    total += float(np.log(scale).sum())
    back = np.ones((n, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        onward = back[at + 1] * emit[at + 1] / scale[at + 1][:, None]
        back[at] = onward @ step.T
        pairs[at + 1] = ahead[at][:, :, None] * step[None] * onward[:, None, :]
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs, total


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float
    empty: float  # score of a text without a line
    fitted: bool = True

    def lines(self, texts: list[str | None]) -> tuple[Lines, np.ndarray]:
        lines = measured(texts)
        return lines, marginals(lines, potentials(lines, self.weights), self.moves)[0]

    def score(self, lines: Lines, good: np.ndarray) -> np.ndarray:
        share, some = shares(lines, good)
        return np.where(some, 1 / (1 + np.exp(-(self.slope * share + self.shift))), self.empty)


def shares(lines: Lines, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the lines' probabilities by text, weighted by length; and which texts have lines."""
    owner = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    n = len(lines.first) - 1
    length = np.bincount(owner, weights=lines.length, minlength=n)
    return np.bincount(owner, weights=lines.length * good, minlength=n) / np.maximum(length, 1), length > 0


def train(lines: Lines, labels: np.ndarray, *, passes: int = 3, steps: int = 50, pull: float = 1e-3):
    """Weights and moves by gradient steps with momentum of their own per weight; see the module."""
    owner = np.repeat(np.arange(len(labels)), np.diff(lines.first))
    goal = labels[owner].astype(float)
    weights, moves = np.zeros(FEATURES), np.zeros((2, 2))
    linked = ~lines.edges[0]
    # Both labels weigh the same.
    share = np.array([0.5 / max((labels == v).sum(), 1) for v in (0, 1)])
    weigh = share[labels[owner]] / np.maximum(np.diff(lines.first)[owner], 1)
    for n in range(passes):
        mean, spread = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, steps + 1):
            good, pairs, _ = marginals(lines, potentials(lines, weights), moves)
            slope = _against(lines, (goal - good) * weigh) - pull * weights
            seen = np.zeros((2, 2))
            want, at = goal.astype(int), np.nonzero(linked)[0]
            np.add.at(seen, (want[at - 1], want[at]), weigh[at])
            seen -= np.einsum("i,ijk->jk", weigh[at], pairs[at])
            both = np.concatenate([slope, (seen - pull * moves).ravel()])
            mean, spread = 0.9 * mean + 0.1 * both, 0.99 * spread + 0.01 * both * both
            move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
            weights, moves = weights + move[:-4], moves + move[-4:].reshape(2, 2)
        if n + 1 < passes:
            good = marginals(lines, potentials(lines, weights), moves)[0]
            goal = np.where(labels[owner] == 1, 1.0, (good > 0.5).astype(float))
            worst = np.lexsort((good, owner))
            head = np.ones(len(worst), dtype=bool)
            head[1:] = owner[worst][1:] != owner[worst][:-1]
            head = worst[head]
            goal[head[labels[owner[head]] == 0]] = 0.0
    return weights, moves


def curve(share: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve; smoothed targets keep a clean split finite."""
    positive, negative = labels.sum(), (1 - labels).sum()
    goal = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    start = beta = np.array([8.0, -4.0])
    design = np.stack([share, np.ones(len(share))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (goal - p) - 0.05 * (beta - start)
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (8.0, -4.0)


SAMPLE = "doc_id bigint, quality int, role string, dice bigint, length binary, ranges binary, shapes binary"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures of the sample's lines, as bytes."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            lines = measured(batch.column("text").to_pylist())
            parts = [
                pa.array([x[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])], pa.binary())
                for x in (lines.length.astype("<i8"), lines.ranges, lines.shapes)
            ]
            names = ("doc_id", "quality", "role", "dice")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *parts], names=[*names, "length", "ranges", "shapes"]
            )


def _collected(rows) -> tuple[Lines, np.ndarray]:
    length = np.frombuffer(b"".join(r["length"] for r in rows), dtype="<i8")
    ranges = np.frombuffer(b"".join(r["ranges"] for r in rows), dtype=np.int8).reshape(-1, MEASURES)
    shapes = np.frombuffer(b"".join(r["shapes"] for r in rows), dtype=np.float32).reshape(-1, SHAPES)
    first = np.concatenate([[0], np.cumsum([len(r["length"]) // 8 for r in rows])]).astype(np.int64)
    labels = np.array([r["quality"] for r in rows], dtype=np.int64)
    return Lines(first, np.zeros(len(length), np.int64), length, ranges, shapes), labels


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    *,
    most_documents: int = 2000,
    most_lines: int = 60_000,
    most_calibration: int = 2000,
    longest: int = 400,
) -> Model:
    """Learn from the labelled rows (``labels``: doc_id, quality) where ``learn`` holds for doc_id.

    Rows of more than ``longest`` lines are passed over in the fit of the field.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(F.lit(True) if learn is None else learn)
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .withColumn("dice", F.xxhash64("doc_id", F.lit("line-quality")))
        .withColumn("role", F.when(F.pmod("dice", F.lit(4)) == 0, "curve").otherwise("field"))
    )
    known = written(known, "quality-known")

    def first(rows: DataFrame, most: int) -> DataFrame:
        return rows.orderBy("dice", "doc_id").limit(most)

    sample = first(known.where("role = 'curve'"), most_calibration)
    for value in (0, 1):
        sample = sample.unionByName(first(known.where(f"role = 'field' AND quality = {value}"), most_documents))
    sample = written(sample, "quality-sample")
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality", "role", "dice").agg(F.min("text").alias("text"))
    held = written(texts.mapInArrow(_sampled, SAMPLE), "quality-lines")
    sizes = held.select("doc_id", "role", "quality", "dice", (F.length("length") / 8).cast("long").alias("lines"))
    listed = sorted(sizes.collect(), key=lambda r: (r["role"], r["dice"], r["doc_id"]))
    chosen, count = [], {}
    for row in listed:
        share = (row["role"], row["quality"] if row["role"] == "field" else None)
        if row["role"] == "field" and row["lines"] > longest:
            continue
        count[share] = count.get(share, 0) + row["lines"]
        if count[share] <= (most_lines // 2 if row["role"] == "field" else most_lines):
            chosen.append((row["doc_id"],))
    ids = documents.sparkSession.createDataFrame(chosen, "doc_id bigint")
    rows = held.join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (r["dice"], r["doc_id"]))
    lines, marked = _collected([r for r in rows if r["role"] == "field"])
    tested, truth = _collected([r for r in rows if r["role"] == "curve"])
    every = np.concatenate([marked, truth])
    rate = (every.sum() + 0.5) / (len(every) + 1)
    if len(np.unique(marked)) < 2 or not len(lines):
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 0.0, float(rate), fitted=False)
    weights, moves = train(lines, marked)
    share, some = shares(tested, marginals(tested, potentials(tested, weights), moves)[0])
    empty = (truth[~some].sum() + rate) / ((~some).sum() + 1)
    slope, shift = curve(share[some], truth[some]) if some.any() else (8.0, -4.0)
    return Model(weights, moves, slope, shift, float(empty))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``quality`` (0 to 1), ``is_good`` (from 0.7) and ``bad_lines`` with their probability of good."""
    documents = without(documents, *RESULT)
    kind = T._parse_datatype_string(EVIDENCE)
    schema = extended(documents, (RESULT[0], T.DoubleType()), (RESULT[1], T.IntegerType()), (RESULT[2], kind))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    item = pa.struct([("line", pa.int32()), ("good", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_copy(key, lambda: shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                lines, good = model.lines(batch.column("text").to_pylist())
                if model.fitted:
                    found = model.score(lines, good)
                else:
                    found = np.full(batch.num_rows, model.empty)
                bad = np.nonzero((good < 0.5) & model.fitted)[0]
                ends = np.searchsorted(bad, lines.first).astype(np.int32)
                rows = pa.StructArray.from_arrays(
                    [pa.array(lines.number[bad].astype(np.int32)), pa.array(good[bad])], fields=list(item)
                )
                yield add_columns(
                    batch, quality=pa.array(found), is_good=pa.array((found >= 0.7).astype(np.int32)),
                    bad_lines=pa.ListArray.from_arrays(pa.array(ends), rows),
                )

    return documents.mapInArrow(run, schema)
