"""Toxicity of whole texts from their nearest labelled examples, with evidence.

Examples are a bounded sample of labelled rows, toxic and clean.  They are TF-IDF vectors in two
inverted indexes, whose blocks store the largest weight of each term:

* the words of the whole text, every word of every example.  Examples of cosine ``NEAR`` or more are
  found: copies and close variants.  In a text's norm a word that no example has weighs as one that a
  single text has.
* the terms that tell of abuse: words and five-letter pieces of words (edges marked) that the sample
  associates with the label, by chi-squared.  The k nearest examples are found.

Document frequencies are counted over all documents.  Both searches are exact: only blocks whose bound
lies below the k-th best are skipped, and only examples whose part under a text's rarest words shows
that the other words cannot lift them to ``NEAR``.  The documents are read once to find the examples,
once to count and once to score; nothing as long as they are is written.  The votes of all examples found, weighted by
distance, become a probability by a logistic curve fitted on labelled rows outside the index.  (The
whole words alone tell abuse from other text poorly: held-out area 0.87 on sf0.1, since few of a
text's words are abusive.)

Defined results: a text without any kept term and without a close example (null and empty
ones included) has no neighbours and scores the smoothed rate of the label among such labelled rows; ties in
similarity go to the example with the smaller doc_id; without labelled rows of both
kinds every score is the smoothed overall rate.  Repeated rows are scored alike.  A doc_id
labelled twice is toxic if any label says so, one that repeats in the documents is one example, its
smallest text; null ids and labels teach nothing.  Other
columns pass through; input columns named like a result column are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import add_columns, extended, slices, without, worker_copy, written

PIECE = 5
BLOCK = 64
#: Cosine of whole texts from which an example is close.
NEAR = 0.5
#: Bytes of text and letters of words read at a time, and rows that meet all examples at a time.
BYTES_AT_ONCE = 4 << 20
LETTERS_AT_ONCE = 1 << 20
ROWS_MET = 128
#: Rows scored at a time, and bytes of results that a task keeps for equal texts.
ROWS_AT_ONCE = 2000
MOST_KNOWN = 64 << 20
RESULT = ("toxicity", "is_toxic", "neighbours", "matched")
EVIDENCE = "array<struct<doc_id: bigint, similarity: double, toxic: int>>"


def word_of(chunk: str) -> str:
    """Letters of one white-space delimited chunk, in lower case."""
    return (chunk if chunk.isalpha() else "".join(filter(str.isalpha, chunk))).lower()


def terms_of(chunk: str) -> set[str]:
    """Terms of one white-space delimited chunk; ``=`` marks a whole word."""
    word = word_of(chunk)
    if not word:
        return set()
    edged = f"^{word}$"
    return {"=" + word, *[edged[i : i + PIECE] for i in range(len(edged) - PIECE + 1)]}


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


@dataclass
class Postings:
    """Block-max inverted index over example vectors.

    An entry is a term's part of a block of examples, with its largest weight.
    """

    idf: np.ndarray
    examples: int
    first: np.ndarray  # entries of term t: first[t] to first[t + 1]
    block: np.ndarray
    most: np.ndarray
    start: np.ndarray  # postings of entry e: start[e] to start[e + 1]
    example: np.ndarray
    weight: np.ndarray
    ends: np.ndarray  # vector of example x: ends[x] to ends[x + 1] of the next two
    term_of: np.ndarray
    weight_of: np.ndarray

    @classmethod
    def of(cls, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Postings:
        """Index of vectors (terms, weights)."""
        ends = np.cumsum([0, *[len(t) for t, _ in vectors]])
        term = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in vectors]])
        return cls.of_flat(idf, ends, term, np.concatenate([np.zeros(0), *[w for _, w in vectors]]))

    @classmethod
    def of_flat(cls, idf: np.ndarray, ends: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Postings:
        """Index of the vectors that lie one after another; vector x from ends[x] to ends[x + 1]."""
        count = len(ends) - 1
        term_of, weight_of = term.astype(np.int32), weight
        order = np.argsort(term_of, kind="stable")
        term, weight = term_of[order], weight[order]
        example = np.repeat(np.arange(count, dtype=np.int32), np.diff(ends))[order]
        block = example // BLOCK
        new = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.nonzero(np.concatenate([[True], new]))[0] if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
        first = np.searchsorted(term[at], np.arange(len(idf) + 1))
        return cls(
            idf, count, first, block[at], most, np.append(at, len(term)), example, weight, ends, term_of, weight_of,
        )

    def raw(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[terms]

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, floor: float = 0.0):
        """Every example whose cosine reaches the k-th best and ``floor``; and their cosines."""
        if floor > 0:
            found, similarity = next(self.close(np.array([0, len(terms)]), terms, q, floor))
            kth = np.partition(similarity, -k)[-k] if len(found) > k else 0.0
            best = similarity >= kth * (1 - 1e-9)
            return found[best], similarity[best]
        entries, of = self._entries(terms)
        bound = np.bincount(self.block[entries], weights=self.most[entries] * q[of], minlength=1)
        blocks = np.nonzero(bound > 0)[0]
        if not len(blocks):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        blocks = blocks[np.argsort(-bound[blocks], kind="stable")]
        few = -(-k // BLOCK) + 3
        best = self._scores(entries, q[of], blocks[:few])
        kth = np.partition(best, -k)[-k] if len(best) > k else 0.0
        # The bound holds up to rounding.
        others = blocks[few:][bound[blocks[few:]] >= kth * (1 - 1e-9)]
        if len(others):
            best += self._scores(entries, q[of], others)
            kth = np.partition(best, -k)[-k] if len(best) > k else 0.0
        found = np.nonzero((best > 0) & (best >= kth * (1 - 1e-9)))[0]
        return found, np.minimum(best[found], 1.0)

    def close(self, ends: np.ndarray, terms: np.ndarray, q: np.ndarray, floor: float):
        """For each vector, from ends[i] to ends[i + 1], every example of cosine ``floor``; and the cosines.

        Terms that no other of a vector is rarer than come first.  Once those left have together a
        norm under a share of ``floor``, an example needs the rest of it from the terms before.
        """
        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        share = 0.7 * floor
        held = self.start[self.first[terms + 1]] - self.start[self.first[terms]]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.argsort(row * (self.examples + 1) + held, kind="stable")
        rare, size = terms[order], held[order]
        sums = np.concatenate([[0.0], np.cumsum(q[order] ** 2)])
        # Sums of squares from each term to the end of its vector.
        ahead = (sums[ends[1:]][row] - sums[:-1] >= (share * (1 - 1e-6)) ** 2) & (size > 0)
        row, rare, size, ahead_q = row[ahead], rare[ahead], size[ahead], q[order][ahead]
        scratch = np.zeros(len(self.idf))
        for low in range(0, len(ends) - 1, ROWS_MET):
            high = min(low + ROWS_MET, len(ends) - 1)
            a, b = np.searchsorted(row, [low, high])
            at = _spans(self.start[self.first[rare[a:b]]], size[a:b])
            name = np.repeat((row[a:b] - low) * self.examples, size[a:b]) + self.example[at]
            part = np.bincount(name, weights=self.weight[at] * np.repeat(ahead_q[a:b], size[a:b]),
                               minlength=(high - low) * self.examples)
            hits = np.nonzero(part >= floor - share - 1e-6)[0]
            stops = np.searchsorted(hits, np.arange(high - low + 1) * self.examples)
            for i in range(high - low):
                if stops[i] == stops[i + 1]:
                    yield none
                    continue
                found = hits[stops[i] : stops[i + 1]] - i * self.examples
                own = slice(ends[low + i], ends[low + i + 1])
                scratch[terms[own]] = q[own]
                length = self.ends[found + 1] - self.ends[found]
                at = _spans(self.ends[found], length)
                cosine = np.add.reduceat(self.weight_of[at] * scratch[self.term_of[at]], np.cumsum(length) - length)
                scratch[terms[own]] = 0
                enough = cosine >= floor * (1 - 1e-9)
                yield found[enough], np.minimum(cosine[enough], 1.0)

    def _entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.first[terms + 1] - self.first[terms]
        return _spans(self.first[terms], size), np.repeat(np.arange(len(terms)), size)

    def _scores(self, entries: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        wanted = np.zeros(int(self.examples) // BLOCK + 1, dtype=bool)
        wanted[blocks] = True
        hit = wanted[self.block[entries]]
        entries, q = entries[hit], q[hit]
        size = self.start[entries + 1] - self.start[entries]
        at = _spans(self.start[entries], size)
        return np.bincount(self.example[at], weights=self.weight[at] * np.repeat(q, size), minlength=self.examples)


@dataclass
class Index:
    """Both indexes over the examples, and the calibration."""

    terms: list[str]
    words: list[str]
    ids: np.ndarray
    labels: np.ndarray
    abuse: Postings
    whole: Postings
    unseen: float  # idf of a word that no example has
    k: int
    slope: float
    shift: float
    silent: float  # score of a text without neighbours

    def _best(self, found: np.ndarray, similarity: np.ndarray):
        """The k most similar, best first; ties to the smaller id."""
        order = np.lexsort((self.ids[found], -np.round(similarity, 12)))[: self.k]
        return found[order], similarity[order]

    def by_terms(self, terms: np.ndarray, counts: np.ndarray):
        """The k nearest examples by the terms of abuse, and their cosines."""
        raw = self.abuse.raw(terms, counts)
        norm = np.sqrt((raw * raw).sum())
        return self._best(*self.abuse.nearest(terms, raw / norm if norm > 0 else raw, self.k))

    def by_words(self, ends: np.ndarray, words: np.ndarray, counts: np.ndarray, other: np.ndarray):
        """Close examples of each whole text, at most k; ``other`` is the square of the unseen words."""
        raw = self.whole.raw(words, counts)
        sums = np.concatenate([[0.0], np.cumsum(raw * raw)])
        norm = np.sqrt(sums[ends[1:]] - sums[ends[:-1]] + other * self.unseen**2)
        q = raw / np.repeat(norm, np.diff(ends))
        for found in self.whole.close(ends, words, q, NEAR):
            yield self._best(*found) if len(found[0]) else found

    def vote(self, found: np.ndarray, similarity: np.ndarray) -> float:
        """Share of toxic votes; a vote weighs the inverse of its distance."""
        w = 1.0 / (1.05 - similarity)
        return float((w * self.labels[found]).sum() / w.sum())

    def score(self, found: np.ndarray, similarity: np.ndarray) -> float:
        if not len(found):
            return self.silent
        x = self.slope * self.vote(found, similarity) + self.shift
        return float(1 / (1 + np.exp(-x)))


def joined(close, near):
    """Close examples first, then the others found by terms."""
    if not len(close[0]):
        return near
    fresh = ~np.isin(near[0], close[0])
    return np.concatenate([close[0], near[0][fresh]]), np.concatenate([close[1], near[1][fresh]])


@dataclass
class Read:
    """Kept terms and known words of some texts: those of text i from ends[i] to ends[i + 1]."""

    term_ends: np.ndarray
    terms: np.ndarray
    term_counts: np.ndarray
    word_ends: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    other: np.ndarray  # the unseen words' squared weight without idf


def _counted(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each distinct pair, ascending."""
    name, counts = np.unique(row * codes + code, return_counts=True)
    return name // codes, name % codes, counts


def _summed(row: np.ndarray, code: np.ndarray, n: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and sum of ``n`` of each distinct pair, ascending."""
    name, at = np.unique(row * codes + code, return_inverse=True)
    return name // codes, name % codes, np.bincount(at, weights=n, minlength=len(name)).astype(np.int64)


def _windows(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """For stretches of ``text``, where they begin and a number under 2 ** 20 of each run of ``PIECE`` letters."""
    for low in range(0, len(text) - PIECE + 1, LETTERS_AT_ONCE):
        part = text[low : low + LETTERS_AT_ONCE + PIECE - 1]
        letters = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        n = len(letters) - PIECE + 1
        mixed = letters[:n].astype(np.uint64)
        for i in range(1, PIECE):
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += letters[i : i + n]
        yield low, (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


class _Reader:
    """Kept terms and known words of batches of texts, from the distinct words of a batch."""

    def __init__(self, terms: list[str], words: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.words = pa.array(words, pa.large_string())
        self.whole = pa.array([t[1:] if t[0] == "=" else None for t in terms], pa.large_string())
        # Most runs of letters are no kept term: one look at this table tells.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        for term in terms:
            for _, number in _windows(term):
                self.maybe[number] = True

    def _held(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word and kept term of each distinct such pair, ascending."""
        whole = pc.index_in(words, value_set=self.whole, skip_nulls=True)
        at = np.nonzero(whole.is_valid().to_numpy(zero_copy_only=False))[0]
        pairs = set(zip(at.tolist(), whole.drop_null().to_pylist()))
        text = f"^{'$^'.join(words.to_pylist())}$"
        starts = np.cumsum(pc.utf8_length(words).to_numpy() + 2)
        for low, numbers in _windows(text):
            at = low + np.nonzero(self.maybe[numbers])[0]
            for i, n in zip(at.tolist(), np.searchsorted(starts, at, side="right").tolist()):
                code = self.terms.get(text[i : i + PIECE])
                if code is not None:
                    pairs.add((n, code))
        made = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return made[:, 0], made[:, 1]

    def read(self, texts: pa.Array) -> Read:
        lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        chunks = lists.flatten().dictionary_encode()
        made = [c.lower() if c.isalpha() else word_of(c) for c in chunks.dictionary.to_pylist()]
        found = pa.array([w or None for w in made], pa.large_string()).dictionary_encode()
        # A token's word; those without letters go.
        words = found.indices.fill_null(-1).to_numpy()[chunks.indices.to_numpy()]
        row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        row, words = row[words >= 0], words[words >= 0]
        row, words, counts = _counted(row, words, len(found.dictionary) + 1)
        rows = np.arange(len(texts) + 1)

        of, terms = self._held(found.dictionary)
        size = np.bincount(of, minlength=len(found.dictionary))
        some = np.nonzero(size[words])[0]
        held = size[words[some]]
        at = _spans((np.cumsum(size) - size)[words[some]], held)
        of_term, terms, term_counts = _summed(
            np.repeat(row[some], held), terms[at], np.repeat(counts[some], held), len(self.terms) + 1
        )

        known = pc.index_in(found.dictionary, value_set=self.words).fill_null(-1).to_numpy()
        codes = known[words]
        seen = codes >= 0
        weight = 1 + np.log(counts[~seen])
        other = np.bincount(row[~seen], weights=weight * weight, minlength=len(texts))
        of_word, codes, counts = row[seen], codes[seen].astype(np.int64), counts[seen]
        order = np.argsort(of_word * len(self.words) + codes)
        return Read(
            np.searchsorted(of_term, rows), terms, term_counts,
            np.searchsorted(of_word, rows), codes[order], counts[order], other,
        )


def _selection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a term, counted per task."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for whole in batches:
        for batch in slices(whole, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held: set[str] = set()
                for chunk in set((text or "").split()):
                    held |= terms_of(chunk)
                counts[toxic].update(held)
    for toxic, counter in enumerate(counts):
        names = list(counter)
        for start in range(0, len(names), 100_000):
            part = names[start : start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.string()),
                    pa.array(np.full(len(part), toxic, dtype=np.int32)),
                    pa.array([counter[n] for n in part], pa.int64()),
                ],
                names=["term", "toxic", "n"],
            )


def chosen_terms(examples: DataFrame, sizes: dict[int, int], most_terms: int, least: float) -> list[str]:
    """Terms by chi-squared against the label, at least ``least``, in three texts or more."""
    counted = examples.select("text", "toxic").mapInArrow(_selection, "term string, toxic int, n bigint")
    n1, n0 = float(sizes[1]), float(sizes[0])
    # Only terms commoner among toxic texts: the others tell of topics, not of abuse.
    tally = counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
    )
    gap = F.col("a") * (n0 - F.col("b")) - F.col("b") * (n1 - F.col("a"))
    spread = (F.col("a") + F.col("b")) * (n0 + n1 - F.col("a") - F.col("b")) * n0 * n1
    chi = gap * gap * (n0 + n1) / spread
    best = (
        tally.where(F.col("a") + F.col("b") >= 3)
        .where((F.col("a") / n1 > F.col("b") / n0) & (F.col("a") + F.col("b") < n0 + n1))
        .withColumn("chi", chi)
        .where(F.col("chi") >= least)
        .orderBy(F.desc("chi"), "term")
        .limit(most_terms)
    )
    return sorted(row["term"] for row in best.select("term").collect())


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            held = {c for text in batch.column("text").to_pylist() for c in set((text or "").split())}
            yield pa.RecordBatch.from_arrays([pa.array({word_of(c) for c in held} - {""}, pa.string())], names=["word"])


def _frequencies(shared, key: str):
    """In how many texts of the task each kept term (kind 0) and known word (kind 1) is, and all its texts (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, words = shared.value
        reader = worker_copy(key, lambda: _Reader(terms, words))
        found = [np.zeros(len(terms), np.int64), np.zeros(len(words), np.int64), np.zeros(1, np.int64)]
        for whole in batches:
            for batch in slices(whole, "text", BYTES_AT_ONCE):
                read = reader.read(batch.column("text"))
                for kind, codes in enumerate((read.terms, read.words, np.zeros(batch.num_rows, np.int64))):
                    found[kind] += np.bincount(codes, minlength=len(found[kind]))
        for kind, counts in enumerate(found):
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at, pa.int32()), pa.array(counts[at])],
                names=["kind", "t", "n"],
            )

    return run


def _totals(partial: DataFrame, *sizes: int) -> list[np.ndarray]:
    """Document frequencies of each kind from the counts of the tasks."""
    rows = partial.groupBy("kind", "t").agg(F.sum("n").alias("n")).toArrow()
    kind, t, n = (rows[c].to_numpy() for c in ("kind", "t", "n"))
    made = [np.zeros(size) for size in sizes]
    for i, df in enumerate(made):
        df[t[kind == i]] = n[kind == i]
    return made


PAIRS = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def _with_pairs(rows: DataFrame, shared, key: str) -> DataFrame:
    """Kept ``terms`` and known ``words`` of each text with their counts, instead of the text."""

    def pairs(ends: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.Array:
        both = pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.array(counts, pa.int32())], names=["t", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = worker_copy(key, lambda: _Reader(*shared.value))
        for whole in batches:
            for batch in slices(whole, "text", BYTES_AT_ONCE):
                read = reader.read(batch.column("text"))
                yield add_columns(
                    batch.select([c for c in batch.schema.names if c != "text"]),
                    terms=pairs(read.term_ends, read.terms, read.term_counts),
                    words=pairs(read.word_ends, read.words, read.word_counts),
                )

    return rows.mapInArrow(run, extended(rows.drop("text"), ("terms", PAIRS), ("words", PAIRS)))


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + df)) + 1e-3


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, codes and counts of the rows of a list column."""
    lists = lists.combine_chunks()
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, flat.field("t").to_numpy(), flat.field("n").to_numpy()


def _vectors(idf: np.ndarray, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Postings:
    raw = (1 + np.log(counts)) * idf[codes]
    sums = np.concatenate([[0.0], np.cumsum(raw * raw)])
    norm = np.sqrt(sums[ends[1:]] - sums[ends[:-1]])
    return Postings.of_flat(idf, ends, codes, raw / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(ends)))


def _strongest(idf: np.ndarray, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The term of largest weight of each row; texts without terms come last."""
    weight = (1 + np.log(counts)) * idf[codes]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    best = np.full(len(ends) - 1, len(idf))
    order = np.lexsort((-np.arange(len(codes)), weight, row))
    best[row[order]] = codes[order]  # the last of a row, its largest, stays
    return best


def _votes(index: Index, read: Read, held: dict):
    """Examples found and their cosines for each row; ``held`` keeps those of equal terms."""
    close = index.by_words(read.word_ends, read.words, read.word_counts, read.other)
    t, n = read.terms.astype(np.int32), read.term_counts.astype(np.int32)
    for i, near in enumerate(close):
        a, b = read.term_ends[i], read.term_ends[i + 1]
        key = t[a:b].tobytes() + n[a:b].tobytes()
        if key not in held:
            if held.get(None, 0) > MOST_KNOWN:
                held.clear()
            held[key] = index.by_terms(t[a:b].astype(np.int64), n[a:b].astype(float))
            # About what an entry and its objects take besides the numbers.
            held[None] = held.get(None, 0) + len(key) + 16 * len(held[key][0]) + 600
        yield joined(near, held[key])


def _calibrate(index: Index, rows: DataFrame, key: str) -> None:
    """Logistic curve of the votes, and the rate among rows without neighbours, from (text, toxic)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        reader = worker_copy(key, lambda: _Reader(index.terms, index.words))
        for whole in batches:
            for batch in slices(whole, "text", BYTES_AT_ONCE):
                found = _votes(index, reader.read(batch.column("text")), {})
                votes = [index.vote(*x) if len(x[0]) else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("toxic"), pa.array(votes, pa.float64())],
                    names=["doc_id", "toxic", "vote"],
                )

    made = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, vote double").collect()
    shared.destroy()
    made.sort(key=lambda r: r["doc_id"])
    silent = [1.0, *[r["toxic"] for r in made if r["vote"] is None]]
    index.silent = (sum(silent) - 0.5) / (len(silent) + 1)
    v = np.array([r["vote"] for r in made if r["vote"] is not None])
    y = np.array([r["toxic"] for r in made if r["vote"] is not None], dtype=float)
    if not len(v):
        return
    # Smoothed targets and a weak pull to the default keep a small sample from overfitting.
    positive, negative = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    start = beta = np.array([8.0, -4.0])
    design = np.stack([v, np.ones(len(v))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (goal - p) - 0.05 * (beta - start)
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    if beta[0] > 0:
        index.slope, index.shift = float(beta[0]), float(beta[1])


def fit_and_mark(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    *,
    k: int = 15,
    most_examples: int = 6000,
    most_calibration: int = 4000,
    most_terms: int = 4096,
    least_chi: float = 24.0,
) -> tuple[Index, DataFrame]:
    """The index, and ``documents`` as ``vote`` takes them.

    Learns only from labelled rows (``labels``: doc_id, toxic) where ``learn``, a condition on
    doc_id, holds.  The sample is bounded: of four labelled rows three may become examples,
    at most half of ``most_examples`` of each label, and the fourth may calibrate, at most
    ``most_calibration``, each by a hash of doc_id.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.lit(True) if learn is None else learn)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("dice", F.xxhash64("doc_id", F.lit("role")))
    )
    teaches = F.pmod("dice", F.lit(4)) != 0

    def some(rows: DataFrame, role: str, group: str, most: int) -> DataFrame:
        # A literal limit lets tasks drop the others before the shuffle.
        place = F.row_number().over(W.partitionBy(group).orderBy("dice", "doc_id"))
        rows = rows.withColumn("role", F.lit(role)).withColumn("all", F.lit(0)).withColumn("place", place)
        return rows.where(F.col("place") <= F.lit(most)).select("doc_id", "toxic", "role")

    # Calibration rows keep the natural share of the label, examples are balanced.
    sample = some(known.where(teaches), "index", "toxic", most_examples // 2).unionByName(
        some(known.where(~teaches), "calibrate", "all", most_calibration)
    )
    sample = written(sample, "toxicity-sample")
    # A doc_id that repeats in ``documents`` is one example.
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    texts = written(texts.groupBy("doc_id", "toxic", "role").agg(F.min("text").alias("text")), "toxicity-examples")
    parallel = 2 * documents.sparkSession.sparkContext.defaultParallelism
    examples = texts.where("role = 'index'").repartition(parallel, "doc_id")
    sizes = {row["toxic"]: row["count"] for row in examples.groupBy("toxic").count().collect()}
    terms = chosen_terms(examples, sizes, most_terms, least_chi) if len(sizes) == 2 else []
    found = examples.select("text").mapInArrow(_distinct_words, "word string").distinct().toArrow()["word"]
    words = sorted(found.to_pylist())
    shared, key = documents.sparkSession.sparkContext.broadcast((terms, words)), uuid.uuid4().hex

    marked = without(documents, *RESULT, "terms")
    counted = marked.select("text").mapInArrow(_frequencies(shared, key), "kind int, t int, n bigint")
    df, word_df, docs = _totals(counted, len(terms), len(words), 1)
    n_docs = int(docs[0])
    idf, word_idf = _idf(df, n_docs), _idf(word_df, n_docs)

    rows = _with_pairs(examples.select("doc_id", "toxic", "text"), shared, key).toArrow()
    ids, labels = (rows[c].to_numpy() for c in ("doc_id", "toxic"))
    # Examples alike in their strongest terms share blocks.
    order = np.lexsort((ids, labels, _strongest(idf, *_flat(rows["terms"]))))
    rows = rows.take(order)
    index = Index(
        terms, words, ids[order], labels[order].astype(float),
        _vectors(idf, *_flat(rows["terms"])), _vectors(word_idf, *_flat(rows["words"])),
        float(_idf(np.ones(1), n_docs)[0]), k, 8.0, -4.0, 0.0,
    )
    _calibrate(index, texts.where("role = 'calibrate'").repartition(parallel, "doc_id"), key)
    return index, marked


def vote(marked: DataFrame, index: Index) -> DataFrame:
    """Add ``toxicity`` (0 to 1), ``is_toxic`` (from 0.5), ``neighbours`` and ``matched`` terms."""
    shared, name = marked.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex
    result = dict(zip(RESULT, ("double", "int", EVIDENCE, "array<string>")))
    fields = [(n, T._parse_datatype_string(t)) for n, t in result.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        reader = worker_copy(name, lambda: _Reader(index.terms, index.words))
        words, labels = pa.array(index.terms, pa.string()), index.labels.astype(np.int32)
        held: dict = {}
        for whole in batches:
            parts = slices(whole, "text", BYTES_AT_ONCE)
            for batch in (p.slice(i, ROWS_AT_ONCE) for p in parts for i in range(0, p.num_rows, ROWS_AT_ONCE)):
                read = reader.read(batch.column("text"))
                near = list(_votes(index, read, held))
                scores = [index.score(*x) for x in near]
                found = np.concatenate([f for f, _ in near]).astype(np.int64)
                similar = np.concatenate([x for _, x in near])
                stops = np.concatenate([[0], np.cumsum([len(f) for f, _ in near])]).astype(np.int32)
                evidence = pa.StructArray.from_arrays(
                    [pa.array(index.ids[found], pa.int64()), pa.array(similar, pa.float64()), pa.array(labels[found])],
                    names=["doc_id", "similarity", "toxic"],
                )
                matched = pa.ListArray.from_arrays(pa.array(read.term_ends, pa.int32()), words.take(pa.array(read.terms)))
                yield add_columns(
                    batch,
                    toxicity=pa.array(scores, pa.float64()),
                    is_toxic=pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    neighbours=pa.ListArray.from_arrays(pa.array(stops), evidence), matched=matched,
                )

    return marked.mapInArrow(run, extended(marked, *fields))


def score(documents: DataFrame, labels: DataFrame, learn: Column | None = None, **fit) -> DataFrame:
    """Toxicity of every row of ``documents``; see the module for the defined results."""
    index, marked = fit_and_mark(documents, labels, learn, **fit)
    return vote(marked, index)
