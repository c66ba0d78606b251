"""Language identification of whole texts, with spans of mixed-language text.

Each white-space delimited word gets one score per language: the log-probability of
its letter trigrams (word edges included) under that language.  The script of a word
narrows its candidates to the languages that use the script.  A Viterbi pass over the
words of a text, with a penalty for switching, labels every word; runs of one label are
the spans, and the label with the most letters is the language of the text.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
spans; a tie between languages goes to the first in code-point order; a word of a script
that no learned language uses has no say; a text of such words only gets the first learned
language with score 0.  Nothing learned (empty or unlabelled input): every text is ``und``.
Other columns pass through; input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import add_columns, extended, slices, without, worker_copy

UNKNOWN = "und"
BUCKETS = 1 << 16
LONGEST_CACHED = 64
RESULT = ("lang_pred", "score", "spans")

# First code points of the script ranges of Unicode blocks, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([start for start, _ in SCRIPTS], dtype=np.uint32)
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS], dtype=np.int8)

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("first_word", T.IntegerType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("lang", T.StringType()),
        ]
    )
)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # trigram bucket x language
    uses: np.ndarray  # script x language: the language uses the script


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every letter trigram, first trigram of each word, script of each word.

    Words are non-empty strings of letters; one space marks either edge of a word.
    """
    joined = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    mixed = joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA6B)
    mixed = (mixed ^ joined[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    bucket = (mixed >> np.uint32(16)).astype(np.int64) % BUCKETS
    # A trigram is centred on each letter; those centred on a space join two words.
    inner = joined[1:-1] != 32
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    scripts = SCRIPT_OF[np.searchsorted(STARTS, joined[1:-1][inner], side="right") - 1]
    return bucket[inner], starts, scripts


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of a task's training texts, by language."""
    code = {name: i for i, name in enumerate(languages)}
    grams = np.zeros((BUCKETS, len(languages)), dtype=np.int64)
    scripts = np.zeros((len(NAMES), len(languages)), dtype=np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = [w for w in map(letters_of, (text or "").split()) if w]
                if words:
                    bucket, _, script = trigrams(words)
                    grams[:, code[lang]] += np.bincount(bucket, minlength=BUCKETS)
                    scripts[:, code[lang]] += np.bincount(script, minlength=len(NAMES))
    for kind, counts in ((0, grams), (1, scripts)):
        row, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), kind, dtype=np.int32)),
                pa.array(row.astype(np.int32)),
                pa.array(lang.astype(np.int32)),
                pa.array(counts[row, lang]),
            ],
            names=["kind", "row", "lang", "n"],
        )


def fit(
    documents: DataFrame,
    learn: Column | None = None,
    *,
    texts_per_language: int = 3000,
) -> Model | None:
    """Learn from the non-null ``text`` and ``lang`` of rows where ``learn`` holds.

    Every label is learned.  The sample is bounded by ``texts_per_language`` texts of each
    label, chosen by a hash of the text.
    """
    rows = documents.select("text", "lang", (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where("learn AND text IS NOT NULL AND lang IS NOT NULL").drop("learn")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    languages = sorted(row["lang"] for row in counts)
    shares = {row["lang"]: min(1.0, 1.2 * texts_per_language / row["count"]) for row in counts}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    dice = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # About a fifth too many by share, then exactly: only chosen texts are shuffled.
    chosen = rows.where(dice < share[F.col("lang")])
    order = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    chosen = chosen.withColumn("place", F.row_number().over(order))
    chosen = chosen.where(F.col("place") <= F.lit(texts_per_language)).drop("place")
    counted = (
        chosen.repartition(2 * len(languages), F.xxhash64("text"))
        .mapInArrow(lambda it: _count(it, languages), "kind int, row int, lang int, n bigint")
        .groupBy("kind", "row", "lang")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    grams = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(NAMES), len(languages)))
    for kind, into in ((0, grams), (1, scripts)):
        part = counted[counted["kind"] == kind]
        into[part["row"], part["lang"]] = part["n"]
    smooth = grams + 0.05
    logp = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    uses = scripts >= 0.05 * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logp, uses)


class _Codes(dict):
    """Word to code; new words queue up to be scored."""

    def __init__(self, first: int):
        super().__init__()
        self.new: list[str] = []
        self.next = first

    def __missing__(self, word: str) -> int:
        self[word] = code = self.next
        self.next += 1
        self.new.append(word)
        return code


class Labeller:
    """Scores words once, then labels whole batches of texts."""

    def __init__(self, model: Model, penalty: float, most_words: int):
        self.model, self.penalty, self.most_words = model, np.float32(penalty), most_words
        self.forget()

    def forget(self) -> None:
        k = len(self.model.languages)
        self.codes = _Codes(0)
        self.scores = np.zeros((1024, k), dtype=np.float32)
        self.sizes = np.zeros(1024, dtype=np.int32)
        self.known = np.zeros(1024, dtype=bool)

    def learn_words(self) -> None:
        new, top = self.codes.new, self.codes.next
        if top > len(self.sizes):
            more = max(top, 2 * len(self.sizes)) - len(self.sizes)
            self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int32)])
            self.known = np.concatenate([self.known, np.zeros(more, bool)])
        words = [letters_of(w) for w in new]
        at = np.array([i for i, w in enumerate(words) if w], dtype=np.int64)
        if len(at):
            kept = [words[i] for i in at]
            bucket, starts, scripts = trigrams(kept)
            sums = np.add.reduceat(self.model.logp[bucket], starts, axis=0)
            allowed = np.logical_or.reduceat(self.model.uses[scripts], starts, axis=0)
            some = allowed.any(axis=1)
            # Below every candidate, however long the word is.
            sums -= np.where(allowed | ~some[:, None], sums, -np.inf).max(axis=1, keepdims=True)
            sums = np.where(allowed, sums, np.minimum(sums.min(axis=1, keepdims=True), 0) - np.float32(1e4))
            place = top - len(new) + at
            self.scores[place] = np.where(some[:, None], sums, 0)
            self.sizes[place] = np.fromiter(map(len, kept), dtype=np.int32, count=len(kept))
            self.known[place] = some
        for word in new:
            if len(word) > LONGEST_CACHED:
                del self.codes[word]
        self.codes.new = []

    def label(self, texts: list[str | None]):
        """Path over all words, word bounds of each text, letters by text and language."""
        if len(self.codes) > self.most_words:
            self.forget()
        get = self.codes.__getitem__
        coded = [np.fromiter(map(get, t.split()), dtype=np.int64) if t else np.zeros(0, np.int64) for t in texts]
        self.learn_words()
        counts = np.array([len(c) for c in coded], dtype=np.int64)
        ends = np.cumsum(counts)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        path = self._viterbi(flat, ends - counts, counts)
        k = len(self.model.languages)
        text_of = np.repeat(np.arange(len(texts)), counts)
        weight = self.sizes[flat]
        total = np.bincount(text_of, weights=weight, minlength=len(texts))
        heard = np.where(self.known[flat], weight, 0)
        by = np.bincount(text_of * k + path, weights=heard, minlength=len(texts) * k)
        return path, ends, total, by.reshape(len(texts), k)

    def _viterbi(self, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Best labels of all texts together, one word of every text per step."""
        path = np.zeros(len(flat), dtype=np.int64)
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        k, longest = self.scores.shape[1], int(counts[0]) if len(counts) else 0
        if not longest:
            return path
        active = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
        switched = np.zeros((len(flat), k), dtype=bool)
        came = np.zeros(len(flat), dtype=np.int32)
        value = self.scores[flat[starts[: active[0]]]]
        ended: list[np.ndarray] = []
        for t in range(1, longest):
            n = active[t]
            if n < len(value):
                ended.append(value[n:].argmax(axis=1))
                value = value[:n]
            at = starts[:n] + t
            best = value.argmax(axis=1)
            jump = value[np.arange(n), best][:, None] - self.penalty
            switch = jump > value
            switched[at], came[at] = switch, best
            value = np.where(switch, jump, value) + self.scores[flat[at]]
        ended.append(value.argmax(axis=1))
        last = np.concatenate(ended[::-1])
        now = np.zeros(len(last), dtype=np.int64)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            # Texts that end at this word start their way back here.
            joined = active[t + 1] if t + 1 < longest else 0
            now[joined:n] = last[joined:n]
            at = starts[:n] + t
            path[at] = now[:n]
            if t:
                back = switched[at, now[:n]]
                now[:n] = np.where(back, came[at], now[:n])
        return path


def _spans(path: np.ndarray, ends: np.ndarray, languages: list[str]) -> pa.Array:
    """Runs of one label inside each text."""
    counts = np.diff(np.concatenate(([0], ends)))
    first = np.zeros(len(path), dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    first[1:] |= path[1:] != path[:-1]
    runs = np.nonzero(first)[0]
    sizes = np.diff(np.concatenate((runs, [len(path)]))).astype(np.int32)
    owner = np.searchsorted(ends, runs, side="right")
    offsets = np.searchsorted(runs, np.concatenate(([0], ends)), side="left").astype(np.int32)
    place = (runs - (ends - counts)[owner]).astype(np.int32) if len(runs) else np.zeros(0, np.int32)
    names = pa.DictionaryArray.from_arrays(pa.array(path[runs].astype(np.int32)), pa.array(languages, pa.string()))
    parts = pa.StructArray.from_arrays(
        [pa.array(place), pa.array(sizes), names.cast(pa.string())], names=["first_word", "words", "lang"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), parts)


def identify(
    documents: DataFrame,
    model: Model | None,
    *,
    penalty: float = 12.0,
    most_words: int = 600_000,
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its share of the letters) and ``spans`` to every row.

    ``most_words`` bounds the words a worker keeps scored.
    """
    documents = without(documents, *RESULT)
    schema = extended(documents, (RESULT[0], T.StringType()), (RESULT[1], T.DoubleType()), (RESULT[2], SPANS))
    if model is None:
        return documents.select(
            "*", F.lit(UNKNOWN).alias(RESULT[0]), F.lit(0.0).alias(RESULT[1]),
            F.array().cast(SPANS).alias(RESULT[2]),
        )
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = worker_copy(key, lambda: Labeller(shared.value, penalty, most_words))
        names = [*shared.value.languages, UNKNOWN]
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                path, ends, total, by = labeller.label(batch.column("text").to_pylist())
                best = by.argmax(axis=1)
                share = np.where(total > 0, by[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
                code = np.where(total > 0, best, len(names) - 1).astype(np.int32)
                spans = _spans(path, ends, shared.value.languages)
                if (total == 0).any():
                    spans = pa.array(
                        [[] if none else s for s, none in zip(spans.to_pylist(), total == 0)], spans.type
                    )
                lang = pa.DictionaryArray.from_arrays(pa.array(code), pa.array(names, pa.string()))
                yield add_columns(
                    batch, lang_pred=lang.cast(pa.string()), score=pa.array(share), spans=spans
                )

    return documents.mapInArrow(run, schema)


def script_name(letter: str) -> str:
    """Script of one letter by its range."""
    return SCRIPTS[bisect.bisect_right([s for s, _ in SCRIPTS], ord(letter)) - 1][1]
