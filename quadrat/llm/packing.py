"""Packing token sequences by minimum bin slack.

A document is cut into full windows and a rest; only the rests compete for space.  Rests are
dealt by hash to groups of a bounded number of tokens.  In a group, each window is filled by a
subset-sum table over the remaining multiset of lengths, a bitset of reachable totals per
distinct length: the best total below the capacity is read off and the counts are traced back.
If even the best subset leaves a gap, one remaining piece is cut to close it, so a group
leaves at most one window that is not full.

Defined results: a null or empty text is the single end token; repeated rows and ids are packed
separately; extra columns are ignored.  No rows in, no rows out.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import byte_letters, slices, worker_copy, written

PIECES = "row long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


class WordCoder:
    """Ids of chunks of text between ASCII white space, for a vocabulary that drops white space.

    Such a vocabulary cuts there, so the ids of a text are those of its chunks, and a chunk that
    occurs often is encoded once.  Chunks of plain Latin letters go through a faster encoder of the
    same merges, in which the byte 1 stands for the end of a word; the others through their own.
    """

    END_OF_WORD = "</w>"
    #: Fixed value: how the vocabulary cuts a chunk, after lower-casing it.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Letters that neither composition nor the letters around them change.
    PLAIN = re.compile("[!-~¡-įı-ɏ]+")
    #: Bytes of the chunks kept with their ids, and letters of the longest kept.
    MOST_BYTES = 96 << 20
    LONGEST_KNOWN = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.specials = [t["content"] for t in held.get("added_tokens") or ()]
        self.fast, self.ends = self._ranked(held)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _ranked(self, held: dict):
        """The merges as ranks, and which ids end a word; nothing if ids do not follow the merges."""
        import regex
        import tiktoken

        model, cut = held["model"], json.dumps(held.get("pre_tokenizer"))
        vocabulary, first = model["vocab"], 512
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        known = model.get("end_of_word_suffix") == self.END_OF_WORD and json.dumps(self.PIECES)[1:-1] in cut
        if not known or any(vocabulary.get(x + y) != first + n for n, (x, y) in enumerate(merges)):
            return None, None
        letters = byte_letters()
        ranks, ends = {}, np.zeros(first + len(merges), dtype=bool)
        for word, i in vocabulary.items():
            if i < first + len(merges):
                ends[i] = word.endswith(self.END_OF_WORD)
                ranks[bytes(letters[c] for c in word.removesuffix(self.END_OF_WORD)) + b"\1" * int(ends[i])] = i
        self.pieces = regex.compile(self.PIECES).findall
        return tiktoken.Encoding("ranks", pat_str="[^\\x01]+\\x01", mergeable_ranks=ranks, special_tokens={}), ends

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has."""
        if self.size > self.MOST_BYTES:
            self.known, self.size = {}, 0
        found = list(map(self.known.get, chunks))
        new = [c for c, raw in zip(chunks, found) if raw is None]
        if new:
            ids, sizes = self._encode(new)
            raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            made = dict(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            found = [made[c] if raw is None else raw for c, raw in zip(chunks, found)]
            self.known.update((c, raw) for c, raw in made.items() if len(c) <= self.LONGEST_KNOWN)
            # About what a dictionary entry and its two objects take besides their contents.
            self.size += 220 * len(new) + len(raw)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype="<u4"), sizes

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = self.PLAIN.fullmatch
        joined = "\n".join(chunks)
        special = any(t in joined for t in self.specials)
        quick = np.array([
            self.fast is not None and plain(c) is not None and not (special and any(t in c for t in self.specials))
            for c in chunks
        ], dtype=bool)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if quick.any():
            at = np.nonzero(quick)[0]
            cut = [self.pieces(chunks[i].lower()) for i in at.tolist()]
            said = "\1".join(["\1".join(held) for held in cut]) + "\1"
            ids = np.array(self.fast.encode_ordinary(said), dtype="<u4")
            # A chunk's ids end where the last of its pieces does.
            stops = np.concatenate([[0], np.nonzero(self.ends[ids])[0] + 1])
            last = np.cumsum([len(held) for held in cut])
            parts.append((at, ids, np.diff(np.concatenate([[0], stops[last]]))))
        if not quick.all():
            at = np.nonzero(~quick)[0]
            coded = self.own.encode_batch_fast([chunks[i] for i in at.tolist()], add_special_tokens=False)
            held = [np.array(x.ids, dtype="<u4") for x in coded]
            parts.append((at, np.concatenate(held), np.array([len(x) for x in held])))
        sizes = np.zeros(len(chunks), dtype=np.int64)
        for at, _, size in parts:
            sizes[at] = size
        ends = np.cumsum(sizes)
        out = np.zeros(int(sizes.sum()), dtype="<u4")
        for at, ids, size in parts:
            out[spans(ends[at] - size, size)] = ids
        return out, sizes


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


def tokenised(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """row, doc_id, ids (little-endian unsigned 32-bit) and their number, written once."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_copy(key, lambda: WordCoder(vocabulary))
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                chunks = pc.ascii_split_whitespace(batch.column("text").fill_null(""))
                words = chunks.flatten().dictionary_encode()
                ids, sizes = coder.encode(words.dictionary.to_pylist())
                code = words.indices.to_numpy()
                # The end token comes after the last chunk of each text.
                ids, sizes = np.append(ids, np.uint32(end)), np.append(sizes, 1)
                last = np.cumsum(chunks.value_lengths().to_numpy())
                code = np.insert(code, last, len(sizes) - 1)
                flat = ids[spans((np.cumsum(sizes) - sizes)[code], sizes[code])]
                stops = np.concatenate([[0], np.cumsum(sizes[code])])[last + np.arange(len(last)) + 1]
                offsets = pa.array(np.concatenate([[0], stops * 4]).astype(np.int32), pa.int32())
                raw = pa.BinaryArray.from_buffers(
                    pa.binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(flat.astype("<u4").tobytes())]
                )
                counts = np.diff(np.concatenate([[0], stops]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), raw, pa.array(counts, pa.int64())],
                    names=["row", "doc_id", "ids", "doc_tokens"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(run, "row long, doc_id long, ids binary, doc_tokens long"), "packing-tokens")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length to number taken, whose sum is the largest within ``capacity``.

    Lengths come longest first; the table stops at the first length that reaches the capacity.
    """
    reach, layers = 1, []
    keep = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        before = reach
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            step = min(step, left)
            reach |= (reach << (length * step)) & keep
            left, step = left - step, 2 * step
        layers.append((length, before))
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            taken[length] = n
    return taken


def _group(capacity: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        out: list[tuple] = []
        serial = int(key[0]) << 32
        pool: dict[int, list] = {}
        for row, doc, tokens in zip(frame["row"], frame["doc_id"], frame["doc_tokens"]):
            full = tokens // capacity
            for i in range(full):
                out.append((row, doc, i * capacity, capacity, tokens, serial, 0))
                serial += 1
            if tokens % capacity:
                pool.setdefault(tokens % capacity, []).append((row, doc, full * capacity, tokens))
        while pool:
            taken = fill({n: len(rows) for n, rows in pool.items()}, capacity)
            offset = 0
            for length, n in taken.items():
                for _ in range(n):
                    row, doc, start, tokens = pool[length].pop()
                    out.append((row, doc, start, length, tokens, serial, offset))
                    offset += length
                if not pool[length]:
                    del pool[length]
            gap = capacity - offset
            if gap and pool:
                # Whatever is left is longer than the gap: cut the longest piece.
                longest = max(pool)
                row, doc, start, tokens = pool[longest].pop()
                if not pool[longest]:
                    del pool[longest]
                out.append((row, doc, start, gap, tokens, serial, offset))
                pool.setdefault(longest - gap, []).append((row, doc, start + gap, tokens))
            serial += 1
        names = [f.split()[0] for f in PIECES.split(", ")]
        made = pd.DataFrame(out, columns=names)
        return made.astype({n: "Int64" if n == "doc_id" else "int64" for n in names})

    return run


def pack(docs: DataFrame, vocabulary: str, *, end: int = 2, capacity: int = 4096, group_windows: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    held = tokenised(docs, vocabulary, end)
    rests = held.agg(F.sum(F.col("doc_tokens") % capacity).alias("n")).first()["n"] or 0
    groups = max(1, -(-rests // (capacity * group_windows)))
    dealt = held.select(
        "row", "doc_id", "doc_tokens", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    )
    pieces = written(dealt.groupBy("group").applyInPandas(_group(capacity), PIECES), "packing-pieces")
    # A document's pieces are listed beside its ids, so the ids of a long one move once.
    at = F.struct("start", "length", "sequence_id", "offset")
    listed = pieces.groupBy("row").agg(F.collect_list(at).alias("at"))
    joined = held.join(listed, "row").select("doc_id", "ids", "doc_tokens", "at")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, held = batch.column("at"), batch.column("ids")
            sizes = listed.value_lengths().to_numpy()
            pieces = listed.flatten()
            start, length = (pieces.field(n).to_numpy(zero_copy_only=False) for n in ("start", "length"))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            raws = [memoryview(x.as_buffer()) for x in held]
            spots = zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())
            crc = [zlib.crc32(raws[i][s:e]) for i, s, e in spots]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), pieces.field("start"), pieces.field("length"), pa.array(crc, pa.int64()),
                 batch.column("doc_tokens").take(of), pieces.field("sequence_id"), pieces.field("offset")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(expand, kind)
