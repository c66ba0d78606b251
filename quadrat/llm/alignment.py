"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded by a byte-level vocabulary (A, of space + text) and by a piece vocabulary (B,
which adds that space itself).  Both sequences of byte offsets at which tokens end are merged along
a merge path: diagonals at equal distances are cut by binary searches into the places where the
merge crosses them, which gives pieces of equal work that are merged without each other.  A piece
holds its tokens of both sides and the token that goes on beyond it on either side; an end shared
by both sides is never parted.

A piece emits its overlaps.  Offsets where both sides end cut the tokens into groups; a piece closes
the groups that end inside it, and what is open at its edges is stitched to its neighbours.

Links are pairs of token occurrences: those that end together, or with ``together=False`` all that
overlap.  The count of a pair of ids is taken over the whole corpus.  Pieces are dealt to blocks of
about ``BLOCK`` tokens; a block asks once for each pair of ids it holds, however often it does, so
that the commonest pair is asked for once a block and no key is hot.

Defined results: texts that are null or empty, and texts whose bytes are not those of the tokens of
either side (B normalises some), have no tokens and zero counts.  Repeated rows and ids are documents
of their own.  No rows in, no rows out.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import MOST_BUCKETS, bucketed, byte_letters, slices, worker_copy, written

#: Merge steps of a piece, and tokens of a block.
WORK = 1 << 16
BLOCK = 1 << 21
LETTERS_A_BUCKET = 16 << 20
#: A pair of ids as one number: A's above the bits of B's.
B_BITS = 32

PIECES = (
    "row bigint, doc_id bigint, block bigint, piece int, pieces int, a array<int>, b array<int>, "
    "a_next int, b_next int, a_at bigint, b_at bigint, pairs array<bigint>, times array<int>"
)
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups string"
)
PARTS = f"row bigint, piece int, pieces int, {RESULT}, a_last string, b_last string, b_head string"

#: No token of either side goes on over such a place: space after something else, before more.
EDGE = re.compile(r"(?<=\S)(?= *[^ ])(?= )")
#: Letters that are encoded at once; longer texts are cut at an edge.
AT_ONCE = 1 << 18
#: Runs of white space that the fast encoder of A cannot hold on its stack.
LONG_SPACE = re.compile(r"\s{5000}")
#: Fixed value: how byte-level vocabularies cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_path, self.slow = a_path, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary = held["model"]["vocab"] | {t["content"]: t["id"] for t in held.get("added_tokens") or ()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.fast = self._ranked(held, letters)
        inner = re.compile("[^▁]▁")
        #: Whether no piece of B goes on over a space, so that long texts may be cut there.
        self.cuts = not any(inner.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    @staticmethod
    def _ranked(held: dict, letters: dict[str, int]):
        """The same vocabulary as ranks for a faster encoder, if its ids follow its merges."""
        import tiktoken

        model, before = held["model"], held.get("pre_tokenizer") or {}
        plain = not held.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if not plain or before.get("add_prefix_space") or model.get("ignore_merges"):
            return None
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary.get(x + y) != 256 + n for n, (x, y) in enumerate(pairs)):
            return None
        words = {w: i for w, i in vocabulary.items() if i < 256 + len(pairs)}
        ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _own(self):
        """A's own encoder, which is slower and larger; loaded where it is needed."""
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.a_path)
            # Strings of special tokens inside a text are text.
            self.slow.encode_special_tokens = True
        return self.slow

    def _a_ids(self, text: str) -> list[int]:
        if self.fast is None or len(text) >= 5000 and LONG_SPACE.search(text):
            return self._own().encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def parts(self, text: str) -> list[str]:
        """Space + text in parts that can be encoded alone: of about ``AT_ONCE`` letters."""
        said = " " + text
        if len(said) <= AT_ONCE or not self.cuts:
            return [said]
        out, start = [], 0
        while len(said) - start > AT_ONCE and (edge := EDGE.search(said, start + AT_ONCE)):
            out.append(said[start : edge.start()])
            start = edge.start()
        return [*out, said[start:]]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where the bytes are not those of space + text."""
        parts = [self.parts(t) if t else [] for t in texts]
        # B adds the space that each part begins with.
        coded = iter(self.b.encode([p[1:] for held in parts for p in held], num_threads=1))
        none = np.zeros(0, dtype=np.int32)
        out = []
        for held in parts:
            a = [i for p in held for i in self._a_ids(p)]
            b = [i for _ in held for i in next(coded)]
            said = "".join(held).encode()
            same = all(b"".join(map(of.__getitem__, ids)) == said for of, ids in ((self.a_bytes, a), (self.b_bytes, b)))
            out.append((np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)) if same else (none, none))
        return out


def crossings(a_ends: np.ndarray, b_ends: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side the merge has passed at each diagonal, first and last included.

    Of equal ends A's comes first; a diagonal between the two is moved behind both.
    """
    steps = np.arange(work, len(a_ends) + len(b_ends), work)
    low, high = np.maximum(steps - len(b_ends), 0), np.minimum(steps, len(a_ends))
    while (low < high).any():
        middle = (low + high) // 2
        going = low < high
        passed = np.zeros(len(steps), dtype=bool)
        passed[going] = a_ends[middle[going]] <= b_ends[steps[going] - 1 - middle[going]]
        low, high = np.where(going & passed, middle + 1, low), np.where(going & ~passed, middle, high)
    i, j = low, steps - low
    inside = (i > 0) & (j < len(b_ends))
    parted = np.zeros(len(steps), dtype=bool)
    parted[inside] = a_ends[i[inside] - 1] == b_ends[j[inside]]
    j = j + parted
    return np.concatenate([[0], i, [len(a_ends)]]), np.concatenate([[0], j, [len(b_ends)]])


def overlaps(
    a_ends: np.ndarray, b_ends: np.ndarray, a_own: int, b_own: int, together: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens (index in A, index in B), and which of the own tokens end a group.

    Each step of the merge, a token that ends, overlaps the token that is open on the other side.
    Only the first ``a_own`` and ``b_own`` tokens make steps; one more may go on beyond them.
    """
    at = np.searchsorted(b_ends, a_ends[:a_own])
    a_cut = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[:a_own]
    b_cut = np.zeros(b_own, dtype=bool)
    b_cut[at[a_cut]] = True
    if together:
        return np.nonzero(a_cut)[0], at[a_cut], a_cut, b_cut
    alone = np.nonzero(~b_cut)[0]
    over = np.searchsorted(a_ends, b_ends[alone])
    return np.concatenate([np.arange(a_own), over]), np.concatenate([at, alone]), a_cut, b_cut


class Merged:
    """Pieces merged, laid end to end: links as pairs of ids, the piece of each, and the cuts.

    Either all pieces are whole documents, or none is.
    """

    def __init__(self, pair: Pair, rows: list[dict], together: bool):
        sizes = [np.array([len(r[side]) for r in rows]) for side in "ab"]
        self.a, self.b = (np.concatenate([r[side] for r in rows]).astype(np.int64) for side in "ab")
        self.a_end, self.b_end = np.cumsum(sizes[0]), np.cumsum(sizes[1])
        if rows[0]["pieces"] == 1:
            # Both sides of a document have the same bytes, so one merge serves all documents.
            ends = np.cumsum(pair.a_length[self.a]), np.cumsum(pair.b_length[self.b])
            if not len(self.a):
                ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
            i, j, self.a_cut, self.b_cut = overlaps(*ends, len(self.a), len(self.b), together)
            self.pairs = (self.a[i] << B_BITS) | self.b[j]
            self.owner = np.searchsorted(self.a_end, i, side="right")
        else:
            made = [self._piece(pair, n, row, together) for n, row in enumerate(rows)]
            self.pairs, self.owner, self.a_cut, self.b_cut = (np.concatenate(x) for x in zip(*made))
        if not together:
            order = np.argsort(self.owner, kind="stable")
            self.pairs, self.owner = self.pairs[order], self.owner[order]

    @staticmethod
    def _piece(pair: Pair, n: int, row: dict, together: bool):
        ids, ends = [], []
        for side, length in (("a", pair.a_length), ("b", pair.b_length)):
            beyond = row[f"{side}_next"]
            own = row[side].astype(np.int64)
            ids.append(own if beyond is None else np.append(own, beyond))
            ends.append(row[f"{side}_at"] + np.cumsum(length[ids[-1]]))
        i, j, a_cut, b_cut = overlaps(*ends, len(row["a"]), len(row["b"]), together)
        return (ids[0][i] << B_BITS) | ids[1][j], np.full(len(i), n), a_cut, b_cut


def pieces(docs: DataFrame, a_path: str, b_path: str, *, together: bool = True, work: int = WORK, block: int = BLOCK) -> DataFrame:
    """Tokens of all texts in pieces of ``work`` merge steps, written once.

    A block has one further row, without a document: its pairs of ids and how often it holds them.
    """
    key = uuid.uuid4().hex
    names = [field.split()[0] for field in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def made(columns: dict) -> pa.RecordBatch:
        n = len(columns["block"])
        arrays = [pa.array(columns.get(c, [None] * n), kind) for c, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def parts(row: int, doc: int | None, a: np.ndarray, b: np.ndarray, pair: Pair) -> list[dict]:
        a_ends, b_ends = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
        i, j = crossings(a_ends, b_ends, work)
        count = len(i) - 1
        out = []
        for n in range(count):
            out.append({
                "row": row, "doc_id": doc, "piece": n, "pieces": count,
                "a": a[i[n] : i[n + 1]], "b": b[j[n] : j[n + 1]],
                "a_next": int(a[i[n + 1]]) if i[n + 1] < len(a) else None,
                "b_next": int(b[j[n + 1]]) if j[n + 1] < len(b) else None,
                "a_at": int(a_ends[i[n] - 1]) if i[n] else 0, "b_at": int(b_ends[j[n] - 1]) if j[n] else 0,
            })
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_copy(key, lambda: Pair(a_path, b_path))
        # Whole documents and pieces of split ones fill blocks of their own: even and odd numbers.
        filling = [Block((TaskContext.get().partitionId() << 32) + odd) for odd in (0, 1)]

        def closing(filled: Block) -> pa.RecordBatch:
            pairs, where = np.unique(np.concatenate([p for p, _ in filled.found]), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate([n for _, n in filled.found])).astype(np.int32)
            return made({"block": [filled.serial], "pairs": [pairs], "times": [times]})

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                coded = pair.encode(batch.column("text").to_pylist())
                ids = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), coded)
                rows = [p for row, doc, (a, b) in ids for p in parts(row, doc, a, b, pair)]
                for odd in (0, 1):
                    own = [r for r in rows if (r["pieces"] > 1) == odd]
                    while own:
                        now, end = filling[odd], 0
                        while end < len(own) and now.held < block:
                            now.held += len(own[end]["a"]) + len(own[end]["b"])
                            end += 1
                        taken, own = own[:end], own[end:]
                        now.found.append(np.unique(Merged(pair, taken, together).pairs, return_counts=True))
                        yield made({c: [r[c] for r in taken] for c in taken[0]} | {"block": [now.serial] * end})
                        if now.held >= block:
                            yield closing(now)
                            filling[odd] = Block(now.serial + 2)
        for filled in filling:
            if filled.found:
                yield closing(filled)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "text")
    letters = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = min(max(cores, -(-letters // LETTERS_A_BUCKET)), MOST_BUCKETS)
    return bucketed(rows.mapInArrow(run, PIECES), "alignment-pieces", "block", buckets, "zstd")


class Block:
    """Tokens held so far, and the pairs of ids found with how often."""

    def __init__(self, serial: int):
        self.serial, self.held = serial, 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []


def counts(held: DataFrame) -> DataFrame:
    """a_id, b_id, pair, n (links of the whole corpus), and whether it is the highest of its B id."""
    each = held.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "times")))
    sums = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    sums = sums.withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    sums = written(sums, "alignment-sums")
    top = sums.groupBy("b_id").agg(F.max("n").alias("top"))
    a_id = F.shiftright("pair", B_BITS).alias("a_id")
    return written(
        sums.join(top, "b_id").select(a_id, "b_id", "pair", "n", (F.col("n") == F.col("top")).alias("best")),
        "alignment-counts",
    )


class Texts:
    """Decimal ids with what follows them: a comma, or the end of a group's side."""

    def __init__(self, size: int, end: str):
        self.of = np.empty((2, size), dtype=object)
        self.of[0] = [f"{i}," for i in range(size)]
        self.of[1] = [f"{i}{end}" for i in range(size)]


def _groups(merged: Merged, rows: list[dict], a_text: Texts, b_text: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All ids as text in the order of the groups, and where each piece ends."""
    a_tie, b_tie = np.nonzero(merged.a_cut)[0], np.nonzero(merged.b_cut)[0]
    a_group = np.cumsum(merged.a_cut) - merged.a_cut
    b_group = np.cumsum(merged.b_cut) - merged.b_cut
    b_before = np.concatenate([[0], b_tie + 1])
    a_through = np.concatenate([a_tie + 1, [len(merged.a)]])
    out = np.empty(len(merged.a) + len(merged.b), dtype=object)
    out[np.arange(len(merged.a)) + b_before[a_group]] = a_text.of[merged.a_cut.astype(np.int8), merged.a]
    out[np.arange(len(merged.b)) + a_through[b_group]] = b_text.of[merged.b_cut.astype(np.int8), merged.b]
    return out, merged.a_end + merged.b_end


def _scoring(a_path: str, b_path: str, together: bool):
    """Counts and groups of every piece of a block, with the corpus counts the block asked for."""
    key = uuid.uuid4().hex
    names = [field.split()[0] for field in PARTS.split(", ")]

    def load():
        pair = Pair(a_path, b_path)
        return pair, Texts(len(pair.a_bytes), "|"), Texts(len(pair.b_bytes), ";")

    def run(held: pa.Table, known: pa.Table) -> pa.Table:
        pair, a_text, b_text = worker_copy(key, load)
        pairs = known.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], known.column("n").to_numpy()[order]
        best = known.column("best").to_numpy()[order].astype(np.int64)
        columns: dict[str, list] = {c: [] for c in names}
        # A side of a block may be missing: its pieces all without links, or none of this kind.
        for batch in held.to_batches(max_chunksize=2000):
            if batch.num_rows:
                scored(_rows(batch), pair, a_text, b_text, pairs, n, best, columns)
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7, *[pa.string()] * 4]
        return pa.Table.from_arrays([pa.array(columns[c], k) for c, k in zip(names, kinds)], names=names)

    def scored(rows, pair, a_text, b_text, pairs, n, best, columns) -> None:
        merged = Merged(pair, rows, together)
        at = np.searchsorted(pairs, merged.pairs)
        sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (n, best)]
        edge = np.searchsorted(merged.owner, np.arange(len(rows) + 1))
        closed = np.concatenate([[0], np.cumsum(merged.a_cut)])
        whole = rows[0]["pieces"] == 1
        if whole:
            out, ends = _groups(merged, rows, a_text, b_text)
        a0 = b0 = start = 0
        for i, row in enumerate(rows):
            a1, b1 = int(merged.a_end[i]), int(merged.b_end[i])
            texts = {"groups": None, "a_last": None, "b_last": None, "b_head": None}
            if whole:
                texts["groups"] = "".join(out[start : int(ends[i])].tolist())[:-1]
                start = int(ends[i])
            else:
                texts = _fragments(merged, slice(a0, a1), slice(b0, b1), a_text, b_text)
            made = {
                "row": row["row"], "piece": row["piece"], "pieces": row["pieces"], "doc_id": row["doc_id"],
                "n_a": a1 - a0, "n_b": b1 - b0, "n_groups": int(closed[a1] - closed[a0]),
                "n_links": int(edge[i + 1] - edge[i]), "n_best": int(sums[1][edge[i + 1]] - sums[1][edge[i]]),
                "count_sum": int(sums[0][edge[i + 1]] - sums[0][edge[i]]), **texts,
            }
            for c in names:
                columns[c].append(made[c])
            a0, b0 = a1, b1

    return run


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """Pieces with their ids as arrays."""
    plain = {c: batch.column(c).to_pylist() for c in ("row", "doc_id", "piece", "pieces", "a_next", "b_next", "a_at", "b_at")}
    rows = [dict(zip(plain, values)) for values in zip(*plain.values())]
    for c in ("a", "b"):
        lists = batch.column(c)
        flat = lists.flatten().to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy()) if len(rows) else []
        for row, end, size in zip(rows, ends, lists.value_lengths().to_pylist()):
            row[c] = flat[end - size : end]
    return rows


def _fragments(merged: Merged, a: slice, b: slice, a_text: Texts, b_text: Texts) -> dict[str, str | None]:
    """A piece of a split document: A and B of the group it ends first (``b_head``: B's part, where
    it ends one), the groups closed after that, and the open rest of either side.

    Without a closed group everything is open.
    """
    a_ids, b_ids, a_cut, b_cut = merged.a[a], merged.b[b], merged.a_cut[a], merged.b_cut[b]
    a_all = a_text.of[a_cut.astype(np.int8), a_ids]
    b_all = b_text.of[b_cut.astype(np.int8), b_ids]
    a_ties, b_ties = np.nonzero(a_cut)[0] + 1, np.nonzero(b_cut)[0] + 1
    if not len(a_ties):
        return {"groups": None, "b_head": None, "a_last": "".join(a_all.tolist()), "b_last": "".join(b_all.tolist())}
    said = [
        "".join(a_all[i:j].tolist()) + "".join(b_all[k:m].tolist())
        for i, j, k, m in zip(a_ties[:-1], a_ties[1:], b_ties[:-1], b_ties[1:])
    ]
    return {
        # The first group's A part comes before whatever its B part gets from the pieces before.
        "groups": "".join(a_all[: a_ties[0]].tolist()) + "\n" + "".join(said),
        "b_head": "".join(b_all[: b_ties[0]].tolist()),
        "a_last": "".join(a_all[a_ties[-1] :].tolist()), "b_last": "".join(b_all[b_ties[-1] :].tolist()),
    }


def stitched(parts: list[dict]) -> str:
    """Groups of a split document from the fragments of its pieces, in order."""
    out, a_open, b_open = [], [], []
    for part in parts:
        if part["groups"] is None:
            a_open.append(part["a_last"])
            b_open.append(part["b_last"])
            continue
        a_head, closed = part["groups"].split("\n", 1)
        out += [*a_open, a_head, *b_open, part["b_head"], closed]
        a_open, b_open = [part["a_last"]], [part["b_last"]]
    return "".join(out)[:-1]


def _stitching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = [stitched(sorted(parts, key=lambda p: p["piece"])) for parts in batch.column("parts").to_pylist()]
        kept = [c for c in batch.schema.names if c != "parts"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(listed, pa.string())], names=[*kept, "groups"]
        )


def align(
    docs: DataFrame, a_path: str, b_path: str, *, together: bool = True, work: int = WORK, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """One row per document (its counts, and its groups as ``a1,a2|b1;a3|b2``), and the counted pairs."""
    held = pieces(docs, a_path, b_path, together=together, work=work, block=block)
    counted = counts(held)
    # A block asks for each of its pairs once.
    asked = held.where("pairs IS NOT NULL").select(F.col("block").alias("asking"), F.explode("pairs").alias("pair"))
    known = asked.join(counted.select("pair", "n", "best"), "pair").select("asking", "pair", "n", "best")
    known = written(known, "alignment-known")
    run = _scoring(a_path, b_path, together)

    def scored(odd: int) -> DataFrame:
        tokens = held.where(f"pairs IS NULL AND pieces {'>' if odd else '='} 1").drop("pairs", "times")
        mine = known.where(F.col("asking").bitwiseAND(1) == odd)
        return tokens.groupBy("block").cogroup(mine.groupBy("asking")).applyInArrow(run, PARTS)

    names = [field.split()[0] for field in RESULT.split(", ")]
    fragments = F.struct("piece", "groups", "b_head", "a_last", "b_last")
    split = scored(1).groupBy("row", "doc_id").agg(
        *[F.sum(c).alias(c) for c in names[1:-1]], F.collect_list(fragments).alias("parts")
    )
    split = split.drop("row").mapInArrow(_stitching, RESULT)
    return scored(0).select(*names).unionByName(split), counted
