"""Hierarchical packing of token ids into sequences of several lengths.

Each task encodes its documents and packs them as it goes, so no text and no ids are shuffled. A document gives
full windows of the greatest length first; its rest is routed to the shortest tier that holds it. Then the tiers
are packed from the longest down: every rest opens a window of its tier, and the gap is filled with the largest
rests of the shorter tiers that fit; where none fits exactly, one rest is cut at the end of the window. So all
windows are full; only the last few rests of a task, less than a window together, are dealt to sequences
whose lengths are the powers of two of their number, which need no padding either. Sequences of one tier
are dealt to step groups of equal size in a serpentine of their attention cost, so that groups cost alike.

A task holds one buffer of rests (BUFFER ids) and one slice of text at a time, whatever its input's size. If it is lost,
it is run again from its input and gives the same rows.

Defined results: a null text is empty, and a document always has the id 1 at its end, so an empty one gives a piece of length 1.
Repeated rows and null ids are packed row by row. An empty table gives no rows. Extra columns, whatever their names,
are ignored. Texts are encoded whole; those over LONG code points in parts cut where the tokenizer cuts anyway
(between a letter and a space before a letter).
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices

TIERS = (256, 512, 1024, 2048)
END_ID = 1
LONG = 500_000
#: Ids of rests that a task collects before it packs them; tokens of a step group.
BUFFER, STEP = 2_000_000, 16_384

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long"
)


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizer file gives them.

    With ``ranks_path`` (the same vocabulary as ranks) texts without special strings are encoded from the ranks, which gives
    the same ids several times faster; texts with special strings go through the tokenizer file.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        parts = [text] if len(text) <= LONG else parts_of(text)
        return np.concatenate([np.asarray(fast.encode_to_numpy(p, disallowed_special=()), dtype=np.uint32) for p in parts])

    return encode


def parts_of(text: str, size: int = LONG) -> list[str]:
    """``text`` cut before spaces that stand between ASCII letters, about every ``size`` code points."""
    out, start, at = [], 0, size
    while at < len(text):
        cut = text.find(" ", at)
        while 0 < cut and not (text[cut - 1 : cut + 2 : 2].isascii() and text[cut - 1 : cut + 2 : 2].isalpha() and cut + 1 < len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start, at = cut, cut + size
    return [*out, text[start:]]


#: A piece: (ids, doc_id, start, doc_tokens). A sequence: its length and its pieces.
Piece = tuple[np.ndarray, int | None, int, int]


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    ids, doc, start, n = piece
    return (ids[:at], doc, start, n), (ids[at:], doc, start + at, n)


def pack(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full sequences, pieces left over for the next call); none are left over if ``last``."""
    pool = sorted(pieces, key=lambda p: len(p[0]))
    sizes = [len(p[0]) for p in pool]
    out: list[tuple[int, list[Piece]]] = []
    left: list[Piece] = []

    def take(k: int) -> Piece:
        sizes.pop(k)
        return pool.pop(k)

    def put(piece: Piece) -> None:
        k = bisect_right(sizes, len(piece[0]))
        sizes.insert(k, len(piece[0]))
        pool.insert(k, piece)

    for below, tier in reversed(list(zip((0, *tiers), tiers, strict=False))):
        while sizes and sizes[-1] > below:  # the longest rest of this tier opens a window
            window = [take(len(sizes) - 1)]
            gap = tier - len(window[0][0])
            while gap and sizes:
                k = bisect_right(sizes, gap) - 1
                if k >= 0:
                    window.append(take(k))  # the largest that fits
                else:
                    head, rest = cut(take(0), gap)  # nothing fits: the shortest is cut
                    window.append(head)
                    put(rest)
                gap -= len(window[-1][0])
            if gap:
                left += window
            else:
                out.append((tier, window))
    if not last:
        return out, left
    total = sum(len(p[0]) for p in left)
    queue = left[::-1]
    while total:
        size = min(tiers[-1], 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            piece = queue.pop()
            if len(piece[0]) > gap:
                piece, rest = cut(piece, gap)
                queue.append(rest)
            window.append(piece)
            gap -= len(piece[0])
        out.append((size, window))
        total -= size
    return out, []


def step_groups(sequences: list[tuple[int, list[Piece]]], first: int) -> list[int]:
    """A group for each sequence, numbered from ``first``; sequences of one length are dealt to and fro by attention cost."""
    groups = [0] * len(sequences)
    for size in sorted({s for s, _ in sequences}):
        own = [k for k, (s, _) in enumerate(sequences) if s == size]
        own.sort(key=lambda k: -sum(len(p[0]) ** 2 for p in sequences[k][1]))
        n = -(-len(own) * size // STEP)
        for j, k in enumerate(own):
            turn, at = divmod(j, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def _pack_task(json_path: str, ranks_path: str | None, tiers: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        number, group, most = base, base, tiers[-1]

        def rows(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal number, group
            columns: list[list] = [[] for _ in range(9)]
            groups = step_groups(sequences, group)
            group = max([group, *(g + 1 for g in groups)])
            for (size, window), own in zip(sequences, groups, strict=True):
                offset = 0
                for ids, doc, start, n in window:
                    row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset, size, own)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += len(ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        rests: list[Piece] = []
        held = 0
        for part in slices(batches, "text"):
            full: list[tuple[int, list[Piece]]] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                whole = len(ids) // most * most
                full += [(most, [(ids[k : k + most], doc, k, len(ids))]) for k in range(0, whole, most)]
                if whole < len(ids):
                    rests.append((ids[whole:].copy(), doc, whole, len(ids)))
                    held += len(ids) - whole
                if held >= BUFFER:
                    packed, rests = pack(rests, tiers, False)
                    full += packed
                    held = sum(len(p[0]) for p in rests)
            if full:
                yield rows(full)
        packed, _ = pack(rests, tiers, True)
        if packed:
            yield rows(packed)

    return run


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group.

    ``tiers`` are powers of two in rising order.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack_task(json_path, ranks_path, tiers), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` packed with the byte-level vocabulary."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
