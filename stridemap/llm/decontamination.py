"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of characters other than white space and ASCII punctuation, A-Z as a-z. A seed is three words in their order within four
places, so that it outlives a word put in, left out or replaced between them; an item with fewer words is one seed.

1.  A first pass over all documents counts in how many documents each seed of the benchmark occurs. Of an item's seeds that occur at
    all the rarer two thirds stay (four at least), and whatever else occurs in at most one of RARE documents, so that each item keeps seeds
    even if it leaked into very many documents.
2.  A second pass looks the remaining seeds up; its hits meet the items by an equi-join on the seed. Where two different seeds of an item lie together
    (one, if it has no more), a passage of the document is cut out around them.
3.  Only these passages meet their items' words, and are aligned word by word. The score is the alignment's, of the item's with itself;
    pairs from THRESHOLD on are returned.

Both passes tell most other word triples by a bitmap of the seeds' hashes of fixed size (1 MB, whatever the benchmark's size), so that next to nothing but seeds moves. Seeds,
items and passages are tables; what is broadcast of them is measured first. A seed or item in a third of all documents is a hot key on the
side of the documents only, whose join Spark splits; all later steps are keyed by document and item.

What is missed: an item of fewer words than a seed is found only where it stands whole. A longer item's pair whose score reaches THRESHOLD is not found without two different kept seeds within about one and a half lengths
of the item. An alignment of L words with e edits has runs of matching words between the edits; a seed is lost only if two edits fall within four places of it.
``tests/llm/test_leaks.py`` measures the share found of all pairs that the alignment alone would return, for copies with words replaced, put in, left out
and moved; the README gives it.

Defined results: a null text has no words and no row; nor has a null, empty or wordless item. Repeated rows of documents
or items give a row for each pair of rows. A null id is returned as null. An empty table on either side gives no rows. Ties: of
equally good passages the first one's span is returned. Texts are read whole. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, list_column, slices, text_bytes
from stridemap.llm.words import mix, word_hashes
from stridemap.runtime import BROADCAST_BYTES, KEY, keyed, materialize, small_side

#: Words of a seed, and their places from the first one's; a seed in at most one of so many documents is rare.
SEED, PLACES, RARE = 3, ((1, 2), (1, 3), (2, 3)), 1000
#: Least score of a pair, as a share of the item's score with itself.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the seeds' bitmap as a power of two; seeds that a task counts before it sends them on.
BITS, LOOK = 23, 1_000_000

_WEIGHTS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def seeds_of(hashes: np.ndarray, row_words: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(seed, word at which it begins) of rows of words; ``size`` under SEED gives runs of so many words."""
    n = len(hashes)
    row_end = np.repeat(row_words[1:], np.diff(row_words))
    seeds, places = [], []
    for steps in PLACES if size == SEED else [tuple(range(1, size))]:
        last = steps[-1] if steps else 0
        at = np.arange(max(0, n - last))
        at = at[at + last < row_end[: len(at)]]
        total = hashes[at] * _WEIGHTS[0] + np.uint64(size)
        for k, step in enumerate(steps, 1):
            total = total + hashes[at + step] * _WEIGHTS[k]
        seeds.append(mix(total))
        places.append(at)
    return np.concatenate(seeds), np.concatenate(places)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, word after the last) of the best local alignment of ``item`` within ``passage``."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    score, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(row[1:] == 0, begin[1:], np.where(row[1:] == diagonal, start[:-1], start[1:]))
        lifted = row + steps  # gaps along the passage: the greatest lifted score so far, less the way since
        reach = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        along = reach - steps
        begin = np.where(along > row, begin[came], begin)
        score, start = np.maximum(row, along), begin
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, item_id, n, words of items that have any."""
    for part in slices(batches, "text", 1 << 20):
        raw, offsets = text_bytes(part.column("text"))
        hashes, row_words, _ = word_hashes(raw, offsets, "folded")
        sizes = np.diff(row_words)
        some = pa.array(np.flatnonzero(sizes))
        yield pa.RecordBatch.from_arrays(
            [part.column("item").take(some), part.column("item_id").take(some), pa.array(sizes[sizes > 0]), list_column(hashes.view(np.int64), sizes[sizes > 0], pa.int64())],
            names=["item", "item_id", "n", "words"],
        )


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, n, seed, and the first and last word of the item at which the seed begins."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for item, words in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
            hashes = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            seeds, at = seeds_of(hashes, np.array([0, len(hashes)]), min(SEED, len(hashes)))
            order = np.lexsort((at, seeds))
            distinct, first = np.unique(seeds[order], return_index=True)
            last = np.r_[first[1:], len(seeds)] - 1
            for column, values in zip(columns, (np.full(len(distinct), item), np.full(len(distinct), len(hashes)), distinct.view(np.int64), at[order][first], at[order][last]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for c in columns], names=["item", "n", "seed", "first", "last"])


def bitmap(seeds: DataFrame) -> bytes:
    """Packed bits: which values the top BITS bits of the seeds take. 2**15 bits a row, 2**(BITS - 15) rows at most."""
    top = F.shiftrightunsigned("seed", 64 - BITS)
    rows = seeds.groupBy(F.shiftright(top, 15).alias("k")).agg(F.bitmap_construct_agg(top.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


Lookup = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _lookup(bits: bytes, sizes: list[int]) -> Lookup:
    """Of a slice's texts: (row, word in the row, seed) of what may be a seed, and the rows' words."""
    set_ = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)

    def look(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(texts)
        hashes, row_words, _ = word_hashes(raw, offsets, "folded")
        seeds, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for size in sizes:
            found, place = seeds_of(hashes, row_words, size)
            good = set_[(found >> np.uint64(64 - BITS)).astype(np.int64)]
            seeds.append(found[good])
            at.append(place[good])
        places = np.concatenate(at)
        row = np.searchsorted(row_words, places, side="right") - 1
        return row, places - row_words[row], np.concatenate(seeds).view(np.int64), row_words

    return look


def _counts(bits: bytes, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seed, n): documents that hold it, summed over a look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(bits, sizes)
        seeds, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in slices(batches, "text", 1 << 20):
            row, _, found, _ = look(part.column("text"))
            order = np.lexsort((row, found))
            row, found = row[order], found[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            seeds, at = np.unique(np.concatenate([seeds, found[fresh]]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, np.ones(int(fresh.sum()))]), minlength=len(seeds)).astype(np.int64)
            if len(seeds) > LOOK:
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(counts)], names=["seed", "n"])
                seeds, counts = seeds[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(counts)], names=["seed", "n"])

    return run


def _hits(bits: bytes, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(KEY, at, seed) of what may be a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(bits, sizes)
        for part in slices(batches, "text", 1 << 20):
            row, at, seed, _ = look(part.column("text"))
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(owner) for k in KEY), pa.array(at, pa.int64()), pa.array(seed)], names=[*KEY, "at", "seed"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each of a document's spans: id, KEY, item, low, passage."""
    for part in slices(batches, "text", 1 << 20):
        raw, offsets = text_bytes(part.column("text"))
        hashes, row_words, _ = word_hashes(raw, offsets, "folded")
        owner, items, lows, cut = [], [], [], [np.empty(0, np.uint64)]
        for k, spans in enumerate(part.column("spans").to_pylist()):
            words = hashes[row_words[k] : row_words[k + 1]]
            for span in spans:
                owner.append(k)
                items.append(span["item"])
                lows.append(max(0, span["low"]))
                cut.append(words[max(0, span["low"]) : span["high"]])
        of = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c).take(of) for c in ("id", *KEY)), pa.array(items, pa.int64()), pa.array(lows, pa.int64()),
             list_column(np.concatenate(cut).view(np.int64), np.array([len(c) for c in cut[1:]], np.int64), pa.int64())],
            names=["id", *KEY, "item", "low", "passage"],
        )


def _aligned(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores, firsts, ends = [], [], [], []
            for k, (low, words, passage) in enumerate(zip(batch.column("low").to_pylist(), batch.column("words"), batch.column("passage"), strict=True)):
                words, passage = (x.values.to_numpy(zero_copy_only=False) for x in (words, passage))
                if np.isin(words, passage).sum() < threshold * len(words):  # more than these positions can't match
                    continue
                score, a, b = align(words, passage)
                if score >= threshold * MATCH * len(words):
                    keep.append(k)
                    scores.append(score / (MATCH * len(words)))
                    firsts.append(low + a)
                    ends.append(low + b)
            of = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("id", *KEY, "item", "item_id")), pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())],
                names=["id", *KEY, "item", "item_id", "score", "first_word", "end_word"],
            )

    return run


PAIRS = "id long, row_file long, row_at long, item long, item_id long, score double, first_word long, end_word long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", scan: bool = False,
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score (0 to 1), first_word, end_word. ``scan``: see ``keyed``."""
    rows = keyed(bounded(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), scan=scan)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    return leaks(rows, items, threshold).select(F.col("id").alias("doc_id"), "item_id", "score", "first_word", "end_word")


def leaks(rows: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, text, KEY) and items (item_id, text) -> PAIRS, the best passage of each document and item."""
    items = items.where(F.col("text").isNotNull()).withColumn("item", F.monotonically_increasing_id())
    items = materialize(items.mapInArrow(_item_rows, "item long, item_id long, n long, words array<long>"), "items", few=True)
    seeds = items.select("item", "words").mapInArrow(_item_seeds, "item long, n long, seed long, first long, last long")
    seeds = materialize(seeds, "seeds", few=True)
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(SEED)).cast("int")).distinct().collect())  # SEED values at most
    bits = bitmap(seeds)
    counts = rows.select("text").mapInArrow(_counts(bits, sizes), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("df"))
    documents = rows.count()
    counts = materialize(counts.join(seeds.select("seed").distinct(), "seed", "left_semi"), "seed-counts", few=True)
    met = seeds.join(counts, "seed")
    of_item = Window.partitionBy("item")
    met = met.withColumns({"rank": F.row_number().over(of_item.orderBy("df", "first", "seed")), "total": F.count("*").over(of_item)})
    met = met.where((F.col("df") * RARE <= documents) | (F.col("rank") <= F.greatest(F.ceil(F.col("total") * 2 / 3), F.lit(4))))
    met = met.select("seed", "item", "n", "first", "last", F.least(F.count("*").over(of_item), F.lit(2)).alias("need"))
    kept = materialize(met, "kept-seeds", few=True)
    hits = rows.select("text", *KEY).mapInArrow(_hits(bitmap(kept), sizes), "row_file long, row_at long, at long, seed long").join(small_side(kept, 56), "seed")
    spans = materialize(passages(hits), "passages", few=True)
    total = spans.agg(F.sum(24 + 24 * F.size("spans"))).first()[0] or 0
    cut = rows.join(F.broadcast(spans) if total <= BROADCAST_BYTES else spans, KEY).select("id", "text", *KEY, "spans")
    cut = cut.mapInArrow(_passages, "id long, row_file long, row_at long, item long, low long, passage array<long>")
    total = items.agg(F.sum(24 + 8 * F.size("words"))).first()[0] or 0
    words = items.select("item", "item_id", "words")
    both = cut.join(F.broadcast(words) if total <= BROADCAST_BYTES else words, "item")
    found = both.mapInArrow(_aligned(threshold), PAIRS)
    best = F.max_by(F.struct("id", "item_id", "score", "first_word", "end_word"), F.struct("score", -F.col("first_word")))
    return found.groupBy(*KEY, "item").agg(best.alias("best")).select("best.id", *KEY, "item", "best.item_id", "best.score", "best.first_word", "best.end_word")


def passages(hits: DataFrame) -> DataFrame:
    """Hits (KEY, item, n, need, at, seed, first, last) -> (KEY, spans of words, each of an item, in which enough different seeds lie together)."""
    half = F.floor(F.col("n") / 2)
    hits = hits.withColumns({"low": F.col("at") - F.col("last") - half, "high": F.col("at") - F.col("first") + F.col("n") + half + 4})
    pair = Window.partitionBy(*KEY, "item").orderBy("at", "seed")
    before = F.lag(F.struct("at", "seed", "low")).over(pair)
    hits = hits.withColumn("before", before)
    together = (F.col("before.seed") != F.col("seed")) & (F.col("at") - F.col("before.at") <= F.col("n") + half + 4)
    near = hits.where((F.col("need") == 1) | together).withColumn("low", F.when(together, F.least("low", "before.low")).otherwise(F.col("low")))
    order = Window.partitionBy(*KEY, "item").orderBy("low", "high")
    apart = F.coalesce(F.col("low") > F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    near = near.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = near.groupBy(*KEY, "item", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("item", "low", "high")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a passage of the benchmark."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark, scan=True)
