"""Removal of repeated word sequences with prefix-partitioned suffix trees.

A suffix is the sequence of words from one place of a document on; two places begin the same WINDOW words if
their suffixes meet at a node of depth WINDOW or more in the suffix tree. Such a node's earliest leaf stays, and the windows
of all its other leaves are repeats; consecutive ones make up maximal repeats, whose words are removed.

1.  The suffixes are thinned: of each window's runs of ANCHOR words the one with the least hash (of equal ones the first) is its anchor; equal windows have
    equal anchors in the same place, and one in seven places is one. Suffixes whose anchor occurs only once in the corpus can have no equal and are left
    out, which needs only the anchors' hashes to move. Exact copies of whole documents are told by their digest before all this.
2.  The other suffixes move by their anchors: a stretch is the words of consecutive suffixes that have one anchor (at most 2 * WINDOW - ANCHOR words for up to
    WINDOW - ANCHOR + 1 suffixes), so each word moves about once and not once a suffix. Stretches are dealt to groups by a prefix of PREFIX words from the anchor on;
    where more than GROUP suffixes would meet in a group, by 2 * PREFIX words. If a group is still too full, its stretches are taken apart into suffixes of WINDOW words, and
    these are dealt by prefixes of their own, PREFIX words longer each time. So a group has at most GROUP suffixes and holds all that can
    be equal. (Suffixes that share all WINDOW words are one leaf path; if they alone fill a group, their least is taken by an aggregation.)
3.  Each group is searched alone. Its words become numbers, and suffixes are ranked by their first 1, 2, 4, .. WINDOW words (prefix doubling): suffixes of equal rank
    are the leaves below a node of depth WINDOW. Words are compared, not hashes.

The trees of step 3 are also built in each task that reads texts, over the suffixes of that task, before any moves: of a deep node's leaves only the earliest
goes on. So a passage in a third of all documents gives a row a task, not a row a document, and the anchors of a task that it met several times go on once.

Defined results: see ``op7_substring_dedup``. A null text has no words, and the digest of the empty text. "Earlier" is the
smaller id, then, for rows that share an id but not their text, an arbitrary but fixed order, then the start. Repeated rows with
equal text are the same document and are treated alike. A null id is later than all others. Documents of less than
WINDOW words are kept whole. Texts are read whole; a task holds one text's words at a time besides some 100 MB. An empty
table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, list_column, slices, text_bytes
from stridemap.llm.words import windows, word_hashes
from stridemap.runtime import BROADCAST_BYTES, KEY, keyed, materialize, small_side

WINDOW, ANCHOR, PREFIX = 20, 8, 4
#: Most suffixes of a group; groups for each such number of suffixes, so that most stay well below it.
GROUP, FINE = 200_000, 16
#: Anchors that a task looks at together; suffixes whose tree it builds, and bytes of their texts.
LOOK, SUFFIXES, HELD = 4_000_000, 1_000_000, 64 << 20
_LAST = 2**63 - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the anchor's hash of each window of one document's words, hashes that stand twice within a window's reach)."""
    grams, _ = windows(hashes, np.array([0, len(hashes)]), ANCHOR)
    near = [grams[d:][grams[d:] == grams[:-d]] for d in range(1, min(WINDOW - ANCHOR + 1, len(grams)))]
    least, done, span = grams, 1, WINDOW - ANCHOR + 1
    while done < span:  # minima over twice as many places each time
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return tuple((x >> np.uint64(1)).view(np.int64) for x in (least, np.concatenate([grams[:0], *near])))


def anchor_places(hashes: np.ndarray) -> np.ndarray:
    """The word at which the anchor of each window of one document's words begins: the first of its least runs."""
    grams, _ = windows(hashes, np.array([0, len(hashes)]), ANCHOR)
    at, done, span = np.arange(len(grams)), 1, WINDOW - ANCHOR + 1
    while done < span:
        step = min(done, span - done)
        left, right = at[:-step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        done += step
    return at


def variant(digest: bytes) -> int:
    """Tells texts of rows that share an id (or have none) apart, by 63 bits of their digest."""
    return int.from_bytes(digest[:8], "little") >> 1


def _documents(batches: Iterator[pa.RecordBatch], most: int = LOOK) -> Iterator[pa.RecordBatch]:
    """id, KEY, v, n_words, sha, and anchors: ``asked`` (met once in this look), ``known`` (met again in it)."""
    held: list[tuple[list[pa.Array], list[int], list[int], list[str], list[np.ndarray]]] = []
    count = 0
    none = np.empty(0, np.int64)

    def look() -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([none, *(a for h in held for a in h[4])])
        keys, counts = np.unique(flat, return_counts=True)
        again = keys[counts > 1]
        for ids, v, n, sha, found in held:
            distinct = [np.unique(a) for a in found]
            sizes = np.array([len(a) for a in distinct])
            values = np.concatenate([none, *distinct])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            known = np.zeros(len(values), bool)
            if len(again):
                known = again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 *(list_column(values[k], np.bincount(owner[k], minlength=len(sizes)), pa.int64()) for k in (~known, known))],
                names=["id", *KEY, "v", "n_words", "sha", "asked", "known"],
            )
        held.clear()

    seen: set[bytes] = set()  # whole texts: their copies are not asked for again
    for part in slices(batches, "text", 1 << 20):
        raw, offsets = text_bytes(part.column("text"))
        data = raw.tobytes()
        hashes, row_words, _ = word_hashes(raw, offsets)
        v, n, sha, found = [], [], [], []
        for k, (a, b) in enumerate(zip(row_words[:-1].tolist(), row_words[1:].tolist(), strict=True)):
            digest = hashlib.sha256(b" ".join(data[offsets[k] : offsets[k + 1]].split())).digest()
            v.append(variant(digest))
            sha.append(digest.hex())
            n.append(b - a)
            if b - a < WINDOW or digest in seen:
                found.append(none)
                continue
            seen.add(digest)
            least, twice = anchors(hashes[a:b])
            runs = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            lengths = np.diff(np.r_[runs, len(least)])
            values = least[runs]  # a run longer than an anchor can serve has it twice
            values = np.concatenate([values, values[lengths > WINDOW - ANCHOR + 1], np.intersect1d(values, twice)])
            found.append(values)
            count += len(values)
        held.append(([part.column(c) for c in ("id", *KEY)], v, n, sha, found))
        if count > most:
            yield from look()
            seen.clear()
            count = 0
    yield from look()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, id, v) of anchors in several rows; a mark (v -1) says that an anchor was met again elsewhere."""
    got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
    if not got:
        return
    a, ids, v = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((v, ids, a))
    a, ids, v = a[order], ids[order], v[order]
    fresh = np.ones(len(a), bool)  # copies of one document ask as that document
    fresh[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1]) | (v[1:] != v[:-1])
    a, ids, v = a[fresh], ids[fresh], v[fresh]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    width = np.diff(np.r_[first, len(a)])
    good = np.repeat(width > 1, width) & (v >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(v[good]), pa.array(a[good])], names=["id", "v", "a"])


def word_numbers(texts: pa.Array) -> np.ndarray:
    """The words of all ``texts`` (parted by one blank) as numbers, end to end: equal words have equal numbers."""
    return pc.split_pattern(texts, " ").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def path_ranks(numbers: np.ndarray) -> np.ndarray:
    """The rank of the WINDOW numbers from each place on, by prefix doubling: equal for equal paths."""
    ranks, done = numbers, 1
    while done < WINDOW:
        step = min(done, WINDOW - done)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        done += step
    return ranks


def later_leaves(node: np.ndarray, ids: np.ndarray, v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which suffixes are not the earliest below their node."""
    order = np.lexsort((start, v, ids, node))
    first = order[np.maximum.accumulate(np.where(np.r_[True, node[order][1:] != node[order][:-1]], np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (v[order] != v[first]) | (start[order] != start[first])
    return out


def runs_of(ids: np.ndarray, v: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """(id, v, start, length) of the runs of consecutive windows among these."""
    order = np.lexsort((start, v, ids))
    ids, v, start = ids[order], v[order], start[order]
    begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1] + 1)][: len(ids)])
    return [ids[begins], v[begins], start[begins], np.diff(np.r_[begins, len(ids)])]


def _suffixes(batches: Iterator[pa.RecordBatch], most: int = SUFFIXES) -> Iterator[pa.RecordBatch]:
    """Suffixes whose anchors were met, after a tree of those of this look: (head, words, id, v, start, length).

    A row with words is a stretch: the words before its anchor, those from it on, and how many suffixes begin in it, the first and the last of
    them the earliest with their words in this look. A row without words is a run of windows that begin earlier in it.
    """
    held: list[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]] = []
    count = size = 0

    def look() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc = np.repeat(np.arange(len(held)), [len(h[4]) for h in held])
        ids, v = (np.array([h[k] for h in held], np.int64)[doc] for k in (0, 1))
        start, place = (np.concatenate([h[k] for h in held]) for k in (4, 5))
        apart = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]
        begins = np.flatnonzero(apart)
        last = np.r_[begins[1:], len(doc)] - 1
        cut = lambda d, a, b: held[d][2][held[d][3][a] : held[d][3][b] - 1]
        texts = [cut(d, a, b + WINDOW) for d, a, b in zip(doc[begins].tolist(), start[begins].tolist(), start[last].tolist(), strict=True)]
        # Each run of windows has WINDOW - 1 more words than windows.
        at = np.arange(len(doc)) + (WINDOW - 1) * (np.cumsum(apart) - 1)
        again = later_leaves(path_ranks(word_numbers(pa.array(texts, pa.binary()).cast(pa.string())))[at], ids, v, start)
        del texts
        stretch = np.cumsum(apart | np.r_[True, place[1:] != place[:-1]])
        fresh = np.flatnonzero(~again)
        edge = stretch[fresh][1:] != stretch[fresh][:-1]
        ones, ends = fresh[np.r_[True, edge]], fresh[np.r_[edge, True]]
        for k in range(0, len(ones), 20_000):
            a, b = ones[k : k + 20_000], ends[k : k + 20_000]
            where = list(zip(doc[a].tolist(), start[a].tolist(), place[a].tolist(), start[b].tolist(), strict=True))
            heads = [held[d][2][held[d][3][s] : held[d][3][p]] for d, s, p, _ in where]
            yield _suffix_rows(heads, [cut(d, p, e + WINDOW) for d, _, p, e in where], ids[a], v[a], start[a], b - a + 1)
        if again.any():
            runs = runs_of(ids[again], v[again], start[again])
            yield _suffix_rows([None] * len(runs[0]), [None] * len(runs[0]), *runs)
        held.clear()

    for part in slices(batches, "text", 1 << 20):
        raw, offsets = text_bytes(part.column("text"))
        hashes, row_words, _ = word_hashes(raw, offsets)
        data = raw.tobytes()
        met = part.column("met")
        met_values, met_ends = met.flatten().to_numpy(zero_copy_only=False), met.offsets.to_numpy() - met.offsets[0].as_py()
        for k, (id_, v) in enumerate(zip(part.column("id").to_pylist(), part.column("v").to_pylist(), strict=True)):
            words = hashes[row_words[k] : row_words[k + 1]]
            if len(words) < WINDOW:
                continue
            known = np.unique(met_values[met_ends[k] : met_ends[k + 1]])
            least, _ = anchors(words)
            start = np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
            if not len(start):
                continue
            own = data[offsets[k] : offsets[k + 1]].split()
            text = b" ".join(own)
            ends = np.r_[0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)]
            held.append((id_, v, text, ends, start.astype(np.int32), anchor_places(words)[start].astype(np.int32)))
            count += len(start)
            size += len(text) + ends.nbytes
        if count > most or size > HELD:
            yield from look()
            count = size = 0
    yield from look()


SUFFIX = "head string, words string, id long, v long, start int, length int"
RUN = "id long, v long, start int, length int"


def _suffix_rows(heads: list[bytes | None], words: list[bytes | None], *columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    numbers = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)]
    texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (heads, words)]
    return pa.RecordBatch.from_arrays([*texts, *numbers], names=["head", "words", "id", "v", "start", "length"])


def _run_table(columns: list[np.ndarray]) -> pa.Table:
    kinds = {"id": pa.int64(), "v": pa.int64(), "start": pa.int32(), "length": pa.int32()}
    return pa.table({name: pa.array(c.astype(k.to_pandas_dtype()), k) for (name, k), c in zip(kinds.items(), columns, strict=True)})


def _stretches(table: pa.Table) -> pa.Table:
    """A group of stretches: all leaves of its deep nodes but the earliest, as runs of windows."""
    texts = pc.binary_join_element_wise(table.column("head"), table.column("words"), "").combine_chunks()
    length = table.column("length").to_numpy().astype(np.int64)
    which = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(which))
    ids, v, start = (table.column(c).to_numpy()[which] for c in ("id", "v", "start"))
    start = start + (at - (np.cumsum(length) - length)[which])
    deep = later_leaves(path_ranks(word_numbers(texts))[at + (WINDOW - 1) * which], ids, v, start)
    return _run_table(runs_of(ids[deep], v[deep], start[deep]))


def repeats(stretches: DataFrame) -> DataFrame:
    """(id, v, start, length) of all windows that begin earlier elsewhere. Groups of more than GROUP suffixes go by longer prefixes, then suffix by suffix."""
    groups = FINE * max(1, -(-(stretches.agg(F.sum("length")).first()[0] or 0) // GROUP))
    group_at = lambda n: F.pmod(F.xxhash64(F.substring_index("words", " ", n)), F.lit(groups))
    out, left = None, stretches
    for depth in (PREFIX, 2 * PREFIX):
        left = left.withColumn("group", group_at(depth))
        full = left.groupBy("group").agg(F.sum("length").alias("k")).where(F.col("k") > GROUP).select("group")
        full = small_side(materialize(full, "full-stretches", few=True), 16)
        found = left.join(full, "group", "left_anti").groupBy("group").applyInArrow(_stretches, RUN)
        out = found if out is None else out.union(found)
        if full.isEmpty():
            return out
        left = left.join(full, "group", "left_semi").drop("group")
    words = left.select("id", "v", "start", F.split(F.concat("head", "words"), " ").alias("w"), F.posexplode(F.sequence(F.lit(1), "length")).alias("k", "at"))
    single = words.select(F.array_join(F.slice("w", F.col("at"), F.lit(WINDOW)), " ").alias("words"), "id", "v", (F.col("start") + F.col("k")).alias("start"))
    return out.union(deep_leaves(materialize(single, "single-suffixes")))


def grouped(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` with the words of their prefix (``depth``) and their group: no more than GROUP share both, below the depth WINDOW."""
    groups = FINE * max(1, -(-suffixes.count() // GROUP))
    group_at = lambda n: F.pmod(F.xxhash64(F.substring_index("words", " ", n)), F.lit(groups))
    out = suffixes.withColumns({"depth": F.lit(PREFIX), "group": group_at(PREFIX)})
    for depth in range(PREFIX, WINDOW, PREFIX):
        full = out.where(F.col("depth") == depth).groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > GROUP)
        full = materialize(full.select("group", F.lit(True).alias("full")), "full-groups", few=True)
        if full.isEmpty():
            break
        deeper = (F.col("depth") == depth) & F.coalesce("full", F.lit(False))
        out = out.join(small_side(full, 16), "group", "left").withColumn("group", F.when(deeper, group_at(depth + PREFIX)).otherwise(F.col("group")))
        out = out.withColumn("depth", F.when(deeper, depth + PREFIX).otherwise(F.col("depth"))).drop("full")
    return out


def suffix_order(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(order of suffixes by their words, words that each has in common with the one before it) of rows of WINDOW words."""
    numbers = pc.split_pattern(words, " ").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).reshape(-1, WINDOW)
    order = np.lexsort(numbers.T[::-1])
    same = numbers[order[1:]] == numbers[order[:-1]]
    common = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
    return order, np.r_[0, common] if len(order) else common


def _subtree(table: pa.Table) -> pa.Table:
    """A group of suffixes: all leaves of its deep nodes but the earliest, as runs of one window."""
    order, common = suffix_order(table.column("words").combine_chunks())
    ids, v, start = (table.column(c).to_numpy()[order] for c in ("id", "v", "start"))
    deep = later_leaves(np.cumsum(common < WINDOW), ids, v, start)  # leaves below one node of depth WINDOW
    return _run_table([ids[deep], v[deep], start[deep], np.ones(int(deep.sum()))])


def deep_leaves(suffixes: DataFrame) -> DataFrame:
    """(id, v, start, length): all suffixes whose WINDOW words begin earlier elsewhere."""
    dealt = grouped(suffixes)
    out = dealt.where(F.col("depth") < WINDOW).groupBy("depth", "group").applyInArrow(_subtree, RUN)
    paths = dealt.where(F.col("depth") >= WINDOW)
    at = F.struct("id", "v", "start")
    firsts = paths.groupBy("words").agg(F.min(at).alias("least"))
    total = firsts.agg(F.sum(F.octet_length("words") + 48)).first()[0] or 0  # whole paths that fill a group: few
    rest = paths.join(_sided(firsts, total), "words").where(at != F.col("least"))
    return out.union(rest.select("id", "v", "start", F.lit(1)))


def merged(runs: DataFrame) -> DataFrame:
    """Runs of windows (id, v, start, length) -> (id, v, starts, ends): each document's maximal spans of words to remove."""
    runs = runs.select("id", "v", "start", (F.col("start") + F.col("length") + (WINDOW - 1)).alias("end"))
    order = Window.partitionBy("id", "v").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = runs.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "v", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("id", "v").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return spans.select("id", "v", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of documents with spans to remove."""
    for part in slices(batches, "text", 1 << 20):
        out: list[tuple[int, int, int, str]] = []
        texts = pc.cast(part.column("text"), pa.binary()).to_pylist()
        columns = (part.column(c).to_pylist() for c in ("id", "v", "starts", "ends"))
        for text, id_, v, starts, ends in zip(texts, *columns, strict=True):
            words = text.split()
            kept, at = [], 0
            for a, b in zip(starts, ends, strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((id_, v, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            names=["id", "v", "removed", "left_sha"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, starts and ends of the removed spans (in words). ``scan``: see ``keyed``."""
    bounded(docs)
    most, least = LOOK, SUFFIXES
    rows = keyed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), scan=scan)
    base = rows.mapInArrow(
        lambda batches: _documents(batches, most),
        "id long, row_file long, row_at long, v long, n_words long, sha string, asked array<long>, known array<long>",
    )
    base = materialize(base.withColumnRenamed("id", "own").withColumn("id", F.coalesce("own", F.lit(_LAST))), "documents")
    # A document is an id and a text; the first of its rows is read for it.
    one_row = base.groupBy("id", "v").agg(F.min(F.struct(*KEY)).alias("row")).select("id", "v", "row.*")
    # Copies of whole documents: all their windows begin earlier in the first of them.
    copies = base.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = small_side(materialize(copies.select(F.col("sha").alias("of"), "first"), "copies", few=True), 100)
    base = base.join(copies, F.col("sha") == F.col("of"), "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    base = base.withColumn("first", F.coalesce("first", "id")).drop("of")
    # Anchors in more than one place. A copy's anchors are those of the first of its documents, whichever row sent them.
    asked = base.select(F.explode("asked").alias("a"), F.col("first").alias("id"), "v")
    marks = base.select(F.explode("known").alias("a")).distinct().select("a", F.lit(0).cast("long"), F.lit(-1).cast("long"))
    met = asked.union(marks).repartition("a").mapInArrow(_met, "id long, v long, a long")
    known = base.select(F.col("first").alias("id"), "v", F.explode("known").alias("a"))
    met = met.union(known).groupBy("id", "v").agg(F.collect_set("a").alias("met"))
    met = materialize(met.join(one_row, ["id", "v"]), "met", few=True)
    total = met.agg(F.sum(48 + 8 * F.size("met"))).first()[0] or 0
    some = _sided(met, total)
    texts = rows.drop("id").join(some, KEY).select("id", "v", "text", "met")
    found = materialize(texts.mapInArrow(lambda batches: _suffixes(batches, least), SUFFIX), "suffixes")
    runs = repeats(found.where("words is not null")).union(found.where("words is null").select("id", "v", "start", "length"))
    spans = materialize(merged(runs), "spans", few=True)
    total = spans.agg(F.sum(64 + 8 * F.size("starts"))).first()[0] or 0
    some = _sided(spans.join(one_row, ["id", "v"]), total)
    left = rows.drop("id").join(some, KEY).select("id", "v", "text", "starts", "ends").mapInArrow(_kept, "id long, v long, removed long, left_sha string")
    left = materialize(left, "left", few=True)
    out = base.drop("asked", "known", "first", *KEY).join(left, ["id", "v"], "left").join(spans, ["id", "v"], "left")
    whole = lambda n: F.array(F.lit(n).cast("int"))
    return out.select(
        F.col("own").alias(id_col), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole(0)).otherwise(F.coalesce("starts", F.expr("cast(array() as array<int>)"))).alias("starts"),
        F.when(F.col("copy"), F.array(F.col("n_words").cast("int"))).otherwise(F.coalesce("ends", F.expr("cast(array() as array<int>)"))).alias("ends"),
    )


def _sided(df: DataFrame, total_bytes: int) -> DataFrame:
    """A broadcast hint while the measured bytes stay under the limit."""
    return F.broadcast(df) if total_bytes <= BROADCAST_BYTES else df


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words over all documents."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True).drop("starts", "ends")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS g FROM t),
f AS (SELECT doc_id, i, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
