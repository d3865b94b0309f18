"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Documents are the rows and word shingles the columns of an incidence matrix; the overlap of two documents is an entry of the
product with its transpose. The product is never formed whole:

1.  Documents with equal shingle sets are one class. Of each class only the first PREFIX part of its shingles, in
    the order of their hashes, goes into the product (two linked documents share at least a twelfth there).
2.  Columns are dealt into blocks by their hash. A block multiplies its columns of up to WIDE classes and sums the overlap
    counts of pairs; the counts of all blocks are added up, and pairs below the bound that their sizes imply are discarded.
3.  Wider columns (a line or passage in very many documents) are left out of the product. A pair can only be missed so if
    both classes have at least a sixteenth of their size in wide columns of the first product. A second product takes these classes
    with all their columns: there a pair's overlap is known but for wide columns, and those hold no more than the smaller of its two
    counts of them, so that pairs below the bound go again. Pairs whose whole overlap is wide need three quarters of each class, and six sevenths of
    one of the two, in wide columns: such classes, which are next to all of a kind, are tied along the first of their wide columns, one edge a class.
4.  The connected components of all ties are candidates. The whole sets of a candidate's classes, and only theirs, come
    together once, where a search finds the exact components: each class found is compared with all classes that are not
    reached yet, through an inverted index of their rarest shingles. A candidate above CAP shingles is split into blocks by size and
    hash: each block is searched alone, then the largest findings of the blocks together. What is then not in the candidate's largest
    component is held, CAP shingles at a time, against each block of sizes that could link. No search holds more than twice CAP (and one class).

A column is never gathered whole: a task that meets more than LOCAL classes in a column sends a mark in their place.

Shingle hashes have 63 bits; two documents would have to share a false one to be misjudged, which for texts of a million words
has a chance below 1e-6 per pair. Classes are 63-bit digests, checked against a second digest: a clash raises.

Defined results: see ``op6_ngram_join``. A null text has no words. Documents with fewer than N words have one shingle, their whole sequence;
those without words have none and are linked with nothing. Repeated rows and null ids get a row each; rows with one id are nodes
of their own. ``component_id`` is the smallest id of the component, null if it has none. Texts are read whole. An
empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, list_column, slices, text_bytes
from stridemap.operators.components import connected_components
from stridemap.llm.words import windows, word_hashes
from stridemap.runtime import KEY, keyed, materialize, small_side

#: Words of a shingle. Two sets link if 7 * intersection >= 3 * (sum of sizes), which is a Jaccard similarity of 0.75.
N = 5
#: Most classes of a column in the product, and of one task's column; postings between two looks at a task's columns.
WIDE, LOCAL, LOOK = 96, 24, 8_000_000
#: Most shingles of a block of a candidate; a block's classes differ in size by less than the factor BAND, which is more than links allow.
CAP, BAND = 300_000, 1.4


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles of a set of ``n`` that go into the product: a third, rounded up, and one."""
    return np.minimum((n + 2) // 3 + 1, n)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of ``n`` and ``m``."""
    return (3 * (n + m) + 6) // 7


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text of a slice."""
    raw, offsets = text_bytes(column)
    hashes, row_words, _ = word_hashes(raw, offsets, "lower")
    grams, _ = windows(hashes, row_words, N)
    for a, b in zip(row_words[:-1].tolist(), row_words[1:].tolist(), strict=True):
        if b - a >= N:
            yield np.unique((grams[a : b - N + 1] >> np.uint64(1)).view(np.int64))
        elif b > a:
            one, _ = windows(hashes[a:b], np.array([0, b - a]), b - a, salt=1 + b - a)
            yield (one >> np.uint64(1)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two 63-bit digests of a set."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little") >> 1, int.from_bytes(digest[8:], "little") >> 1


def _sets(batches: Iterator[pa.RecordBatch], local: int = LOCAL, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """id, KEY, n, cls, check; for the first row of a class in its look also the prefix (or all of it), parted into narrow and wide columns.

    ``marks`` names each wide column of a look once, in the first row that has it.
    """
    held: list[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
    seen: set[int] = set()
    postings = 0

    def look() -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([np.empty(0, np.int64), *(p for h in held for p in h[4])])
        keys, counts = np.unique(flat, return_counts=True)
        wide = keys[counts > local]
        told = np.zeros(len(wide), bool)
        for ids, n, cls, check, prefixes in held:
            sizes = np.array([len(p) for p in prefixes])
            values = np.concatenate([np.empty(0, np.int64), *prefixes])
            is_wide, is_new = np.zeros(len(values), bool), np.zeros(len(values), bool)
            if len(wide):
                at = np.minimum(np.searchsorted(wide, values), len(wide) - 1)
                is_wide = wide[at] == values
                met, first = np.unique(at[is_wide], return_index=True)
                is_new[np.flatnonzero(is_wide)[first[~told[met]]]] = True
                told[met] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(n), pa.array(cls), pa.array(check),
                 list_column(values[~is_wide], np.bincount(owner[~is_wide], minlength=len(sizes)), pa.int64()),
                 list_column(values[is_wide], np.bincount(owner[is_wide], minlength=len(sizes)), pa.int64()),
                 list_column(values[is_new], np.bincount(owner[is_new], minlength=len(sizes)), pa.int64())],
                names=["id", *KEY, "n", "cls", "check", "narrow", "wide", "marks"],
            )
        held.clear()
        seen.clear()

    none = np.empty(0, np.int64)
    for part in slices(batches, "text", 1 << 20):
        n, cls, check, prefixes = [], [], [], []
        for shingles in shingle_sets(part.column("text")):
            a, b = class_of(shingles)
            n.append(len(shingles))
            cls.append(a)
            check.append(b)
            prefixes.append(none if a in seen else shingles if whole else shingles[: prefix_size(len(shingles))])
            postings += len(prefixes[-1])
            seen.add(a)
        held.append(([part.column(c) for c in ("id", *KEY)], np.array(n, np.int64), np.array(cls, np.int64), np.array(check, np.int64), prefixes))
        if postings > LOOK:
            yield from look()
            postings = 0
    yield from look()


def _block_product(batches: Iterator[pa.RecordBatch], widest: int = WIDE) -> Iterator[pa.RecordBatch]:
    """A block of columns (s, cls, n; a mark has n 0): overlap counts of pairs, and the classes of wide columns.

    Rows out: (a, b, na, nb, c) for a pair; (a, s, na, 0, 0) for a class a in a wide column s.
    """
    got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
    if not got:
        return
    s, cls, n = (np.concatenate([g[k] for g in got]) for k in range(3))
    names, who = np.unique(cls, return_inverse=True)
    size = np.zeros(len(names), dtype=np.int64)
    np.maximum.at(size, who, n)
    order = np.lexsort((who, s))
    s, who, mark = s[order], who[order], (n == 0)[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    s, who, mark = s[fresh], who[fresh], mark[fresh]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    width = np.diff(np.r_[first, len(s)])
    marked = np.add.reduceat(mark, first) > 0
    is_wide = marked | (width > widest)
    rows = np.flatnonzero(np.repeat(is_wide, width) & ~mark)
    if len(rows):
        yield _rows(names[who[rows]], s[rows], size[who[rows]], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
    total, m = (np.empty(0, np.int64), np.empty(0, np.int64)), len(names)
    pending: list[np.ndarray] = []
    held = 0

    def summed(total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.unique(np.concatenate(pending), return_counts=True)
        codes, at = np.unique(np.concatenate([total[0], codes]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([total[1], counts]), minlength=len(codes)).astype(np.int64)

    for w in range(2, widest + 1):
        at = first[(width == w) & ~is_wide]
        i, j = np.triu_indices(w, 1)
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            members = who[at[k : k + step, None] + np.arange(w)]
            a, b = members[:, i].ravel(), members[:, j].ravel()  # a < b, as members are in order
            fits = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
            pending.append(a[fits] * m + b[fits])
            held += int(fits.sum())
            if held > 8_000_000:
                total, held = summed(total), 0
                pending.clear()
    if pending:
        total = summed(total)
    for k in range(0, len(total[0]), 500_000):
        a, b = total[0][k : k + 500_000] // m, total[0][k : k + 500_000] % m
        yield _rows(names[a], names[b], size[a], size[b], total[1][k : k + 500_000])


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "na", "nb", "c"])


def exact_components(sets: list[np.ndarray]) -> np.ndarray:
    """A component number for each set: the least index of a set that links reach."""
    count = len(sets)
    label = np.full(count, -1, dtype=np.int64)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *sets])
    _, flat, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))  # rare shingles first
    flat = rank[flat]
    ends = np.r_[0, np.cumsum(sizes)]
    own = [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    flat = np.concatenate([np.empty(0, np.int64), *own])
    heads = [x[: len(x) - -(-3 * len(x) // 4) + 1] for x in own]  # linked sets share one of these
    inside = np.zeros(len(df), dtype=bool)

    def index(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([np.empty(0, np.int64), *(heads[k] for k in rows)])
        who = np.repeat(rows, [len(heads[k]) for k in rows])
        order = np.argsort(values, kind="stable")
        return who[order], np.searchsorted(values[order], np.arange(len(df) + 1))

    left = count
    who, start = index(np.arange(count))
    indexed = count
    for root in range(count):
        if label[root] >= 0:
            continue
        label[root] = root
        left -= 1
        queue = [root]
        while queue and left:
            x = queue.pop()
            if left * 2 < indexed and indexed > 64:  # only those not yet reached stay in the index
                rest = np.flatnonzero(label < 0)
                who, start = index(rest)
                indexed = len(rest)
            h = heads[x]
            near = np.concatenate([np.empty(0, np.int64), *(who[start[v] : start[v + 1]] for v in h.tolist())])
            near = near[label[near] < 0]
            near = near[4 * np.minimum(sizes[near], sizes[x]) >= 3 * np.maximum(sizes[near], sizes[x])]
            if not len(near):
                continue
            near = np.unique(near)
            inside[own[x]] = True
            for k in range(0, len(near), 2048):
                some = near[k : k + 2048]
                lengths = sizes[some]
                firsts = np.r_[0, np.cumsum(lengths)[:-1]]
                positions = np.arange(lengths.sum()) + np.repeat(ends[some] - firsts, lengths)
                overlap = np.add.reduceat(inside[flat[positions]].astype(np.int64), firsts)
                linked = some[7 * overlap >= 3 * (sizes[x] + lengths)]
                label[linked] = root
                left -= len(linked)
                queue += linked.tolist()
            inside[own[x]] = False
    return label


def _resets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of wanted classes again, from their texts."""
    for part in slices(batches, "text", 1 << 20):
        wanted = part.column("cls").to_numpy(zero_copy_only=False)
        keep, values = [], []
        for k, shingles in enumerate(shingle_sets(part.column("text"))):
            if class_of(shingles)[0] == wanted[k]:
                keep.append(k)
                values.append(shingles)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("candidate").take(rows), part.column("block").take(rows), part.column("cls").take(rows),
             list_column(np.concatenate([np.empty(0, np.int64), *values]), np.array([len(v) for v in values], np.int64), pa.int64())],
            names=["candidate", "block", "cls", "shingles"],
        )


def _search(table: pa.Table) -> pa.Table:
    """Exact components among the sets of one group: a tie from each class to the first of its component."""
    cls = table.column("cls").to_numpy()
    _, once = np.unique(cls, return_index=True)
    table, cls = table.take(pa.array(once)), cls[once]
    column = table.column("shingles").combine_chunks()
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    label = exact_components([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return pa.table({"candidate": table.column("candidate"), "block": table.column("block"), "a": cls, "b": cls[label]})


TIES = "candidate long, block long, a long, b long"
SETS = "id long, row_file long, row_at long, n long, cls long, check long, narrow array<long>, wide array<long>, marks array<long>"
PIECES = "candidate long, block long, cls long, shingles array<long>"


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, class_id (equal shingle sets; null without shingles). ``scan``: see ``keyed``."""
    rows = keyed(bounded(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), scan=scan)
    return labelled(rows).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("cls").alias("class_id"))


def labelled(rows: DataFrame) -> DataFrame:
    """Rows (id, text, KEY) -> id, KEY, n_shingles, cls, component_id, first: whether it is the component's row with the smallest id, nulls last, then KEY."""
    local = LOCAL
    sets = materialize(rows.mapInArrow(lambda batches: _sets(batches, local), SETS), "sets")
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", *KEY)
    classes = sets.where("n > 0").groupBy("cls").agg(F.min(row).alias("rep"), F.first("n").alias("n"), (F.min("check") == F.max("check")).alias("one"))
    classes = materialize(classes.withColumn("one", F.expr("if(one, one, raise_error('two shingle sets share a class digest'))")), "classes", few=True)
    ties = candidate_ties(rows, sets, classes)
    links = materialize(exact_ties(rows, classes, ties), "links", few=True)
    components = connected_components(links)
    named = classes.select("cls", "rep").join(components.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    labels = named.join(least, "component").select("cls", "least")
    some = sets.where("n > 0").select("id", *KEY, "n", "cls").join(labels, "cls")
    some = some.select("id", *KEY, F.col("n").alias("n_shingles"), "cls", F.col("least.id").alias("component_id"), (row == F.col("least")).alias("first"))
    none = sets.where("n = 0").select("id", *KEY, F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("cls"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return some.union(none)


def product(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of SETS -> (pairs of classes with their overlap in narrow columns: a, b, na, nb, c; each class's wide columns: cls, n, h, cols)."""
    narrow = sets.where(F.size("narrow") > 0).select(F.explode("narrow").alias("s"), "cls", "n")
    marks = sets.where(F.size("marks") > 0).select(F.explode("marks").alias("s")).distinct()
    columns = narrow.union(marks.select("s", F.lit(-1).cast("long"), F.lit(0).cast("long")))
    widest = WIDE
    blocks = columns.repartition("s").mapInArrow(lambda batches: _block_product(batches, widest), "a long, b long, na long, nb long, c long")
    blocks = materialize(blocks, "products", few=True)
    met = blocks.where("nb = 0").select(F.col("a").alias("cls"), F.array("b").alias("cols"), F.col("na").alias("n"))
    met = met.union(sets.where(F.size("wide") > 0).select("cls", "wide", "n")).groupBy("cls").agg(F.first("n").alias("n"), F.collect_list("cols").alias("cols"))
    met = met.withColumn("cols", F.array_distinct(F.flatten("cols"))).select("cls", "n", F.size("cols").alias("h"), "cols")
    pairs = blocks.where("nb > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pairs, materialize(met, "widths", few=True)


def _with_widths(pairs: DataFrame, widths: DataFrame) -> DataFrame:
    """``pairs`` with the counts ha, hb of their classes' wide columns."""
    h = small_side(widths.select(F.col("cls").alias("k"), "h"), 16)
    for side in "ab":
        pairs = pairs.join(h.withColumnsRenamed({"k": f"k{side}", "h": f"h{side}"}), F.col(side) == F.col(f"k{side}"), "left").drop(f"k{side}")
    return pairs.fillna(0, ["ha", "hb"])


def candidate_ties(rows: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ties between classes such that all linked classes are connected by them."""
    pairs, widths = product(sets)
    overlap = F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7)
    first = lambda n: F.least(F.floor((n + 2) / 3) + 1, n)
    broad = lambda h, n: F.col(h) >= F.floor(F.col(n) / 16) + 1
    bound = F.least(overlap - F.col("na") + first(F.col("na")), overlap - F.col("nb") + first(F.col("nb")))
    pairs = _with_widths(pairs, widths).where(~(broad("ha", "na") & broad("hb", "nb")))
    kept = materialize(pairs.where(F.col("c") + F.least("ha", "hb") >= bound).select("a", "b"), "narrow", few=True)
    wanted = materialize(widths.where(broad("h", "n")).select("cls").join(classes.select("cls", *(f"rep.{k}" for k in KEY)), "cls"), "broad", few=True)
    if wanted.isEmpty():
        return kept
    local = LOCAL
    texts = rows.join(small_side(wanted.drop("cls"), 24), KEY, "left_semi").select("id", "text", *KEY)
    again = materialize(texts.mapInArrow(lambda batches: _sets(batches, local, whole=True), SETS), "broad-sets")
    pairs, widths = product(again)
    kept = kept.union(_with_widths(pairs, widths).where(F.col("c") + F.least("ha", "hb") >= overlap).select("a", "b"))
    # Two classes that share three quarters of each share one of the first so many of their wide columns.
    covered = widths.where("4 * h >= 3 * n").withColumn("cols", F.expr("slice(array_sort(cols), 1, greatest(0, int(h - ceil(3 * n / 4) + 1)))"))
    among = covered.select("cls", (F.col("h") * 7 >= F.col("n") * 6).alias("tight"), F.explode("cols").alias("s"))
    among = materialize(among, "covered", few=True)
    hubs = among.where("tight").groupBy("s").agg(F.min("cls").alias("hub"))
    stars = among.join(hubs, "s").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    return kept.union(stars)


def searched(pieces: DataFrame, name: str) -> DataFrame:
    """The links within each (candidate, block) of PIECES."""
    return materialize(pieces.groupBy("candidate", "block").applyInArrow(_search, TIES), name, few=True)


def exact_ties(rows: DataFrame, classes: DataFrame, ties: DataFrame) -> DataFrame:
    """(a, b): ties that connect exactly the linked classes."""
    found = connected_components(ties).select(F.col("node").alias("cls"), F.col("component").alias("candidate"))
    wanted = materialize(found.join(classes, "cls").select("cls", "candidate", *(f"rep.{k}" for k in KEY), "n"), "wanted", few=True)
    large = wanted.groupBy("candidate").agg(F.sum("n").alias("total")).where(F.col("total") > CAP)
    large = small_side(materialize(large.select("candidate", F.lit(True).alias("large")), "large", few=True), 16)
    wanted = wanted.join(large, "candidate", "left").fillna(False, ["large"])
    wanted = wanted.withColumn("band", F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))).otherwise(F.lit(0)))
    parts = wanted.where("large").groupBy("candidate", "band").agg(F.ceil(F.sum("n") * 1.5 / CAP).alias("parts"))
    parts = small_side(materialize(parts, "parts", few=True), 32)
    wanted = wanted.join(parts, ["candidate", "band"], "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))))
    wanted = materialize(wanted.withColumn("block", F.col("band") * PARTS + F.col("part")).drop("parts", "part"), "blocks", few=True)
    chosen = small_side(wanted.select("cls", "candidate", "block", *KEY), 40)
    texts = rows.join(chosen, KEY).select("candidate", "block", "cls", "text")
    whole = materialize(texts.mapInArrow(_resets, PIECES), "whole")
    first = searched(whole, "first")
    ties = first.select("a", "b")
    split = wanted.where("large")
    if split.isEmpty():
        return ties
    # The largest finding of each block, by its first class: searched together, CAP shingles at a time.
    sizes = first.join(split.select("candidate", "block").distinct(), ["candidate", "block"], "left_semi").groupBy("candidate", "block", "b").agg(F.count("*").alias("k"))
    heads = sizes.groupBy("candidate", "block").agg(F.max_by("b", F.struct("k", "b")).alias("cls"))
    heads = materialize(heads.select("candidate", "cls").join(split.select("cls", "n"), "cls"), "heads", few=True)
    groups = heads.groupBy("candidate").agg(F.ceil(F.sum("n") * 1.5 / CAP).alias("groups"))
    heads = heads.join(groups, "candidate").select("candidate", "cls", (-1 - F.pmod(F.xxhash64("cls"), F.col("groups"))).alias("block"))
    # Only sets of split candidates are read again, and move only into their groups: the lists that choose them are counted and broadcast.
    whole = whole.join(large.select("candidate"), "candidate", "left_semi").select("cls", "shingles")
    heads = small_side(materialize(heads, "heads-placed", few=True), 40)
    ties = ties.union(searched(whole.join(heads, "cls").select(*NAMES), "heads-found").select("a", "b"))
    # All that isn't in a candidate's largest component is held against every block of sizes that could link with it.
    merged = connected_components(ties)
    placed = split.select("candidate", "cls", "n", "band", "block").join(merged.withColumnRenamed("node", "cls"), "cls", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "cls")), "placed", few=True)
    counts = placed.groupBy("candidate", "component").agg(F.count("*").alias("k"))
    largest = counts.groupBy("candidate").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    rest = materialize(placed.join(largest, "candidate").where("component <> largest").select("candidate", "cls", "n", "band"), "rest", few=True)
    chunks = rest.groupBy("candidate", "band").agg(F.ceil(F.sum("n") * 1.5 / CAP).alias("chunks"))
    rest = rest.join(chunks, ["candidate", "band"]).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")))
    near = rest.select("candidate", "band", "chunk").distinct().withColumn("of", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    blocks = placed.select("candidate", F.col("band").alias("of"), "block").distinct()
    cells = near.join(blocks, ["candidate", "of"]).withColumn("cell", F.xxhash64("band", "chunk", "block"))
    cells = materialize(cells.select("candidate", "band", "chunk", "block", "cell"), "cells", few=True)
    ours = rest.join(cells, ["candidate", "band", "chunk"]).select("candidate", "cls", "cell")
    theirs = placed.join(cells.select("candidate", "block", "cell"), ["candidate", "block"]).select("candidate", "cls", "cell")
    members = small_side(materialize(ours.union(theirs).distinct().withColumnRenamed("cell", "block"), "members", few=True), 40)
    last = searched(whole.join(members, "cls").select(*NAMES), "rest-found")
    return ties.union(last.select("a", "b"))


#: More blocks of one size than a candidate has.
PARTS = 1 << 32
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 0.75 or more."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True).drop("class_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
