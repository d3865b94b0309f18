"""Exact deduplication by content-defined chunk recipes.

Each text, without white space, is cut where a rolling hash over the last 32 bytes hits a mask, so equal texts are
cut alike. A chunk gets a 64-bit identifier, verified over the whole corpus against a SHA-256 digest: the few
identifiers that stand for several contents are told apart by the rank of the digest. A document is then the
ordered list of its identifiers, some 8 bytes for each 2 KB of text; lists are compared instead of texts, and no
text is shuffled.

Defined results: texts are equal when they are identical after deleting ``[\\x20\\x09-\\x0D]``; a null text counts as
empty, and all empty texts are one group. Of a group the row with the most code points in its original text stays,
then the smallest id; a null id comes last. Repeated rows with one id are counted as rows; those with the kept id
and as many code points are all marked as kept, since nothing tells them apart. Texts of any length are read whole.
An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices, text_bytes
from stridemap.runtime import KEY, join_groups, keyed, materialize

#: Mean bytes of a chunk (a power of two), and the most.
CHUNK, CHUNK_MOST = 2048, 16384
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_WHITE = bytes([0x20, *range(0x09, 0x0E)])

_RECIPE = "id long, row_file long, row_at long, chars long, text_sha256 string, chunks array<long>, digests array<binary>"


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of one text's bytes (the last is its length)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    cuts = []
    block = 1 << 18
    for at in range(0, n, block):  # with the 31 bytes before it, each block has all windows that end in it
        low = max(0, at - 31)
        h = _GEAR[raw[low : at + block]]
        for width in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[i-k] << k over twice as many k
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        found = np.flatnonzero(h < np.uint32(2**32 // CHUNK)) + low + 1
        cuts.append(found[(found > at) & (found <= at + block)])
    ends = np.concatenate([*cuts, [n]])
    ends = np.unique(ends[ends <= n])
    gaps = np.diff(ends, prepend=0)
    if (gaps > CHUNK_MOST).any():
        more = [np.arange(e - g + CHUNK_MOST, e, CHUNK_MOST) for e, g in zip(ends, gaps, strict=True) if g > CHUNK_MOST]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        raw, offsets = text_bytes(part.column("text"))
        data = raw.tobytes()
        chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).cast(pa.int64())
        shas, chunks, digests = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            bare = data[a:b].translate(None, _WHITE)
            shas.append(hashlib.sha256(bare).hexdigest())
            own, start = [], 0
            for end in boundaries(np.frombuffer(bare, np.uint8)).tolist():
                own.append(hashlib.sha256(bare[start:end]).digest())
                start = end
            digests.append(own)
            chunks.append([int.from_bytes(hashlib.blake2b(d, digest_size=8).digest(), "little", signed=True) for d in own])
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("id", *KEY)), chars, pa.array(shas, pa.string()), pa.array(chunks, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))],
            names=["id", *KEY, "chars", "text_sha256", "chunks", "digests"],
        )


def _verified(recipes: DataFrame) -> DataFrame:
    """``recipes`` with ``recipe``: identifiers that stand for one content each.

    An identifier with several digests is followed in the list by the rank of the digest (all others by nothing);
    as any such identifier always has one, lists still agree only if the contents do.
    """
    pairs = recipes.select(F.explode(F.arrays_zip("chunks", "digests")).alias("z")).select("z.chunks", "z.digests")
    clash = pairs.groupBy("chunks").agg(F.min("digests").alias("low"), F.max("digests").alias("high")).where("low <> high")
    clash = materialize(clash.select("chunks"), "clashes", few=True)
    if clash.isEmpty():  # what is expected below some 2**32 distinct chunks
        return recipes.withColumn("recipe", F.col("chunks"))
    ranked = pairs.join(clash, "chunks").distinct()
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("chunks").orderBy("digests")).cast("long"))
    ranked = materialize(ranked, "ranked", few=True)
    keyed = recipes.withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "keyed")
    parts = keyed.select("row", F.posexplode(F.arrays_zip("chunks", "digests")).alias("pos", "z")).select("row", "pos", "z.chunks", "z.digests")
    named = parts.join(ranked, ["chunks", "digests"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    with_ranks = keyed.join(named, "row", "left")
    parts_of = F.transform(
        "chunks",
        lambda c, i: F.when(F.col("ranks")[i].isNotNull(), F.array(c, F.col("ranks")[i])).otherwise(F.array(c)),
    )
    return with_ranks.withColumn("recipe", F.flatten(parts_of)).drop("row", "ranks")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the text without white space). ``scan``: see ``keyed``."""
    rows = keyed(bounded(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), scan=scan)
    return measured(rows).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def measured(rows: DataFrame) -> DataFrame:
    """Rows (id, text, KEY) -> id, KEY, keep_id, group_size, kept, text_sha256, first: whether it is the one row of its group that stays.

    ``first`` also tells repeated rows apart, by KEY; they are all ``kept`` if one is.
    """
    recipes = materialize(rows.mapInArrow(_recipes, _RECIPE), "recipes")
    recipes = _verified(recipes).select("id", *KEY, "chars", "text_sha256", "recipe")
    best = F.max(F.struct(F.col("chars"), F.col("id").isNotNull().alias("named"), F.bitwise_not("id").alias("back"), *(F.bitwise_not(k).alias(k) for k in KEY)))
    groups = recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select(
        "recipe", F.bitwise_not("best.back").alias("keep_id"), F.col("best.chars").alias("most"), "group_size",
        *(F.bitwise_not(f"best.{k}").alias(f"best_{k}") for k in KEY),
    )
    groups = materialize(groups, "groups", few=True)
    joined = join_groups(recipes, groups, "recipe", "group_size", 80 + 8 * F.size("recipe"))
    alone = F.col("group_size").isNull()
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most"))
    first = (F.col(KEY[0]) == F.col(f"best_{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"best_{KEY[1]}"))
    return joined.select(
        "id", *KEY, F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(alone, True).otherwise(kept).alias("kept"), "text_sha256", F.when(alone, True).otherwise(first).alias("first"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True)


OP3_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), keyed AS (SELECT doc_id, chars, sha256(t) AS text_sha256, t FROM bare)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM keyed
WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
