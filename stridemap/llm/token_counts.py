"""Token counts through a digest cache.

A text's count depends only on the text and on the tokenizer, so counts are stored under (content digest,
tokenizer digest). Texts are joined with the stored counts by digest; of the digests that are missing, one row each
is encoded, and the new counts are appended to the cache.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens). Rows are never merged: repeated rows
and null ids each get their own output row. Extra columns, whatever their names, are ignored. An empty table gives
an empty result with the same schema. Texts of any length are encoded whole: long ones in pieces cut at single
spaces, which gives the same tokens because no piece of the vocabulary has a space after another character (this
is checked when the model is loaded; otherwise they are not cut).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices
from stridemap.runtime import KEY, join_groups, keyed, materialize, scratch_path, small_side

LONG = 200_000
CACHE = "content binary, tokenizer string, n_tokens long"


@functools.lru_cache(maxsize=4)
def counter(model_path: str) -> Callable[[list[str]], list[int]]:
    """Counts of token ids for a list of texts, as the library of the model file gives them."""
    if model_path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(model_path)
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    bar = "▁"
    cuts = not any(bar in model.id_to_piece(i).lstrip(bar) for i in range(model.get_piece_size()))
    cuts = cuts and len(model.encode(" a")) == len(model.encode("a")) + 1  # a leading space isn't swallowed

    def count(texts: list[str]) -> list[int]:
        pieces, owner = [], []
        for k, text in enumerate(texts):
            parts = pieces_of(text) if cuts and len(text) > LONG else [text]
            pieces += parts
            owner += [k] * len(parts)
        out = [0] * len(texts)
        for k, ids in zip(owner, model.encode(pieces, num_threads=1), strict=True):
            out[k] += len(ids)
        return out

    return count


def pieces_of(text: str, size: int = LONG) -> list[str]:
    """``text`` cut at single spaces between ASCII letters, about every ``size`` code points; the space is left out."""
    out, start, at = [], 0, size
    while at < len(text):
        cut = text.find(" ", at)
        while 0 < cut and not (text[cut - 1 : cut + 2 : 2].isascii() and text[cut - 1 : cut + 2 : 2].isalpha() and cut + 1 < len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start, at = cut + 1, cut + 1 + size
    return [*out, text[start:]]


def tokenizer_digest(model_path: str) -> str:
    """Identifies the tokenizer and its version: the digest of its file."""
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(model_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for part in slices(batches, "text"):
            counts = count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, scan: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, content (SHA-256 of the text). ``scan``: see ``keyed``.

    ``cache_path`` is a Parquet table in a place that all executors reach; it is read if it exists, and the counts
    of texts that it lacks are appended. Two runs may append the same counts; equal keys have equal counts, of which the least is read.
    """
    spark = bounded(docs).sparkSession
    rows = keyed(docs, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), scan=scan)
    sized = rows.select("_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text"), 256)).alias("content"))
    sized = materialize(sized, "digests")  # every text is digested once
    tokenizer = tokenizer_digest(model_path)
    stored = _cache(spark, cache_path).where(F.col("tokenizer") == tokenizer).select("content")
    wanted = sized.groupBy("content").agg(F.min(F.struct(*KEY)).alias("row"), F.count("*").alias("copies"))
    wanted = materialize(wanted.select("content", "row.*", "copies"), "wanted", few=True)
    misses = materialize(wanted.join(stored, "content", "left_anti").select(F.col("content").alias("c"), *KEY), "misses", few=True)
    # A row for each distinct missing text is encoded where it lies, if the list of misses is small; else texts move once.
    texts = rows.join(small_side(misses, 72), KEY).select(F.col("c").alias("content"), "text")
    fresh = texts.mapInArrow(_encode(model_path), "content binary, n_tokens long")
    fresh.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = _cache(spark, cache_path).where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    counts = materialize(wanted.select("content", "copies").join(counts, "content"), "counts", few=True)
    return join_groups(sized, counts, "content", "copies", F.lit(72)).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content"
    )


def _cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is laid down where there is none."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, with a cache that starts empty, so that every text is counted in this run."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"), scan=True).drop("content")
