"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its three letters:
the product of the first letter's vector permuted twice, the second's permuted once and the third's. A text bundles
(sums) the vectors of its trigrams; a language's prototype bundles those of all its training texts. A text gets the
language whose prototype has the greatest cosine with it.

Bundling is linear: a slice of texts is a matrix of trigram counts, and its bundles are that matrix times the
matrix of trigram vectors. Prototypes are summed per task and then per language, so that training reads every
labelled text, and only one vector per language and task moves.

Defined results: a null text and a text without a letter get ``und`` and score 0; so does every text if nothing could be
learned. Ties go to the first language by name. Ids, sources and labels are never inputs of a prediction. Repeated
rows and null ids each get their own row; a null id is in the training part. An empty table gives an empty
result. Extra columns, whatever their names, are ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices, text_bytes

#: Elements of a vector; classes that hash the code points' letters.
DIMENSIONS, CLASSES = 2048, 1024
#: Trigram vectors, and cells of a matrix of counts, that a task holds at a time.
VECTORS, CELLS = 1024, 4_000_000
UNKNOWN = "und"

_letters: np.ndarray | None = None
_table: np.ndarray | None = None


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, else a number under CLASSES; capitals have their small letter's."""
    global _letters
    if _letters is None:
        out = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
        for code in range(sys.maxunicode + 1):
            c = chr(code)
            if c.isalpha():
                small = c.lower()[0]
                key = ord(small)
                out[code] = key if key < 512 else 512 + key * 2654435761 % 2**32 % (CLASSES - 512)
        _letters = out
    return _letters


def letter_vectors() -> np.ndarray:
    """For positions 0, 1, 2 of a trigram, the vectors of all classes, permuted (rotated) by 2, 1 and 0 elements."""
    global _table
    if _table is None:
        plain = np.random.default_rng(4711).integers(0, 2, (CLASSES, DIMENSIONS), dtype=np.int8) * 2 - 1
        _table = np.stack([np.roll(plain, k, axis=1) for k in (2, 1, 0)])
    return _table


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """One bound vector per trigram code."""
    table = letter_vectors()
    a, b, c = grams >> 20, grams >> 10 & 1023, grams & 1023
    return (table[0][a] * table[1][b] * table[2][c]).astype(np.float32)


def trigrams(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram code, count) of a slice's texts. Runs of other characters count as one gap, as do a text's ends."""
    raw, offsets = text_bytes(part)
    rows = len(offsets) - 1
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = (raw & 0xC0) != 0x80  # the bytes at which code points begin
    ends = np.concatenate([[0], np.cumsum(heads)])[offsets]
    if ends[-1] != len(codes):
        raise ValueError("text is not valid UTF-8")
    # With a gap before and after each text, and no two gaps together.
    letters = np.zeros(len(codes) + rows + 1, dtype=np.uint16)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(ends))
    at = np.arange(1, len(codes) + 1, dtype=np.int64) + row
    letters[at] = letter_classes()[codes]
    owner = np.zeros(len(letters), dtype=np.int32)
    owner[at] = row
    owner[ends[1:] + np.arange(1, rows + 1)] = np.arange(rows)
    del codes, heads, row, at
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    keep[0] = True
    letters, owner = letters[keep].astype(np.int32), owner[keep]
    if len(letters) < 3:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    whole = letters[1:-1] != 0  # the middle is a letter, so that both neighbours are of the same text
    grams = (letters[:-2] << 20 | letters[1:-1] << 10 | letters[2:])[whole]
    key, counts = np.unique(owner[1:-1][whole].astype(np.int64) << 30 | grams, return_counts=True)
    return key >> 30, key & (1 << 30) - 1, counts


def bundles(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bundle of each row, number of its trigrams)."""
    rows, grams, counts = trigrams(part)
    out = np.zeros((len(part), DIMENSIONS), dtype=np.float32)
    if len(rows):
        distinct, at = np.unique(grams, return_inverse=True)
        # Columns in order, and as many rows at a time as CELLS allow: a slice of very short texts has very many.
        step = max(1, CELLS // min(len(distinct), VECTORS))
        for k in range(0, len(distinct), VECTORS):
            vectors = trigram_vectors(distinct[k : k + VECTORS])
            mine = (at >= k) & (at < k + VECTORS)
            r, c, n = rows[mine], at[mine] - k, counts[mine]
            for i in range(0, len(part), step):
                some = slice(*np.searchsorted(r, (i, i + step)))
                matrix = np.zeros((min(step, len(part) - i), len(vectors)), dtype=np.float32)
                matrix[r[some] - i, c[some]] = n[some]
                out[i : i + step] += matrix @ vectors
    return out, np.bincount(rows, weights=counts, minlength=len(part))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for part in slices(batches, "text", 1 << 20):
        rows, grams, counts = trigrams(part.column("text"))
        langs = part.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)[rows]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = which == k
            distinct, at = np.unique(grams[own], return_inverse=True)
            total = np.bincount(at, weights=counts[own], minlength=len(distinct))
            vector = sums.setdefault(lang, np.zeros(DIMENSIONS))
            for j in range(0, len(distinct), VECTORS):
                vector += total[j : j + VECTORS].astype(np.float32) @ trigram_vectors(distinct[j : j + VECTORS])
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def train(labelled: DataFrame) -> dict[str, list[float]]:
    """The prototype of each language from (lang, text): one vector a language, which is all that comes to the driver."""
    partial = bounded(labelled).select("lang", "text").mapInArrow(_train, "lang string, v array<double>")
    # Sums of whole numbers below 2**53: the order of the tasks can't change them.
    parts = partial.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
    return {r["lang"]: [x["x"] for x in r["v"]] for r in sorted(rows, key=lambda r: r["lang"])}


def _predict(prototypes: dict[str, list[float]], text: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*prototypes, UNKNOWN], dtype=object)
        profile = np.array(list(prototypes.values()), dtype=np.float64).reshape(len(prototypes), DIMENSIONS)
        profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)
        for part in slices(batches, "text", 512 << 10):
            sums, n = bundles(part.column("text"))
            norms = np.linalg.norm(sums, axis=1)
            known = (n > 0) & (len(prototypes) > 0)
            best, score = np.full(len(n), len(names) - 1), np.zeros(len(n))
            if known.any():
                cosines = (sums @ profile.T.astype(np.float32)) / np.maximum(norms, 1e-12)[:, None]
                best[known] = cosines[known].argmax(axis=1)
                score[known] = np.clip(cosines[known].max(axis=1), 0, 1)
            others = [k for k in part.schema.names if text or k != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in others), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(n.astype(np.int64))], names=[*others, "lang_pred", "score", "trigrams"]
            )

    return run


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (cosine with the prototype, 0 at least)."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predict(prototypes), "id long, lang_pred string, score double, trigrams long")
    return out.withColumnRenamed("id", id_col).drop("trigrams")


#: Least cosine of a long text in a learned language; trigrams of which a cosine says as much as nothing.
LEAST_SCORE, VAGUE = 0.05, 10


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without those in no learned language.

    A document goes if its text has no letter, or if its score falls short of LEAST_SCORE by more than its error, which for n trigrams is LEAST_SCORE times
    sqrt(VAGUE / n): a bundle of few trigrams shares little with its language's by chance alone. The prototypes are learned from all of ``docs`` that have a label; if they teach
    nothing, every document stays. Null texts go, with all others without a letter; repeated rows are judged alike; an empty table gives an empty one.
    """
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", lang_pred string, score double, trigrams long"
    prototypes = train(rows.where(F.col("lang").isNotNull()))
    if not any(any(v) for v in prototypes.values()):
        return rows
    judged = rows.mapInArrow(_predict(prototypes, text=True), schema)
    least = LEAST_SCORE * (1 - F.sqrt(VAGUE / F.greatest("trigrams", F.lit(1))))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score", "trigrams")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> dict[str, list[float]]:
    """Prototypes from the documents that are not held out and have a label."""
    return train(docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text")))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
