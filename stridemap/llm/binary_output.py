"""Token ids as files: a concatenated id array with Elias-Fano document boundaries, read back through their select structures.

Documents are encoded where they lie; the ids (2 bytes each for a vocabulary of up to 65,536, else 4) move once, to ranges of ascending doc_id
of about SHARD_BYTES, whose ends are found on a sample of the ids. A task writes one file a range, as a stream: ids of its documents end to end, an Elias-Fano list of their ends, one of the doc_ids, and
a footer. No table of 64-bit offsets exists: the start of a document is the end before it, and the start of a file is in the manifest, one row
a file. The manifest names the files that count. It is written last, so a task that ran twice leaves no double, and a run that broke off no files that a reader sees.

Reading deals parts of BLOCK documents of a file to tasks; each finds its first boundary by a select and reads the ids from there on, a few MB
at a time. ``documents_at`` opens only the files whose range of ids can hold a wanted document.

Defined results: a null text is empty, and every document ends with END_ID, so an empty one has one id. Null ids come first. Rows with one id, or none,
are documents each, in the order of their place in the table. Texts are encoded whole. An empty table gives an empty manifest and no rows.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices
from stridemap.llm.elias_fano import EliasFano, encode
from stridemap.runtime import KEY, keyed, materialize, scratch_path

END_ID = 1
#: Bytes of ids in a file, about; documents that a reading task looks at in one piece; bytes of ids that it holds.
SHARD_BYTES, BLOCK, READ_BYTES = 256 << 20, 20_000, 4 << 20
#: Rows of a range that are looked at to find its end, and of all ranges together at most.
SAMPLED, MOST_SAMPLED = 100, 1_000_000
#: Words and chunks that a task remembers with their ids, and the most code points of one.
MEMORY, REMEMBERED = 350_000, 64

_MAGIC = b"EFIDS001"
#: Width of an id, documents, null ids, least id, then the places of the two lists.
_FOOTER = "<BQQqQQ8s"
#: Chunks of ASCII from ! to ~ and of the letters of Latin 1: each is composed, and one letter in lower case. What the tokenizer's pattern finds in them.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*").fullmatch
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+").findall

MANIFEST = "shard int, path string, docs long, nulls long, ids long, least long, greatest long, start long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of texts as ``tokenizers`` gives them for a model file, packed; what stands between spaces is encoded once and remembered.

    A space or a line end always separates tokens in a model whose pattern never matches white space (``cuts``), so a text's ids are those of
    the chunks between them. Plain chunks are taken apart by the pattern and given to the library's BPE word by word; all others, texts with
    special strings, and all texts of other models go through the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.cuts = _is_word_model(made) and not any(re.search(r"\s", s) for s in self.special)
        self.model = self.tokenizer.model
        of_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: of_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # what stands for their bytes in the vocabulary
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.packed([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
            if len(word) <= REMEMBERED:
                if len(self.words) >= MEMORY:
                    self.words.clear()
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        ids = b"".join(map(self._word, _PLAIN_WORDS(chunk.lower()))) if _PLAIN(chunk) else self.whole(chunk)
        if len(chunk) <= REMEMBERED:
            self.chunks[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.cuts or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.chunks) >= MEMORY:
            self.chunks.clear()
            self.chunks[""] = b""
        known = self.chunks.get
        return b"".join([ids if (ids := known(chunk)) is not None else self._chunk(chunk) for chunk in text.replace("\n", " ").split(" ")])


def _is_word_model(made: dict) -> bool:
    """Whether the model file has the steps that ``Encoder`` takes apart: composed, lower-cased, split by the known pattern, byte letters, BPE."""
    steps = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex") if splits else None
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and made.get("post_processor") is None
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ENCODED = "shard int, doc_id long, row_file long, row_at long, n_tokens long, ids binary"
#: Place of a row in the order of the files: whether it has an id, the id, KEY.
Place = tuple[bool, int, int, int]


def _place(doc_id: int | None, *key: int) -> Place:
    return (doc_id is not None, doc_id or 0, *key)


def _encode_task(model_path: str, ends: list[Place]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(model_path)
        end = to_ids.packed([END_ID])
        for part in slices(batches, "text"):
            ids = [to_ids(text) + end if text else end for text in part.column("text").to_pylist()]
            keys = [part.column(c) for c in ("doc_id", *KEY)]
            shards = pa.array([bisect_right(ends, _place(*key)) for key in zip(*(k.to_pylist() for k in keys), strict=True)], pa.int32())
            counts = pa.array([len(x) // to_ids.width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([shards, *keys, counts, pa.array(ids, pa.binary())], names=["shard", "doc_id", *KEY, "n_tokens", "ids"])

    return run


def _write_task(folder: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, base = pa.fs.FileSystem.from_uri(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}.ids"
        out, nulls, ids, ends = None, 0, [], []
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}")
                out.write(_MAGIC)
            column = batch.column("doc_id")
            nulls += column.null_count
            ids.append(column.drop_null().to_numpy(zero_copy_only=False))
            counts = batch.column("n_tokens").to_numpy()
            ends.append(total + np.cumsum(counts))
            total = int(ends[-1][-1])
            for value in batch.column("ids"):
                out.write(value.as_buffer())
        if out is None:
            return
        ids, ends = np.concatenate(ids), np.concatenate(ends)
        least, greatest = (int(ids[0]), int(ids[-1])) if len(ids) else (0, 0)
        listed = encode(ends)
        out.write(listed)
        out.write(encode(ids.astype(np.uint64) - np.uint64(least % 2**64)))
        boundaries = len(_MAGIC) + total * width
        out.write(struct.pack(_FOOTER, width, len(ends), nulls, least, boundaries, boundaries + len(listed), _MAGIC))
        out.close()
        row = (shard, f"{folder}/{name}", len(ends), nulls, total, least if len(ids) else None, greatest if len(ids) else None, None)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


_KINDS = [{"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in MANIFEST.split(", ")]


class TokenFile:
    """One file of ids: the boundaries and the doc_ids stay encoded, ids are read where they are asked for."""

    def __init__(self, path: str):
        files, name = pa.fs.FileSystem.from_uri(path)
        self._file = files.open_input_file(name)
        size, tail = self._file.size(), struct.calcsize(_FOOTER)
        self.width, self.docs, self.nulls, self.least, boundaries, ids, magic = struct.unpack(_FOOTER, self._file.read_at(tail, size - tail))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.ends = EliasFano(self._file.read_at(ids - boundaries, boundaries))
        self._ids = EliasFano(self._file.read_at(size - tail - ids, ids))
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Starts of the documents first to last - 1, and the end of the last one."""
        ends = self.ends.slice(max(first - 1, 0), last).astype(np.int64)
        return ends if first else np.concatenate([np.zeros(1, np.int64), ends])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        values = self._ids.slice(max(first - self.nulls, 0), max(last - self.nulls, 0)).astype(np.uint64) + np.uint64(self.least % 2**64)
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + values.astype(np.int64).tolist()

    def find(self, doc_id: int) -> range:
        """Places of the documents with this id."""
        if not len(self._ids) or doc_id < self.least:
            return range(0)
        return range(*(self.nulls + self._ids.first_not_below(v - self.least) for v in (doc_id, doc_id + 1)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at these places of the array."""
        return np.frombuffer(self._file.read_at((stop - start) * self.width, len(_MAGIC) + start * self.width), dtype=self.kind)


def _crcs(file: TokenFile, bounds: np.ndarray) -> Iterator[int]:
    """Of each document between ``bounds``, the CRC-32 of its ids as 32-bit integers; READ_BYTES are held at a time."""
    step = READ_BYTES // file.width
    at, held, crc = int(bounds[0]), np.empty(0, file.kind), 0
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        crc = 0
        while start < stop:
            if start >= at + len(held):
                at = start
                held = file.ids(at, min(at + step, int(bounds[-1])))
            piece = held[start - at : stop - at]
            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
            start += len(piece)
        yield crc


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            with TokenFile(part["path"]) as file:
                bounds = file.bounds(part["first"], part["last"])
                columns = (file.doc_ids(part["first"], part["last"]), bounds[:-1] + part["start"], np.diff(bounds), list(_crcs(file, bounds)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in DOCUMENT.split(", ")])


def _find_task(manifest: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = manifest.value  # (least, greatest, path, start), rising
        greatest = [f[1] for f in files]
        for batch in batches:
            for doc_id in batch.column("doc_id").to_pylist():
                k = bisect_left(greatest, doc_id)
                while k < len(files) and files[k][0] <= doc_id:
                    with TokenFile(files[k][2]) as file:
                        for place in file.find(doc_id):
                            start, stop = file.bounds(place, place + 1).tolist()
                            row = (doc_id, files[k][3] + start, file.ids(start, stop).tolist())
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "start", "ids"])
                    k += 1

    return run


def write_tokens(docs: DataFrame, model_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """Write the ids of ``docs`` to ``folder`` (a URI that all executors reach), and return the manifest. ``scan``: see ``keyed``."""
    spark = bounded(docs).sparkSession
    rows = keyed(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), scan=scan)
    width = encoder(model_path).width
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # A token of two bytes of text, or a byte of those that the vocabulary has no words for.
    shards = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-(size or 0) * width // (2 * SHARD_BYTES)))))
    encoded = rows.mapInArrow(_encode_task(model_path, _ends(rows, count, shards)), _ENCODED)
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions("doc_id", *KEY)
    written = materialize(dealt.select("doc_id", "n_tokens", "ids").mapInArrow(_write_task(folder, width), MANIFEST), "files")
    found = sorted(written.collect(), key=lambda r: r["shard"])  # a row a file
    start, manifest = 0, []
    for row in found:
        manifest.append((*row[:-1], start))
        start += row["ids"]
    _drop_others(spark, folder, {r["path"].rsplit("/", 1)[1] for r in found})
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _ends(rows: DataFrame, count: int, shards: int) -> list[Place]:
    """Where the ranges of ``shards`` files end: of SAMPLED places a range, and MOST_SAMPLED at most, every so many. The ranges hold all rows, whatever was sampled."""
    if shards == 1:
        return []
    wanted = min(SAMPLED * shards, MOST_SAMPLED)
    places = rows.select("doc_id", *KEY)
    if wanted < count:
        places = places.sample(fraction=min(1.0, 1.1 * wanted / count), seed=1)
    found = sorted(_place(*r) for r in places.collect())
    return [found[k * len(found) // shards] for k in range(1, shards)] if found else []


def _drop_others(spark: SparkSession, folder: str, named: set[str]) -> None:
    """Delete the files of attempts that failed or were overtaken."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path) if files.exists(path) else ():
        name = status.getPath().getName()
        if name.endswith(".ids") and name not in named:
            files.delete(status.getPath(), False)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document of the files in ``folder``: doc_id, start (ids before it), n_tokens, ids_crc32."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(BLOCK).cast("long")))
    parts = manifest.select("path", "start", "docs", firsts.alias("first")).withColumn("last", F.least(F.col("first") + BLOCK, "docs")).drop("docs")
    dealt = parts.repartition(spark.sparkContext.defaultParallelism * 4, "path", "first")
    return dealt.mapInArrow(_read_task, DOCUMENT)


def documents_at(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of the documents whose ids are in ``wanted``; only files whose range holds one are opened.

    The manifest, a row of some 200 bytes for each SHARD_BYTES of ids, is broadcast.
    """
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where("least is not null").collect()
    files = sorted((r["least"], r["greatest"], r["path"], r["start"]) for r in rows)
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return asked.mapInArrow(_find_task(spark.sparkContext.broadcast(files)), "doc_id long, start long, ids array<long>")


def op12_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of ids, read back."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder, scan=True)
    return read_tokens(spark, folder)
