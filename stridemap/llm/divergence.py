"""How far the sources of a language diverge: a two-pass vocabulary automaton and sparse postings.

The first pass counts exactly in how many documents of a language each term occurs; terms in MIN_DOCS of them are kept. The second pass counts their
occurrences by an Aho-Corasick automaton of the kept terms, each between blanks, over the texts in which all but terms is blank. A
vocabulary is cut into blocks of VOCABULARY_BYTES, each broadcast for one scan of the documents, so no task holds more than a block.

The counts are postings (language, source, term); absent terms have no row. All sources of a language share V kept terms, and of each only the share of an
absent term differs. So the distance of two sources is V times the distance of their absent shares, put right by the terms that one of them has. These
corrections are worked out by blocks: some TERM_BLOCK terms by two groups of SOURCE_BLOCK sources meet in a task, as dense rows of numpy. The pairs
themselves are the result, so their number is the square of a language's sources; nothing else has that size, and no term emits its pairs of sources.

Defined results: null text, lang and source are ''. A source without terms has its row in every pair, with absent shares only. Without kept terms all
values of a language are 0 and there are no term rows. Repeated rows and null ids count as documents each. An empty table gives no rows. Extra columns,
whatever their names, are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded, slices, text_bytes
from stridemap.runtime import BROADCAST_BYTES, materialize

#: Documents of its language that a kept term is in at least; what is added to each count; what shares add up to, about; ranks of the term part.
MIN_DOCS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of terms in an automaton; entries of counts that a task collects before it emits them.
VOCABULARY_BYTES, COUNTED = 16 << 20, 800_000
TERM_BLOCK, SOURCE_BLOCK = 1024, 128

#: Bytes between terms become blanks, and A-Z lower-case; all bytes of other letters are terms' and stay.
_BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "lang string, source string, part string, item string, value long, rank int"


def spaced(part: pa.RecordBatch) -> Iterator[bytes]:
    """Of each row's text its terms, between blanks."""
    raw, offsets = text_bytes(part.column("text"))
    data = raw.tobytes().translate(_BLANKED)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def _documents_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def emitted() -> pa.RecordBatch:
        langs, terms, ns = zip(*((lang, term, n) for lang, own in counts.items() for term, n in own.items()), strict=True)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], names=["lang", "term", "n"])

    for part in slices(batches, "text"):
        for lang, text in zip(part.column("lang").to_pylist(), spaced(part), strict=True):
            counts.setdefault(lang, Counter()).update(set(text.split()))
        if sum(map(len, counts.values())) >= COUNTED:
            yield emitted()
    if any(counts.values()):
        yield emitted()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) in at least ``min_docs`` of a language's ``docs`` (lang, text)."""
    counts = docs.mapInArrow(_documents_task, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def _count_task(vocabulary: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata = {}
        for lang, terms in vocabulary.value.items():
            automata[lang] = ahocorasick.Automaton()
            for k, term in enumerate(terms):
                automata[lang].add_word(f" {term} ", k)
            automata[lang].make_automaton()
        counts: dict[tuple[str, str], Counter] = {}

        def emitted() -> pa.RecordBatch:
            rows = [(*group, vocabulary.value[group[0]][k], n) for group, own in counts.items() for k, n in own.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COUNT_KINDS, strict=True)], names=["lang", "source", "term", "n"])

        for part in slices(batches, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source")), spaced(part), strict=True):
                if lang in automata:
                    found = [k for _, k in automata[lang].iter(f" {text.decode()} ")]
                    if found:
                        counts.setdefault((lang, source), Counter()).update(found)
            if sum(map(len, counts.values())) >= COUNTED:
                yield emitted()
        if counts:
            yield emitted()

    return run


_COUNT_KINDS = (pa.string(), pa.string(), pa.string(), pa.int64())


def postings(docs: DataFrame, kept: DataFrame, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(lang, source, term, n): how often the ``kept`` (lang, term) occur in the ``docs`` (lang, source, text) of a source."""
    spark = docs.sparkSession
    total = kept.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = -(-total // vocabulary_bytes)
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(1, blocks))))
    counts = None
    for block in range(blocks):
        vocabulary: dict[str, list[str]] = {}
        for row in dealt.where(F.col("block") == block).sort("lang", "term").collect():  # about vocabulary_bytes
            vocabulary.setdefault(row["lang"], []).append(row["term"])
        own = docs.mapInArrow(_count_task(spark.sparkContext.broadcast(vocabulary)), "lang string, source string, term string, n long")
        own = own.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        own = materialize(own, "postings", few=True)
        counts = own if counts is None else counts.unionByName(own)
    return counts if counts is not None else spark.createDataFrame([], "lang string, source string, term string, n long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)) in exact whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    exact = F.call_function("div", wide(n + ADDED) * F.lit(WHOLE).cast("decimal(10,0)"), wide(total + ADDED * terms))
    return (exact + 1).cast("long")


def _corrections(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (number, block of sources, absent share, term or null, share) of two blocks of sources -> (a, b, value): what its terms add to V times the distance of absent shares."""
    lang = rows["lang"].iloc[0]
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    sources = rows.drop_duplicates("number")[["number", "block", "absent"]].sort_values("number")
    numbers, blocks, absent = (sources[c].to_numpy() for c in ("number", "block", "absent"))
    own = rows[rows["term"].notna()]
    terms, columns = np.unique(own["term"].to_numpy().astype(str), return_inverse=True) if len(own) else (np.empty(0), np.empty(0, int))
    shares = np.repeat(absent[:, None], len(terms), axis=1)
    shares[np.searchsorted(numbers, own["number"].to_numpy()), columns] = own["share"].to_numpy()
    out_a, out_b, out_value = [], [], []
    for i in np.flatnonzero(blocks == low):
        others = np.flatnonzero((blocks == high) & (numbers > numbers[i]))
        if len(others):
            value = np.abs(shares[others] - shares[i]).sum(axis=1) - len(terms) * np.abs(absent[others] - absent[i])
            out_a.append(np.full(len(others), numbers[i]))
            out_b.append(numbers[others])
            out_value.append(value)
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, out_value)]
    return pd.DataFrame({"lang": lang, "a": joined[0], "b": joined[1], "value": joined[2]})


def _paired(sources: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, a, b, value): distances of the ``sources`` (lang, number, absent, terms, blocks of terms and sources) by postings ``known``."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("term_blocks"), F.lit(1).cast("long")) - 1)).alias("term_block")
    frame = sources.select("lang", "number", "absent", "source_blocks", blocks, F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("share"))
    own = known.select("lang", "number", "absent", "source_blocks", F.pmod(F.xxhash64("term"), "term_blocks").alias("term_block"), "term", "share")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)).alias("other")
    both = frame.unionByName(own).select("*", F.floor(F.col("number") / SOURCE_BLOCK).alias("block"), others).drop("source_blocks")
    both = both.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    met = both.groupBy("lang", "term_block", "low", "high").applyInPandas(_corrections, "lang string, a long, b long, value long")
    return met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """The audit of ``docs`` (text, lang, source): SCHEMA, parts ``pair`` and ``term``."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = bounded(docs).select(*(empty(c).alias(c) for c in ("lang", "source", "text")))
    kept = materialize(kept_terms(rows, min_docs), "kept", few=True)
    counts = postings(rows, kept, vocabulary_bytes)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    sources = sources.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    sources = sources.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    of_lang = Window.partitionBy("lang")
    sources = sources.select(
        "*", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0).alias("absent"),
        F.sum("total").over(of_lang).alias("lang_total"),
        F.ceil(F.count("*").over(of_lang) / SOURCE_BLOCK).alias("source_blocks"), F.ceil(F.col("terms") / TERM_BLOCK).alias("term_blocks"),
    )
    sources = materialize(sources, "sources", few=True)
    side = F.broadcast(sources) if (sources.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 80)).first()[0] or 0) <= BROADCAST_BYTES else sources
    known = counts.join(side, ["lang", "source"]).withColumn("share", share(F.col("n"), F.col("total"), F.col("terms")))
    known = materialize(known, "known", few=True)
    return _pairs(sources, side, known).unionByName(_terms(known, ranks))


def _pairs(sources: DataFrame, side: DataFrame, known: DataFrame) -> DataFrame:
    fixed = lambda c: side.select("lang", F.col("number").alias(c), F.col("source").alias(f"{c}_source"), F.col("absent").alias(f"{c}_absent"), *(["terms"] if c == "a" else []))
    met = _paired(sources, known).join(fixed("a"), ["lang", "a"]).join(fixed("b"), ["lang", "b"])
    value = F.col("value") + F.col("terms") * F.abs(F.col("a_absent") - F.col("b_absent"))
    sides = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    return _ranked(met.select("lang", sides.alias("side"), value.alias("value")).select("lang", "side.*", "value"), "pair")


def _terms(known: DataFrame, ranks: int) -> DataFrame:
    whole = known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    met = known.select("lang", "source", "term", "share", "lang_total", "terms").join(whole, ["lang", "term"])
    above = F.col("share") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return _ranked(met.select("lang", "source", F.col("term").alias("item"), above.alias("value")).where("value > 0"), "term").where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * v.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c USING (lang, source, term)
), q AS (
  SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.n) + 5) // (any_value(t.total) + 5 * any_value(v.v)) AS q
  FROM counts c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM groups GROUP BY ALL) t USING (lang) GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.s = a.source AND d.o = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
