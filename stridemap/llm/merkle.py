"""A Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Leaves are digests of rows. Those of a source, in order of doc_id, form a tree of fan-out FAN, and the roots of the sources, in order of source,
another. A vertex stands for HEIGHT levels of a tree. In each superstep upward the nodes of a level message their vertex; a vertex whose
children have all come hashes its levels and forwards one digest. The reverse supersteps carry the siblings on the way from the root down:
a vertex adds to the message from above what each of its children needs, and the last one gives its leaves their proofs, which are
then folded with what the leaf is now.

Leaves are numbered without gathering a source anywhere: rows are sorted over range partitions, and the driver gets a row a partition (first and
last source, counts) to carry the counts on. A vertex has at most FAN ** HEIGHT children, whatever the size of a source, so a source with a third
of all rows is as many vertices as its leaves need. Shuffled are the digests and ids of rows, never texts; all steps are repeated from the
written table of leaves if an executor is lost.

Defined results: a null column is ``-`` in a leaf, told apart from an empty one. Null ids come first in their source; rows of one id are ordered by
their leaf (equal leaves are interchangeable). A null source comes before all others. A lone leaf is its source's root, and a lone source's root the
root; its proof is the digest of nothing. Rows with a null id are never tampered with. An empty table gives no rows. Extra columns, whatever their
names, are ignored. Texts are digested whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.batches import bounded
from stridemap.runtime import materialize

FAN = 3
#: Levels of a tree that one vertex stands for.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: On the way to a node: for each level, from below, its place in its run and the digests of the others there.
Step = tuple[int, tuple[bytes, ...]]


def h(digests: Iterable[bytes]) -> bytes:
    """SHA-256 of the digests' hex texts, end to end."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def runs(level: list[bytes]) -> list[list[bytes]]:
    return [level[k : k + FAN] for k in range(0, len(level), FAN)]


def levels(children: list[bytes], alone: bool, height: int) -> list[list[bytes]]:
    """The levels of a vertex from its children up to its one node. ``alone``: it is the only one at its height, so its tree ends with it."""
    out = [children]
    while len(out[-1]) > 1 or (not alone and len(out) <= height):
        out.append([h(run) for run in runs(out[-1])])
    return out


def ways(built: list[list[bytes]]) -> Iterator[list[Step]]:
    """For each child of a vertex, the steps from it to the vertex's node."""
    for k in range(len(built[0])):
        way = []
        for level in built[:-1]:
            run, at = k // FAN * FAN, k % FAN
            way.append((at, tuple(d for j, d in enumerate(level[run : run + FAN]) if j != at)))
            k //= FAN
        yield way


def fold(leaf: bytes, way: list[Step]) -> bytes:
    for at, others in way:
        leaf = h((*others[:at], leaf, *others[at:]))
    return leaf


def leaf_digest(*values: Column) -> Column:
    """Of each value ``-`` if it is null, else its bytes' count, a colon and itself; the SHA-256 of all, as hex text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts += [F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))]
    return F.sha2(F.concat(*parts), 256)


def numbered(leaves: DataFrame, parts: int) -> tuple[RDD, int, int]:
    """((tree, place in it), last of it, row) of each row (source, doc_id, leaf, ...), the number of sources, and the most leaves of one.

    Trees are the sources in their order.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    rows = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd

    def outline(rows: Iterator) -> Iterator[tuple]:
        first = last = None
        trees = most = count = head = 0
        for source, own in itertools.groupby(rows, key=lambda r: (r["source"] is not None, r["source"])):
            count = sum(1 for _ in own)
            first, head = (source, count) if trees == 0 else (first, head)
            last, trees, most = source, trees + 1, max(most, count)
        if trees:
            yield first, last, trees, head, count, most

    outlines = rows.mapPartitionsWithIndex(lambda p, it: ((p, x) for x in outline(it))).collect()  # a row a partition
    carried, before, tree, most, previous = {}, 0, -1, 0, None
    for p, (first, last, trees, head, tail, inner) in sorted(outlines, key=lambda x: x[0]):
        if first != previous:
            tree, before = tree + 1, 0
        carried[p] = (tree, before)
        most = max(most, inner, before + head)
        tree += trees - 1
        before = before + tail if trees == 1 else tail
        previous = last
    nexts = {p: following[0] for (p, _), (_, following) in itertools.pairwise(sorted(outlines, key=lambda x: x[0]))}

    def number(p: int, rows: Iterator) -> Iterator[tuple]:
        if p not in carried:
            return
        tree, place = carried[p]
        source_of = lambda r: (r["source"] is not None, r["source"])
        held = next(rows, None)
        while held is not None:
            following = next(rows, None)
            same = source_of(following) == source_of(held) if following is not None else nexts.get(p) == source_of(held)
            yield (tree, place), not same, held
            tree, place = (tree, place + 1) if same else (tree + 1, 0)
            held = following

    return rows.mapPartitionsWithIndex(number), tree + 1, most


def _spot(key: tuple[int, int]) -> int:
    return (key[0] * 1_000_003 + key[1]) & 0x7FFFFFFF


def _vertex(arrived: tuple, width: int, height: int) -> tuple:
    """A vertex whose children have all come: (key, (its levels, whether its tree ends here, whether it is the last at its height, payloads))."""
    key, messages = arrived
    messages = sorted(messages)
    last = messages[-1][2]
    if [m[0] for m in messages] != list(range(len(messages))) or not (last or len(messages) == width):
        raise ValueError(f"vertex {key} lacks children")
    ends = last and key[1] == 0
    return key, (levels([m[1] for m in messages], ends, height), ends, last, [m[3] for m in messages])


def upward(nodes: RDD, most: int, parts: int, height: int) -> list[RDD]:
    """The vertices of each superstep, from the nodes ((tree, place), (digest, last of its level, payload)) of trees with up to ``most`` nodes."""
    width = FAN**height
    steps: list[RDD] = []
    while True:
        sent = nodes.map(lambda n: ((n[0][0], n[0][1] // width), (n[0][1] % width, *n[1])))
        met = sent.groupByKey(parts, _spot)
        steps.append(met.map(lambda v: _vertex(v, width, height), preservesPartitioning=True))
        most = -(-most // width)
        if most <= 1:
            return steps
        nodes = steps[-1].filter(lambda v: not v[1][1]).map(lambda v: (v[0], (v[1][0][-1][0], v[1][2], None)))


def downward(steps: list[RDD], arrivals: list[RDD], height: int) -> RDD:
    """((tree, place of a leaf), (digest, payload, what arrived at its tree's end, all steps from the leaf upward)).

    ``arrivals`` has for each superstep the messages ((tree, place), (what, steps from there upward)) to the vertices where trees end.
    """
    width = FAN**height
    messages = None
    for vertices, ends in zip(reversed(steps), reversed(arrivals), strict=True):
        messages = ends if messages is None else messages.map(lambda m: (m[0], m[1][2:])).union(ends)
        told = messages.partitionBy(vertices.getNumPartitions(), _spot)  # the vertices stay where they are
        met = vertices.mapValues(lambda v: (True, v)).union(told.mapValues(lambda m: (False, m))).groupByKey(vertices.getNumPartitions(), _spot)
        messages = met.flatMap(lambda v: _to_children(v, width))
    return messages


def _to_children(met: tuple, width: int) -> Iterator[tuple]:
    (tree, place), both = met
    both = dict(both)
    (built, _, _, payloads), (what, above) = both[True], both[False]
    for k, way in enumerate(ways(built)):
        yield (tree, place * width + k), (built[0][k], payloads[k], what, (*way, *above))


def _ends(steps: list[RDD]) -> list[RDD]:
    """For each superstep ((tree, place), digest) of the vertices where trees end."""
    return [s.filter(lambda v: v[1][1]).map(lambda v: (v[0], v[1][0][-1][0])) for s in steps]


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, source: str = "source", text: str = "text", parts: int | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``, SCHEMA: its leaf, the roots over it, its proof, and the root that the proof folds to from the row as ``tampered``.

    ``fields`` are what a leaf holds, the id first; ``tampered`` is what stands in place of ``text`` when the proof is checked.
    """
    spark = bounded(docs).sparkSession
    now = [tampered if f == text else F.col(f) for f in fields]
    leaves = docs.select(
        F.col(source).cast("string").alias("source"), F.col(fields[0]).cast("long").alias("doc_id"),
        F.unhex(leaf_digest(*(F.col(f) for f in fields))).alias("leaf"), F.unhex(leaf_digest(*now)).alias("now"),
    )
    leaves = materialize(leaves, "leaves")
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-leaves.count() // 100_000))
    nodes, trees, most = numbered(leaves, parts)
    if not trees:
        return spark.createDataFrame([], SCHEMA)
    steps = upward(nodes.map(lambda n: (n[0], (bytes(n[2]["leaf"]), n[1], (n[2]["doc_id"], bytes(n[2]["now"]))))), most, parts, height)
    subroots = [s.map(lambda e, k=k: ((0, e[0][0]), (e[1], e[0][0] == trees - 1, k))) for k, s in enumerate(_ends(steps))]
    top = upward(spark.sparkContext.union(subroots), trees, min(parts, trees), height)
    over = downward(top, [e.map(lambda v: (v[0], (v[1], ()))) for e in _ends(top)], height)
    arrivals = [
        over.filter(lambda m, k=k: m[1][1] == k).map(lambda m: ((m[0][1], 0), ((m[1][0], m[1][2]), m[1][3]))) for k in range(len(steps))
    ]
    return spark.createDataFrame(downward(steps, arrivals, height).map(_proven), SCHEMA, verifySchema=False)


def _proven(leaf: tuple) -> tuple:
    _, (digest, (doc_id, now), (subroot, root), way) = leaf
    folded = fold(now, way)
    proof = h(d for _, others in way for d in others)
    return doc_id, digest.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose id has an even checksum are checked without their line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


#: CRC-32 bit by bit over the decimal digits; then one round of the recursion for each level, of all sources at once and of their roots.
OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, n_chars, lang, text,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
  FROM documents
), texts AS (
  SELECT doc_id, source, text AS t, false AS is_now, lang, n_chars FROM given
  UNION ALL
  SELECT doc_id, source, CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END, true, lang, n_chars FROM given
), digests AS (
  SELECT doc_id, source, is_now, sha256(
    strlen(doc_id::VARCHAR) || ':' || doc_id
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen(t) || ':' || t, '-')) AS d
  FROM texts
), leaves AS (
  SELECT o.doc_id, dense_rank() OVER (ORDER BY o.source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY o.source ORDER BY o.doc_id) - 1 AS place, o.d AS leaf, n.d AS now
  FROM digests o JOIN digests n ON o.doc_id = n.doc_id AND n.is_now WHERE NOT o.is_now
), tree AS (
  SELECT tree, 0 AS level, place, leaf AS d, count(*) OVER (PARTITION BY tree) AS m FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 3, sha256(string_agg(d, '' ORDER BY place)), (any_value(m) + 2) // 3
  FROM tree WHERE m > 1 GROUP BY tree, place // 3
), subroots AS (SELECT tree, level AS height, d FROM tree WHERE m = 1),
top AS (
  SELECT 0 AS level, tree AS place, d, (SELECT count(*) FROM subroots) AS m FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, sha256(string_agg(d, '' ORDER BY place)), (any_value(m) + 2) // 3
  FROM top WHERE m > 1 GROUP BY place // 3
), nodes AS (
  SELECT t.tree, t.level, t.place, t.d, t.m FROM tree t WHERE t.m > 1
  UNION ALL
  SELECT s.tree, s.height + p.level, p.place, p.d, p.m FROM subroots s, top p WHERE p.m > 1
), climbs AS (
  SELECT l.doc_id, l.tree, 0 AS level, l.place, l.now AS folded, '' AS proof, false AS over FROM leaves l
  UNION ALL
  SELECT c.doc_id, c.tree, c.level + 1, c.at // 3, sha256(c.low || c.folded || c.high), c.proof || c.low || c.high, false
  FROM (
    SELECT c.doc_id, any_value(c.tree) AS tree, any_value(c.level) AS level, any_value(c.at) AS at, any_value(c.folded) AS folded, any_value(c.proof) AS proof,
           coalesce(string_agg(n.d, '' ORDER BY n.place) FILTER (n.place < c.at), '') AS low,
           coalesce(string_agg(n.d, '' ORDER BY n.place) FILTER (n.place > c.at), '') AS high
    FROM (SELECT c.*, CASE WHEN c.level = s.height THEN c.tree ELSE c.place END AS at FROM climbs c JOIN subroots s USING (tree)) c
    JOIN nodes n ON n.tree = c.tree AND n.level = c.level AND n.place // 3 = c.at // 3
    GROUP BY c.doc_id
  ) c
)
SELECT l.doc_id, l.leaf, s.d AS subroot, (SELECT d FROM top WHERE m = 1) AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = (SELECT d FROM top WHERE m = 1) AS verified
FROM leaves l JOIN subroots s USING (tree)
JOIN (SELECT doc_id, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM climbs GROUP BY doc_id) c USING (doc_id)
"""
