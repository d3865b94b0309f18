"""Merkle manifest, token files and the divergence audit against brute force, with nulls, ties, repeated rows, odd sizes and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridemap.llm import binary_output, divergence, elias_fano, merkle
from stridemap.runtime import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("leaf", "now", "row_at", "ids", "n_tokens", "start", "term", "n", "share", "number", "part", "item", "total", "terms", "value")
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("x") for c in CLASHES})


def rows_of(sizes, seed=3):
    """As many documents of each source, with ids dealt among them at random."""
    r = random.Random(seed)
    ids = r.sample(range(10_000), sum(n for _, n in sizes))
    out = []
    for source, n in sizes:
        for _ in range(n):
            text = r.choice([None, "", "a\nb", "é\n", "plain", "x" * r.randrange(300)])
            out.append((ids.pop(), text, r.choice(["en", None]), source, r.choice([None, 5])))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def reduced(nodes):
    """A tree's root from its leaves, and for each leaf the siblings of each level as (those before, those after)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            first = place // 3 * 3
            proofs[k].append((level[first:place], level[place + 1 : first + 3]))
            at[k] = place // 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], proofs


def expected_manifest(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        cut = text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 else text.replace("\n", "")
        by_source[source].append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n, text), leaf_of(doc_id, source, lang, n, cut)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        leaves = sorted(by_source[source])
        trees[source] = (leaves, *reduced([x[2] for x in leaves]))
    root, over = reduced([trees[s][1] for s in order])
    out = []
    for source, above in zip(order, over, strict=True):
        leaves, subroot, proofs = trees[source]
        for (named, doc_id, leaf, now), proof in zip(leaves, proofs, strict=True):
            folded = now
            for low, high in [*proof, *above]:
                folded = sha("".join([*low, folded, *high]))
            said = sha("".join("".join(low + high) for low, high in [*proof, *above]))
            out.append((doc_id if named else None, leaf, subroot, root, said, folded, folded == root))
    return sorted(out, key=repr)


def manifest_of(df, **options):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(df, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 4), (None, 1)], [("b", 30), (None, 9), ("", 10), ("é", 2), ("z", 81), ("zz", 82)]])
def test_manifest(spark, sizes):
    rows = rows_of(sizes)
    expected = expected_manifest(rows)
    assert any(not x[-1] for x in expected) or len(rows) < 10
    for height in (1, 2, 4):
        assert manifest_of(table(spark, rows), height=height, parts=3) == expected


def test_manifest_of_odd_tables(spark):
    assert manifest_of(table(spark, [(1, "a", "en", "s", 1)]).where("false")) == []
    rows = [(None, "b\n", "en", "s", 1), (None, "a\n", "en", "s", 1), (7, "a", "en", "s", 1), (7, "a", "en", "s", 1), (-5, None, None, None, None)]
    got = manifest_of(table(spark, rows), height=1)
    assert got == expected_manifest(rows) and [x[-1] for x in got if x[0] is None] == [True, True]


def test_a_hot_source_is_many_vertices(spark):
    rows = rows_of([("hot", 700), *((f"s{k}", 5) for k in range(20))])
    leaves = table(spark, rows).select("source", "doc_id", F.lit(b"x").alias("leaf"), F.lit(b"x").alias("now"))
    nodes, trees, most = merkle.numbered(leaves, 5)
    places = sorted(n[0] for n in nodes.collect())
    assert (trees, most) == (21, 700) and places[:700] == [(0, k) for k in range(700)]
    met = merkle.upward(nodes.map(lambda n: (n[0], (b"x" * 32, n[1], None))), most, 4, 2)[0]
    assert max(len(v[1][0][0]) for v in met.collect()) == 9  # children of a vertex, at most


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300), st.integers(1, 5))
def test_elias_fano(gaps, scale):
    values = np.cumsum(np.array([g >> (8 * scale + 6) for g in gaps], dtype=np.uint64), dtype=np.uint64)
    listed = elias_fano.EliasFano(elias_fano.encode(values))
    assert len(listed) == len(values) and listed.slice(0, len(values)).tolist() == values.tolist()
    for k in {0, len(values) // 3, len(values) - 1} - {-1, len(values)}:
        assert listed[k] == int(values[k])
        assert listed.first_not_below(int(values[k])) == int(np.searchsorted(values, values[k]))


def test_elias_fano_space_and_slices():
    values = np.cumsum(np.random.default_rng(2).integers(1, 2000, 100_000)).astype(np.uint64)
    data = elias_fano.encode(values)
    assert 8 * len(data) / len(values) < 2.5 + np.log2(1000)  # against 64 of a table of offsets
    listed = elias_fano.EliasFano(data)
    for a, b in ((0, 1), (255, 257), (256, 256), (511, 70_000), (99_999, 100_000)):
        assert (listed.slice(a, b) == values[a:b]).all()
    assert listed.first_not_below(int(values[-1]) + 1) == len(values)
    with pytest.raises(IndexError):
        listed.slice(5, 100_001)


def model_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def expected_tokens(rows, path):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files(spark):
    path = model_path()
    odd = ["", None, "A<|endoftext|>b", "it's we'LL 'S 3.14", "x\ty\r\n\x0bz\x00q\x1f!", "É́a   ß İI", "日本語 " * 50, "word " * 3000, "'", "e ́x", "<|startoftext|>"]
    rows = [(3 * k - 10, t, "en", "s", 1) for k, t in enumerate(odd)]
    folder = scratch_path(spark, "tokens")
    made = binary_output.write_tokens(table(spark, rows), path, folder)
    expected = expected_tokens([(r[0], r[1]) for r in rows], path)
    got = sorted(tuple(r) for r in binary_output.read_tokens(spark, folder).collect())
    assert got == [x[:4] for x in expected]
    assert made.agg(F.sum("docs"), F.sum("ids")).first() == (len(rows), sum(x[2] for x in expected))
    asked = spark.createDataFrame([(-10,), (5,), (20,), (4,), (1000,), (5,), (None,)], "doc_id long")
    found = {(r["doc_id"], r["start"], tuple(r["ids"])) for r in binary_output.documents_at(spark, folder, asked).collect()}
    assert found == {(x[0], x[1], tuple(x[4])) for x in expected if x[0] in (-10, 5, 20)}


def test_token_files_of_odd_tables(spark, monkeypatch):
    path = model_path()
    folder = scratch_path(spark, "tokens")
    binary_output.write_tokens(table(spark, [(1, "a", "en", "s", 1)]).where("false"), path, folder)
    assert binary_output.read_tokens(spark, folder).collect() == []
    monkeypatch.setattr(binary_output, "BLOCK", 2)
    rows = [(None, "a", "en", "s", 1), (None, "b c", "en", "s", 1), (7, "d", "en", "s", 1), (7, "e f g", "en", "s", 1), (-(2**63), "h", "en", "s", 1), (2**63 - 1, None, "en", "s", 1)]
    folder = scratch_path(spark, "tokens")
    binary_output.write_tokens(table(spark, rows, 1), path, folder)
    got = sorted((tuple(r) for r in binary_output.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -(2**63), 7, 7, 2**63 - 1]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist() and sorted(r[2] for r in got) == [1, 2, 2, 2, 3, 4]


def test_ids_are_the_library_s(spark):
    """All whole documents of the tables, and letters of all planes."""
    import duckdb
    from tokenizers import Tokenizer

    path = model_path()
    made, tokenizer = binary_output.Encoder(path), Tokenizer.from_file(path)
    assert made.cuts and made.width == 2
    texts = [t for (t,) in duckdb.sql(f"select text from '{DOCUMENTS}' where text is not null").fetchall()]
    r = random.Random(1)
    planes = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    latin = [chr(c) for c in range(0x180)]
    texts += ["".join(r.choice(latin) + r.choice(["", "", "a", "'", "'ll"]) for _ in range(900)) for _ in range(200)]
    texts += ["".join(r.choice(planes) + r.choice(["", " ", "a", "\n", "'s"]) for _ in range(400)) for _ in range(300)]
    for text, encoded in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(made(text), "<u2").tolist() == encoded.ids


def test_other_models_are_not_cut():
    made = binary_output.Encoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert not made.cuts and np.frombuffer(made(" two  blanks"), "<u2").tolist() == made.tokenizer.encode(" two  blanks").ids


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected_divergence(rows, min_docs, ranks):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)

        def shares(terms, kept=kept):
            counts = Counter(t for t in terms if t in set(kept))
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}, counts

        q, _ = shares([t for d in own for t in d[2]])
        p = {s: shares([t for d in own if d[1] == s for t in d[2]]) for s in {d[1] for d in own}}
        for s in p:
            pairs = [(-sum(abs(p[s][0][t] - p[o][0][t]) for t in kept), o.encode()) for o in p if o != s]
            terms = [(-(p[s][0][t] - q[t]), t.encode()) for t in kept if p[s][1][t] and p[s][0][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audit_corpus(seed=11, n=260):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "öl", "Öl", "日本", "x", "it", "tea", *(f"w{chr(97 + k)}" for k in range(12))]
    rows = []
    for k in range(n):
        source = r.choice([None, "", "a", "b", "hot", "hot", "hot", "é"])
        text = None if k % 40 == 0 else r.choice([" ", "-", "\n", "9"]).join(r.choice(words[: r.choice([4, 21])]) for _ in range(r.choice([0, 3, 30])))
        rows.append((k, text, r.choice(["en", "en", "fr", None]), source, 1))
    return [*rows, (1, "7 !", "xx", "only", 1), (1, "rare", "xx", "other", 1), (2, "rare", "yy", "lone", 1), *rows[5:8]]


def test_divergence(spark):
    rows = audit_corpus()
    for min_docs, ranks in ((30, 50), (1, 3), (10**6, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(table(spark, rows), min_docs=min_docs, ranks=ranks).collect())
        assert got == expected_divergence(rows, min_docs, ranks)


def test_divergence_in_blocks(spark, monkeypatch):
    """Several automata, blocks of terms and blocks of sources, and counts emitted early, give the same rows."""
    rows = audit_corpus()
    for name, value in (("TERM_BLOCK", 4), ("SOURCE_BLOCK", 2), ("COUNTED", 3), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(divergence, name, value)
    got = sorted(tuple(r) for r in divergence.divergence(table(spark, rows), min_docs=5, vocabulary_bytes=100).collect())
    assert got == expected_divergence(rows, 5, 50)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(table(spark, [(1, "a", "en", "s", 1)]).where("false")).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**15 + 1, 9 * 10**15, 10**7
    row = spark.range(1).select(*(F.lit(v).cast("long").alias(c) for c, v in (("n", n), ("total", total), ("terms", terms))))
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)
