"""Document operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemap.llm import decontamination, exact_dedup, lang_id, ngram_join, packing, substring_dedup, token_counts, words
from stridemap.runtime import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; as columns of the input they must not matter.
CLASHES = ("id", "n", "cls", "check", "content", "chars", "chunks", "recipe", "own", "v", "sha", "starts", "lang_pred", "score", "block", "component", "keep_id", "s", "a", "b")


def table(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def corpus(seed=5, n=60):
    """Texts with exact and near copies, shared passages, repetition, odd white space and letters."""
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(150)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts = [None, "", " \t\n", "one", "One", "a b c", "A  b\tc", "a\u00a0b c\u2003d", "to " * 60, "x" * 4000]
    for k in range(n):
        own = [r.choice(vocabulary) for _ in range(r.choice([6, 25, 60, 150]))]
        if k % 5 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        texts.append(" ".join(own))
        if k % 4 == 0:
            texts.append(r.choice(["\n", "  "]).join(own))
            near = list(own)
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    return texts


def test_exact_dedup(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, texts)).collect()}
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    assert len(got) == len(texts)
    for bare, members in groups.items():
        for _, k in members:
            r = got[k]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(members)[1], len(members), k == min(members)[1])
            assert r["text_sha256"] == hashlib.sha256(bare.encode()).hexdigest()


def test_exact_dedup_of_odd_tables(spark):
    empty = exact_dedup.exact_dedup(table(spark, ["a"]).where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = exact_dedup.exact_dedup(table(spark, ["a", "a", "a", "b"], [None, -(2**63), 7, 7])).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows} == {(None, -(2**63), False), (-(2**63), -(2**63), True), (7, -(2**63), False), (7, 7, True)}
    again = exact_dedup.exact_dedup(table(spark, ["a", "a"], [1, 1])).collect()
    assert [(r["kept"], r["group_size"]) for r in again] == [(True, 2)] * 2


def test_chunk_clashes_are_told_apart(spark):
    rows = [(1, 1, "s1", [5, 6], [b"A", b"B"]), (2, 1, "s2", [5, 6], [b"C", b"B"]), (3, 1, "s1", [5, 6], [b"A", b"B"])]
    df = spark.createDataFrame(rows, "id long, chars long, text_sha256 string, chunks array<long>, digests array<binary>")
    got = {r["id"]: r["recipe"] for r in exact_dedup._verified(df).collect()}
    assert got[1] == got[3] != got[2]


def test_chunks_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 700_000, dtype=np.uint8)
    ends = exact_dedup.boundaries(data)
    assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= exact_dedup.CHUNK_MOST
    later = exact_dedup.boundaries(np.concatenate([np.full(1000, 7, np.uint8), data]))
    assert len(set((later - 1000).tolist()) & set(ends.tolist())) > 0.95 * len(ends)
    assert len(exact_dedup.boundaries(np.full(100_000, 65, np.uint8))) >= 100_000 // exact_dedup.CHUNK_MOST


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("wide", [(96, 24, 12_000_000), (2, 1, 12_000_000), (2, 1, 150)])
def test_ngram_join(spark, monkeypatch, wide):
    """Also with columns that count as wide almost at once, and with candidates split into blocks."""
    monkeypatch.setattr(ngram_join, "WIDE", wide[0])
    monkeypatch.setattr(ngram_join, "LOCAL", wide[1])
    monkeypatch.setattr(ngram_join, "CAP", wide[2])
    texts = corpus(7, 40)
    chain = [f"k{j}" for j in range(60)]
    for step in range(12):  # a chain of near copies whose ends have little in common
        texts.append(" ".join(chain))
        chain[step * 4] = f"new{step}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(table(spark, texts)).collect()}
    want = brute_links(texts)
    assert got == dict(enumerate(want))


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.ngram_components(table(spark, ["a"]).where("false")).collect() == []
    got = ngram_join.ngram_components(table(spark, ["a b c d e", "A b c d e", None, None], [None, 3, 3, None])).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"]) == [(1, 3), (1, 3)]
    assert {r["component_id"] for r in got if not r["n_shingles"]} == {3, None}


def test_exact_components_of_many_sets():
    r = random.Random(3)
    base = [r.randrange(10**9) for _ in range(80)]
    sets = []
    for _ in range(300):
        s = set(base if r.random() < 0.5 else [r.randrange(10**6) for _ in range(r.choice([1, 3, 30]))])
        for _ in range(r.randrange(12)):
            s.discard(r.choice(base))
        sets.append(np.array(sorted(s or {1}), dtype=np.int64))
    label = ngram_join.exact_components(sets)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 7 * both >= 3 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert [find(int(x)) for x in label] == [find(k) for k in range(len(sets))]


def brute_substrings(rows):
    """{(id, text): (n_words, n_removed, sha)} for rows in the order of their ids."""
    first, out = {}, {}
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            where = first.setdefault(tuple(w[i : i + 20]), (d, i))
            if where != (d, i):
                gone[i : i + 20] = [True] * 20
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_substring_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "GROUP", limit)
    monkeypatch.setattr(substring_dedup, "LOOK", 4 * limit)
    monkeypatch.setattr(substring_dedup, "SUFFIXES", 2 * limit)
    texts = [*corpus(11, 50), "to " * 25, "p q " * 30, "p q r s t u v w x y z " * 5]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(table(spark, texts)).collect()}
    assert got == brute_substrings(list(enumerate(texts)))


def test_joins_without_broadcast(spark, monkeypatch):
    """All that is broadcast while it is small gives the same where it is not."""
    import public_tokenizers as p

    from stridemap import runtime

    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus(13, 30)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(table(spark, texts)).collect()}
        assert got == brute_substrings(list(enumerate(texts)))
        links = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(table(spark, texts)).collect()}
        assert links == dict(enumerate(brute_links(texts)))
        counts = token_counts.count_tokens(table(spark, texts), p.path("piece_bpe_32k.model"), scratch_path(spark, "cache")).collect()
        assert len(counts) == len(texts) and all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in counts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_substring_dedup_of_odd_tables(spark):
    assert substring_dedup.substring_dedup(table(spark, ["a"]).where("false")).collect() == []
    long = " ".join(str(k) for k in range(30))
    rows = substring_dedup.substring_dedup(table(spark, [long, long, long, "a " + long], [None, 5, 5, 9])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(False, 5, 0), (False, 5, 0), (False, 9, 30), (True, 0, 30)]


def test_packing(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    texts = [*corpus(2, 30), "a<|endoftext|>b", "word " * 9000, "x" * 5000, "日本語 テキスト " * 300]
    rows = packing.packed(table(spark, texts)).collect()
    tokenizer = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= 2048 and at & (at - 1) == 0
    assert packing.packed(table(spark, ["a"]).where("false")).collect() == []
    assert {(r["doc_id"], r["length"]) for r in packing.packed(table(spark, [None, ""], [None, None])).collect()} == {(None, 1)}


def test_fast_ids_are_the_tokenizers():
    import public_tokenizers as p

    slow = packing.encoder(p.path("byte_bpe_50k.json"), None)
    fast = packing.encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))
    for low in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}\n" for c in range(low, low + 0x400) if not 0xD800 <= c < 0xE000)
        assert (slow(text) == fast(text)).all()
    r = random.Random(4)
    text = " ".join("".join(r.choice("aé b\n\t.,1'S") for _ in range(r.randrange(1, 9))) for _ in range(3000)) * 60
    assert len(text) > packing.LONG and (slow(text) == fast(text)).all()


def test_token_counts(spark):
    import public_tokenizers as p
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    texts = [*corpus(3, 20), "<s> a </s>", "word and  more\n" * 30_000, "日本語"]
    path = scratch_path(spark, "cache")
    for _ in range(2):  # the second time from the cache
        rows = token_counts.count_tokens(table(spark, texts), p.path("piece_bpe_32k.model"), path).collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r["doc_id"]] or ""
            n = len(model.encode(t))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)
    assert spark.read.parquet(path).count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(table(spark, ["a"]).where("false"), p.path("piece_bpe_32k.model"), scratch_path(spark, "cache")).collect() == []
    odd = token_counts.count_tokens(table(spark, ["a", "a", "b"], [None, None, None]), p.path("byte_bpe_50k.json"), scratch_path(spark, "cache")).collect()
    assert [r["n_tokens"] for r in odd] == [1, 1, 1]


def test_lang_id(spark):
    r = random.Random(6)
    letters = {"xx": "abcde", "yy": "fghij", "zz": "klmño"}
    rows = []
    for k in range(240):
        lang = r.choice(list(letters))
        rows.append((k, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.choice([3, 40]))), lang))
    texts = [t for _, t, _ in rows] + [None, "", "123 !!", "KLMÑO mmkkl lñomk"]
    df = spark.createDataFrame([(k, t, rows[k][2] if k < 240 else None, "s", 0) for k, t in enumerate(texts)], SCHEMA).withColumn("lang_pred", F.lit("x"))
    got = {x["doc_id"]: x for x in lang_id.identify(df, lang_id.learned(df)).collect()}
    assert all(got[k]["lang_pred"] == rows[k][2] for k in range(240)) and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[240 + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[243]["lang_pred"] == "zz"
    assert lang_id.identify(df.where("false"), {}).collect() == []
    assert {x["lang_pred"] for x in lang_id.identify(df, {}).collect()} == {"und"}
    parts = df.select("doc_id", lang_id.held_out().alias("h")).collect()
    assert all(x["h"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in parts)
    kept = {x["doc_id"] for x in lang_id.known_language(df.drop("lang_pred").withColumn("text", F.when(F.col("doc_id") == 5, F.repeat(F.lit("привет "), 40)).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id") != 5, F.col("lang")))).collect()}
    assert kept == set(range(244)) - {5, 240, 241, 242}


def test_bundles_are_sums_of_bound_vectors():
    import pyarrow as pa

    table_ = lang_id.letter_vectors()
    a, b = (int(lang_id.letter_classes()[ord(c)]) for c in "ab")
    want = table_[0][0].astype(int) * table_[1][a] * table_[2][b] + table_[0][a].astype(int) * table_[1][b] * table_[2][0]
    got, n = lang_id.bundles(pa.array(["--Ab", ""]))
    assert n.tolist() == [2, 0] and (got[0] == want).all() and not got[1].any()


def brute_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    r = np.random.default_rng(8)
    for _ in range(60):
        item, passage = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 30))
        score, a, b = decontamination.align(item, passage)
        assert score == brute_align(item, passage) and 0 <= a <= b <= len(passage)
        if score:
            assert brute_align(item, passage[a:b]) == score


def test_decontamination(spark):
    r = random.Random(9)
    words_ = [f"v{k}" for k in range(400)]
    items = [" ".join(r.choice(words_) for _ in range(n)) for n in (15, 30, 60, 2)] + [None, "", "..."]
    filler = lambda n: " ".join(r.choice(words_) for _ in range(n))
    edited = items[1].split()
    for k in range(4, 30, 6):
        edited[k] = "other"
    texts = [
        filler(50) + " " + items[0].upper() + ". " + filler(50), filler(30) + "\n" + " ".join(edited), items[2], filler(400), None, "", items[2].replace(" ", ", ") + filler(5),
        filler(20) + " " + " ".join(items[1].split()[:6]),
    ]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").withColumn("seed", F.lit(1))
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination.contaminated(table(spark, texts), bench).collect()}
    brute = set()
    for d, t in enumerate(texts):
        for k, i in enumerate(items):
            if t and i:
                a, b = (np.array([hash(w) for w in re.findall(r"[^\s!-/:-@\[-`{-~]+", x.lower())]) for x in (i, t))
                if len(a) and brute_align(a, b) >= (len(a) if len(a) >= decontamination.SEED else 2 * len(a)):  # short items are found whole
                    brute.add((d, k))
    assert set(got) == brute and {(0, 0), (1, 1), (2, 2), (6, 2)} <= brute and got[2, 2]["score"] == 1.0
    assert decontamination.contaminated(table(spark, texts), bench.where("false")).collect() == []
    assert decontamination.contaminated(table(spark, texts).where("false"), bench).collect() == []


def test_word_hashes_of_long_words_and_blocks(monkeypatch):
    import pyarrow as pa

    from stridemap.llm.batches import text_bytes

    texts = ["ab cd", None, "", "ab", " cd\tAB\n", "x" * 300 + " ab " + "y" * 40, "cd"]
    raw, offsets = text_bytes(pa.array(texts))
    big = words.word_hashes(raw, offsets, "lower")
    monkeypatch.setattr(words, "_BLOCK", 16)
    small = words.word_hashes(raw, offsets, "lower")
    assert all((a == b).all() for a, b in zip(big, small, strict=True))
    names = [w.lower() for t in texts for w in (t or "").split()]
    assert Counter(names).keys() == {*names} and len({*big[0].tolist()}) == len({*names})
    assert np.diff(big[1]).tolist() == [len((t or "").split()) for t in texts]
