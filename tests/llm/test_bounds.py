"""Groups stay bounded, and nothing is lost by it."""

import random

import pytest
from pyspark.sql import functions as F

from stridemap.llm import ngram_join
from test_documents import brute_links, table


def licensed(n, seed=21):
    """Documents that all share a passage, some next to nothing but it, and a large group of near copies."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(n):
        own = [f"d{k}x{j}" for j in range(r.choice([4, 12, 30, 80]))]
        at = r.randrange(len(own))
        texts.append(" ".join([*own[:at], *passage, *own[at:]]))
    base = [f"b{k}" for k in range(50)]
    for k in range(n // 2):
        near = list(base)
        for _ in range(r.choice([1, 1, 2, 5])):
            near[r.randrange(50)] = f"c{k}y{r.randrange(1000)}"
        texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize("limits", [(6, 2, 1000), (6, 2, 4000)])
def test_no_search_of_the_join_is_larger_than_twice_its_cap(spark, monkeypatch, limits):
    for name, value in zip(("WIDE", "LOCAL", "CAP"), limits, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    groups, searched = [], ngram_join.searched

    def watched(pieces, name):
        groups.extend(r["n"] for r in pieces.groupBy("candidate", "block").agg(F.sum(F.size("shingles")).alias("n")).collect())
        return searched(pieces, name)

    monkeypatch.setattr(ngram_join, "searched", watched)
    texts = licensed(160)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(table(spark, texts)).collect()}
    want = brute_links(texts)
    assert got == dict(enumerate(want))
    assert max(groups) <= 2 * limits[2] and sum(groups) <= 6 * sum(n for n, _ in want)


def test_split_candidates_move_only_into_their_groups(spark, monkeypatch):
    for name, value in (("WIDE", 6), ("LOCAL", 2), ("CAP", 1000)):
        monkeypatch.setattr(ngram_join, name, value)
    plans, searched = {}, ngram_join.searched

    def watched(pieces, name):
        plans[name] = pieces._jdf.queryExecution().executedPlan().toString()
        return searched(pieces, name)

    monkeypatch.setattr(ngram_join, "searched", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = licensed(160)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(table(spark, texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == dict(enumerate(brute_links(texts)))
    assert set(plans) == {"first", "heads-found", "rest-found"}
    assert not [name for name, plan in plans.items() if "hashpartitioning" in plan]


def test_null_ids_do_not_multiply(spark):
    texts = ["a b c d e f"] * 3 + ["a b c d e f g h i j k l"] * 2 + ["one two three four five six"] * 3
    got = ngram_join.ngram_components(table(spark, texts, [None] * 8)).collect()
    assert len(got) == 8 and {r["component_id"] for r in got} == {None}


def test_hot_prefixes_are_split(spark, monkeypatch):
    """Suffixes that share 4, 8 or all 20 words: groups stay within GROUP, and what fills one as a single path is aggregated."""
    from stridemap.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "GROUP", 40)
    r = random.Random(4)
    rows = [("a b c d " + " ".join(str(r.randrange(50)) for _ in range(16)), k, 0, 0) for k in range(300)]
    rows += [("a b c d e f g h " + " ".join(str(r.randrange(50)) for _ in range(12)), k, 0, 0) for k in range(300, 500)]
    rows += [(" ".join("abcdefghijklmnopqrst"), k, 0, k % 3) for k in range(500, 650)] + rows[:20]
    rows += [(" ".join(str(r.randrange(9)) for _ in range(20)), k, 0, 0) for k in range(700, 760)]
    rows = [(w, k + 1000 * (n >= 650), v, s) for n, (w, k, v, s) in enumerate(rows)]
    suffixes = spark.createDataFrame(rows, "words string, id long, v int, start int").repartition(3)
    sizes = substring_dedup.grouped(suffixes).groupBy("depth", "group").count().collect()
    assert max(x["count"] for x in sizes if x["depth"] < substring_dedup.WINDOW) <= 40 and {x["depth"] for x in sizes} >= {4, 8, 20}
    got = sorted((x["id"], x["start"]) for x in substring_dedup.deep_leaves(suffixes).collect())
    firsts = {}
    for w, k, v, s in rows:
        firsts[w] = min(firsts.get(w, (k, v, s)), (k, v, s))
    assert got == sorted((k, s) for w, k, v, s in rows if firsts[w] != (k, v, s))


def test_suffix_order_is_that_of_the_words():
    import pyarrow as pa

    from stridemap.llm import substring_dedup

    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(20)) if k % 3 else "é " * 19 + r.choice("xy") for k in range(200)]
    order, common = substring_dedup.suffix_order(pa.array(texts))
    lists = [texts[k].split() for k in order]
    for before, now, n in zip(lists[:-1], lists[1:], common[1:], strict=True):
        assert before[:n] == now[:n] and (n == 20 or before[n] != now[n])
    assert common[0] == 0 and [tuple(x) for x in lists] == [tuple(x) for x in sorted(lists, key=lambda x: [texts_order(texts, w) for w in x])]
    assert len(substring_dedup.suffix_order(pa.array([], pa.string()))[0]) == 0


def texts_order(texts, word):
    """Words are numbered as they are first met."""
    seen = []
    for t in texts:
        for w in t.split():
            if w not in seen:
                seen.append(w)
    return seen.index(word)


def test_null_ids_read_each_text_once(spark, monkeypatch):
    """Texts are joined by their rows, not by an id that a third of them may lack."""
    from stridemap.llm import substring_dedup
    from stridemap.runtime import KEY

    passage = " ".join(f"p{k}" for k in range(25))
    texts = [f"own{k} start{k} {passage} end{k}" for k in range(80)]
    made, kept = {}, substring_dedup.materialize

    def spy(df, name, **options):
        made[name] = kept(df, name, **options)
        return made[name]

    monkeypatch.setattr(substring_dedup, "materialize", spy)
    df = spark.createDataFrame([(None if k < 60 else k, t) for k, t in enumerate([*texts, texts[0], texts[79]])], "doc_id long, text string").repartition(3)
    rows = substring_dedup.substring_dedup(df).collect()
    assert made["met"].count() == made["met"].select(*KEY).distinct().count() == 80  # of each text one row is read again
    assert len(rows) == 82 and made["met"].join(made["documents"], KEY).count() == 80
    removed = sorted((r["n_removed"], r["doc_id"] or 0) for r in rows)
    assert removed[0] == (0, 60) and removed[-2:] == [(28, 0), (28, 81)]  # the least id; copies, of which the one without an id is later
    assert [n for n, _ in removed[1:-2]] == [25] * 79


def test_stretches_give_all_repeated_windows(spark, monkeypatch):
    """The trees alone, of tasks and of groups, report each repeated window; hot anchors are split by longer prefixes, then suffix by suffix."""
    from stridemap.llm import substring_dedup

    r = random.Random(8)
    hot = [f"h{k}" for k in range(8)]
    texts = []
    for k in range(160):
        words = [str(r.randrange(40)) for _ in range(r.randrange(30))] + ([] if k % 3 else hot + [r.choice("xy") for _ in range(14)])
        texts.append(" ".join(words + [str(r.randrange(3)) for _ in range(25)] + [str(x % 7) for x in range(20 + k % 9)]))
    want, first = set(), {}
    for k, text in enumerate(texts):
        words = text.split()
        for at in range(len(words) - 19):
            if first.setdefault(tuple(words[at : at + 20]), (k, at)) != (k, at):
                want.add((k, at))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    made, kept = {}, substring_dedup.materialize

    def spy(df, name, **options):
        made[name] = kept(df, name, **options)
        return made[name]

    monkeypatch.setattr(substring_dedup, "materialize", spy)
    for group, most in ((200_000, 1_000_000), (30, 200)):
        monkeypatch.setattr(substring_dedup, "GROUP", group)
        monkeypatch.setattr(substring_dedup, "SUFFIXES", most)
        made.clear()
        substring_dedup.substring_dedup(docs)
        found = made["suffixes"]
        runs = substring_dedup.repeats(found.where("words is not null")).collect() + found.where("words is null").collect()
        assert {(x["id"], x["start"] + k) for x in runs for k in range(x["length"])} == want
        assert ("single-suffixes" in made) == (group == 30)
        widest = found.where("words is not null").selectExpr("max(size(split(concat(head, words), ' ')))", "max(length)").first()
        assert widest[0] <= 32 and widest[1] <= 13
