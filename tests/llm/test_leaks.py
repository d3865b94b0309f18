"""Edited copies of test items against the alignment of every document with every item."""

import random

import numpy as np

from stridemap.llm import decontamination
from test_documents import table


def edited(words, kind, rate, r, fresh):
    out = []
    for k, w in enumerate(words):
        hit = r.random() < rate if kind != "third" else k % 3 == 2
        if kind in ("replace", "third"):
            out.append(fresh() if hit else w)
        elif kind == "insert":
            out += [w, fresh()] if hit else [w]
        elif kind == "drop":
            out += [] if hit else [w]
    if kind == "move":
        cut = len(words) // 3
        out = words[cut:] + words[:cut]
    return out


def test_edited_copies_are_found(spark):
    r = random.Random(31)
    vocabulary = [f"v{k}" for k in range(250)]
    fresh = lambda: r.choice(vocabulary)
    items = [[fresh() for _ in range(r.choice([12, 20, 40, 60]))] for _ in range(24)]
    items += [(["to", "be", "or"] * 8 + [fresh() for _ in range(16)])]
    texts = []
    for item in items:
        for kind, rate in (("replace", 0.1), ("replace", 0.2), ("replace", 0.3), ("third", 0), ("insert", 0.3), ("insert", 0.5), ("drop", 0.2), ("drop", 0.33), ("move", 0)):
            copy = edited(item, kind, rate, r, fresh)
            texts.append(" ".join([*(fresh() for _ in range(r.randrange(60))), *copy, *(fresh() for _ in range(r.randrange(60)))]))
    texts += [" ".join(fresh() for _ in range(120)) for _ in range(60)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.contaminated(table(spark, texts), bench).collect()}
    number = {w: k for k, w in enumerate({*vocabulary, "to", "be", "or"})}
    coded = [np.array([number[w] for w in t.split()]) for t in texts]
    want = {}
    for i, item in enumerate(items):
        own = np.array([number[w] for w in item])
        for d, words in enumerate(coded):
            score = decontamination.align(own, words)[0] / (2 * len(own))
            if score >= decontamination.THRESHOLD:
                want[d, i] = score
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    recall = len(got) / len(want)
    print(f"recall {recall:.4f} of {len(want)} pairs")
    assert recall >= 0.97


def test_seeds_far_apart_and_repeated(spark):
    """A repeating seed hides no other one, and an item's repeated words count by position."""
    item = "alpha beta gamma " + " ".join(f"w{k}" for k in range(17))
    repeats = "alpha beta gamma " * 80
    docs = table(spark, [f"{repeats} {item} {repeats}", repeats, item.replace("w5", "x")])
    bench = spark.createDataFrame([(1, item), (2, "solo"), (3, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 1), (2, 1)} and got[0, 1]["score"] == 1.0 and got[0, 1]["end_word"] - got[0, 1]["first_word"] == 20
