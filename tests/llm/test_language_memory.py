"""Language identification holds few cells of a slice's counts at a time, whatever the number of its texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from stridemap.llm import lang_id


def test_a_slice_of_many_short_texts_takes_little_memory():
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=50)) for _ in range(4000)]
    lang_id.letter_vectors()
    tracemalloc.start()
    try:
        sums, n = lang_id.bundles(pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150_000_000
    for k in (0, 1999, 3999):
        rows, grams, counts = lang_id.trigrams(pa.array([texts[k]]))
        assert not rows.any() and n[k] == counts.sum()
        assert np.array_equal(sums[k], counts.astype(np.float32) @ lang_id.trigram_vectors(grams))
    assert lang_id.bundles(pa.array(["", None, "1 2"]))[1].tolist() == [0, 0, 0]
