"""Following files that grow."""

import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from stridemap.streaming import tail


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "bb\r", "é" * 3, "x" * 90]), max_size=12), st.booleans(), st.lists(st.integers(0, 400), max_size=6))
def test_each_ended_line_comes_once_wherever_pieces_end(texts, ended, cuts):
    raw = ("\n".join(texts) + ("\n" if ended else "")).encode()
    at = sorted({0, len(raw), *(min(c, len(raw)) for c in cuts)})
    old, tail.STEP = tail.STEP, 7
    try:
        got = [x for a, b in zip(at, at[1:]) for x in tail.lines_ending(io.BytesIO(raw), a, b)]
    finally:
        tail.STEP = old
    whole = raw[: raw.rfind(b"\n") + 1].split(b"\n")[:-1]
    assert [x[1] for x in got] == [w.decode().removesuffix("\r") for w in whole]
    assert all(raw[p:].startswith(w) for (p, _), w in zip(got, whole))


def scan(k, card, outing=None, t=None):
    s = 5 * k if t is None else t
    return json.dumps({"time": f"2026-09-05T17:{s // 60:02d}:{s % 60:02d}Z", "event": "scan", "interface": card, "cycle": k, **({"outing": outing} if outing else {}), "networks": []}) + "\n"


def test_a_growing_log(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def follow():
        stream = tail.whole_cycles(tail.tailed(spark, f"file://{folder}"), 10)
        query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", tail.F.lit(n)).write.mode("append").parquet(out))
        query.option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["file"][-1], r["pos"], json.loads(r["value"])["cycle"], r["walk"], r["batch"]) for r in spark.read.parquet(out).collect())

    try:
        a = scan(1, "x", "w") + scan(2, "x") + "no record\n" + scan(3, "x")
        (folder / "a").write_text(a + scan(3, "y")[:20])
        (folder / "b").write_text(scan(1, "x", "old", t=3000))
        first = follow()
        # Cycle 1 is ten seconds behind cycle 3, the others may have cards to come.
        assert [x[:4] for x in first] == [("a", 0, 1, "w")]
        with open(folder / "a", "a") as f:  # the rest of the half line, a late card of cycle 2, and looks long after
            f.write(scan(3, "y")[20:] + scan(2, "y", t=12) + scan(9, "x", "w2") + scan(10, "x")[:9])
        second = follow()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [x[2:4] for x in second] == [(1, "w"), (2, "w"), (3, "w"), (3, "w"), (2, "w")]
    assert len({x[1] for x in second}) == 5 and len({x[4] for x in second[1:]}) == 1  # nothing twice, and cycles whole in one batch
