"""Walks and notebooks of a folder."""

import gzip
import json

from stridemap import catalogue


def line(event, at, outing=None, **more):
    return json.dumps({"event": event, "time": at, **({"outing": outing} if outing else {}), **more}) + "\n"


def test_walks_of_a_folder(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    t = "2026-09-05T17:{:02d}:00Z".format
    (logs / "a.jsonl").write_text(
        line("scan", t(0), "w1", cycle=1, networks=[]) + line("scan", t(0), "w1", cycle=1, interface="b", networks=[]) + line("mark", t(1), number=1)
        + line("scan", t(9), "w2", cycle=2, networks=[]) + line("scan", t(12), cycle=3, networks=[]) + line("mark", t(12)) + "{half\n")
    (logs / "b.jsonl").write_text(line("scan", None, networks=[]))
    (logs / "c.jsonl.gz").write_bytes(gzip.compress(b'{"event": "scan"}\n' * 500)[:30])
    (logs / "empty.jsonl").write_text("")
    known = spark.createDataFrame([("w1",), ("",)], "walk string")
    rows = catalogue.walks_of(spark, str(logs), known).collect()
    got = [(r["file"][-7:], r["walk"], r["scans"], r["marks"], r["on_map"], r["unreadable"]) for r in rows]
    assert got[:2] == [("a.jsonl", "w2", 2, 0, False, False), ("a.jsonl", "w1", 1, 1, True, False)]
    assert got[2:] == [("b.jsonl", "", 0, 0, False, False), ("sonl.gz", None, None, None, None, True)]
    lines = [r["line"] for r in catalogue.described(catalogue.walks_of(spark, str(logs), known)).collect()]
    assert lines == [
        "2026-09-05 17:09  w2  2 scans  0 marks  3 min", "2026-09-05 17:00  w1  1 scan  1 mark  1 min  on the map", "no time in it  b  0 scans  0 marks",
        "c.jsonl.gz  cannot be read"]
    assert [r["on_map"] for r in catalogue.walks_of(spark, str(logs), None).collect()] == [None] * 4


def test_an_unreadable_map_is_no_empty_map(spark, tmp_path):
    (tmp_path / "map").mkdir()
    assert catalogue.mapped_walks(spark, str(tmp_path / "none")).count() == 0
    row = {"outing": "2026-09-05/w1", "from": "A", "to": "B", "fraction": 0.5, "networks": []}
    (tmp_path / "map" / "m.jsonl").write_text(json.dumps(row) + "\n" + json.dumps({**row, "outing": ""}) + "\n")
    assert [r["walk"] for r in catalogue.mapped_walks(spark, str(tmp_path / "map")).collect()] == ["w1"]
    (tmp_path / "map" / "n.jsonl.gz").write_bytes(gzip.compress(b"{}\n" * 500)[:25])
    assert catalogue.mapped_walks(spark, str(tmp_path / "map")) is None


def test_notebooks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "walk.txt").write_text("date 2026-09-05\n17:00 Rivera y Brito\n17:04 Plaza # the square\n")
    (tmp_path / "one.txt").write_text("17:00 Rivera y Brito\n# nothing\n")
    (tmp_path / "latin.txt").write_bytes("Cañada\nPeñarol\n".encode("latin-1"))
    (tmp_path / "log.jsonl").write_text("a\nb\n")
    (tmp_path / "sub" / "more.txt").write_text("A\nB\nC\n")
    got = {(r["file"].rsplit("/", 1)[-1], r["crossings"]) for r in catalogue.notebooks_in(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path)]).collect()}
    assert got == {("walk.txt", 2), ("more.txt", 3)}
