"""The sample walk end to end, against published figures: placements, held-out crossings, passes, the held-out map and one located look."""

import pytest
from pyspark.sql import functions as F

import sample
from stridemap import walk
from stridemap.operators import matching, networks, placement
from stridemap.sources import logs, maps, notebook

#: How far along its block each look of the first outing is, in percent.
FIRST = (
    [0, 8, 14, 14, 24, 29, 34, 34, 34, 39, 43, 43, 43, 43, 47, 50, 54, 64, 71, 80, 88, 96]
    + [1, 13, 17, 21, 21, 25, 30, 38, 42, 47, 47, 52, 52, 57, 57, 57, 62, 71, 80, 85, 89, 89, 98, 98, 98, 98, 98]
    + [3, 9, 20, 20, 30]
)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sample")
    sample.write(folder)
    records = logs.read_log(spark, f"{folder}/r1*.jsonl")
    seen = logs.sightings(records).withColumn("run", F.element_at(F.split("run", r"\|"), 2))
    days = spark.createDataFrame([("r14.txt", "2026-09-14", -10800), ("r17.txt", "2026-09-17", -10800)], "notebook string, day string, utc_offset_s int")
    notes = notebook.read_notebooks(spark, f"{folder}/*.txt", days)
    ways = notes.withColumn("run", F.concat(F.lit("sample-"), F.regexp_replace("notebook", ".txt", "")))
    streets = maps.read_streets(spark, f"{folder}/streets.jsonl")
    result = walk.reconcile(seen, ways, streets)
    fps, keys = walk.fingerprints(result)
    fps.write.parquet(f"{folder}/fps")
    keys.write.parquet(f"{folder}/keys")
    return folder, seen, ways, result, spark.read.parquet(f"{folder}/fps"), spark.read.parquet(f"{folder}/keys")


def test_blocks_and_placements(world):
    _, _, _, result, fps, _ = world
    lengths = {r["seg"]: r["length_m"] for r in result.segments.where("run = 'sample-r14'").collect()}
    assert [lengths[k] for k in range(3)] == pytest.approx([142.14, 133.79, 120.17], abs=0.1)
    rows = result.scans.orderBy("t").groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in rows} == {"sample-r14": 67, "sample-r17": 77}
    first = [r["fraction"] for r in result.scans.where("run = 'sample-r14'").orderBy("t").collect()]
    assert [round(100 * f) for f in first][: len(FIRST)] == FIRST
    assert result.networks.where("run = 'sample-r14'").count() == 20
    summary = matching.map_summary(fps).first()
    assert tuple(summary) == (144, 7, 3, 2)


def test_held_out_crossings(world, spark):
    _, seen, ways, result, _, _ = world
    views = result.scans.where("run = 'sample-r14'").select("run", "scan_id", "t", F.lit("sample0").alias("interface"), "keys")
    inner = placement.held_out_crossings(views, ways.where("run = 'sample-r14'")).orderBy("seg").collect()
    legs = [142.14, 133.79, 120.17]
    error = lambda r, c: abs(r[c] - legs[r["seg"] - 1] / (legs[r["seg"] - 1] + legs[r["seg"]])) * (legs[r["seg"] - 1] + legs[r["seg"]])
    assert [round(error(r, "fraction")) for r in inner] == [27, 7] and [round(error(r, "clock")) for r in inner] == [17, 13]


def test_passes(world):
    row = networks.repeated_stretches(networks.passes(world[3].placed)).where("run = 'sample-r17'").first()
    assert row["shared"] == 11 and round(100 * row["disagreement"]) == 9 and round(100 * abs(row["shift"])) == 5


def test_located_query(world, spark):
    folder, _, _, _, fps, keys = world
    heard = logs.sightings(logs.read_log(spark, f"{folder}/query.jsonl"))
    queries = spark.createDataFrame([("q", "none")], "query string, grp string")
    answer = matching.locate(fps, keys, queries, heard.select(F.lit("q").alias("query"), "key", "strength")).first()
    assert round(100 * answer["fraction"]) in (53, 47) and round(100 * answer["score"]) == 89 and answer["matches"] == 2
    assert (round(answer["lat"], 5), round(answer["lon"], 5)) == (-34.90311, -56.15836)


#: Right stretch, across a mark, mean and median error in percent and metres, within the band, towards the middle, fast steps and steps.
@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, (136, 8, 18, 17, 23, 21, 69, 12, 22, 129)),
        ({"by_signal": True}, (139, 5, 17, 17, 23, 22, None, 14, 9, 132)),
        ({"by_signal": True, "calibrate": True}, (138, 6, 17, 17, 23, 22, None, 13, 9, 131)),
        ({"order": "tie"}, (136, 8, 18, 17, 23, 21, 69, 12, 22, 129)),
        ({"order": "path"}, (135, 9, 18, 17, 24, 22, 68, 12, 23, 128)),
        ({"order": "tie", "pace": True}, (136, 8, 17, 18, 23, 23, 71, 11, 6, 129)),
    ],
)
def test_held_out_map(world, how, want):
    report, steps = walk.check(world[4], world[5], **how)
    r, s = report.first(), steps.first()
    got = (
        r["right_stretch"], r["across_mark"], round(100 * r["mean_fraction"]), round(100 * r["median_fraction"]), round(r["mean_m"]), round(r["median_m"]),
        r["within_band"] if want[6] is not None else None, round(r["pulled_in_m"]), s["fast"], s["steps"],
    )
    assert got == want and r["wrong_stretch"] == r["not_on_map"] == 0


def test_what_a_card_learns(world):
    offsets = [r["offset"] for r in walk.corrected_keys(world[4], world[5])[1].collect() if r["offset"] is not None]
    assert len(offsets) == 100 and sorted(offsets)[50] == 0.5


def test_along_levels(world):
    r = walk.check(world[4], world[5], along_levels=True)[0].first()
    assert (round(r["mean_m"]), round(r["median_m"])) == (23, 21)
