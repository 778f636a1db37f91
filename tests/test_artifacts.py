"""Line numbers of files read in splits, zone artifacts as whole documents."""

import json

import pytest

from evidex.sources import readers as rd


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_line_numbers_of_files_of_several_splits(spark, tmp_path, split):
    files = {"a.jsonl": [f"line {i} " + "x" * (i % 50) if i % 9 else "" for i in range(1500)], "b.jsonl": ["one"], "c.jsonl": [str(i) for i in range(3000)]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        numbered = rd.numbered_lines(spark, str(tmp_path))
        found = {(r.path.rsplit("/", 1)[1], r.line_no): r.value for r in numbered.collect()}
        over_all = {r.line: r.value for r in rd.ordered_lines(numbered).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {(name, i + 1): line for name, lines in files.items() for i, line in enumerate(lines)}
    assert over_all == dict(enumerate((line for lines in files.values() for line in lines), 1))


def artifact(**changes):
    zone = {"slug": "desk", "name": "Desk", "description": "d", "stable_landmarks": ["lamp"], "prompts": {"name": "a desk", "landmarks": "a lamp", "technician_question": "Where?"}}
    zone |= changes.pop("zone", {})
    return {"zones": [{k: v for k, v in zone.items() if v is not None}], "assignments": {"o1": "desk", "o2": "desk", "o3": "unassigned"}, "assignment_counts": {"desk": 2}} | changes


CASES = {
    "good": (artifact(), None), "extra": (artifact(more={"x": [1]}), None), "list": ([1, 2], "parts"), "no_counts": (artifact(assignment_counts=None), "parts"),
    "odd_assignments": (artifact(assignments=["o1"]), "parts"), "zones_object": (artifact(zones={"slug": "desk"}), "parts"), "empty": (artifact(zones=[]), "no_zones"),
    "number_slug": (artifact(zone={"slug": 5}), "no_zones"), "no_prompts": (artifact(zone={"prompts": None}), "prompts"),
    "blank_prompt": (artifact(zone={"prompts": {"name": "x", "landmarks": "  ", "technician_question": "y"}}), "prompt"),
    "number_prompt": (artifact(zone={"prompts": {"name": 3, "landmarks": "x", "technician_question": "y"}}), "prompt"),
    "one_without_slug": (artifact(zones=[artifact()["zones"][0], {"name": "x"}]), "slug"), "unused": (artifact(assignments={"o1": "unassigned"}), "frames"),
}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zones")
    for name, (value, _) in CASES.items():
        (folder / f"{name}.json").write_text(json.dumps(value, indent=2))
    (folder / "broken.json").write_text(json.dumps(artifact(), indent=2)[:-3])
    (folder / "nothing.json").write_text("\n")
    return str(folder)


def test_zone_artifacts(spark, written):
    name = lambda path: path.rsplit("/", 1)[1].removesuffix(".json")
    found = rd.read_zone_documents(spark, written)
    assert {name(r.path): r.rule for r in found.collect()} == {k: rule for k, (_, rule) in CASES.items()} | {"broken": "json", "nothing": "json"}
    lenient = {name(r.path): r.rule for r in rd.read_zone_documents(spark, written, prompts=False).collect()}
    assert lenient["no_prompts"] is lenient["unused"] is lenient["one_without_slug"] is None and lenient["number_slug"] == "no_zones"
    zones, assigned, counts = rd.zone_tables(rd.read_zone_documents(spark, f"{written}/good.json"))
    zone = zones.first()
    assert (zone.slug, zone.stable_landmarks, zone.prompts["landmarks"]) == ("desk", ["lamp"], "a lamp")
    assert sorted(map(tuple, assigned.collect())) == [("o1", "desk"), ("o2", "desk"), ("o3", "unassigned")] and counts.first().assigned == 2


def test_a_broken_artifact_is_refused(spark, written):
    assert rd.require_zone_documents(rd.read_zone_documents(spark, f"{written}/good.json")).count() == 1
    with pytest.raises(ValueError, match="blank_prompt.json breaks rule prompt"):
        rd.require_zone_documents(rd.read_zone_documents(spark, f"{written}/blank_prompt.json"))


def test_stored_evaluations(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("query_id string, x double")
    good = '{"query_id": "a", "x": 1}\n{"query_id": "b", "x": 2}\n'
    cases = {
        "good": ('{\n  "recall": 0.5,\n  "per": {"k": [1]}\n}', good, None), "no_metrics": ("{}", good, "metrics"), "list": ("[1]", good, "metrics"), "broken": ('{"a": 1}}', good, "metrics"),
        "no_rows": ('{"a": 1}', "\n", "rows"), "twice": ('{"a": 1}', good + '{"query_id": "a", "x": 3}\n', "twice a"), "no_id": ('{"a": 1}', good + '{"x": 3}\n', "query_id"),
    }
    for name, (metrics, rows, problem) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(metrics)
        (tmp_path / name / "per_query.jsonl").write_text(rows)
        if problem:
            with pytest.raises(ValueError, match=f"refused: {problem}"):
                rd.read_evaluation(spark, str(tmp_path / name), schema)
        else:
            found, stored = rd.read_evaluation(spark, str(tmp_path / name), schema)
            assert {r.name: json.loads(r.value) for r in found.collect()} == json.loads(metrics) and stored.count() == 2
