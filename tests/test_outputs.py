"""Output documents and the progress line."""

import json

import pytest

from specweave.sources import knowledge
from tests.test_engine import CURRENT, GUIDES, HEAT, LEGACY, model

MORE = [{**HEAT[0], "extra": {"b": [1, None, 2.5], "a": "ü"}}, {"model_group": None, "temperature_tolerance_c": None}]
RAW = [
    {"document_date": "2024", "current": CURRENT, "legacy": LEGACY, "temperature_specs": MORE, "guidance": [*GUIDES, {"section": 9, "source_pdf_page": None, "note": "n"}], "mass_tolerances": [{"class": "E2", "mpe": [0.1, None]}, "text", 3, None], "weight_class_crossmap": [], "series_class_recommendations": [None]},
    {"document_date": "2025", "current": [model(f"M{i}1000") for i in range(30, 0, -1)], "legacy": [], "temperature_specs": [], "guidance": [], "mass_tolerances": [], "weight_class_crossmap": [["x", {"y": 1}]], "series_class_recommendations": []},
    {"document_date": None, "current": None, "legacy": [model("EX10201")]},
]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("outputs")
    for i, raw in enumerate(RAW):
        (path / f"raw-{i}.json").write_text(json.dumps(raw, indent=1))
    line = knowledge.write_output(knowledge.output_documents(knowledge.read_document(spark, str(path / "raw-*.json"))), str(path / "out"))
    files = [f.read_text() for f in (path / "out").glob("*.json")]
    return path, line, {json.loads(f)["meta"]["documentDate"]: json.loads(f) for f in files if f}


def test_progress_line_counts_what_was_written(outputs):
    path, line, _ = outputs
    assert line == f"Prepared 39 model records at {path / 'out'}"


def test_documents_are_whole(outputs):
    _, _, read = outputs
    assert sorted(read, key=str) == ["2024", "2025", None]
    one = read["2024"]
    assert one["meta"] == {"title": "Master Tolerance Reference", "documentDate": "2024", "currentRecords": 6, "legacyRecords": 2, "temperatureRecords": 2, "knownQaItems": 21}
    assert [r["id"] for r in one["current"]] == [f"CUR-000{i}" for i in range(1, 7)] and [r["modelGroup"] for r in read["2025"]["current"]][:2] == ["M301000", "M291000"]
    assert one["temperatureSpecs"] == MORE and one["guidance"] == RAW[0]["guidance"] and one["massTolerances"] == RAW[0]["mass_tolerances"] and read["2025"]["classCrossMap"] == RAW[1]["weight_class_crossmap"]
    assert read[None]["current"] == [] and read[None]["guidance"] == [] and read[None]["legacy"][0]["id"] == "LEG-0001"


def test_members_and_nulls_stay(outputs):
    record = outputs[2]["2024"]["current"][2]
    assert list(record) == ["id", "lifecycle", "series", "tableTitle", "modelGroup", "aliases", "capacity", "readability", "repeatability", "linearity", "ocl", "tolerance", "calibration", "source", "qa"]
    assert record["tolerance"] == {"value": None, "secondaryValue": None, "unit": "g", "secondaryUnit": None, "d": None, "raw": None}
    assert record["capacity"] == {"value": None, "unit": None, "secondaryValue": None, "secondaryUnit": None, "note": None}
    assert list(outputs[2]["2024"]["legacy"][0]) == ["id", "lifecycle", "series", "tableTitle", "modelGroup", "aliases", "repeatability", "linearity", "ocl", "source"]


def test_tables_of_an_output_document(spark, outputs):
    """The tables are the same whether they come from the raw document or from the output."""
    path = outputs[0]
    made = knowledge.prepare(knowledge.read_document(spark, str(path / "raw-0.json")))
    back = knowledge.from_output(knowledge.read_output(spark, str(path / "out")).filter("meta.documentDate = '2024'"))
    for name in ("records", "temperature", "guidance", "meta"):
        a, b = getattr(made, name), getattr(back, name)
        columns = sorted(set(a.columns))
        assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect())), name
    assert [r[0] for r in back.mass_tolerances.selectExpr("cast(row as string)").collect()] == ['{"class":"E2","mpe":[0.1,null]}', "text", "3", None]


def test_no_job_for_the_count(spark, outputs, tmp_path):
    made = knowledge.prepare(knowledge.read_document(spark, str(outputs[0] / "raw-0.json")))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("plain", "")
    for name, table in vars(made).items():
        table.write.parquet(f"{tmp_path}/plain/{name}")
    context.setJobGroup("observed", "")
    line = knowledge.write(made, f"{tmp_path}/observed")
    context.setJobGroup("rest", "")
    assert line == f"Prepared 8 model records at {tmp_path}/observed"
    assert len(tracker.getJobIdsForGroup("observed")) == len(tracker.getJobIdsForGroup("plain"))
