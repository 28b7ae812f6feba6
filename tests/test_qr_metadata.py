import datetime

import pytest
from pyspark.sql import functions as F

from tallysheet.functions.identifiers import academic_year, is_due_date, points, subject_prefix
from tallysheet.operators import metadata, qr
from tallysheet.sources import synthetic
from tallysheet.sources.relations import regions
from tallysheet.sources.settings import Settings
from tallysheet.sources.templates import templates

GOOD = '{"assignment_id":"AG_1","assignment_name":"n","subject":"s","total_points":5}'


@pytest.mark.parametrize("data, valid", [(GOOD, True), ('{"assignment_id":"AG_1","subject":"s"}', False), ('{"assignment_id":null,"assignment_name":"n","subject":"s"}', True), ("[1]", False), ("nope", False), (None, False)])
def test_key_presence(spark, data, valid):
    assert spark.createDataFrame([(data,)], "d string").select(qr.has_keys(F.col("d"))).first()[0] is valid


def test_extraction(spark):
    ddl = "image_id long, seq long, data string, region string, method string, confidence double, x int, y int, w int, h int"
    rows = [
        (1, 1, GOOD, "top_left", "opencv", 0.9, 0, 0, 50, 10), (1, 2, GOOD, "top_left", "pyzbar", 1.0, 0, 0, 500, 10), (1, 3, GOOD, "full_image", "pyzbar", 1.0, 0, 0, 60, 60), (1, 4, GOOD, "top_right", "pyzbar", 1.0, 0, 0, 501, 60),
        (2, 5, "bad", "top_left", "pyzbar", 1.0, 0, 0, 49, 49),
    ]
    det = spark.createDataFrame(rows, ddl)
    got = qr.extract(det, regions(spark)).collect()
    assert [(r.image_id, r.seq, r.total_points, r.qr_detection.method) for r in got] == [(1, 2, 5, "pyzbar")]
    rep = {r.image_id: r for r in qr.extraction_report(det, regions(spark)).collect()}
    assert rep[1].success and not rep[2].success and rep[2].error_message == "no valid code"
    img = spark.createDataFrame([(1, 800, 600)], "image_id long, width int, height int")
    b = {r.region: (r.x0, r.y0, r.x1, r.y1) for r in qr.region_boxes(img, regions(spark)).collect()}
    assert b["top_right"] == (480, 0, 800, 180) and b["full_image"] == (0, 0, 800, 600)


def test_identifiers(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(academic_year(t("2024-08-01")), academic_year(t("2024-07-31")), is_due_date(F.lit("2025-6-5")), is_due_date(F.lit("06/05/2025")), is_due_date(F.lit("2025-02-30")), points(F.lit(0), F.lit(90)), points(F.lit(None).cast("int"), F.lit(None).cast("int")), subject_prefix(F.lit(None).cast("string"))).first()
    assert tuple(r) == ("2024-2025", "2023-2024", True, False, False, 90, 100, "ASN")


def test_templates_and_builder(spark, tmp_path):
    t = templates(spark)
    assert [r.id for r in metadata.list_templates(t).collect()] == ["fractions_intro", "ratios_review", "angles_practice"]
    assert [r.subject for r in metadata.subjects(t).collect()] == ["arithmetic", "shapes"]
    made = metadata.AssignmentBuilder(t).template("fractions_intro").name("A").due("2025-06-20").worth(50).build(created_at=datetime.datetime(2025, 1, 2))
    r = made.first()
    assert r.error is None and r.total_points == 50 and r.academic_year == "2024-2025" and r.assignment_id.startswith("ARI-20250102-")
    assert metadata.round_trip(made).first().same
    with pytest.raises(ValueError, match="due_date"):
        metadata.AssignmentBuilder(t).template("x").name("A").build()
    bad = metadata.AssignmentBuilder(t).template("nope").name("A").due("2025-06-20").build().first()
    assert bad.error == "unknown template nope" and bad.assignment_id is None
    (tmp_path / "t.yaml").write_text("templates:\n  own:\n    name: Own\n")
    assert [r.template_id for r in templates(spark, str(tmp_path / "t.yaml")).collect()] == ["own"]
    (tmp_path / "b.yaml").write_text("a: [")
    assert templates(spark, str(tmp_path / "b.yaml")).count() == 3


def test_payloads(spark):
    rows = spark.createDataFrame([("x",), ('{"a":1}',)], "v string").select(metadata.any_payload(F.col("v")))
    assert [r[0] for r in rows.collect()] == ['{"assignment_name":"x"}', '{"a":1}']
    full = '{"assignment_id":"a","subject":"s","assignment_name":"n","due_date":"d","total_points":1}'
    r = spark.createDataFrame([(full,), ('{"subject":"s"}',)], "v string").select(metadata.from_payload(F.col("v")).alias("lenient"), metadata.from_payload(F.col("v"), strict=True).alias("strict")).collect()
    assert r[0].lenient.total_points == 1 and r[0].strict is None and r[1].lenient is None
    assert synthetic.sample_assignment(spark).first().total_points == 100


def test_settings(tmp_path):
    s = Settings()
    assert s.get("ocr.processing.aggregation_method") == "weighted_vote" and s.get("no.such", 3) == 3 and s.offline and s.mock("x")
    s.set("a.b.c", 1)
    assert s.get("a.b") == {"c": 1} and s.reload().get("a") is None
    (tmp_path / "s.yaml").write_text("application: {offline_mode: false, debug: true}\nmock: {mail: true}")
    s = Settings(str(tmp_path / "s.yaml"))
    assert s.debug and not s.mock("web") and s.mock("mail")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="YAML"):
        Settings(str(tmp_path / "bad.yaml"))


def test_keys_of_a_payload_are_read_once(spark):
    """However many keys are needed, the plan reads them in one place; what is read back comes with the round trip."""
    read = spark.createDataFrame([("{}",)], "p string").select(metadata.from_payload(F.col("p"), strict=True).alias("r"))
    assert read._jdf.queryExecution().analyzed().toString().count("json_object_keys(") == 1
