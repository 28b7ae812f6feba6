"""Schemas of the relations; no inference anywhere."""

from __future__ import annotations

import re


class Schema(str):
    """A schema in DDL. Plain text, so that tasks can import it without a session."""

    @property
    def names(self) -> list[str]:
        flat = self
        while (less := re.sub(r"<[^<>]*>", "", flat)) != flat:
            flat = less
        return [part.split()[0] for part in flat.split(",")]


_ddl = Schema

OCR_RESULTS = _ddl("image_id bigint, engine_name string, pos int, text string, confidence double, processing_time double, error_message string")
ENGINES = _ddl("engine_name string, enabled boolean, priority int, timeout int, config_pos int")
WORD_BOXES = _ddl("page_id bigint, idx bigint, text string, conf double, left double, top double, width double, height double")
QR_DETECTIONS = _ddl("image_id bigint, seq bigint, data string, region string, method string, confidence double, x int, y int, w int, h int")
REGIONS = _ddl("region string, region_rank int, x double, y double, w double, h double")
ASSIGNMENTS = _ddl(
    "assignment_id string, subject string, assignment_name string, due_date string, total_points int, class_period string, teacher_name string,"
    " academic_year string, created_at string, qr_version string, additional_data map<string,string>"
)
ASSIGNMENT_CORE = _ddl("assignment_id string, assignment_name string, subject string, class_period string, teacher_name string, due_date string, total_points int, created_date string, qr_version string")
TEMPLATES = _ddl(
    "template_id string, name string, subject string, total_points int, estimated_time_minutes int, difficulty_level string, instructions string,"
    " problem_types array<struct<type:string,count:int,points_each:int,description:string>>, grading_rubric map<string,int>"
)
RASTERS = _ddl("image_id bigint, height int, width int, pixels array<int>")
TEST_RESULTS = _ddl("suite string, test string, passed boolean, score double")
