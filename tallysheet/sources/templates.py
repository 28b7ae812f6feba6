"""Assignment templates from YAML, with built-in ones where there is no usable file."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from tallysheet.schemas import TEMPLATES


def _problem(kind: str, count: int, points: int, description: str) -> dict:
    return {"type": kind, "count": count, "points_each": points, "description": description}


#: The catalogue an installation starts with.
BUILT_IN = {
    "fractions_intro": {
        "name": "Fractions, first sheet", "subject": "arithmetic", "total_points": 60, "estimated_time_minutes": 30, "difficulty_level": "beginner",
        "instructions": "Write each result in lowest terms.", "problem_types": [_problem("reduce", 6, 4, "Reduce the fraction"), _problem("add", 6, 6, "Add two fractions")],
        "grading_rubric": {"result": 36, "method": 24},
    },
    "ratios_review": {
        "name": "Ratios and shares", "subject": "arithmetic", "total_points": 80, "estimated_time_minutes": 40, "difficulty_level": "intermediate",
        "instructions": "Name the unit of each answer.", "problem_types": [_problem("share", 5, 8, "Divide a sum"), _problem("scale", 4, 10, "Read a map")],
        "grading_rubric": {"setup": 30, "result": 40, "unit": 10},
    },
    "angles_practice": {
        "name": "Angles in polygons", "subject": "shapes", "total_points": 90, "estimated_time_minutes": 55, "difficulty_level": "advanced",
        "instructions": "Mark the angles in a sketch.", "problem_types": [_problem("triangle", 5, 6, "Find the third angle"), _problem("polygon", 4, 15, "Sum the inner angles")],
        "grading_rubric": {"sketch": 25, "reasoning": 40, "result": 25},
    },
}


def read_templates(path: str | None = None) -> dict[str, dict]:
    """Templates of a YAML file; the built-in ones if it is missing, invalid or empty."""
    try:
        found = yaml.safe_load(Path(path).read_text()) if path else None
    except (OSError, yaml.YAMLError):
        found = None
    return (found or {}).get("templates") or BUILT_IN


def templates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The templates as a relation."""
    rows = [
        (k, t.get("name"), t.get("subject"), t.get("total_points"), t.get("estimated_time_minutes"), t.get("difficulty_level"), t.get("instructions"), [(p.get("type"), p.get("count"), p.get("points_each"), p.get("description")) for p in t.get("problem_types") or []], t.get("grading_rubric") or {})
        for k, t in read_templates(path).items()
    ]
    return spark.createDataFrame(rows, TEMPLATES)
