"""Assignment templates and metadata: listing, instantiation, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.identifiers import academic_year, dated_id, hashed_id, is_due_date, points, subject_prefix
from tallysheet.functions.text import let
from tallysheet.schemas import ASSIGNMENT_CORE, ASSIGNMENTS

FIELDS = tuple(ASSIGNMENTS.names)
REQUIRED = ("assignment_id", "subject", "assignment_name", "due_date", "total_points")


def list_templates(templates: DataFrame, subject: str | None = None) -> DataFrame:
    """Summaries with defaults, of one subject if given, by subject, difficulty and name."""
    rows = templates if subject is None else templates.where(F.col("subject") == subject)
    d = lambda c, v, name: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)).alias(name)
    return rows.select(
        F.col("template_id").alias("id"), d("name", F.col("template_id"), "name"), d("subject", "unknown", "subject"), d("total_points", 100, "total_points"),
        d("difficulty_level", "intermediate", "difficulty"), d("estimated_time_minutes", 60, "estimated_time"),
    ).orderBy("subject", "difficulty", "name")


def subjects(templates: DataFrame) -> DataFrame:
    """Distinct subjects in order, without null and empty ones."""
    return templates.where("subject <> ''").select("subject").distinct().orderBy("subject")


def instantiate(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """An assignment for each request, or ``error`` where it can't be made.

    Requests: ``request_id, template_id, assignment_name, due_date,
    class_period, teacher_name, custom_points, created_at``. Templates are a
    catalogue that a person maintains, so the join broadcasts them by size alone.
    """
    t = templates.select("template_id", F.lit(True).alias("known"), "name", "subject", F.col("total_points").alias("t_points"), "difficulty_level", "estimated_time_minutes", "instructions", "problem_types", "grading_rubric")
    rows = requests.join(t, "template_id", "left")
    error = (
        F.when(F.coalesce("template_id", F.lit("")) == "", "no template")
        .when(F.coalesce("assignment_name", F.lit("")) == "", "no name")
        .when(F.coalesce("due_date", F.lit("")) == "", "no due date")
        .when(F.col("known").isNull(), F.concat(F.lit("unknown template "), "template_id"))
        .when(~is_due_date(F.col("due_date")), "due date is no date")
    )
    extra = F.map_filter(
        F.create_map(
            F.lit("template_id"), F.col("template_id"), F.lit("template_name"), F.coalesce("name", "template_id"), F.lit("difficulty_level"), F.coalesce("difficulty_level", F.lit("intermediate")),
            F.lit("estimated_time_minutes"), F.coalesce("estimated_time_minutes", F.lit(60)).cast("string"), F.lit("instructions"), F.coalesce("instructions", F.lit("")),
            F.lit("problems_count"), F.size(F.coalesce("problem_types", F.array())).cast("string"),
        ), lambda k, v: v.isNotNull(),
    )
    made = error.isNull()
    ident = dated_id(subject_prefix(F.col("subject")), F.col("created_at"), F.md5(F.col("request_id").cast("string")))
    return rows.select(
        "request_id", F.when(made, ident).alias("assignment_id"), F.when(made, F.coalesce("subject", F.lit("mathematics"))).alias("subject"), "assignment_name", "due_date",
        F.when(made, points(F.col("custom_points"), F.col("t_points"))).alias("total_points"), "class_period", "teacher_name", F.when(made, academic_year(F.col("created_at"))).alias("academic_year"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit("1.0").alias("qr_version"), F.when(made, extra).alias("additional_data"), error.alias("error"),
    )


def payload(assignment: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The fields as compact JSON in their order, nulls kept."""
    return F.to_json(F.struct(*[assignment[f] for f in fields]), {"ignoreNullFields": "false"})


def from_payload(json: Column, strict: bool = False) -> Column:
    """The metadata in a JSON payload, null if it can't be read.

    Lenient: required keys must be there, others default to null. Strict: the
    keys must be just those of the record.
    """
    needed = FIELDS if strict else REQUIRED

    def complete(keys: Column) -> Column:
        ok = F.forall(F.array(*map(F.lit, needed)), lambda k: F.array_contains(keys, k))
        return ok & (F.size(keys) == len(FIELDS)) if strict else ok

    # Bound, so that the keys are read once and not for each that is needed.
    ok = let(F.json_object_keys(json), complete)
    return F.when(F.coalesce(ok, F.lit(False)), F.from_json(json, str(ASSIGNMENTS)))


CORE = tuple(ASSIGNMENT_CORE.names)


def created(wanted: DataFrame) -> DataFrame:
    """An assignment and its payload for each row, in one step, without a template.

    Rows: ``request_id, assignment_name, subject, teacher_name, class_period,
    total_points, created_at``; a null period is ``Unknown``, null points are
    100; the work is due on the day it is created.
    """
    at = F.col("created_at")
    rows = wanted.select(
        "request_id", hashed_id(F.col("assignment_name"), at).alias("assignment_id"), "assignment_name", "subject", F.coalesce("class_period", F.lit("Unknown")).alias("class_period"), "teacher_name",
        F.date_format(at, "yyyy-MM-dd").alias("due_date"), F.coalesce("total_points", F.lit(100)).cast("int").alias("total_points"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"), F.lit("1.0").alias("qr_version"),
    )
    return rows.withColumn("payload", payload(rows, CORE))


def any_payload(value: Column, key: str = "assignment_name") -> Column:
    """A text that is JSON as it is, any other text wrapped under ``key``."""
    is_json = F.try_parse_json(value).isNotNull()
    return F.when(is_json, value).otherwise(F.to_json(F.struct(value.alias(key))))


def round_trip(assignments: DataFrame) -> DataFrame:
    """Each assignment with its payload, the record ``back`` that is read from it, and whether that is the same record."""
    rows = assignments.withColumn("payload", payload(assignments))
    rows = rows.withColumn("back", from_payload(F.col("payload"), strict=True))
    same = [F.col("back")[f].eqNullSafe(F.col(f)) for f in FIELDS if f != "additional_data"]
    extra = F.to_json(F.col("back")["additional_data"]).eqNullSafe(F.to_json("additional_data"))
    return rows.withColumn("same", F.forall(F.array(*same), lambda x: x) & extra)


def rubric_lines(templates: DataFrame) -> DataFrame:
    """One row for each rubric entry, with its share of the template's total."""
    rows = templates.select("template_id", F.explode("grading_rubric").alias("item", "weight"))
    totals = rows.groupBy("template_id").agg(F.sum("weight").alias("total"))
    return rows.join(totals, "template_id").select("template_id", "item", "weight", (F.col("weight") / F.col("total")).alias("share"))


def problem_points(templates: DataFrame) -> DataFrame:
    """Problems and points of each template by its problem types."""
    total = lambda f: F.aggregate("problem_types", F.lit(0), f)
    return templates.select("template_id", total(lambda a, p: a + p["count"]).alias("problems"), total(lambda a, p: a + p["count"] * p["points_each"]).alias("points"))


class AssignmentBuilder:
    """A request put together step by step; :meth:`build` gives the assignment's frame, or raises if something is missing."""

    def __init__(self, templates: DataFrame):
        self._templates, self._given = templates, {}

    def _with(self, **given) -> AssignmentBuilder:
        self._given |= given
        return self

    def template(self, template_id: str | Column) -> AssignmentBuilder:
        return self._with(template_id=template_id)

    def name(self, assignment_name: str | Column) -> AssignmentBuilder:
        return self._with(assignment_name=assignment_name)

    def due(self, due_date: str | Column) -> AssignmentBuilder:
        return self._with(due_date=due_date)

    def period(self, class_period: str | Column) -> AssignmentBuilder:
        return self._with(class_period=class_period)

    def teacher(self, teacher_name: str | Column) -> AssignmentBuilder:
        return self._with(teacher_name=teacher_name)

    def worth(self, custom_points: int | Column) -> AssignmentBuilder:
        return self._with(custom_points=custom_points)

    def _missing(self) -> list[str]:
        return [k for k in ("template_id", "assignment_name", "due_date") if not isinstance(self._given.get(k), Column) and not self._given.get(k)]

    def build_each(self, requests: DataFrame) -> DataFrame:
        """An assignment for each row ``request_id, created_at``; what was given may be Columns over these rows."""
        if missing := self._missing():
            raise ValueError(f"missing: {', '.join(missing)}")
        kinds = {"template_id": "string", "assignment_name": "string", "due_date": "string", "class_period": "string", "teacher_name": "string", "custom_points": "int"}
        given = {k: v if isinstance(v := self._given.get(k), Column) else F.lit(v) for k in kinds}
        return instantiate(requests.select("request_id", "created_at", *[given[k].cast(kind).alias(k) for k, kind in kinds.items()]), self._templates)

    def build(self, request_id: int = 1, created_at=None) -> DataFrame:
        row = self._templates.sparkSession.createDataFrame([(request_id, created_at)], "request_id bigint, created_at timestamp")
        return self.build_each(row.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
