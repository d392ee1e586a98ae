"""Typed records out of raw model responses held in a table.

The rules are written as Spark SQL text over the parsed response: one expression
per rule set instead of hundreds of small Column calls.
"""

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.operators.lineage import once
from gapweave.schemas import (
    EMPLOYMENT_TYPES,
    JOB_SCHEMA,
    PROJECT_TYPE_DEFAULT,
    PROJECT_TYPES,
    PUBLICATION_YEARS,
    RESUME_SCHEMA,
)

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def json_part(raw: Column) -> Column:
    """The JSON in a response: inside its first code fence if it has one."""
    fenced = F.regexp_extract(raw, FENCE, 1)
    return F.when(fenced != "", fenced).otherwise(raw)


def loose_parse(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (variant, null when the text is not JSON); keep the raw text."""
    return once(responses, "parsed", F.try_parse_json(json_part(F.col(raw))))


# --- SQL text --------------------------------------------------------------


def _get(value: str, path: str, data_type: str) -> str:
    return f"try_variant_get({value}, '{path}', '{data_type}')"


def _field(value: str, name: str) -> str:
    """The field as a variant: SQL null when absent, a variant null when null."""
    return _get(value, f"$.{name}", "variant")


def _kind(value: str, name: str) -> str:
    """``STRING``, ``VOID`` for a null, another type name, or null when absent."""
    return f"schema_of_variant({_field(value, name)})"


def _text_ok(value: str, name: str, null_ok: bool = False, key_needed: bool = True) -> str:
    """True when the field holds text, or is null or absent where that is allowed."""
    kinds = "'STRING', 'VOID'" if null_ok else "'STRING'"
    absent_ok = "false" if key_needed else f"{_field(value, name)} IS NULL"
    return f"(CASE WHEN {_kind(value, name)} IN ({kinds}) THEN true ELSE {absent_ok} END)"


def _list_ok(value: str, name: str, item_ok, key_needed: bool = False, null_ok: bool = True) -> str:
    """True for a list of good items, or null or absent where that is allowed."""
    field, item = _field(value, name), f"{name}_item"
    return (
        f"(CASE WHEN {field} IS NULL THEN {str(not key_needed).lower()} "
        f"WHEN is_variant_null({field}) THEN {str(null_ok).lower()} "
        f"ELSE coalesce(forall({_get(field, '$', 'array<variant>')}, {item} -> {item_ok(item)}), false) END)"
    )


def _is_text(item: str) -> str:
    return f"schema_of_variant({item}) = 'STRING'"


def _one_of(value: str, name: str, words: list[str]) -> str:
    listed = ", ".join(f"'{word}'" for word in words)
    return f"coalesce({_get(value, f'$.{name}', 'string')} IN ({listed}), false)"


def _skills_ok(value: str, name: str) -> str:
    """All items are strings, or all are objects with a text ``skill``."""
    objects = _list_ok(value, name, lambda item: _text_ok(item, "skill"))
    return f"({_list_ok(value, name, _is_text)} OR {objects})"


def _null_or(value: str, name: str, rule: str) -> str:
    return f"(coalesce({_kind(value, name)} = 'VOID', false) OR {rule})"


def _job_rules(v: str) -> dict[str, str]:
    return {
        "job_title": _text_ok(v, "job_title", null_ok=True),
        "employment_type": _null_or(v, "employment_type", _one_of(v, "employment_type", EMPLOYMENT_TYPES)),
        "key_responsibilities": _list_ok(v, "key_responsibilities", lambda i: _text_ok(i, "description")),
        "qualifications": _list_ok(v, "qualifications", lambda i: _text_ok(i, "qualification")),
        "education_requirements": _list_ok(
            v,
            "education_requirements",
            lambda i: f"{_text_ok(i, 'degree', key_needed=False)} AND {_text_ok(i, 'field_of_study', null_ok=True)}",
        ),
        "must_have_skills": _skills_ok(v, "must_have_skills"),
        "bonus_skills": _skills_ok(v, "bonus_skills"),
    }


def _resume_rules(v: str) -> dict[str, str]:
    low, high = PUBLICATION_YEARS

    def year_ok(item):
        year = _get(item, "$.year", "double")
        return _null_or(item, "year", f"coalesce({year} BETWEEN {low} AND {high} AND {year} = floor({year}), false)")

    def all_of(*rules):
        return " AND ".join(rules)

    return {
        "skills": _list_ok(v, "skills", _is_text, null_ok=False),
        "certifications": _list_ok(
            v,
            "certifications",
            lambda i: all_of(_text_ok(i, "name"), _text_ok(i, "organization", null_ok=True)),
            key_needed=True,
        ),
        "projects": _list_ok(
            v,
            "projects",
            lambda i: all_of(
                _text_ok(i, "title"),
                _text_ok(i, "description", null_ok=True),
                f"({_field(i, 'type')} IS NULL OR {_one_of(i, 'type', PROJECT_TYPES)})",
            ),
            key_needed=True,
        ),
        "publications": _list_ok(
            v,
            "publications",
            lambda i: all_of(_text_ok(i, "title"), _text_ok(i, "journal", null_ok=True), year_ok(i)),
            key_needed=True,
        ),
        "academic_awards": _list_ok(
            v,
            "academic_awards",
            lambda i: all_of(_text_ok(i, "title"), _list_ok(i, "related_skills", _is_text, key_needed=True)),
            key_needed=True,
        ),
    }


def _errors(v: str, rules: dict[str, str]) -> str:
    """Names of the fields that break a rule; ``not json`` when no object was read."""
    broken = ", ".join(f"CASE WHEN NOT {rule} THEN '{name}' END" for name, rule in rules.items())
    is_object = f"coalesce(startswith(schema_of_variant({v}), 'OBJECT'), false)"
    return f"CASE WHEN NOT {is_object} THEN array('not json') ELSE array_compact(array({broken})) END"


def _list(v: str, name: str, schema) -> str:
    """An absent list is empty; a list given as null stays null."""
    data_type = schema[name].dataType.simpleString()
    return f"CASE WHEN {_field(v, name)} IS NULL THEN cast(array() AS {data_type}) ELSE {_get(v, f'$.{name}', data_type)} END"


def _skill_names(v: str, name: str) -> str:
    """Items are plain strings or objects with a ``skill``; null unless a list."""
    name_of = f"coalesce({_get('item', '$.skill', 'string')}, {_get('item', '$', 'string')})"
    return f"transform({_get(v, f'$.{name}', 'array<variant>')}, item -> {name_of})"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def _job_record(v: str) -> str:
    def skills(name):
        return f"CASE WHEN {_field(v, name)} IS NULL THEN cast(array() AS array<string>) ELSE {_skill_names(v, name)} END"

    lists = ["key_responsibilities", "qualifications", "education_requirements"]
    return _struct(
        {
            "job_title": _get(v, "$.job_title", "string"),
            "employment_type": _get(v, "$.employment_type", "string"),
            **{name: _list(v, name, JOB_SCHEMA) for name in lists},
            "must_have_skills": skills("must_have_skills"),
            "bonus_skills": skills("bonus_skills"),
        }
    )


def _resume_record(v: str) -> str:
    fields = {name: _list(v, name, RESUME_SCHEMA) for name in RESUME_SCHEMA.names}
    fields["projects"] = (
        f"transform({fields['projects']}, p -> named_struct('title', p.title, 'description', p.description, "
        f"'type', coalesce(p.type, '{PROJECT_TYPE_DEFAULT}')))"
    )
    return _struct(fields)


KINDS = {"job": (_job_rules, _job_record), "resume": (_resume_rules, _resume_record)}


# --- operators -------------------------------------------------------------


def normalize_skills(responses: DataFrame, name: str = "must_have_skills", raw: str = "raw") -> DataFrame:
    """Add ``skills``: the named skill list as an array of strings, empty if unreadable."""
    skills = F.expr(f"coalesce({_skill_names('parsed', name)}, cast(array() AS array<string>))")
    return once(loose_parse(responses, raw), "skills", skills).drop("parsed")


def parse_records(responses: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Add ``record`` (null when invalid) and ``errors`` (empty when valid)."""
    rules, build = KINDS[kind]
    checked = once(loose_parse(responses, raw), "errors", F.expr(_errors("parsed", rules("parsed"))))
    record = F.expr(f"CASE WHEN size(errors) = 0 THEN {build('parsed')} END")
    return once(checked, "record", record).drop("parsed")


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") == 0).drop("errors")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("errors") > 0).drop("record")


def record_json(record: Column) -> Column:
    """A record as JSON text that keeps its null fields."""
    return F.to_json(record, {"ignoreNullFields": "false"})
