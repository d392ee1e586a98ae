import pytest
from pyspark.sql import functions as F

from gapweave.functions import text
from gapweave.schemas import RESUME_SCHEMA

DURATIONS = [
    ("On-Demand", 0.0), ("4 weeks", 672.0), ("1-2 hours", 1.0), ("3-6 weeks, 5-8 hours a week", 678.0),
    ("1.5 hours", 5.0), ("90 minutes", 1.5), ("1 hour 30 minutes", 1.5), ("12 - 14 hours", 14.0), ("2days", 48.0),
    ("Self paced", 0.0), ("", 0.0), ("10-13 Hours", 0.0), ("1 day 2 hours", 26.0), ("6 weeks long, On-Demand", 0.0),
    ("4\u00a0weeks", 672.0), ("5\u2003hours", 5.0), (None, None),
]


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()[0]


def test_duration_hours(spark):
    df = spark.createDataFrame(DURATIONS, "text string, want double")
    for row in df.select("text", "want", text.duration_hours(F.col("text")).alias("got")).collect():
        assert row.got == row.want, row.text


@pytest.mark.parametrize(
    "given, want",
    [("1", 1.0), (" 0.5 ", 0.5), ("n/a", None), ("1e2", 100.0), ("1d", None), (".5", 0.5), ("-inf", float("-inf")),
     ("Infinity", float("inf")), ("nan", None), ("", None), ("0x10", None)],
)
def test_to_number(spark, given, want):
    assert one(spark, given, text.to_number) == want


def test_strip_knows_every_space(spark):
    given = "\u00a0\u2003 \x1f\x85\n a\u00a0b \t\u3000"
    assert one(spark, given, text.strip) == given.strip() == "a\u00a0b"


def test_clean_text(spark):
    assert one(spark, "a\n\tb\u00a0 c\x1fd", text.clean_text) == "a b c d"


def test_blank_means_missing(spark):
    assert one(spark, "  \n", text.blank_to_null) is None
    assert one(spark, " x", text.blank_to_null) == " x"


def test_nan_to_null(spark):
    assert one(spark, float("nan"), text.nan_to_null, "double") is None
    assert one(spark, 4.0, text.nan_to_null, "double") == 4.0


def test_encode_text_writes_nan_for_missing(spark):
    df = spark.createDataFrame([("a", None)], "name string, description string")
    assert df.select(text.encode_text(F.col("name"), F.col("description"))).first()[0] == "a\tnan"


def test_record_text(spark):
    awards = RESUME_SCHEMA["academic_awards"].dataType
    df = spark.createDataFrame([([("P", ["sql", "it's"]), ("Q", None)],), ([],), (None,)], f"a {awards.simpleString()}")
    got = [r[0] for r in df.select(text.record_text(F.col("a"), awards)).collect()]
    assert got == [
        "title: P, related_skills: ['sql', \"it's\"]; title: Q, related_skills: None", "", "",
    ]
