"""Column functions over free text. Everything here stays in the JVM."""

from pyspark.sql import Column, functions as F

# White space as Unicode and the C0 separators define it.
SPACE = r"(?U)[\s\x1C-\x1F]"
NOT_SPACE = r"(?U)[^\s\x1C-\x1F]"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# An amount such as "3", "3-5" or "3-", in front of a unit.
AMOUNT = r"(?U)([0-9]+)-?([0-9]+)?[\s\x1C-\x1F]*"
HOURS_PER_UNIT = [("week", 168.0), ("day", 24.0), ("hour", 1.0)]
MINUTES_PER_HOUR = 60.0
ON_DEMAND = "On-Demand"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def blank_to_null(text: Column) -> Column:
    """An empty input box means "not given"."""
    return F.when(text.rlike(NOT_SPACE), text)


def clean_text(text: Column) -> Column:
    """Replace each run of white space by one blank."""
    return F.regexp_replace(text, SPACE + "+", " ")


def nan_to_null(number: Column) -> Column:
    """Spark sorts NaN above every number, so a missing rating must be null."""
    return F.when(~F.isnan(number), number)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return bare_number(strip(text))


def bare_number(bare: Column) -> Column:
    """``to_number`` for text without outer white space."""
    endless = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double")).when(bare.rlike(INFINITE), endless)


def _amount(text: Column, unit: str) -> Column:
    """First amount given in ``unit``; a range counts as its rounded-down middle."""
    pattern = AMOUNT + unit
    low = F.regexp_extract(text, pattern, 1).try_cast("double")
    high = F.regexp_extract(text, pattern, 2).try_cast("double")
    middle = F.floor((low + F.coalesce(high, low)) / 2)
    return F.coalesce(middle, F.lit(0)).cast("double")


def duration_hours(text: Column) -> Column:
    """Hours in a free-text duration such as ``3-6 weeks, 5 hours a week``."""
    total = F.lit(0.0)
    for unit, hours in HOURS_PER_UNIT:
        total = total + _amount(text, unit) * hours
    total = total + _amount(text, "minute") / MINUTES_PER_HOUR
    return F.when(text.contains(ON_DEMAND), F.lit(0.0)).when(text.isNotNull(), total)


def encode_text(*columns: Column) -> Column:
    """Text handed to the encoder: columns joined by TAB, a missing one as ``nan``."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def _plain(value: Column, data_type) -> Column:
    if data_type.typeName() == "array":
        def quote(item):
            mark = F.when(item.contains("'") & ~item.contains('"'), F.lit('"')).otherwise(F.lit("'"))
            return F.concat(mark, item, mark)

        quoted = F.transform(value, quote)
        value = F.concat(F.lit("["), F.array_join(quoted, ", ", "None"), F.lit("]"))
    return F.coalesce(value.cast("string"), F.lit("None"))


def record_text(record: Column, data_type) -> Column:
    """A record as ``field: value`` pairs; a list of records joined by ``; ``.

    A null record is empty text, a null field prints ``None``.
    """
    if data_type.typeName() == "array":
        parts = F.transform(record, lambda item: record_text(item, data_type.elementType))
        return F.coalesce(F.array_join(parts, "; "), F.lit(""))
    pairs = []
    for field in data_type.fields:
        value = record.getField(field.name)
        if field.dataType.typeName() == "struct":
            pairs.append(record_text(value, field.dataType))
        else:
            pairs.append(F.concat(F.lit(f"{field.name}: "), _plain(value, field.dataType)))
    return F.when(record.isNull(), F.lit("")).otherwise(F.concat_ws(", ", *pairs))


def epoch_text(moment: Column) -> Column:
    return F.unix_timestamp(moment).cast("string")


def moment_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
