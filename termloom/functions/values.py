"""Field values of the release format: times, flags, numbers, member ids, concrete values, semantic tags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import constants as K

UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
NUMBER = r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


class TimeError(ValueError):
    pass


def parse_time(s: str) -> int:
    """yyyymmdd; months to 12 and days to 31, no calendar."""
    if not re.fullmatch("[0-9]{8}", s, re.ASCII) or not 1 <= int(s[4:6]) <= 12 or not 1 <= int(s[6:]) <= 31:
        raise TimeError(s)
    return int(s)


def time(s: Column) -> Column:
    """The int form of a time; null if malformed. Comparing ints compares times."""
    month, day = F.substring(s, 5, 2).cast("int"), F.substring(s, 7, 2).cast("int")
    return F.when(s.rlike("^[0-9]{8}$"), F.when(month.between(1, 12) & day.between(1, 31), s.cast("int")))


def year(t: Column) -> Column:
    return F.floor(t / 10_000).cast("int")


def month(t: Column) -> Column:
    return (F.floor(t / 100) % 100).cast("int")


def day(t: Column) -> Column:
    return (t % 100).cast("int")


def active(s: Column) -> Column:
    return F.when(s == "1", True).when(s == "0", False)


def unsigned(s: Column) -> Column:
    """An unsigned 32-bit number, which one plus sign may lead; null otherwise."""
    digits = F.regexp_replace(s, "^[+]?0*", "")
    n = F.concat(F.lit("0"), digits).try_cast("long")
    return F.when(s.rlike("^[+]?[0-9]+$") & (F.length(digits) <= 10), F.when(n < 2**32, n))


def member_id(s: Column) -> Column:
    return F.when(s.rlike(UUID), F.lower(s))


def non_empty(s: Column) -> Column:
    return F.when(s != "", s)


def concrete_error(s: Column) -> Column:
    """Null for a good concrete value, else Empty, InvalidNumber, UnterminatedString or Malformed."""
    return (
        F.when(s.isNull() | (s == ""), "Empty")
        .when(s.startswith("#"), F.when(~F.substring(s, 2, 1 << 30).rlike(NUMBER), "InvalidNumber"))
        .when(s.startswith('"'), F.when(~s.endswith('"') | (F.length(s) < 2), "UnterminatedString"))
        .otherwise("Malformed")
    )


def concrete_value(s: Column) -> Column:
    """struct(value_type, value, num): the literal's text is kept; num is its double, for numbers only."""
    text = F.when(s.startswith("#"), F.substring(s, 2, 1 << 30)).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))
    kind = F.when(s.startswith("#"), "Number").otherwise("String")
    num = F.when(s.startswith("#"), text.try_cast("double"))
    return F.when(concrete_error(s).isNull(), F.struct(kind.alias("value_type"), text.alias("value"), num.alias("num")))


def semantic_tag(term: Column, type_id: Column) -> Column:
    """What the last parentheses at the end of a fully specified name hold; null for other descriptions."""
    trimmed = F.regexp_replace(term, r"\s+$", "")
    inner = F.regexp_extract(trimmed, r"\(([^(]*)\)$", 1)
    return F.when((type_id == K.FSN) & trimmed.rlike(r"\([^(]*\)$"), inner)


def is_fsn(type_id: Column) -> Column:
    return type_id == K.FSN


def is_synonym(type_id: Column) -> Column:
    return type_id == K.SYNONYM


def is_is_a(type_id: Column) -> Column:
    return type_id == K.IS_A


def is_inferred(characteristic: Column) -> Column:
    return characteristic == K.INFERRED


def is_sufficiently_defined(status: Column) -> Column:
    return status == K.DEFINED


def is_preferred(acceptability: Column) -> Column:
    return acceptability == K.PREFERRED
