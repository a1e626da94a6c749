"""Pulling numeric answers and targets out of text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number pattern of an answer, and how many numbers each task kind asks for.
# A digit is a decimal digit of any script.
NUMBER_PATTERN = r"-?\p{Nd}+\.?\p{Nd}*"
ANSWER_LENGTH = {"AD": 1, "TL": 2, "Detection": 4}

# Every blank of Unicode, with the separators 0x1c to 0x1f.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def answer_length(task_kind: str) -> int:
    if task_kind not in ANSWER_LENGTH:
        raise ValueError(f"task kind must be one of {sorted(ANSWER_LENGTH)}, not {task_kind!r}")
    return ANSWER_LENGTH[task_kind]


def first_response(resps_json: Column) -> Column:
    """First response of a ``resps`` field kept as JSON text, nested two or three deep."""
    return F.coalesce(
        F.get_json_object(resps_json, "$[0][0][0]"), F.get_json_object(resps_json, "$[0][0]")
    )


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def all_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER_PATTERN})"), 1)


OTHER_DIGITS = "".join(
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
)
OTHER_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)


def plain_digits(number: Column) -> Column:
    """A found number in ASCII digits; only numbers that need it are rewritten."""
    rewritten = F.translate(number, OTHER_DIGITS, OTHER_DIGIT_VALUES)
    return F.when(is_ascii(number), number).otherwise(rewritten)


def last_numbers_text(text: Column, k: int) -> Column:
    """The last k numbers joined by commas; the empty string when the text has fewer."""
    found = all_numbers(text)
    return F.when(
        F.size(found) >= k, F.array_join(F.slice(found, -k, k), ",")
    ).otherwise(F.lit(""))


def last_numbers(text: Column, k: int) -> Column:
    """The last k numbers as doubles rounded to single precision, or null when there are fewer."""
    picked = F.transform(
        F.slice(all_numbers(text), -k, k), lambda n: plain_digits(n).cast("float").cast("double")
    )
    # Filtering a one-element array tests the value without working it out a second time.
    return F.get(F.filter(F.array(picked), lambda values: F.size(values) == k), F.lit(0))


def parse_prediction(answer: Column, k: int) -> Column:
    """Split an answer at commas into exactly k single-precision numbers; anything else is null."""
    parts = F.split(strip(answer), ",")
    values = [_number(F.get(parts, F.lit(i))) for i in range(k)]
    ok = F.size(parts) == k
    for value in values:
        ok = ok & value.isNotNull()
    return F.when(ok, F.array(*values))


def _number(part: Column) -> Column:
    # A trailing f or d is a Java spelling of a number that an answer must not get away with.
    text = plain_digits(strip(part))
    value = text.try_cast("float").cast("double")
    return F.when(text.rlike(r"^(?i)([^fd]*|[+-]?inf(inity)?)$"), value)


def parse_target(target: Column, strict: bool = True) -> Column:
    """Read a target literal, scalar or list, as an array of doubles. Never evaluates the text."""
    bare = F.regexp_replace(target, r"[\[\]()\s]", "")
    bare = F.regexp_replace(bare, r",$", "")
    values = F.transform(F.split(bare, ","), lambda part: part.try_cast("double"))
    good = F.when(~F.exists(values, lambda v: v.isNull()), values)
    if not strict:
        return good
    return F.when(target.isNull(), F.lit(None).cast("array<double>")).otherwise(
        F.coalesce(good, F.raise_error(F.concat(F.lit("target is not numeric: "), target)))
    )


def parse_fixed_target(target: Column, k: int) -> Column:
    """Code-generated form of :func:`parse_target` for a list of exactly k numbers, else null."""
    parts = F.split(F.regexp_replace(target, r"[\[\]()\s]", ""), ",")
    values = [F.get(parts, F.lit(i)).try_cast("double") for i in range(k)]
    ok = F.size(parts) == k
    for value in values:
        ok = ok & value.isNotNull()
    return F.when(ok, F.array(*values))
