"""Hashes, names and small text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.binding import bound
from scorelake.functions.numbers import strip

# Characters a model name may not keep, and the words read as booleans.
RESERVED_NAME_CHARS = r"""["<>:/\|\\?\*\[\]]+"""
TRUE_WORDS = ("yes", "y", "true", "t", "1")
FALSE_WORDS = ("no", "n", "false", "f", "0")


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. The parser itself stops after the first value, so the
    text has to hold up both as the only array element and as the only field."""
    def holds(before: str, after: str) -> Column:
        return F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()

    return F.coalesce(holds("[", "]") & holds('{"v":', "}"), F.lit(False))


def sanitize_model_name(name: Column, full_path: bool = False) -> Column:
    if not full_path:
        parts = F.split(name, "/")
        name = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(name)
    return F.regexp_replace(name, RESERVED_NAME_CHARS, "__")


def sanitize_task_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\W", "_")


def detokenize(text: Column) -> Column:
    """Join clitics, brackets, quotes and punctuation back onto their words."""
    for find, put in ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        text = F.replace(text, F.lit(find), F.lit(put))
    return F.regexp_replace(text, r" (['.,])", "$1")


def replace_first(text: Column, pattern: str, replacement: str, count: int) -> Column:
    """Replace at most ``count`` matches with plain text; 0 replaces them all."""
    if count == 0:
        return F.regexp_replace(text, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return F.array_join(F.split(text, pattern, count + 1), replacement)


def escaped_split(text: Column, separator: str, max_splits: int = -1) -> Column:
    """Split at a character unless a backslash stands before it."""
    if len(separator) != 1:
        raise ValueError("the separator must be one character")
    if max_splits == 0:
        return F.array(text)
    return F.split(text, r"(?<!\\)\Q" + separator + r"\E", max_splits + 1 if max_splits > 0 else -1)


def parse_arguments(text: Column) -> Column:
    """``a=1,b=x`` as an array of (key, value, kind), kind being bool, int, float or str."""
    items = F.filter(F.split(strip(text), ","), lambda item: item != "")

    def typed(item: Column) -> Column:
        pieces = F.split(item, "=")
        key, value = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
        kind = (
            F.when(F.lower(value).isin("true", "false"), "bool")
            .when(value.rlike(r"^\d+$"), "int")
            .when(value.try_cast("double").isNotNull() & ~value.rlike("[dDfF]$"), "float")
            .otherwise("str")
        )
        return F.struct(key.alias("key"), value.alias("value"), kind.alias("kind"))

    return F.transform(items, typed)


def run_task(file_name: Column) -> Column:
    """Task part of a run file name: between the first and the last underscore."""
    return F.regexp_extract(file_name, r"^[^_]*_(.*)_[^_]*$", 1)


def run_time(file_name: Column) -> Column:
    """Time part of a run file name: after the last underscore, without the extension."""
    return F.replace(F.regexp_extract(file_name, r"([^_]*)$", 1), F.lit(".jsonl"), F.lit(""))


def drop_default_filter(metric: Column) -> Column:
    """``acc,none`` becomes ``acc``."""
    return F.regexp_replace(metric, ",none$", "")


def to_boolean(text: Column) -> Column:
    word = F.lower(text)
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def fixed_decimals(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded by its exact binary value, half to even.

    ``format_string`` rounds the shortest decimal spelling instead, which turns 0.5515 (stored a little
    below) into 0.552. The product with a power of ten is taken in two parts so that no bit is lost.
    """
    scale = float(10**digits)
    step = F.lit(10**digits).cast("bigint")

    def spelled(v: Column) -> Column:
        size = F.abs(v)
        high = size * 134217729.0 - (size * 134217729.0 - size)
        product = size * scale
        rest = (high * scale - product) + (size - high) * scale
        whole = F.floor(product)
        beyond = (product - whole - 0.5) + rest
        units = whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)
        return F.struct((v < 0).alias("minus"), units.alias("units"))

    parts = bound(value.cast("double"), spelled)

    def shown(p: Column) -> Column:
        sign = F.when(p["minus"], F.lit("-")).otherwise(F.lit(""))
        whole = F.floor(p["units"] / step).cast("string")
        if digits == 0:
            return F.concat(sign, whole)
        return F.concat(sign, whole, F.lit("."), F.lpad((p["units"] % step).cast("string"), digits, "0"))

    return bound(parts, shown)


def fixed(value: Column, digits: int, width: int | None = None) -> Column:
    """As :func:`fixed_decimals` with ``nan`` for null, padded on the right when a width is given."""
    shown = F.coalesce(fixed_decimals(value, digits), F.lit("nan"))
    return pad(shown, width) if width else shown


def float_text(value: Column) -> Column:
    """A number spelled as Python spells it: ``0.0005`` and ``12000000.0``, ``1e-05`` and ``1e+16``."""
    text = value.cast("string")
    size = F.abs(value)
    plain = F.rtrim(text.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    sign = F.when(F.contains(text, F.lit("E-")), F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    spelled = F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)
    return F.when(F.contains(text, F.lit("E")), spelled).otherwise(text)


def pad(text: Column, width: int) -> Column:
    """Pad on the right up to a width; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def stringify_leaves(nested: Column, depth: int = 2) -> Column:
    """Every leaf of an array nested ``depth`` deep as text."""
    if depth == 1:
        return F.transform(nested, lambda leaf: leaf.cast("string"))
    return F.transform(nested, lambda inner: stringify_leaves(inner, depth - 1))


def clean_json(value: Column) -> Column:
    """JSON text of a nested value; null fields are kept so that a failure stays visible."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def estimated_tokens(text: Column) -> Column:
    return F.size(F.split(text, " ")) * F.lit(1.5)


def throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def config_name(task: Column, split: str) -> Column:
    """Data configuration of a task for a split; configurations say BoxSize where tasks say BoxCoordinate."""
    if split.lower() not in ("train", "test"):
        raise ValueError("split must be 'train' or 'test'")
    suffix = "_Train" if split.lower() == "train" else "_Test"
    return F.replace(F.concat(task, F.lit(suffix)), F.lit("BoxCoordinate"), F.lit("BoxSize"))
