"""Type resolution of plain scalars under four schema families, and conversion of their texts.

Each family exists twice with one meaning: as a Python function for the kernels, and as a
Spark expression that Catalyst compiles. Families: ``core`` (1.2), ``compat`` (1.1, as in
Ruby), ``json`` (1.2) and ``full`` (1.2 with timestamps, merge and value).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag numbers and their URIs.
STR, INT, FLOAT, BOOL, NULL, TIMESTAMP, SEQ, MAP, BINARY, MERGE, VALUE, CUSTOM = range(12)
TAG_NAMES = ("str", "int", "float", "bool", "null", "timestamp", "seq", "map", "binary", "merge", "value")
PREFIX = "tag:yaml.org,2002:"
FAMILIES = ("core", "compat", "json", "full")

# The texts of each type. \A and \z become anchors of either dialect.
CORE_NULL = r"|~|null|Null|NULL"
CORE_BOOL = r"true|True|TRUE|false|False|FALSE"
CORE_INT = r"[-+]?0x[0-9a-fA-F]+|[-+]?0o[0-7]+|[-+]?[0-9]+"
DIGITS_FLOAT = r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+"
CORE_FLOAT = r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)|" + DIGITS_FLOAT
JSON_INT = r"-?(?:0|[1-9][0-9]*)"
JSON_FLOAT = JSON_INT + r"(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
STAMP = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?"
COMPAT_NULL = r"(?i:null)||~"
COMPAT_BOOL = r"(?i:y|yes|true|on|n|no|false|off)"
COMPAT_SPECIAL = r"[-+]?(?i:\.inf)|(?i:\.nan)"
SIXTY = r"[-+]?[0-9][0-9_]*(?::[0-5]?[0-9]){1,2}"
SIXTY_FLOAT = SIXTY + r"\.[0-9_]*"
COMPAT_INT = r"[-+]?0b[0-9_,]+|[-+]?0x[0-9a-fA-F_,]+|[-+]?0[0-7_,]*|[-+]?[1-9][0-9_,]*"
COMPAT_FLOAT = r"[-+]?(?:[0-9][0-9_,]*)?\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|[-+]?[0-9][0-9_,]*\.(?:[eE][-+][0-9]+)?"

#: Family: ordered (type, texts).
TABLES = {
    "core": ((NULL, CORE_NULL), (BOOL, CORE_BOOL), (INT, CORE_INT), (FLOAT, CORE_FLOAT)),
    "json": ((NULL, "null"), (BOOL, "true|false"), (INT, JSON_INT), (FLOAT, JSON_FLOAT)),
    "full": ((MERGE, "<<"), (VALUE, "="), (TIMESTAMP, f"{DATE}|(?=.{{10}}){STAMP}"), (NULL, CORE_NULL), (BOOL, CORE_BOOL), (INT, CORE_INT), (FLOAT, CORE_FLOAT)),
    "compat": (
        (NULL, COMPAT_NULL),
        (BOOL, COMPAT_BOOL),
        (VALUE, "="),
        (MERGE, "<<"),
        (TIMESTAMP, f"{DATE}|{STAMP}"),
        (FLOAT, COMPAT_SPECIAL),
        (INT, SIXTY),
        (FLOAT, SIXTY_FLOAT),
        (INT, COMPAT_INT),
        (FLOAT, COMPAT_FLOAT),
    ),
}
_compiled = {name: tuple((t, re.compile(f"(?:{p})")) for t, p in table) for name, table in TABLES.items()}
YES = frozenset("y yes true on".split())
WORDS = frozenset("y yes true on n no false off".split())


def resolve(text: str, family: str = "core") -> int:
    """The tag number of a plain scalar."""
    return _known(text, family) if len(text) <= 64 else _resolve(text, family)


def _resolve(text: str, family: str) -> int:
    for tag, pattern in _compiled[family]:
        if pattern.fullmatch(text):
            return tag
    return STR


#: Short texts repeat, keys above all.
_known = lru_cache(1 << 14)(_resolve)


def resolve_column(text: Column, family: str = "core") -> Column:
    """``resolve`` as one conditional expression; null stays null."""
    out = F.lit(STR)
    for tag, pattern in reversed(TABLES[family]):
        out = F.when(text.rlike(rf"\A(?:{pattern})\z"), F.lit(tag)).otherwise(out)
    return F.when(text.isNotNull(), out)


def tag_number(uri: str) -> int:
    name = uri.removeprefix(PREFIX)
    return TAG_NAMES.index(name) if uri.startswith(PREFIX) and name in TAG_NAMES else CUSTOM


def tag_uri(number: int) -> str | None:
    return PREFIX + TAG_NAMES[number] if 0 <= number < len(TAG_NAMES) else None


def tag_uri_column(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(PREFIX + n) for n in TAG_NAMES), F.lit(None).cast("string")), number + 1)


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def to_int(text: str) -> int | None:
    """A 64-bit integer from any spelling of the families: radixes, leading-zero octal, separators, sixties."""
    if len(text) < 19 and text.isascii() and text.isdigit() and (text[0] != "0" or len(text) == 1):
        return int(text)
    m = re.fullmatch(r"([-+]?)(.*)", text, re.S)
    sign, body = (-1 if m[1] == "-" else 1), m[2].replace("_", "").replace(",", "")
    if re.fullmatch(r"[0-9]+(:[0-9]+)+", body):
        parts = [int(p) for p in body.split(":")]
        # weights are fixed by place: hours, minutes, seconds
        value = parts[0] * sign * 3600 + sum(p * 60 ** abs(i - 2) for i, p in enumerate(parts) if i)
        return value if LOW <= value <= HIGH else None
    for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if body.startswith(prefix):
            body = body[2:]
            break
    else:
        base = 8 if len(body) > 1 and body[0] == "0" else 10
    try:
        value = sign * int(body, base) if re.fullmatch("[0-9a-fA-F]+", body) else None
    except ValueError:
        value = None
    return value if value is not None and LOW <= value <= HIGH else None


def to_float(text: str) -> float | None:
    """A double from any spelling of the families."""
    low = text.lower().replace("_", "").replace(",", "")
    if low.lstrip("+-") == ".inf":
        return -math.inf if low[0] == "-" else math.inf
    if low == ".nan":
        return math.nan
    if ":" in low:
        sign, body = (-1.0 if low[0] == "-" else 1.0), low.lstrip("+-")
        parts = body.split(":")
        try:
            return float(parts[0]) * sign * 3600 + sum(float(p or 0) * 60 ** abs(i - 2) for i, p in enumerate(parts) if i)
        except ValueError:
            return None
    if re.fullmatch(DIGITS_FLOAT + r"|[-+]?[0-9]+", low):
        return float(low)
    number = to_int(text)
    return None if number is None else float(number)


def to_bool(text: str, any_word: bool = False) -> bool | None:
    """The words of core, or with ``any_word`` those of compat."""
    if any_word:
        low = text.lower()
        return low in YES if low in WORDS else None
    return {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}.get(text)


def to_int_column(text: Column) -> Column:
    """``to_int`` as an expression; null where the text is no 64-bit integer."""
    clean = F.regexp_replace(text, "[_,]", "")
    sign = F.when(clean.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(clean, r"\A[-+]", "")

    def radix(digits: Column, base: int) -> Column:
        # conv gives unsigned 64 bits; what does not fit a signed long is null
        wide = F.conv(digits, base, 10).cast("decimal(38,0)") * sign
        width = {16: 16, 8: 22, 2: 64}[base]
        short = F.length(F.regexp_replace(digits, r"\A0+", "")) <= width
        fits = short & (wide >= F.lit(LOW).cast("decimal(38,0)")) & (wide <= F.lit(HIGH).cast("decimal(38,0)"))
        return F.when(fits, wide.cast("long"))

    cut = F.split(body, ":")
    # null where a part or the sum is beyond 64 bits
    place = lambda i, weight: F.try_multiply(F.when(F.size(cut) > i, F.get(cut, i).try_cast("long")).otherwise(F.lit(0).cast("long")), weight)
    sixty = F.try_add(F.try_add(place(0, (sign * 3600).cast("long")), place(1, F.lit(60).cast("long"))), place(2, F.lit(1).cast("long")))
    return (
        F.when(body.rlike(r"\A[0-9]+(:[0-9]+){1,2}\z"), sixty)
        .when(body.rlike(r"\A0x[0-9a-fA-F]+\z"), radix(F.substring(body, 3, 100), 16))
        .when(body.rlike(r"\A0o[0-7]+\z"), radix(F.substring(body, 3, 100), 8))
        .when(body.rlike(r"\A0b[01]+\z"), radix(F.substring(body, 3, 100), 2))
        .when(body.rlike(r"\A0[0-7]+\z"), radix(body, 8))
        .when(body.rlike(r"\A(0|[1-9][0-9]*)\z"), F.concat(F.when(sign < 0, "-").otherwise(""), body).try_cast("long"))
    )


def to_float_column(text: Column) -> Column:
    """``to_float`` as an expression."""
    low = F.lower(F.regexp_replace(text, "[_,]", ""))
    body = F.regexp_replace(low, r"\A[-+]", "")
    sign = F.when(low.startswith("-"), -1.0).otherwise(1.0)
    cut = F.split(body, ":")
    part = lambda i: F.coalesce(F.get(cut, i).try_cast("double"), F.lit(0.0))
    return (
        F.when(body == ".inf", sign * F.lit(math.inf))
        .when(low == ".nan", F.lit(math.nan))
        .when(body.rlike(r"\A[0-9.]*(:[0-9.]*)+\z"), part(0) * sign * 3600 + part(1) * 60 + part(2))
        .when(low.rlike(rf"\A(?:{DIGITS_FLOAT}|[-+]?[0-9]+)\z"), low.try_cast("double"))
        .otherwise(to_int_column(text).cast("double"))
    )


def to_bool_column(text: Column, any_word: bool = False) -> Column:
    if any_word:
        return F.when(F.lower(text).isin(*sorted(WORDS)), F.lower(text).isin(*sorted(YES)))
    return F.when(text.isin("true", "True", "TRUE"), True).when(text.isin("false", "False", "FALSE"), False)


def to_timestamp_column(text: Column) -> Column:
    """Timestamp of a text that is classified as one; null where the calendar has no such instant."""
    shaped = F.regexp_replace(text, r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[Tt]|[ \t]+)", "$1-$2-$3 ")
    shaped = F.regexp_replace(shaped, r"[ \t]+(Z|[-+])", "$1")
    shaped = F.regexp_replace(shaped, r"([-+])([0-9])(?=\z|:)", "$10$2")
    shaped = F.regexp_replace(shaped, r"(:[0-9]{2}(?:\.[0-9]*)?[-+][0-9]{2})\z", "$1:00")
    return F.when(text.rlike(rf"\A(?:{DATE}|{STAMP})\z"), F.try_to_timestamp(shaped))


def float_word(value: float) -> str | None:
    """YAML's word for a number that is not finite."""
    if math.isnan(value):
        return ".nan"
    if math.isinf(value):
        return ".inf" if value > 0 else "-.inf"
    return None


def shortest(value: float) -> str:
    """The shortest decimal text that reads back as the same double, with a dot: 1.0, 1.5e-07 as 1.5e-07."""
    return float_word(value) or repr(float(value))


def json_float(value: float) -> str:
    """A finite double as JSON: plain between 1e-4 and 1e16, else with an exponent, always with a dot."""
    text = repr(float(value))
    if "e" in text:
        mantissa, exponent = text.split("e")
        mantissa = mantissa if "." in mantissa else mantissa + ".0"
        return f"{mantissa}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').zfill(2)}"
    return text
