"""Scalar functions whose semantics differ from Spark's of the same name.

All are expressions over built-in functions, so that they stay inside generated code; ANSI mode never
raises in them. Text functions count characters, comparisons ignore only ASCII case where they ignore
case, and a null argument gives null unless stated otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- text ---------------------------------------------------------------------------------------------


def upper(x: Column) -> Column:
    """ASCII upper case."""
    return F.translate(x, LOWER, UPPER)


def lower(x: Column) -> Column:
    """ASCII lower case."""
    return F.translate(x, UPPER, LOWER)


def substr(x: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Characters from start (1 is the first; negative counts from the end). Start 0 uses up one
    character of the length; a negative length takes the characters before start."""
    s = F.lit(start) if isinstance(start, int) else start
    n = F.length(x)
    first = F.when(s > 0, s - 1).when(s < 0, n + s).otherwise(F.lit(-1))
    if length is None:
        begin, end = F.greatest(first, F.lit(0)), n
    else:
        k = F.lit(length) if isinstance(length, int) else length
        begin = F.greatest(F.when(k < 0, first + k).otherwise(first), F.lit(0))
        end = F.when(k < 0, first).otherwise(first + k)
        # The character before the first takes part in the count but has no text.
        begin = F.when((s == 0) & (k < 0), F.lit(0)).otherwise(begin)
        end = F.when((s == 0) & (k < 0), F.lit(0)).otherwise(end)
    return F.when(x.isNull() | s.isNull(), None).otherwise(F.substr(x, (begin + 1).cast("int"), F.greatest((F.least(end, n) - begin).cast("int"), F.lit(0))))


def concat(*xs: Column) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def quote(x: Column, kind: str = "string") -> Column:
    """An SQL literal: text in single quotes, binary as X'..', numbers as they are, null as NULL."""
    if kind == "binary":
        body = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "string":
        body = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        body = x.cast("string")
    return F.coalesce(body, F.lit("NULL"))


def hex(x: Column) -> Column:
    """Upper-case hex digits of the UTF-8 text; numbers are hexed as text."""
    return F.hex(F.encode(x.cast("string"), "UTF-8"))


def unhex(x: Column, ignore: str = "") -> Column:
    """Bytes of hex digits, characters of ignore left out; null if malformed."""
    clean = F.translate(x, ignore, "") if ignore else x
    return F.when(clean.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(clean))


def char(*codes: Column) -> Column:
    """The text of code points (also beyond 16 bits)."""

    def one(c: Column) -> Column:
        high = F.lit(0xD800) + F.shiftright(c - 0x10000, 10)
        low = F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF))
        plain = F.lpad(F.hex(c), 4, "0")
        pair = F.concat(F.lpad(F.hex(high), 4, "0"), F.lpad(F.hex(low), 4, "0"))
        return F.decode(F.unhex(F.when(c < 0x10000, plain).otherwise(pair)), "UTF-16BE")

    return F.concat(*[one(c.cast("long")) for c in codes])


def unicode(x: Column) -> Column:
    """The first character's code point; null for an empty text."""
    return F.when(x != "", F.ascii(x))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to ASCII case."""
    return F.coalesce(lower(x).rlike("(?s)^" + _like_regex(pattern.translate(str.maketrans(UPPER, LOWER)), escape) + r"\z"), F.lit(None).cast("boolean"))


def _like_regex(pattern: str, escape: str | None) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return "".join(out)


def glob(x: Column, pattern: str) -> Column:
    """GLOB: * any text, ? one character, [..] and [^..] sets; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0:
                return F.when(x.isNotNull(), F.lit(False))
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return x.rlike("(?s)^" + "".join(out) + r"\z")


def regexp(pattern: str, x: Column, ignore_case: bool = False) -> Column:
    return x.rlike(("(?i)" if ignore_case else "") + pattern)


# --- conditionals, types --------------------------------------------------------------------------------


def iif(*args: Column) -> Column:
    """iif(c1, a1, c2, a2, ..., otherwise)."""
    out = F.lit(None) if len(args) % 2 == 0 else args[-1]
    for c, a in reversed(list(zip(args[0 : len(args) - 1 : 2], args[1::2], strict=False))):
        out = F.when(c, a).otherwise(out)
    return out


def smallest(*xs: Column) -> Column:
    """Scalar min: null if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.least(*xs))


def largest(*xs: Column) -> Column:
    """Scalar max: null if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.greatest(*xs))


def type_name(x: Column) -> Column:
    """integer, real, text, blob or null."""
    kind = F.typeof(x)
    return (
        F.when(x.isNull(), "null")
        .when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer")
        .when(kind.isin("float", "double") | kind.startswith("decimal"), "real")
        .when(kind == "binary", "blob")
        .otherwise("text")
    )


def to_integer(x: Column) -> Column:
    """Lenient cast of text: its leading whole number, cut to 64 bits; 0 without one."""
    digits = F.regexp_extract(x, r"^\s*([+-]?\d+)", 1)
    beyond = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(x.isNull(), None).when(digits == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), beyond))


def to_real(x: Column) -> Column:
    """Lenient cast of text to a real number."""
    number = F.regexp_extract(x, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0)))


# --- arithmetic -----------------------------------------------------------------------------------------


def divide(a: Column, b: Column) -> Column:
    """Whole-number division, cut towards 0; null for a divisor of 0, and where 64 bits don't hold it."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when(b == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; null for a divisor of 0."""
    return F.try_mod(a, b)


def add_or_real(a: Column, b: Column) -> Column:
    """a + b as a real number; exact while it fits 64 bits."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def shift_left(x: Column, n: Column) -> Column:
    """x << n; a negative n shifts right, 64 or more empties the number."""
    return F.when(n >= 64, F.lit(0).cast("bigint")).when(n <= -64, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).when(n < 0, F.call_function("shiftright", x, (-n).cast("int"))).otherwise(F.call_function("shiftleft", x, n.cast("int")))


def shift_right(x: Column, n: Column) -> Column:
    return shift_left(x, -n)


# --- mathematics: null outside a function's domain ---------------------------------------------------------


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def log(x: Column, base: Column | None = None) -> Column:
    """log10(x), or the logarithm to a base."""
    return F.when(x > 0, F.log10(x)) if base is None else F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def acos(x: Column) -> Column:
    return _known(F.acos(x))


def asin(x: Column) -> Column:
    return _known(F.asin(x))


def acosh(x: Column) -> Column:
    return _known(F.acosh(x))


def atanh(x: Column) -> Column:
    return F.when(F.abs(x) < 1, F.atanh(x))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def modulo(a: Column, b: Column) -> Column:
    """Remainder of real numbers."""
    return F.try_mod(a.cast("double"), b.cast("double"))


# --- other representations ---------------------------------------------------------------------------------


def rot13(x: Column) -> Column:
    return F.translate(x, UPPER + LOWER, UPPER[13:] + UPPER[:13] + LOWER[13:] + LOWER[:13])


def zorder(*xs: Column) -> Column:
    """Interleaved bits of up to 24 small whole numbers."""
    n, width = len(xs), 63 // len(xs)
    bits = [F.shiftleft(F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * n + i) for i, x in enumerate(xs) for b in range(width)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def unzorder(z: Column, n: int, i: int) -> Column:
    width = 63 // n
    bits = [F.shiftleft(F.shiftright(z, b * n + i).bitwiseAND(F.lit(1).cast("long")), b) for b in range(width)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def prefix_length(a: Column, b: Column) -> Column:
    """Number of characters with which both texts begin."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))
    return F.array_max(same)


def prefixes(x: Column) -> Column:
    """All prefixes of a text as an array, the longest first, the empty one last."""
    return F.transform(F.sequence(F.length(x), F.lit(0), F.lit(-1)), lambda k: F.substr(x, F.lit(1), k))


def number_key(x: Column) -> Column:
    """A sort key by which digits in texts order as numbers."""
    return F.regexp_replace(F.regexp_replace(x, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def decimal_text(x: Column, scale: int = 10) -> Column:
    """A decimal number as text without trailing zeros."""
    text = x.cast(f"decimal(38,{scale})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
