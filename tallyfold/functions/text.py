"""Metric values as text (F3-F7), in the JVM throughout.

F3 prints a double with the fewest digits that read back to the same value and
never in exponent form (``10.0 -> "10"``, ``1e21 -> "1000000000000000000000"``).
For ``1e-4 <= |v| < 2**53`` the digits of ``cast(v as string)`` are the shortest:
in ``[1e-3, 1e7)`` they are already plain and only trailing zeros are cut; elsewhere
in the range an exact decimal cast removes the exponent first. Outside that range they
are not always the shortest. There the digits come from the Schubfach algorithm, which finds
them once, in integer arithmetic on the interval of decimals that read back, by a
static method of Jackson, the JSON library that Spark itself runs on (``java_method``). It writes
two digits at least, so the least subnormals, where one may do, are tried with one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.model import COUNTER, GAUGE

# Spellings of non-finite floats in text output.
POS_INF_TEXT = "+Inf"
NEG_INF_TEXT = "-Inf"
NAN_TEXT = "NaN"

_NATIVE_MIN = 1e-4
_NATIVE_MAX = float(2**53)
# JSON switches to exponent form outside [1e-6, 1e21).
_JSON_PLAIN_MIN = 1e-6
_JSON_PLAIN_MAX = 1e21


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


_TWO_63 = float(2**63)
# Shortest digits of a double, in the notation of Double.toString.
_SHORTEST = "com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal"
#: Up to it decimals of two digits are closer together than doubles.
_TWO_DIGITS_MAX = 1e-322


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(n: Column, d: Column) -> Column:
    """Whole-number division of bigints."""
    return F.call_function("div", n, d)


def _shortest_digits(a: Column) -> Column:
    """``(digits, x)``: shortest decimal digits (no zeros at the end) of a positive finite double."""
    digits = F.java_method(F.lit(_SHORTEST), F.lit("toString"), a)
    one = F.upper(F.format_string("%.0e", a))
    return _let(F.when((a <= F.lit(_TWO_DIGITS_MAX)) & (one.cast("double") == a), one).otherwise(digits), _as_digits)


def _as_digits(s: Column) -> Column:
    """``12.5E7`` as its digits 125 and the power of ten 6 behind them."""
    mantissa = F.substring_index(s, "E", 1)
    fraction = F.rtrim(F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(""), F.lit("0"))
    exponent = F.when(s.contains("E"), F.substring_index(s, "E", -1).cast("int")).otherwise(0)
    all_ = F.ltrim(F.concat(F.substring_index(mantissa, ".", 1), fraction), F.lit("0"))
    d = F.rtrim(all_, F.lit("0"))
    return F.struct(d.alias("d"), (exponent - F.length(fraction) + F.length(all_) - F.length(d)).alias("x"))


def _sign(v: Column) -> Column:
    return F.when(v < 0, F.lit("-")).otherwise(F.lit(""))


def _plain(t: Column) -> Column:
    """Digits times 10**x without an exponent."""
    point = F.length(t["d"]) + t["x"]
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    return (
        F.when(t["x"] >= 0, F.concat(t["d"], zeros(t["x"])))
        .when(point > 0, F.concat(F.substring(t["d"], F.lit(1), point), F.lit("."), F.substring(t["d"], point + 1, F.length(t["d"]))))
        .otherwise(F.concat(F.lit("0."), zeros(-point), t["d"]))
    )


def _exponent(t: Column) -> Column:
    """Exponent form, JSON style: ``1e+21``, ``1.5e-7`` (two exponent digits at least where it is not negative)."""
    e = F.length(t["d"]) + t["x"] - 1
    mantissa = F.concat(F.substring(t["d"], 1, 1), F.when(F.length(t["d"]) > 1, F.concat(F.lit("."), F.substring(t["d"], F.lit(2), F.length(t["d"])))).otherwise(""))
    power = F.abs(e).cast("string")
    return F.concat(mantissa, F.when(e < 0, F.concat(F.lit("e-"), power)).otherwise(F.concat(F.lit("e+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))))


def _plain_tail(v: Column) -> Column:
    return F.concat(_sign(v), _let(_shortest_digits(F.abs(v)), _plain))


def _json_tail(v: Column) -> Column:
    """JSON number text: plain in ``[1e-6, 1e21)``, exponent form outside."""
    a = F.abs(v)
    is_plain = (a >= F.lit(_JSON_PLAIN_MIN)) & (a < F.lit(_JSON_PLAIN_MAX))
    return F.concat(_sign(v), _let(_shortest_digits(a), lambda t: F.when(is_plain, _plain(t)).otherwise(_exponent(t))))


def _strip_fraction_zeros(s: Column) -> Column:
    """``"12.50" -> "12.5"``, ``"10.0" -> "10"`` (the text always holds a point)."""
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))


def _native_plain(v: Column) -> Column:
    a = F.abs(v)
    java = v.cast("string")
    return F.when((a >= F.lit(1e-3)) & (a < F.lit(1e7)), _strip_fraction_zeros(java)).otherwise(
        _strip_fraction_zeros(java.cast("decimal(38,22)").cast("string"))
    )


def format_float(value: str | Column) -> Column:
    """shortest text of a double, no exponent; ``+Inf``, ``-Inf``, ``NaN`` spelled out."""
    v = _c(value)
    a = F.abs(v)
    native = (a >= F.lit(_NATIVE_MIN)) & (a < F.lit(_NATIVE_MAX))
    finite = ~F.isnan(v) & (a != F.lit(float("inf")))
    tail = finite & ~native & (v != 0)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), F.lit(NAN_TEXT))
        .when(v == F.lit(float("inf")), F.lit(POS_INF_TEXT))
        .when(v == F.lit(float("-inf")), F.lit(NEG_INF_TEXT))
        .when(v == 0, _strip_fraction_zeros(v.cast("string")))
        .when(native, _native_plain(v))
        .when(tail, _plain_tail(v))
    )


def format_int(delta: str | Column) -> Column:
    """int64 as base-10 text."""
    return _c(delta).cast("string")


def value_text(type_: str | Column = "type", delta: str | Column = "delta", value: str | Column = "value") -> Column:
    """the typed field as text, ``''`` when it is NULL or the type is unknown."""
    t = _c(type_)
    return F.coalesce(
        F.when(t == COUNTER, format_int(delta)).when(t == GAUGE, format_float(value)),
        F.lit(""),
    )


_LIMB, _STEP_BITS = 10**9, 20


def _whole_text(a: Column) -> Column:
    """Exact decimal digits of a finite double from 2**63 on."""
    shift = F.floor(F.log2(a)).cast("int") - 60
    small = (a / F.pow(F.lit(2.0), shift.cast("double"))).cast("bigint")  # exact: only the exponent changes
    limb = F.lit(_LIMB).cast("bigint")
    limbs = F.array(small % limb, _div(small, limb) % limb, _div(small, limb * limb))

    def times(n: Column, factor: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            t = x * factor + acc["carry"]
            return F.struct(_div(t, limb).alias("carry"), F.array_append(acc["out"], t % limb).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        done = F.aggregate(n, zero, step)
        return F.array_append(done["out"], done["carry"])

    factors = F.concat(
        F.array_repeat(F.lit(1 << _STEP_BITS).cast("bigint"), F.floor(shift / _STEP_BITS).cast("int")),
        F.array(F.call_function("shiftleft", F.lit(1).cast("bigint"), shift % _STEP_BITS)),
    )
    product = F.aggregate(factors, limbs, times)
    text = F.array_join(F.transform(F.reverse(product), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.ltrim(text, F.lit("0"))


def round_half_even_text(value: str | Column) -> Column:
    """``%.0f`` of the exact binary value, half-even: ``2.5 -> "2"``, ``-0.4 -> "-0"``.

    Below 2**53 ``bround`` is exact; above, every double is an integer. The bigint
    cast prints it exactly up to 2**63, and from there on it is a bigint times a
    power of two, multiplied out in limbs (Java's ``%.0f`` would print its own digits).
    """
    v = _c(value)
    a = F.abs(v)
    rounded = F.format_string("%.0f", F.bround(v, 0))
    return (
        F.when(F.isnan(v), F.lit(NAN_TEXT))
        .when(v == F.lit(float("inf")), F.lit(POS_INF_TEXT))
        .when(v == F.lit(float("-inf")), F.lit(NEG_INF_TEXT))
        .when((a >= F.lit(_NATIVE_MAX)) & (a < F.lit(float(2**63))), v.cast("bigint").cast("string"))
        .when(a >= F.lit(_TWO_63), F.concat(_sign(v), _whole_text(a)))
        .when((v < 0) & (F.bround(v, 0) == 0), F.lit("-0"))
        .otherwise(rounded)
    )


def debug_text(id_: str | Column = "id", type_: str | Column = "type",
               delta: str | Column = "delta", value: str | Column = "value") -> Column:
    """``{ID: x, MType: gauge, Value: %.0f}`` (half-even) or ``{ID: x, MType: t, Delta: %d}``.

    NULL where the reference would dereference a missing field.
    """
    t, d, v = _c(type_), _c(delta), _c(value)
    gauge_line = F.format_string("{ID: %s, MType: %s, Value: %s}", _c(id_), t, round_half_even_text(v))
    other_line = F.format_string("{ID: %s, MType: %s, Delta: %s}", _c(id_), t, format_int(d))
    return F.when((t == GAUGE) & v.isNotNull(), gauge_line).when((t != GAUGE) & d.isNotNull(), other_line)


def _json_string(s: Column) -> Column:
    """JSON string literal of ``s``; ``<``, ``>``, ``&`` and the line separators escaped as in HTML-safe JSON."""
    quoted = F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    for ch in ("<", ">", "&", "\u2028", "\u2029"):
        quoted = F.replace(quoted, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return quoted


def json_float(value: str | Column) -> Column:
    """A double as JSON number text (plain in [1e-6, 1e21), else exponent); NULL if not finite."""
    v = _c(value)
    a = F.abs(v)
    finite = ~F.isnan(v) & (a != F.lit(float("inf")))
    native = (a >= F.lit(_NATIVE_MIN)) & (a < F.lit(_NATIVE_MAX))
    tail = finite & ~native & (v != 0)
    return (
        F.when(v == 0, _strip_fraction_zeros(v.cast("string")))
        .when(native, _native_plain(v))
        .when(tail, _json_tail(v))
    )


def metric_json(id_: str | Column = "id", type_: str | Column = "type",
                delta: str | Column = "delta", value: str | Column = "value") -> Column:
    """one metric as JSON text, unset fields omitted, HTML-safe escapes.

    NULL when the value is not finite (JSON has no NaN/Inf).
    """
    d, v = _c(delta), _c(value)
    number = json_float(v)
    bad = v.isNotNull() & number.isNull()
    body = F.concat(
        F.lit('{"id":'), F.coalesce(_json_string(_c(id_)), F.lit('""')),
        F.lit(',"type":'), F.coalesce(_json_string(_c(type_)), F.lit('""')),
        F.coalesce(F.concat(F.lit(',"delta":'), format_int(d)), F.lit("")),
        F.coalesce(F.concat(F.lit(',"value":'), number), F.lit("")),
        F.lit("}"),
    )
    return F.when(~bad, body)
