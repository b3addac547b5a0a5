"""Typed field values: constructors, canonical text, JSON decoding, version ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("string", "int", "float", "bool")
VALUE = "struct<type:string,s:string,i:bigint,f:double,b:boolean>"
FIELDS = f"map<string,{VALUE}>"
ENTRIES = f"entity string, fields {FIELDS}, version_id string, written_at timestamp_ntz"

#: Decimal exponents from which on, and below which, floats are written with an exponent.
EXPONENT_FROM, EXPONENT_BELOW = 6, -4


def _value(kind: str, **slots: Column) -> Column:
    empty = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
    parts = [slots.get(k, F.lit(None)).cast(t).alias(k) for k, t in empty.items()]
    return F.struct(F.lit(kind).alias("type"), *parts)


def string_value(c: Column) -> Column:
    return _value("string", s=c)


def int_value(c: Column) -> Column:
    return _value("int", i=c)


def float_value(c: Column) -> Column:
    return _value("float", f=c)


def bool_value(c: Column) -> Column:
    return _value("bool", b=c)


def no_fields() -> Column:
    return F.from_json(F.lit("{}"), FIELDS)


def fields_of(**values: Column) -> Column:
    """A field map; the values are made by the constructors above."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _once(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def float_text(x: Column) -> Column:
    """Shortest digits that read back as ``x``; an exponent of two digits or more below 1e-4 and from 1e6 on."""
    plain = F.abs(x).cast("string")
    digits_of = lambda s: F.regexp_replace(F.regexp_replace(F.split(s, "E")[0], "[.]", ""), "^0+", "")
    # The plain cast is not always shortest for long fractions: look for fewer digits there.
    fewer = F.lit(None).cast("string")
    for p in (16, 15, 14):
        text = F.format_string(f"%.{p}E", F.abs(x))
        fewer = F.when(text.cast("double") == F.abs(x), text).otherwise(fewer)
    single = F.format_string("%.0E", F.abs(x))
    chosen = (
        F.when(F.length(digits_of(plain)) > 15, F.coalesce(fewer, plain))
        .when((F.length(digits_of(plain)) == 2) & (single.cast("double") == F.abs(x)), single).otherwise(plain)
    )

    def parts(s: Column) -> Column:
        mantissa, power = F.split(s, "E")[0], F.coalesce(F.get(F.split(s, "E"), F.lit(1)).cast("int"), F.lit(0))
        whole, rest = F.split(mantissa, "[.]")[0], F.coalesce(F.get(F.split(mantissa, "[.]"), F.lit(1)), F.lit(""))
        zeros = F.length(rest) - F.length(F.regexp_replace(rest, "^0+", ""))
        exponent = F.when(whole != "0", F.length(whole) - 1).otherwise(-1 - zeros) + power
        digits = F.regexp_replace(digits_of(s), "0+$", "")
        return F.struct(digits.alias("d"), exponent.alias("e"))

    def written(p: Column) -> Column:
        d, e = p.d, p.e
        n = F.length(d)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        sign = F.when(e < 0, "-").otherwise("+")
        power = F.concat(F.substr(d, F.lit(1), F.lit(1)), tail, F.lit("e"), sign, F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(2)), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        whole = F.rpad(d, F.greatest(n, e + 1), F.lit("0"))
        large = F.when(n <= e + 1, whole).otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        return F.when((e < EXPONENT_BELOW) | (e >= EXPONENT_FROM), power).when(e < 0, small).otherwise(large)

    minus = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf")
        .when(x == 0, F.concat(minus, F.lit("0"))).otherwise(F.concat(minus, _once(_once(chosen, parts), written)))
    )


def canonical(v: Column) -> Column:
    """The text by which values are compared; a missing value is the empty text."""
    text = (
        F.when(v.type == "int", v.i.cast("string")).when(v.type == "float", float_text(v.f))
        .when(v.type == "bool", v.b.cast("string")).otherwise(v.s)
    )
    return F.coalesce(text, F.lit(""))


def decode_fields(text: Column) -> Column:
    """A JSON object's members as field values.

    Strings, numbers (integral ones within 64 bits are ints), booleans; null is
    the empty string. Arrays and objects raise an error that names the field.
    """
    members = F.from_json(text, "map<string,variant>")

    def decode(name: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        whole = (number == F.floor(number)) & (F.abs(number) < 2.0**63)
        as_number = F.when(whole, int_value(F.when(whole, number).cast("bigint"))).otherwise(float_value(number))
        bad = F.raise_error(F.concat(F.lit("cannot decode field "), F.to_json(F.struct(name.alias("n")))))
        return (
            F.when(v.isNull() | (kind == "VOID"), string_value(F.lit("")))
            .when(kind == "BIGINT", int_value(F.try_variant_get(v, "$", "bigint")))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), as_number)
            .when(kind == "BOOLEAN", bool_value(F.try_variant_get(v, "$", "boolean")))
            .when(kind == "STRING", string_value(F.try_variant_get(v, "$", "string")))
            .otherwise(bad.cast(VALUE))
        )

    return F.transform_values(members, decode)


def quoted(name: Column) -> Column:
    """A name as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r'^\{"n":(.*)\}$', 1)


def version_rank(version_id: Column, compat: bool = False) -> Column:
    """The number at the end of a version id, 0 without one; with ``compat``, its digits read backwards."""
    digits = F.regexp_extract(version_id, "([0-9]+)$", 1)
    digits = F.reverse(digits) if compat else digits
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0)).cast("bigint")


def field_names(fields: Column) -> Column:
    return F.array_sort(F.map_keys(fields))


def only(fields: Column, names: list[str]) -> Column:
    """Fields by those names."""
    return F.map_filter(fields, lambda k, _: k.isin(names) if names else F.lit(False))


def without(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(names)) if names else fields
