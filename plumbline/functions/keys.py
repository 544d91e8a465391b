"""Typed keys and canonical text of result cells and rows, as columns.

A cell's key says its kind and its value, so that 1, true, 1.0 and the text '1' are four keys, all NaN are one and
-0.0 is 0.0. Results are compared by these keys and never by raw columns, which Spark would coerce to a common type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "null"
SCALE = 6


class UnsupportedValue(TypeError):
    """A column's type has no canonical form."""


def declared_type(kind: T.DataType) -> str:
    """A type's name without precision, scale or length."""
    return "string" if isinstance(kind, T.StringType | T.VarcharType | T.CharType) else kind.typeName()


def declared_types(df: DataFrame) -> list[str]:
    return [declared_type(f.dataType) for f in df.schema.fields]


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType | T.VarcharType | T.CharType)


def tag_of(kind: T.DataType) -> str:
    """The tag of a type's values that aren't null. Timestamps without zone are a kind of their own, ts_ntz."""
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.DecimalType | T.DoubleType | T.FloatType):
        return "dec"
    if is_text(kind) or isinstance(kind, T.DayTimeIntervalType | T.YearMonthIntervalType | T.CalendarIntervalType):
        return "str"
    if isinstance(kind, T.TimestampNTZType):
        return "ts_ntz"
    if isinstance(kind, T.TimestampType):
        return "ts"
    if isinstance(kind, T.DateType):
        return "date"
    raise UnsupportedValue(f"values of type {kind.simpleString()} have no canonical form")


def type_tag(c: Column, kind: T.DataType) -> Column:
    tag = F.lit(tag_of(kind))
    if is_text(kind):
        tag = F.when(F.is_valid_utf8(c), tag).otherwise("text-bytes")
    return F.when(c.isNull(), NULL).otherwise(tag)


def _special(c: Column, rest: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c), "NaN").when(c == inf, "Infinity").when(c == -inf, "-Infinity").otherwise(rest)


def _bound(value: Column, of) -> Column:
    """of(value), where value is computed once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _digits(text: Column) -> Column:
    """A struct of sign, whole digits and digits of the fraction of a number's text, with or without an exponent."""
    part = lambda x, by, i: F.split_part(x, F.lit(by), F.lit(i))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    split = _bound(F.upper(F.ltrim(text, F.lit("+-"))), lambda x: F.struct(part(x, "E", 1).alias("mantissa"), F.coalesce(part(x, "E", 2).try_cast("int"), F.lit(0)).alias("power")))
    placed = _bound(split, lambda x: F.struct(F.replace(x["mantissa"], F.lit("."), F.lit("")).alias("digits"), (F.length(part(x["mantissa"], ".", 1)) + x["power"]).alias("point")))
    # the point may stand before the first digit or behind the last
    padded = _bound(placed, lambda x: F.struct(F.concat(zeros(-x["point"]), x["digits"], zeros(x["point"] - F.length(x["digits"]))).alias("digits"), F.greatest(x["point"], F.lit(0)).alias("at")))
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("").alias("sign")
    return _bound(padded, lambda x: F.struct(sign, F.coalesce(F.nullif(F.ltrim(F.substring(x["digits"], F.lit(1), x["at"]), F.lit("0")), F.lit("")), F.lit("0")).alias("whole"), F.substring(x["digits"], x["at"] + 1, F.length(x["digits"])).alias("fraction")))


def _signed(sign: Column, text: Column) -> Column:
    return _bound(text, lambda x: F.when(F.rlike(x, F.lit("[1-9]")), F.concat(sign, x)).otherwise(x))


def stripped(text: Column) -> Column:
    """A number's text in plain digits, without trailing zeros of its fraction, however large or small it is."""
    plain = lambda d: _signed(d["sign"], _bound(F.rtrim(d["fraction"], F.lit("0")), lambda cut: F.concat(d["whole"], F.when(cut == "", "").otherwise(F.concat(F.lit("."), cut)))))
    short = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(F.contains(text, F.lit("E")), _bound(_digits(text), plain)).otherwise(short)


def _plain_double(c: Column, places: int) -> Column:
    """A finite double in plain digits at so many places, half up, from the digits of its own text."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("string").try_cast("double")))


def payload(c: Column, kind: T.DataType) -> Column:
    """The exact value as text."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        c = c + F.lit(0.0).cast(kind)  # -0.0 becomes 0.0
        text = F.when(F.contains(c.cast("string"), F.lit("E")), _plain_double(c, 340)).otherwise(c.cast("string"))
        return _special(c, F.regexp_replace(text, r"\.?0+$", ""))
    if isinstance(kind, T.DecimalType):
        return stripped(c.cast("string"))
    if is_text(kind):
        return F.when(F.is_valid_utf8(c), c).otherwise(F.lower(F.hex(c.cast("binary"))))
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def cell_key(c: Column, kind: T.DataType) -> Column:
    """tag:value of a cell; null: for null."""
    tag_of(kind)
    return F.when(c.isNull(), f"{NULL}:").otherwise(F.concat(type_tag(c, kind), F.lit(":"), payload(c, kind)))


def cells(df: DataFrame) -> list[Column]:
    return [cell_key(df[f"`{f.name}`"] if df.columns.count(f.name) == 1 else df[i], f.dataType) for i, f in enumerate(df.schema.fields)]


def by_place_but(df: DataFrame, pos: str) -> DataFrame:
    """df with its columns named c0 and so on, whatever their names, but for one of places, which is _pos."""
    n = iter(range(len(df.columns)))
    return df.toDF(*("_pos" if c == pos else f"c{next(n)}" for c in df.columns))


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named by place, as two of a result's columns may share a name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def row_key(df: DataFrame) -> Column:
    """Typed cells of a row. df: from by_place."""
    return F.array(*(cell_key(F.col(f.name), f.dataType) for f in df.schema.fields if f.name[0] == "c"))


def rendered(c: Column, kind: T.DataType, null_text: str = "NULL") -> Column:
    """The canonical text of a cell: numbers that aren't integers at scale 6, half up, without exponent or signed
    zero; backslash, tab and line breaks escaped."""
    tag = tag_of(kind)
    if tag == "dec":
        own = c.cast("string")
        text = own.try_cast(f"decimal(38,{SCALE})").cast("string")
        if isinstance(kind, T.DecimalType):
            # more whole digits than that leave fewer than SCALE places, so that nothing is rounded
            pointed = F.concat(own, F.when(F.contains(own, F.lit(".")), "").otherwise("."))
            text = F.coalesce(text, F.rpad(pointed, F.length(F.split_part(own, F.lit("."), F.lit(1))) + 1 + SCALE, F.lit("0")))
        else:
            wide = _plain_double(c, SCALE)
            text = _special(c, F.coalesce(text, F.when(F.rlike(wide, F.lit("[1-9]")), wide).otherwise(F.ltrim(wide, F.lit("-")))))
    else:
        text = payload(c, kind)
        if tag == "str":
            for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.coalesce(text, F.lit(null_text))


def canonical_line(df: DataFrame) -> Column:
    """A row's tagged canonical cells, joined by tabs: what ordered results are compared by. df: from by_place."""
    own = [f for f in df.schema.fields if f.name[0] == "c"]
    return F.concat_ws("\t", *(F.concat(type_tag(F.col(f.name), f.dataType), F.lit(":"), rendered(F.col(f.name), f.dataType)) for f in own))


def _whole_double(c: Column) -> Column:
    """The exact value, as text, of a whole double below 1e38 in size: a sum of multiples of 2**64, 2**32 and 1, each of
    which a double holds exactly."""
    # by way of an integer: a cast of the double itself would take its shortest digits
    wide = lambda x: x.try_cast("bigint").cast("decimal(19,0)")
    upper = _bound(F.abs(c), lambda x: F.struct(x.alias("size"), F.floor(x / 2.0**64).cast("double").alias("high")))
    lower = _bound(upper, lambda x: F.struct(x["high"].alias("high"), (x["size"] - x["high"] * 2.0**64).alias("rest")))
    three = _bound(lower, lambda x: F.struct(x["high"].alias("high"), F.floor(x["rest"] / 2.0**32).cast("double").alias("middle"), x["rest"].alias("rest")))

    def total(x):
        high = (wide(x["high"]) * F.lit(str(1 << 64)).cast("decimal(20,0)")).try_cast("decimal(38,0)")
        return F.try_add(high, (wide(x["middle"]) * F.lit(str(1 << 32)).cast("decimal(11,0)") + wide(x["rest"] - x["middle"] * 2.0**32)).try_cast("decimal(38,0)")).cast("string")

    return F.concat(F.when(c < 0, "-").otherwise(""), _bound(three, total))


def set_reading_key(c: Column, kind: T.DataType) -> Column:
    """A cell's key under plain set equality, where numbers of all types compare by exact value and 1, 1.0 and true
    are equal. A decimal equals a double only if the double holds it exactly; every NaN differs from all others. Whole
    numbers below 1e38 have a key of all digits, other doubles that of the double, and what is left its plain text."""
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("n:"), c.cast("int").cast("string"))
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit("n:"), c.cast("string"))
    if isinstance(kind, T.DoubleType | T.FloatType):
        c = c.cast("double") + F.lit(0.0)
        small = F.when(F.abs(c) < 1e18, c)
        text = F.when(small == F.floor(small), F.concat(F.lit("n:"), small.cast("bigint").cast("string"))).when((F.abs(c) >= 1e18) & (F.abs(c) < 1e38), F.concat(F.lit("n:"), _whole_double(c)))
        return _special(c, text.otherwise(F.concat(F.lit("f:"), c.cast("string"))))
    if isinstance(kind, T.DecimalType):
        text = stripped(c.cast("string"))
        places, digits = F.length(F.split_part(text, F.lit("."), F.lit(2))), F.replace(text, F.lit("."), F.lit("")).try_cast("decimal(38,0)")
        fives = F.get(F.array(*(F.lit(str(5**i)).cast("decimal(27,0)") for i in range(39))), places)
        # the number is n / 2**places just if its digits are n times 5**places, and a double if that holds n
        n = F.try_divide(digits, fives).try_cast("decimal(38,0)")
        near = _bound(F.struct(n.alias("n"), n.cast("double").alias("d")), lambda x: F.when(F.when(F.abs(x["d"]) < 1e38, _whole_double(x["d"])) == x["n"].cast("string"), F.concat(F.lit("f:"), (x["d"] / F.pow(F.lit(2.0), places)).cast("string"))))
        return F.when(places == 0, F.concat(F.lit("n:"), text)).when(digits % fives == 0, F.coalesce(near, F.concat(F.lit("d:"), text))).otherwise(F.concat(F.lit("d:"), text))
    return F.concat(F.lit(f"{tag_of(kind)}:"), payload(c, kind))


def set_row_key(df: DataFrame) -> Column:
    """df: from by_place."""
    own = [f for f in df.schema.fields if f.name[0] == "c"]
    return F.array(*(F.coalesce(set_reading_key(F.col(f.name), f.dataType), F.lit("null:")) for f in own))


def has_nan(df: DataFrame) -> Column:
    own = [F.isnan(f.name) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    out = F.lit(False)
    for c in own:
        out = out | F.coalesce(c, F.lit(False))
    return out
