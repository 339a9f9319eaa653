"""Comparable forms of values.

``normalise`` maps a value of any type to a tagged string (``num:5``, ``bool:true``,
``time:...``, ``str:...``) so that values of different types can be compared, grouped
and joined.  ``same`` is an equality of such forms, hence always usable as an
equi-join condition; where both sides already have the same plain type the strings
are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as booleans, and what counts as a date or a number in text.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
PLAIN_NUMBER = r"^[+-]?\d+(\.\d+)?$"

WHITESPACE = " \t\n\r\x0b\x0c"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
NOT_PRESENT = "— not present —"
NULL_TEXT = "NULL"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = INTEGRAL + (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.StructType, T.ArrayType, T.MapType)


@dataclass(frozen=True)
class Options:
    """Switches of the comparison; the defaults are forgiving."""

    case_insensitive: bool = True
    trim: bool = True
    numbers: bool = True
    booleans: bool = True
    dates: bool = True
    empty_is_null: bool = False


DEFAULT = Options()
STRICT = Options(case_insensitive=False, trim=False, numbers=False, booleans=False, dates=False)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def plain_text(col: Column, dtype: T.DataType) -> Column:
    """The text of a value, a decimal without the zeros that only its scale adds."""
    text = col.cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale:
        return F.regexp_replace(text, r"\.?0+$", "")
    return text


def orderable(col: Column, dtype: T.DataType) -> Column:
    """The value, or its JSON text where its type has no order."""
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    text = dtype.simpleString()
    return F.to_json(F.to_variant_object(col)) if "map<" in text or "variant" in text else col


def number_text(col: Column) -> Column:
    """Canonical digits at any length: no sign of zero, no outer zeros; decimals beyond nine are rounded where the whole number
    has at most 29 digits and kept where it has more."""
    exact = col.try_cast("decimal(38,9)").cast("string")
    text = col.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"\.0*$|(\.\d*?[1-9])0+$", "$1")
    return F.coalesce(
        F.regexp_replace(exact, r"\.?0+$", ""),
        F.when(text.rlike(PLAIN_NUMBER), F.concat(F.when(text.startswith("-"), "-").otherwise(""), digits)),
        col.try_cast("decimal(38,0)").cast("string"),
        text,
    )


def _number_form(col: Column, dtype: T.DataType, opt: Options) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        col = F.when(~F.isnan(col), F.round(col, 9))
    if not opt.numbers:
        return F.concat(F.lit("str:"), col.cast("string"))
    if isinstance(dtype, INTEGRAL):
        return F.concat(F.lit("num:"), col.cast("string"))
    return F.concat(F.lit("num:"), number_text(col))


def _boolean_marks(opt: Options, as_numbers: bool) -> tuple[str, str]:
    """How true and false are tagged; as 1 and 0 where they may meet numbers."""
    if not opt.booleans:
        return "str:true", "str:false"
    return ("num:1", "num:0") if as_numbers and opt.numbers else ("bool:true", "bool:false")


def _text_form(col: Column, opt: Options, as_numbers: bool) -> Column:
    s = strip(col) if opt.trim else col
    branches = []
    if opt.empty_is_null:
        branches.append((s == "", F.lit(None).cast("string")))
    if opt.dates:
        parsed = F.when(s.rlike(ISO_TIME), s.try_cast("timestamp"))
        branches.append((parsed.isNotNull(), F.concat(F.lit("time:"), F.date_format(parsed, TIME_FORMAT))))
    if opt.numbers:
        branches.append((s.rlike(PLAIN_NUMBER), F.concat(F.lit("num:"), number_text(s))))
    if opt.booleans:
        true, false = _boolean_marks(opt, as_numbers)
        branches.append((F.lower(s).isin(TRUE_WORDS), F.lit(true)))
        branches.append((F.lower(s).isin(FALSE_WORDS), F.lit(false)))
    plain = F.concat(F.lit("str:"), F.lower(s) if opt.case_insensitive else s)
    if not branches:
        return plain
    case = F.when(*branches[0])
    for cond, value in branches[1:]:
        case = case.when(cond, value)
    return case.otherwise(plain)


@dataclass(frozen=True)
class JsonValue:
    """A JSON value with its type and text (and, where wanted, display text and normal form).

    As columns of an earlier projection each is computed once, however often it is used.
    """

    value: Column
    kind: Column
    text: Column
    shown: Column | None = None
    form: Column | None = None

    @classmethod
    def of(cls, value: Column) -> "JsonValue":
        return cls(value, json_type(value), json_text(value))


def json_text(value: Column) -> Column:
    """Text of a scalar (and JSON of a container); NULL for JSON null."""
    return F.try_variant_get(value, "$", "string")


def json_form(v: JsonValue, opt: Options = DEFAULT, as_numbers: bool = False) -> Column:
    """JSON values carry their own type, so the branch is chosen per row."""
    if v.form is not None:
        return v.form
    number = F.concat(F.lit("num:"), number_text(v.text)) if opt.numbers else F.concat(F.lit("str:"), v.text)
    true, false = _boolean_marks(opt, as_numbers)
    return (
        F.when(v.kind == "string", _text_form(v.text, opt, as_numbers))
        .when(v.kind == "number", number)
        .when(v.kind == "boolean", F.when(v.text == "true", true).otherwise(false))
        .when(v.kind.isin("object", "list"), F.concat(F.lit("str:"), F.to_json(v.value)))
    )


def normalise(col: Column, dtype: T.DataType, opt: Options = DEFAULT, as_numbers: bool = False) -> Column:
    """Tagged comparable form; NULL (and NaN) stay NULL.

    With ``as_numbers`` true counts as 1 and false as 0, as when a boolean meets a number.
    """
    if isinstance(dtype, T.BooleanType):
        true, false = _boolean_marks(opt, as_numbers)
        return F.when(col, F.lit(true)).when(~col, F.lit(false))
    if isinstance(dtype, TIMES):
        if opt.dates:
            return F.concat(F.lit("time:"), F.date_format(col, TIME_FORMAT))
        return F.concat(F.lit("str:"), col.cast("string"))
    if isinstance(dtype, NUMERIC):
        return _number_form(col, dtype, opt)
    if isinstance(dtype, NESTED):
        return F.concat(F.lit("str:"), F.to_json(F.to_variant_object(col)))
    if isinstance(dtype, T.VariantType):
        return json_form(JsonValue.of(col), opt, as_numbers)
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("str:"), F.hex(col))
    return _text_form(col.cast("string"), opt, as_numbers)


def _plain_type(a: T.DataType, b: T.DataType) -> str | None:
    """A type in which both sides compare exactly as their normal forms would."""
    if isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL):
        return "bigint"
    if isinstance(a, T.BooleanType) and isinstance(b, T.BooleanType):
        return "boolean"
    if isinstance(a, TIMES) and isinstance(b, TIMES) and type(a) is type(b):
        return a.simpleString()
    return None


def key_pair(
    a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, opt: Options = DEFAULT
) -> tuple[Column, Column]:
    """Two join keys that are equal exactly when the normal forms are equal."""
    plain = _plain_type(a_type, b_type)
    if plain:
        return a.cast(plain), b.cast(plain)
    return normalise(a, a_type, opt), normalise(b, b_type, opt)


def whole_text(text: Column) -> Column:
    """The whole number that a text equals as a decimal of nine places, or NULL.

    Plain digits never become a decimal, and a text that starts with a letter is not tried: it would cost an exception a row.
    """
    plain = text.try_cast("bigint")
    exact = F.when(~F.ascii(text).between(65, 122), text.try_cast("decimal(38,9)"))
    whole = exact.try_cast("bigint")
    return F.when(plain.cast("string") == text, plain).when(whole == exact, whole)


def raw_key(col: Column, own: T.DataType, other: T.DataType) -> Column:
    """A key as it can be joined with a key of type ``other``: as it is where the types compare, else in a common type, NULL where
    the value has none (a text that is no number has no equal among numbers)."""
    for kinds in (NUMERIC, TIMES):
        if own == other or isinstance(own, kinds) and isinstance(other, kinds):
            return col
    if isinstance(own, T.StringType) and isinstance(other, INTEGRAL):
        return whole_text(col)
    if isinstance(own, INTEGRAL) and isinstance(other, T.StringType):
        return col.cast("bigint")
    for kinds, common in ((NUMERIC, "decimal(38,9)"), (TIMES, "timestamp"), ((T.BooleanType,), "boolean")):
        if isinstance(own, kinds) and isinstance(other, T.StringType) or isinstance(own, T.StringType) and isinstance(other, kinds):
            return col.try_cast(common)
    return col.cast("string")


def raw_keys(left: DataFrame, a: str, right: DataFrame, b: str) -> tuple[Column, Column]:
    """``raw_key`` of both sides of a join, the frames' columns by name."""
    own, other = left.schema[a].dataType, right.schema[b].dataType
    return raw_key(F.col(f"`{a}`"), own, other), raw_key(F.col(f"`{b}`"), other, own)


def raw_join(left: DataFrame, a: str, right: DataFrame, b: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where the ``raw_keys`` of ``a`` and ``b`` are equal.

    Keys that are cast become columns first: a join would cast them again for the shuffle and for every step of its sort. Rows of an
    anti join whose key has no form on the other side are dealt by their own value; as NULL keys they would meet in one task.
    """
    own, other = raw_keys(left, a, right, b)
    kind, other_kind = left.schema[a].dataType, right.schema[b].dataType
    if kind == other_kind or isinstance(kind, NUMERIC) and isinstance(other_kind, NUMERIC) or isinstance(kind, TIMES) and isinstance(other_kind, TIMES):
        return left.join(right, own == other, how)
    left, right = left.withColumn("_own_form", own), right.withColumn("_other_form", other)
    met = F.col("_own_form") == F.col("_other_form")
    if how == "left_anti":
        unmet = F.when(F.col("_own_form").isNull(), F.col(f"`{a}`").cast("string"))
        left = left.withColumn("_own_spread", F.xxhash64("_own_form", unmet))
        right = right.withColumn("_other_spread", F.xxhash64("_other_form"))
        met &= F.col("_own_spread") == F.col("_other_spread")
    return left.join(right, met, how).drop("_own_form", "_other_form", "_own_spread", "_other_spread")


def comparable_pair(
    a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, opt: Options = DEFAULT
) -> tuple[Column, Column]:
    """Like ``key_pair`` for field values, where numbers also equal booleans."""
    plain = _plain_type(a_type, b_type)
    if plain:
        return a.cast(plain), b.cast(plain)
    return normalise(a, a_type, opt, True), normalise(b, b_type, opt, True)


def same(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, opt: Options = DEFAULT) -> Column:
    """Are two present values equal?  NULL equals only NULL."""
    left, right = comparable_pair(a, a_type, b, b_type, opt)
    return left.eqNullSafe(right)


# Names of JSON types by the head of a variant's schema; any other head is a number.
JSON_TYPES = {"OBJECT": "object", "ARRAY": "list", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def json_type(col: Column) -> Column:
    """string / number / boolean / list / object / null of a variant; NULL when absent."""
    head = F.schema_of_variant(col)
    kind = F.when(col.isNull(), F.lit(None).cast("string"))
    for start, name in JSON_TYPES.items():
        kind = kind.when(head.startswith(start), name)
    return kind.otherwise("number")


#: characters of a container that are shown
SHOWN = 200


def json_shown(v: JsonValue, most: int = SHOWN) -> Column:
    if v.shown is not None:
        return v.shown
    return (
        F.when(v.value.isNull(), F.lit(NOT_PRESENT))
        .when(v.kind == "null", F.lit(NULL_TEXT))
        .when(v.kind.isin("object", "list"), F.substring(F.to_json(v.value), 1, most))
        .otherwise(v.text)
    )


def display(col: Column, dtype: T.DataType, absent: Column | None = None) -> Column:
    """Text shown for a value; ``absent`` marks values that are not there at all."""
    if isinstance(dtype, T.VariantType):
        text = json_shown(JsonValue.of(col))
    elif isinstance(dtype, NESTED):
        text = F.coalesce(F.substring(F.to_json(F.to_variant_object(col)), 1, SHOWN), F.lit(NULL_TEXT))
    elif isinstance(dtype, T.BinaryType):
        text = F.coalesce(F.hex(col), F.lit(NULL_TEXT))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        written = col.cast("string")
        plain = F.when(written.contains("E") & (F.abs(col) >= 1) & (F.abs(col) < 1e29), number_text(col))
        text = F.coalesce(F.when(plain.contains("."), plain), F.concat(plain, F.lit(".0")), written, F.lit(NULL_TEXT))
    else:
        text = F.coalesce(col.cast("string"), F.lit(NULL_TEXT))
    if absent is not None:
        text = F.when(absent, F.lit(NOT_PRESENT)).otherwise(text)
    return text


# Whole seconds between 2000-01-01 and 2100-01-01.
EPOCH_RANGE = (946684800, 4102444800)


def to_time(col: Column, dtype: T.DataType) -> Column:
    """A timestamp from a time, epoch seconds or text; junk and zero dates give NULL."""
    if isinstance(dtype, TIMES):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, NUMERIC):
        seconds = F.when(col.between(*EPOCH_RANGE), col)
        return F.timestamp_seconds(seconds).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        s = strip(col)
        return F.when((s != "") & ~s.startswith("0000-00-00"), s.try_cast("timestamp")).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")
