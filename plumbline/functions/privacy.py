"""Masking, scrubbing and keyed fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.functions.names import DEFAULT_POLICY, NamePolicy

# What is shown, and what is recognised inside text.
HIDDEN = "•••• hidden"
DOT = "•"
# Patterns of addresses, phone numbers, secrets and literals in text.
EMAIL_VALUE = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE_RUN = r"(?<!\d)(\+?\d{2})\d{6,9}(\d{2})(?!\d)"
SECRET_PAIR = (
    r"(?i)(\"?(?:password|passwd|token|access_token|refresh_token|api_key|secret|otp|"
    r"authorization|aadhaar|pan)\"?\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,}]+)"
)
# The same findings where only their presence counts; each starts at a character that few places of a text have.
EMAIL_THERE = r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9.-]+\.[A-Za-z]{2}"
PHONE_THERE = r"\d(?<!\d\d)\d{9,12}(?!\d)"
SECRET_THERE = (
    r"(?i)[dnytpr](?=\"?\s*[:=])(?<=password|passwd|token|api_key|secret|otp|authorization|aadhaar|pan)"
    r"\"?\s*[:=]\s*[^\s,}]"
)
SQL_LITERAL = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\d{4,}"


def hide_emails(text: Column) -> Column:
    """First letter and domain stay; the pattern only runs on text with an @."""
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL_VALUE, f"$1{DOT * 3}$2")).otherwise(text)


def hide_phone(col: Column) -> Column:
    """First and last two digits of anything with seven digits or more."""
    text = col.cast("string")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    n = F.length(digits)
    masked = F.concat(F.substring(digits, 1, 2), F.repeat(F.lit(DOT), n - 4), F.right(digits, F.lit(2)))
    return F.when(n >= 7, masked).otherwise(text)


def _phone_text(col: Column, dtype: T.DataType) -> Column:
    """Phone numbers stored as doubles or decimals are read as whole numbers."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.coalesce(col.try_cast("decimal(38,0)").cast("string"), col.cast("string"))
    return col.cast("string")


def masked_column(
    name: str, col: Column, dtype: T.DataType, show_personal: bool = False, policy: NamePolicy = DEFAULT_POLICY
) -> Column:
    """One column as it may be shown."""
    if policy.is_secret(name):
        return F.lit(HIDDEN)
    if show_personal:
        return col
    phone = policy.is_personal(name)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return _masked_inside(name, col, dtype, policy)
    if phone:
        col = hide_phone(_phone_text(col, dtype))
    if phone or isinstance(dtype, T.StringType):
        col = hide_emails(col)
    return col


def _masked_inside(name: str, col: Column, dtype: T.DataType, policy: NamePolicy) -> Column:
    """Fields, elements and entries of a nested column, each by its own name; the text of a VARIANT is scrubbed."""
    if isinstance(dtype, T.StructType):
        inner = [masked_column(f.name, col.getField(f.name), f.dataType, False, policy).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*inner))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: masked_column(name, x, dtype.elementType, False, policy))
    if isinstance(dtype, T.MapType):
        def entry(k: Column, v: Column) -> Column:
            shown = masked_column(name, v, dtype.valueType, False, policy)
            if isinstance(dtype.keyType, T.StringType) and isinstance(dtype.valueType, T.StringType):
                by_name = F.when(policy.personal_flag(k), hide_phone(v)).otherwise(shown)
                return F.when(policy.secret_flag(k), F.lit(HIDDEN)).otherwise(by_name)
            return shown

        return F.transform_values(col, entry)
    return scrub(F.to_json(col))


def mask(df: DataFrame, show_personal: bool = False, policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """The whole frame with secrets hidden and, unless asked otherwise, personal data masked."""
    return df.select(
        *[
            masked_column(f.name, F.col(f"`{f.name}`"), f.dataType, show_personal, policy).alias(f.name)
            for f in df.schema.fields
        ]
    )


def masked_by_field(value: Column, field: Column, show_personal: bool = False, policy: NamePolicy = DEFAULT_POLICY) -> Column:
    """Long format: the row's ``field`` decides how its text ``value`` is shown."""
    shown = value if show_personal else hide_emails(
        F.when(policy.personal_flag(field), hide_phone(value)).otherwise(value)
    )
    return F.when(policy.secret_flag(field), F.lit(HIDDEN)).otherwise(shown)


def scrub(text: Column) -> Column:
    """Free text without secret values, e-mail addresses and phone-like digit runs."""
    text = F.regexp_replace(text, SECRET_PAIR, f'$1"{HIDDEN}"')
    return F.regexp_replace(hide_emails(text), PHONE_RUN, f"$1{DOT * 6}$2")


def scrub_sql(sql: Column, policy: NamePolicy = DEFAULT_POLICY) -> Column:
    """SQL text safe to store: literals compared with personal or secret names are dotted."""
    words = "|".join(policy.personal_parts + policy.secret_parts)
    # fixed values: a name that holds one of the words, and an IN list behind it
    name = rf"\b[\w.`]*(?:{words})[\w`]*"
    listed = rf"(?i)({name}\s+(?:not\s+)?in\s*\()([^)]*)\)"
    dotted = f"'{DOT * 3}'"
    # each IN list is cut out, its literals are replaced, and the pieces are joined again
    marked = F.regexp_replace(sql, listed, "$1\u0001$2\u0002)")
    pieces = F.transform(
        F.split(marked, "\u0001"),
        lambda p, i: F.when(
            (i > 0) & p.contains("\u0002"),
            F.concat(
                F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(1)), SQL_LITERAL, dotted),
                F.split_part(p, F.lit("\u0002"), F.lit(2)),
            ),
        ).otherwise(p),
    )
    text = F.array_join(pieces, "")
    compared = rf"(?i)({name}\s*(?:=|<>|!=|like)\s*)({SQL_LITERAL})"
    return hide_emails(F.regexp_replace(text, compared, f"$1{dotted}"))


def personal_text(text: Column) -> Column:
    """Does a text value hold an e-mail address?"""
    return text.contains("@") & text.rlike(EMAIL_THERE)


def phone_text(text: Column) -> Column:
    """Does a text value hold a run of digits that ``PHONE_RUN`` finds?"""
    return text.rlike(PHONE_THERE)


def secret_text(text: Column) -> Column:
    """Does a text value hold a pair that ``SECRET_PAIR`` finds?"""
    return (text.contains(":") | text.contains("=")) & text.rlike(SECRET_THERE)


def canonical(col: Column, dtype: T.DataType) -> Column:
    """The text that is fingerprinted: quoted for text and times, bare for numbers, ``null``."""
    if isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit('"<'), F.octet_length(col).cast("string"), F.lit(' bytes>"'))
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(F.to_variant_object(col))
    elif isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), col.cast("string"), F.lit('"'))
    else:
        text = V.plain_text(col, dtype)
    return F.coalesce(text, F.lit("null"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, from the built-in SHA-2."""
    if len(key) > 64:
        raise ValueError("use a key of at most 64 bytes")
    block = key.ljust(64, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def fingerprint(col: Column, dtype: T.DataType, key: bytes, digest_len: int = 32) -> Column:
    """Keyed fingerprint: equal values have equal fingerprints, the value stays unknown."""
    return F.substring(hmac_sha256(canonical(col, dtype), key), 1, digest_len)
