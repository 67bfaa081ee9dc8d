"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, key fragments that mark a secret, and what replaces its value.
WHITE_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
SECRET_FRAGMENTS = ["password", "token", "secret", "key", "authorization", "x-hub-signature-256", "x-github-token"]
REDACTED = "[REDACTED]"


def clean_text(text: Column) -> Column:
    """White space collapsed to single blanks and none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def clean_markup(text: Column) -> Column:
    return F.translate(clean_text(text), "<>", "")


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the three dots included."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def safe_filename(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._/-]", "_"), "_{2,}", "_"))


def mask_url_credentials(url: Column) -> Column:
    """The first ``//...@`` of a URL without what stands between."""
    return F.regexp_replace(url, r"(?s)^(.*?)//[^@]+@", "$1//***:***@")


def hash_key(text: Column) -> Column:
    """31-multiplier hash over UTF-16 units in 32-bit arithmetic, its absolute value in base 36."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    wrap = lambda value: F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(units, F.lit(0).cast("bigint"), lambda acc, u: wrap(acc * 31 + F.conv(u, 16, 10).cast("bigint")))
    return F.lower(F.conv(F.abs(total).cast("string"), 10, 36))


def is_secret_key(name: Column) -> Column:
    hit = F.lit(False)
    for fragment in SECRET_FRAGMENTS:
        hit = hit | F.contains(F.lower(name), F.lit(fragment))
    return hit


def redact(value: Column, data_type: T.DataType) -> Column:
    """Replace the values of secret keys at any depth. Struct fields are decided while planning, map keys per row."""
    if isinstance(data_type, T.StructType):
        fields = []
        for field in data_type.fields:
            secret = any(fragment in field.name.lower() for fragment in SECRET_FRAGMENTS)
            inner = value[field.name]
            hidden = F.when(inner.isNotNull(), F.lit(REDACTED)) if secret else redact(inner, field.dataType)
            fields.append(hidden.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: redact(item, data_type.elementType))
    if isinstance(data_type, T.MapType) and isinstance(data_type.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(v))
    if isinstance(data_type, T.MapType):
        # Such a value cannot hold the text that stands for a secret, so it is left out.
        return F.transform_values(value, lambda k, v: F.when(~is_secret_key(k.cast("string")), redact(v, data_type.valueType)))
    return value
