"""Scalar functions over identifiers, text, JSON, tokens and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.constants import ANALYTICS_LINES


def first_non_empty(*cols: Column) -> Column:
    """The first argument that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def is_pdf(name: Column) -> Column:
    """Case-sensitive test of the file suffix."""
    return name.endswith(".pdf")


def canonical_uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of a UUID written with any dashes, braces or URN prefix; else NULL."""
    plain = F.replace(F.replace(c, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.lower(F.replace(F.trim(plain, F.lit("{}")), F.lit("-"), F.lit("")))
    groups = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike(r"\A[0-9a-f]{32}\z"), F.concat_ws("-", *groups))


def iso_ts(ts: Column, zoned: bool = True, separator: str = "T") -> Column:
    """ISO-8601 text with microseconds only where they are not zero; NULL stays NULL."""
    fraction = F.date_format(ts, "SSSSSS")
    text = F.concat(
        F.date_format(ts, f"yyyy-MM-dd'{separator}'HH:mm:ss"),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
    )
    return F.concat(text, F.date_format(ts, "xxx")) if zoned else text


def encode_json(*cols: str | Column) -> Column:
    return F.to_json(F.struct(*cols))


def decode_json(c: Column, schema: T.DataType | str) -> Column:
    """Parsed value, NULL where the text is not valid JSON of that shape."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def json_text(c: Column, kind: T.DataType) -> Column:
    """JSON text of a column that holds either JSON text already or a parsed value."""
    return c if isinstance(kind, T.StringType) else F.to_json(c)


def permission_map(c: Column, kind: T.DataType | None = None) -> Column:
    """``map<string,boolean>`` from JSON text or from an already parsed map."""
    return c if isinstance(kind, T.MapType) else decode_json(c, "map<string,boolean>")


def has_permission(perms: Column, name: str | Column) -> Column:
    """The flag of one permission; a missing map or entry means false."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(perms, key), F.lit(False))


def token_payload(token: Column) -> Column:
    """JSON text in the middle part of ``header.payload.signature``; the signature is not checked."""
    middle = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    return F.try_to_binary(middle, F.lit("base64")).cast("string")


def token_claims(token: Column) -> Column:
    """``struct(user_id, role_id, status)``; status is OK, MISSING or BAD_USER."""
    payload = token_payload(token)
    user, role = F.get_json_object(payload, "$.user_id"), F.get_json_object(payload, "$.role_id")
    status = (
        F.when(F.coalesce(user, F.lit("")) == "", "MISSING")
        .when(role.isNull(), "MISSING")
        .when(canonical_uuid(user).isNull(), "BAD_USER")
        .otherwise("OK")
    )
    return F.struct(
        user.alias("user_id"), role.try_cast("int").alias("role_id"), status.alias("status")
    )


def stored_name(doc_id: Column, file_name: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_"), file_name)


def lower_status(status: Column) -> Column:
    return F.lower(status)


def chunk_key(doc_id: Column, chunk_idx: Column) -> Column:
    """Repeatable chunk id, so that a retried or re-delivered document yields the same keys."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), chunk_idx.cast("string")), 256)


def fixed4(x: Column) -> Column:
    return F.format_string("%.4f", x)


def analytics_text(total: Column, topics: Column, updated: Column, zoned: bool = True) -> Column:
    """Summary handed back to the caller of the analytics tool."""
    when = F.coalesce(iso_ts(updated, zoned, " "), F.lit("None"))
    return filled("\n".join(ANALYTICS_LINES), total.cast("string"), topics, when)


def filled(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by a value."""
    first, *rest = template.split("{}")
    pairs = [part for value, text in zip(values, rest) for part in (value, F.lit(text))]
    return F.concat(F.lit(first), *pairs)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is otherwise computed anew for each element.
    """
    return F.transform(F.array(value), body)[0]


def to_b64(c: Column) -> Column:
    return F.base64(c)


def from_b64(c: Column) -> Column:
    """Decoded bytes, NULL where the text is not base64."""
    return F.try_to_binary(c, F.lit("base64"))


def map_with_default(c: Column, mapping: dict[str, str], default: str) -> Column:
    """Look a value up in a small fixed mapping, with a default for all others."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None)
    return F.coalesce(found, F.lit(default))
