import base64
import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import values as V

U = "a98cc8b4-023a-4a6c-9c09-cdab900a892b"


@pytest.mark.parametrize(
    "raw, ok",
    [
        (U, True),
        (U.upper(), True),
        ("{" + U + "}", True),
        ("urn:uuid:" + U, True),
        (U.replace("-", ""), True),
        (U[:-1], False),
        (U + "0", False),
        ("g" + U[1:], False),
        ("", False),
        (U + "\n", False),
        (None, False),
    ],
)
def test_canonical_uuid(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(V.canonical_uuid(F.col("c"))).first()[0] == (str(uuid.UUID(raw)) if ok else None)


def test_first_non_empty(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, ""), (None, "c"), (" ", "d")], "a string, b string")
    got = [r[0] for r in df.select(V.first_non_empty(F.col("a"), F.col("b"))).collect()]
    assert got == ["a", "b", "", "c", " "]


def test_is_pdf_is_case_sensitive(spark):
    df = spark.createDataFrame([("a.pdf",), ("a.PDF",), ("pdf",), (None,)], "f string")
    assert [r[0] for r in df.select(V.is_pdf(F.col("f"))).collect()] == [True, False, False, None]


def test_iso_ts(spark):
    times = [dt.datetime(2024, 1, 2, 3, 4, 5, 60), dt.datetime(2024, 1, 2, 3, 4, 5), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select(V.iso_ts(F.col("t"), zoned=False)).collect()]
    assert got == [t.isoformat() if t else None for t in times]
    zoned = df.select(V.iso_ts(F.col("t").cast("timestamp"))).first()[0]
    assert zoned == "2024-01-02T03:04:05.000060+00:00"


def _token(claims, pad=False):
    body = base64.urlsafe_b64encode(json.dumps(claims).encode()).decode()
    return f"h.{body if pad else body.rstrip('=')}.s"


def test_token_claims(spark):
    tokens = [
        _token({"user_id": U, "role_id": 2}),
        _token({"user_id": U, "role_id": 2, "x": "ÿÿ>?"}, pad=True),
        _token({"user_id": U}),
        _token({"role_id": 1}),
        _token({"user_id": "nobody", "role_id": 1}),
        "h.***.s",
        "nodots",
        "",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [tuple(r[0]) for r in df.select(V.token_claims(F.col("t"))).collect()]
    assert got[0] == got[1] == (U, 2, "OK")
    assert got[2] == (U, None, "MISSING") and got[3] == (None, 1, "MISSING")
    assert got[4] == ("nobody", 1, "BAD_USER")
    assert {g[2] for g in got[5:]} == {"MISSING"}


def test_has_permission(spark):
    df = spark.createDataFrame([('{"a": true, "b": false}',), ("{}",), (None,), ("broken",)], "p string")
    perms = V.permission_map(F.col("p"))
    for name, want in (("a", [True, False, False, False]), ("b", [False] * 4)):
        assert [r[0] for r in df.select(V.has_permission(perms, name)).collect()] == want
    parsed = spark.createDataFrame([({"a": True},)], "p map<string,boolean>")
    kind = T.MapType(T.StringType(), T.BooleanType())
    assert parsed.select(V.has_permission(V.permission_map(F.col("p"), kind), "a")).first()[0] is True


def test_json_text_accepts_text_and_parsed_values(spark):
    df = spark.sql("""SELECT '["x"]' AS t, array('x') AS a""")
    got = df.select(*[V.json_text(F.col(c), df.schema[c].dataType) for c in ("t", "a")]).first()
    assert got[0] == got[1] == '["x"]'


def test_names_and_status(spark):
    df = spark.createDataFrame([("id", "f.pdf", "PENDING")], "d string, f string, s string")
    got = df.select(V.stored_name(F.col("d"), F.col("f")), V.lower_status(F.col("s"))).first()
    assert tuple(got) == ("id_f.pdf", "pending")


def test_base64(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff"),)], "b binary")
    text = df.select(V.to_b64(F.col("b")).alias("t"))
    assert bytes(text.select(V.from_b64(F.col("t"))).first()[0]) == b"\x00\xff"


def test_analytics_text(spark):
    df = spark.createDataFrame([(3, '["a"]', dt.datetime(2024, 1, 2))], "n int, t string, u timestamp")
    got = df.select(V.analytics_text(F.col("n"), F.col("t"), F.col("u"))).first()[0]
    assert got == (
        "User Analytics Insights:\n- Total Interactions: 3\n- Top Topics: [\"a\"]\n"
        "- Last Updated: 2024-01-02 00:00:00+00:00"
    )


def test_fixed_mapping_and_format(spark):
    df = spark.createDataFrame([("a", 0.12345), ("z", 2.0), (None, -1.0)], "c string, x double")
    got = df.select(V.map_with_default(F.col("c"), {"a": "A"}, "?"), V.fixed4(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("A", "0.1235"), ("?", "2.0000"), ("?", "-1.0000")]


def test_let_computes_once(spark):
    df = spark.createDataFrame([("a b",)], "c string")
    got = df.select(V.let(F.split("c", " "), lambda x: F.concat(x, x))).first()[0]
    assert got == ["a", "b", "a", "b"]


def test_chunk_key_depends_on_both_parts(spark):
    df = spark.createDataFrame([("1", 12), ("11", 2), ("1", 12)], "d string, i int")
    keys = [r[0] for r in df.select(V.chunk_key(F.col("d"), F.col("i"))).collect()]
    assert keys[0] == keys[2] != keys[1]
