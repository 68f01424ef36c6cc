"""Names, labels and value shapes."""

import pytest
from pyspark.sql import functions as F

from tableguard.functions import names as N, scan as S, values as V
from tableguard.operators import protect as P

NAMES = {
    "FIRST_NAME": "personal_name", "LAST_NAME": "personal_name", "FNAME": "personal_name", "FARMER_NAME": "personal_name",
    "ID_CARD": "national_id", "CITIZEN_ID": "national_id", "PID": "national_id", "TEL": "phone", "MOBILE_NO": "phone",
    "EMAIL": "email", "ADDR": "address", "HOUSE_NO": "address", "DOB": "date_of_birth", "BIRTH_DATE": "date_of_birth",
    "LATITUDE": "precise_location", "GEOM": "precise_location", "BANK_ACC_NO": "financial_account", "PWD": "password",
    "PASSWORD_HASH": "password_hash", "TOKEN": "access_token", "refreshToken": "refresh_token", "API_KEY": "api_key",
    "REMARK": "free_text", "CREATED_BY": "username", "cardNumber": "credit_card", "FACE_TEMPLATE": "biometric",
    "ID": "public", "CROP_NAME": "public", "PROVINCE_NAME": "public", "AREA_RAI": "public", "STATUS": "public",
    "IS_PASS": "public", "CREATED_DATE": "public", "": "public", "__": "public",
}


def test_names_in_plans_and_columns_agree(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r.c for r in rows.select("n", N.classify_column_name("n").alias("c")).collect()}
    assert got == NAMES
    assert {n: N.name_class(n) for n in NAMES} == NAMES


@pytest.mark.parametrize(
    "info, label, want",
    [
        (None, None, "public"), ("", "Public", "public"), (None, "Confidential", "unknown_sensitive"), ("Contact Info", "x", "unknown_sensitive"),
        ("National ID", None, "national_id"), ("id", None, "national_id"), ("Credentials", None, "password"), ("Name", None, "personal_name"),
        ("Credit Card", "Public", "credit_card"), ("Banking", None, "financial_account"), ("Date Of Birth", None, "date_of_birth"),
    ],
)
def test_labels(spark, info, label, want):
    row = spark.createDataFrame([(info, label)], "i string, l string")
    assert row.select(N.classify_label("i", "l")).first()[0] == want == N.label_class(info, label)


def test_declared_class_precedence():
    assert N.declared_class("CODE", {"code": "phone"}) == "phone"
    assert N.declared_class("EMAIL", {"Email": "unknown_sensitive"}) == "email"
    assert N.declared_class("REMARK", {"REMARK": "unknown_sensitive"}) == "unknown_sensitive"
    assert N.declared_class("EMAIL", {"EMAIL": "public"}) == "email"


def test_most_restrictive_label_wins(spark):
    rows = [("t", "A", "phone", None), ("t", "a", "credentials", None), ("u", "A", "phone", None), ("u", "A", "", "public")]
    labels = spark.createDataFrame(rows, "table_name string, column_name string, information_type string, label string")
    got = {(r.table_name, r.column_name): r["class"] for r in P.declared_labels(labels).collect()}
    assert got == {("t", "a"): "password", ("u", "a"): "phone"}


VALUES = {
    "abc.def.ghi": "jwt", "1.2.3": "public", "host.example.com": "jwt", " a@b.co ": "email", "a@b": "public",
    "1103700012345": "national_id", "1-1037-00012-34-5": "national_id", "0812345678": "phone", "+66 81 234 5678": "phone",
    "+1 (555) 123-4567": "phone", "4111 1111 1111 1111": "credit_card", "12345678901234567890": "public", "2024-01-31": "public",
    "Mr. John Smith": "personal_name", "Dr Who": "personal_name", "mr john": "public", "นายสมชาย ใจดี": "personal_name",
    "นางสาวสุดา": "personal_name", "": "public", "   ": "public", " 0812345678 ": "phone",
}


def test_value_shapes(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = {r.v: r.c for r in rows.select("v", V.classify_value("v").alias("c")).collect()}
    assert got == VALUES
    assert {v: S.value_class(v) for v in VALUES} == VALUES


def test_null_has_no_class(spark):
    assert spark.sql("select cast(null as string) v").select(V.classify_value("v")).first()[0] == "public"


def test_generalised_values(spark):
    rows = spark.createDataFrame([("13.756331",), ("13.25",), ("13.35",), ("-0.04",), ("x",), ("1e2",), (None,), ("NaN",)], "v string")
    got = [r[0] for r in rows.select(V.coarse_location("v")).collect()]
    assert got == ["13.8", "13.2", "13.4", "-0.0", "[PRECISE_LOCATION]", "100.0", None, "[PRECISE_LOCATION]"]
    rows = spark.createDataFrame([("1990-05-17",), ("17/05/2533",), ("12345",), ("n/a",), (None,)], "v string")
    assert [r[0] for r in rows.select(V.birth_year("v")).collect()] == ["1990", "2533", "[DATE_OF_BIRTH]", "[DATE_OF_BIRTH]", None]


def test_bounded_text(spark):
    def shown(v, name="", kind=""):
        return spark.createDataFrame([(v,)], "v string").select(V.bounded_text("v", name, kind)).first()[0]

    assert shown("short") == "short"
    assert shown("é" * 201) == "...long text payload...(402 bytes)..."
    assert shown('{"a":"' + "x" * 300 + '"}') == "...json string payload...(308 bytes)..."
    assert shown("plain", "my_payload") == "...long text payload...(5 bytes)..."
    assert shown('{"a":1}', "p", "NVARCHAR (MAX)") == "...json string payload...(7 bytes)..."
    assert shown("not json", "p", "text") == "not json"


def test_thai_id_check_digit(spark):
    rows = spark.createDataFrame([("1101700230708",), ("1101700230706",), ("12",), (None,)], "v string")
    assert [r[0] for r in rows.select(V.thai_id_valid("v")).collect()] == [True, False, False, None]


def test_profile_counts_every_value(spark):
    rows = spark.createDataFrame([("a@b.co", 1), ("x", 2), (None, 3)], "c string, n int")
    got = {(r.column_name, r["class"]): r.n for r in P.profile_sensitivity(rows, cast_numbers=True).collect()}
    assert got == {("c", "email"): 1, ("c", "public"): 1, ("n", "public"): 3}
    assert P.profile_sensitivity(rows, distinct_share=True).where("class = 'email'").first().distinct_values == 1


def test_embedded_values_need_a_candidate_character():
    """What the JVM filter lets stay must hold nothing the scan would find."""
    import re

    candidate = re.compile(S._CANDIDATE)
    for text in ["call 0812345678", "+12345678901", "id 1103700012345", "4111111111111111", "x@y.zz", "Mrs Ann", "นายสมชาย", "Miss.  Ann"]:
        assert S.spans(text) and candidate.search(text)
    for text in ["2024-01-31", "room 12", "Mount Rushmore", "a.b.c"]:
        assert not S.spans(text)


def test_python_and_native_scan_order(spark):
    texts = ["a@b.co 4111 1111 1111 1111", "Mr John Smith +66 81 234 5678", "1103700012345 and 1-1037-00012-34-5", "none", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [[f["class"] for f in r[0]] if r[0] is not None else None for r in rows.select(S.findings("v")).collect()]
    assert got == [["email", "credit_card"], ["personal_name", "phone"], ["national_id", "national_id"], [], None]
    spans = rows.select(S.findings("v").alias("f")).first().f
    assert [texts[0][f["start"] : f["end"]] for f in spans] == ["a@b.co", "4111 1111 1111 1111"]
    assert F is not None
