"""Keyed fakes, whole-table protection, aliases and text redaction."""

import datetime as dt
import hashlib
import hmac
import json
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tableguard.functions import fixed as X, keyed as K, scan as S, text as Tx, values as V
from tableguard.operators import aliases as A, protect as P, texts as TX

SECRET = b"secret of the tests"
CELLS = dict(
    ID_CARD="1-1037-00012-34-5", FIRST_NAME="Somchai", DOB="1990-05-17", LATITUDE="13.756331", ADDR="1 Main Road", PWD="hunter2",
    TEL="081-234-5678", EMAIL="Ann@Example.org", CREATED_BY="ann", BANK_ACC_NO="123-4-56789-0", CODE="0812345678", DAY="2024-01-31",
    REMARK="call 0812345678, Mr. John Smith, 1103700012345 or x@y.org now",
)


def table(spark):
    return spark.createDataFrame([tuple(CELLS.values()), (None,) * len(CELLS)], ", ".join(f"{c} string" for c in CELLS))


def test_digest_matches_the_standard_library(spark, key):
    for value in [" Ann ", "0812345678", "Straße", "ใจดี"]:
        want = hmac.new(SECRET, f"phone|{value.strip().casefold()}".encode(), hashlib.sha256).hexdigest()
        row = spark.createDataFrame([(value,)], "v string").select(K.keyed_digest("phone", "v", key).alias("h"))
        assert row.first().h == want
        digits = row.select(K.digest_digits("h", 18).alias("a"), K.digest_digits("h", 70).alias("b")).first()
        assert digits.a == str(int(want, 16))[-18:] and digits.b == str(int(want, 16)).zfill(78)[-70:]


def test_long_and_scoped_keys():
    long = b"x" * 100
    inner, outer = K.key_blocks(long)
    message = hashlib.sha256(outer + hashlib.sha256(inner + b"m").digest()).hexdigest()
    assert message == hmac.new(long, b"m", hashlib.sha256).hexdigest()
    assert K.key_blocks(SECRET, "a") != K.key_blocks(SECRET, "b") != K.key_blocks(SECRET)


def test_every_class(spark, key):
    masked, empty = P.protect(table(spark), None, key).collect()
    m = masked.asDict()
    assert all(v is None for v in empty)
    assert re.fullmatch(r"0-\d{4}-\d{5}-\d\d-\d", m["ID_CARD"]) and m["ID_CARD"] != CELLS["ID_CARD"]
    digits = m["ID_CARD"].replace("-", "")
    assert int(digits[12]) == (11 - sum(int(d) * (13 - i) for i, d in enumerate(digits[:12])) % 11) % 10
    assert m["FIRST_NAME"] in X.LATIN_GIVEN
    assert (m["DOB"], m["LATITUDE"], m["ADDR"], m["PWD"]) == ("1990", "13.8", "[ADDRESS]", "[REDACTED]")
    assert re.fullmatch(r"0\d\d-\d{3}-\d{4}", m["TEL"]) and re.fullmatch(r"0\d\d-\d-\d{5}-\d", m["BANK_ACC_NO"])
    assert re.fullmatch(r"user_[0-9a-f]{10}@example\.invalid", m["EMAIL"]) and re.fullmatch(r"user_[0-9a-f]{10}", m["CREATED_BY"])
    assert m["CODE"] != CELLS["CODE"] and m["CODE"].startswith("0") and m["DAY"] == CELLS["DAY"]
    assert m["REMARK"].startswith("call 0") and m["REMARK"].endswith(" now")
    assert not any(x in m["REMARK"] for x in ("0812345678", "John", "1103700012345", "x@y.org"))


def test_deterministic_per_key_and_unlinkable_across_keys(spark, key):
    other = K.table_key(K.key_table(spark, SECRET, "other scope"))
    a, b, c = (P.protect(table(spark), None, k).first().asDict() for k in (key, key, other))
    assert a == b
    keyed = ("ID_CARD", "TEL", "EMAIL", "CREATED_BY", "BANK_ACC_NO", "CODE", "REMARK")
    assert all(a[n] != c[n] for n in keyed) and a["DOB"] == c["DOB"]


def test_literal_and_table_keys_agree_and_the_table_key_stays_out_of_the_plan(spark, key, capsys):
    a = P.protect(table(spark), None, K.literal_key(SECRET)).collect()
    df = P.protect(table(spark), None, key)
    assert a == df.collect()
    df.explain("extended")
    shown = capsys.readouterr().out
    inner, outer = K.key_blocks(SECRET)
    assert inner.hex().upper() not in shown.upper() and outer.hex().upper() not in shown.upper()


def test_native_and_batch_replacements_agree(spark, key):
    """The same value gets the same fake in a column, in a text and in JSON."""
    rep = S.Replacer(b"".join(K.key_blocks(SECRET)), {})
    masked = P.protect(table(spark), None, key).first().asDict()
    for name in ("ID_CARD", "FIRST_NAME", "TEL", "EMAIL", "CREATED_BY", "BANK_ACC_NO", "CODE", "DOB", "LATITUDE", "ADDR", "PWD", "REMARK"):
        assert rep.leaf(name, CELLS[name]) == masked[name], name


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 -.ก@aZß%'", max_size=40), min_size=1, max_size=20))
def test_native_digit_fakes_agree_with_a_plain_loop(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(v,) for v in values], "phone string")
    key = K.literal_key(SECRET)
    rep = S.Replacer(b"".join(K.key_blocks(SECRET)), {})
    got = [r[0] for r in P.protect(rows, None, key).collect()]
    assert got == [rep._digits("phone", v) for v in values]


def test_long_numbers_use_all_digits(spark, key):
    value = "-".join(["1234567"] * 9)  # 63 digits
    got = P.protect(spark.createDataFrame([(value,)], "phone string"), None, key).first()[0]
    want = str(int(hmac.new(SECRET, f"phone|{value}".encode(), hashlib.sha256).hexdigest(), 16))[-62:]
    assert got.replace("-", "") == "0" + want and [i for i, c in enumerate(got) if c == "-"] == [7 + 8 * i for i in range(8)]
    assert P.protect(spark.createDataFrame([("none",)], "phone string"), None, key).first()[0] == "[REDACTED]"


def test_digits_beyond_one_digest_are_chained(spark, key):
    values = ["7" * n for n in (18, 19, 20, 21, 73, 74, 77, 78, 79, 80, 155, 156, 157, 200, 500)] + ["12-3" * 30, "4 " * 90]
    got = [r[0] for r in P.protect(spark.createDataFrame([(v,) for v in values], "phone string").coalesce(1), None, key).collect()]
    rep = S.Replacer(b"".join(K.key_blocks(SECRET)), {})
    for value, fake in zip(values, got, strict=True):
        seed = hmac.new(SECRET, f"phone|{value.strip()}".encode(), hashlib.sha256).digest()
        digits, n = "", sum(c.isdigit() for c in value)
        while len(digits) < n - 1:
            digits += str(int.from_bytes(seed, "big"))
            seed = hashlib.sha256(seed).digest()
        assert "".join(c for c in fake if c.isdigit()) == "0" + digits[-(n - 1) :]
        assert fake == rep._digits("phone", value) and [c.isdigit() for c in fake] == [c.isdigit() for c in value]


def test_numbers_have_one_text_whatever_their_size(spark):
    from tableguard.functions import values as V

    numbers = [0.0, -0.0, 1.0, -1.5, 1e-3, 9.9e-4, 1.25e-4, 1e-4, 9.99e-5, 1e-5, -1.5e-9, 1e6, 9999999.0, 1e7, 12345678.25, -25000000.5, 123456789012345.6, 1e15, 9.5e15, 1e16, 1.5e16, 1.2345678901234567e19, 1e100, -1e-300, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double").coalesce(1)
    assert [r[0] for r in rows.select(V.float_text(F.col("v"))).collect()] == [str(v) for v in numbers]


def test_json_locations_and_deep_json(spark, key):
    rep = S.Replacer(b"".join(K.key_blocks(SECRET)), {})
    out = rep.walk("x", {"latitude": ["NaN", "inf", "13.756331", " 1e1 ", "-0.04", "x"], "a": [{"password": {"b": 1}}]})
    assert out == {"latitude": [X.LOCATION_MARK, X.LOCATION_MARK, "13.8", "10.0", "-0.0", X.LOCATION_MARK], "a": [{"password": X.REDACTED}]}
    deep = "[" * 100_000 + "]" * 100_000
    assert S.container(deep) is None


def test_treatments_of_nested_values_are_counted(spark, key):
    rows = spark.sql("""select * from values
      (named_struct('phone', '0812345678', 'n', 1, 'in', named_struct('email', 'a@b.co')), array('0812345678', 'x'), map('pwd', 'x', 'k', 'plain'), 'y'),
      (null, null, null, null) as t(person, contact, extra, code)""")
    counts = {r.treatment: r.n for r in P.treatment_counts(rows, None, key).collect()}
    masked = P.protect(rows, None, key).first()
    assert masked.person.phone != "0812345678" and masked.contact[0] != "0812345678" and masked.extra["pwd"] == X.REDACTED
    assert counts == {"fake": 2, "alias": 1, "redact": 1}


def test_alias_collisions_are_counted(spark, key):
    names = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name"))
    few = K.alias_collisions(names, "name", key, length=2).first()
    assert few.n_values == few.n_shared == 3000 and K.alias_collisions(names, "name", key).first().n_shared == 0


def test_types(spark, key):
    rows = spark.createDataFrame(
        [(1, 1863.84, dt.date(1990, 5, 17), bytearray(b"x"), bytearray(b"y"), 25000000.5)],
        "id int, bank_acc_no double, dob date, photo binary, face_template binary, iban double",
    )
    m = P.protect(rows, {"photo": "unknown_sensitive"}, key)
    assert dict(m.dtypes) == dict(id="int", bank_acc_no="string", dob="string", photo="string", face_template="string", iban="string")
    r = m.first()
    assert re.fullmatch(r"0\d{3}\.\d\d", r.bank_acc_no) and r.dob == "1990" and r.photo == r.face_template == "[REDACTED]"
    assert re.fullmatch(r"0\d{7}\.\d", r.iban)
    assert m.schema["dob"].metadata == {"marker": "⟨GENERALIZED:DATE_OF_BIRTH⟩"}


def test_json_text(spark, key):
    doc = {"password": ["x"], "member_name": "Bob", "n": 1.5, "t": True, "z": None, "in": {"note": "tel 0812345678", "phone": ["0812345678"]}, "s": '{"email":"a@b.co"}'}
    rows = spark.createDataFrame([(json.dumps(doc, indent=1),), ("{not json",), ("[]",)], "props string")
    a, b, c = (r[0] for r in P.protect(rows, None, key).collect())
    m = json.loads(a)
    assert list(m) == list(doc) and " " not in a.split('"in"')[0].replace(m["member_name"], "")
    assert m["password"] == "[REDACTED]" and (m["n"], m["t"], m["z"]) == (1.5, True, None) and m["member_name"] != "Bob"
    assert "0812345678" not in a and json.loads(m["s"])["email"].endswith("@example.invalid")
    assert b == "{not json" and c == "[]"


def test_nested_types(spark, key):
    rows = spark.sql(
        """select 1 as id, named_struct('login', 'ann', 'tags', array('0812345678', 'x'), 'emb', array(1.5D), 'pwd', named_struct('a', 1)) as s,
           map('email', 'a@b.co', 'k', 'v') as m, array(named_struct('phone', 812345678L, 'v', 1)) as a, array(1, 2) as plain"""
    )
    m = P.protect(rows, None, key).first()
    assert m.s.login.startswith("user_") and m.s.tags[1] == "x" and m.s.tags[0] != "0812345678" and m.s.emb == [1.5] and m.s.pwd == "[REDACTED]"
    assert m.m["email"].endswith("@example.invalid") and m.m["k"] == "v" and m.plain == [1, 2]
    assert m.a[0].phone.startswith("0") and m.a[0].v == 1


def test_native_plan_has_no_python(spark, key):
    plan = P.protect(table(spark).drop("REMARK"), None, key, scan_public=False)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Exchange" not in plan
    with_text = P.protect(table(spark), None, key)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in with_text and "Exchange" not in with_text


def test_counts_and_markers(spark, key):
    rows = table(spark)
    counts = {r.treatment: r.n for r in P.treatment_counts(rows, None, key).collect()}
    assert counts == {"fake": 8, "alias": 3, "generalize": 3, "redact": 1}
    marks = {r.column_name: r.marker for r in P.markers(rows, None, key).collect()}
    assert marks["FIRST_NAME"] == "⟨FAKE:PERSONAL_NAME⟩" and marks["CODE"] == "⟨SCANNED⟩" and "DAY" not in marks
    assert P.with_markers(rows.select("FIRST_NAME", "DAY"), marks).columns == ["FIRST_NAME ⟨FAKE:PERSONAL_NAME⟩", "DAY"]


def test_decisions(spark, key):
    rows = spark.createDataFrame([("x",), ("a@b.co",), ("a.b.c",), ("tel 0812345678",), (None,), ('{"phone":"0812345678"}',)], "CODE string")
    got = [(r.decision["class"], r.decision.action, r.decision.rule) for r in P.explain_masking(rows, "CODE", None, key).collect()]
    assert got == [
        ("public", "keep", "public"), ("email", "alias", "snapshot-hmac"), ("jwt", "redact", "high-risk-secret"),
        ("public", "scan", "embedded-pii-scan"), ("public", "keep", "public"), ("public", "scan", "embedded-pii-scan"),
    ]
    forced = P.explain_masking(rows, "CODE", None, key, override=F.lit("phone")).collect()[0].decision
    assert (forced["class"], forced.action, forced.masked_value) == ("phone", "redact", "[REDACTED]")


def test_distinct_map_equals_direct_masking(spark, key):
    rows = spark.createDataFrame([(i, f"08{i % 7:08d}" if i % 5 else None) for i in range(200)], "id int, phone string")
    a = P.protect(rows, None, key, scan_public=False).orderBy("id").collect()
    assert P.protect_distinct(rows, "phone", {}, key).orderBy("id").collect() == a


def test_alias_registry(spark, key):
    empty = spark.createDataFrame([], "class string, digest string, alias string")
    values = spark.createDataFrame([("email", "A@b.co"), ("email", "a@B.co "), ("username", "a@b.co"), ("username", None), ("username", "ann")], "class string, value string")
    first = A.alias_registry(values, empty, key)
    rows = {(r["class"], r.digest): r.alias for r in first.collect()}
    assert len(rows) == 3 and all(re.fullmatch(r"user_[0-9a-hjkmnp-tv-z]{10}(@example\.invalid)?", a) for a in rows.values())
    more = spark.createDataFrame([("username", "ann"), ("username", "bob")], "class string, value string")
    assert A.alias_registry(more, first, key).count() == 1
    names = spark.createDataFrame([(1, "ann"), (2, None)], "id int, who string")
    out = {r.id: r.who for r in A.apply_aliases(names, "who", "username", first, key).collect()}
    assert out[1].startswith("user_") and out[2] is None


def test_alias_collisions_get_longer_aliases(spark, key, monkeypatch):
    """Digests that share a prefix are told apart; registered aliases stay."""
    codes = {"a": "0" * 10 + "11" + "0" * 40, "b": "0" * 10 + "12" + "0" * 40, "c": "0" * 9 + "1" + "0" * 42, "old": "0" * 12 + "2" + "0" * 39}
    monkeypatch.setattr(A, "alias_digest", lambda v, k: F.col("value") if v == "value" else v)
    expr = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    monkeypatch.setattr(A, "encode_digest", lambda d: expr[F.col(d)])
    old = spark.createDataFrame([("username", "old", "user_" + "0" * 10)], "class string, digest string, alias string")
    new = spark.createDataFrame([("username", x) for x in "abc"], "class string, value string")
    got = {r.digest: r.alias for r in A.alias_registry(new, old, key).collect()}
    assert got == {"a": "user_" + codes["a"][:12], "b": "user_" + codes["b"][:12], "c": "user_" + codes["c"][:10]}


def test_encoding_matches_plain_arithmetic(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    got = spark.createDataFrame([(digest,)], "d string").select(A.encode_digest("d")).first()[0]
    n, out = int(digest, 16), ""
    while n:
        n, r = divmod(n, 32)
        out = X.ALIAS_ALPHABET[r] + out
    assert got == out.rjust(52, "0")


# Text ---------------------------------------------------------------------------------------------


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "v string").select(*columns).first()


def test_secrets(spark):
    text, n = one(spark, "a password='x' and 'Bearer abc.def' API-KEY = \"q\" token='[REDACTED]'", *Tx.redact_secrets("v"))
    assert text == "a password='[REDACTED]' and '[REDACTED]' API-KEY='[REDACTED]' token='[REDACTED]'" and n == 3
    again, m = one(spark, text, *Tx.redact_secrets("v"))
    assert (again, m) == (text, 0)
    pem = "x -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- y"
    assert tuple(one(spark, pem, *Tx.redact_secrets("v"))) == ("x [REDACTED] y", 1)


def test_personal_data_marks(spark):
    text = "Mr. John Smith 0812345678, นายสมชาย ใจดี 1103700012345 a@b.co 4111-1111-1111-1111 [REDACTED:PHONE]"
    got = one(spark, text, *Tx.redact_pii("v"))
    assert got[0] == "[REDACTED:PERSONAL_NAME] [REDACTED:PHONE], [REDACTED:PERSONAL_NAME] [REDACTED:NATIONAL_ID] [REDACTED:EMAIL] [REDACTED:CREDIT_CARD] [REDACTED:PHONE]"
    assert got[1] == 6


def test_marks_inside_literals_only(spark):
    got = one(spark, "'a@b.co' x@y.zz N'it''s 0812345678'", *Tx.redact_pii_in_literals("v"))
    assert tuple(got) == ("'[REDACTED:EMAIL]' x@y.zz N'it''s [REDACTED:PHONE]'", 2)
    assert tuple(one(spark, "no literal x@y.zz", *Tx.redact_pii_in_literals("v"))) == ("no literal x@y.zz", 0)


def test_messages(spark):
    assert one(spark, "  failed\n at /var/lib/x.sql pwd='a' CREATE TABLE t (a int)", Tx.safe_message("v"))[0] == "failed at [REDACTED] pwd='[REDACTED]' [REDACTED]"
    assert one(spark, " \n ", Tx.safe_message("v"))[0] == "No sanitized reason is available."
    long = one(spark, "x" * 300, Tx.safe_message("v"))[0]
    assert len(long) == 200 and long.endswith("…")
    d = one(spark, "[SQL Server]bad login (18456)  PWD=abc;uid=u1;x", Tx.driver_error("v"))[0]
    assert d.message == "[SQL Server]bad login (18456) PWD=<redacted>;uid=<redacted>;x" and d.native_errors == [18456]
    lines = one(spark, "L1 found 'abc'\nkey: zz", Tx.tool_diagnostic("v"))[0]
    assert lines[0] == "L1 found '<redacted 5 chars>' key=[REDACTED]" and len(lines) == 2
    assert one(spark, "", Tx.tool_diagnostic("v"))[0] == []


def test_gate_and_findings(spark):
    rows = spark.createDataFrame([(1, "password='bearer\nabc def'"), (2, "pwd='x'"), (3, None)], "id int, body string")
    kept, skipped = TX.residual_gate(rows, "body")
    assert {r.id for r in kept.collect()} == {2, 3} and skipped.first().error_code == "RAW_SECRET_DETECTED"
    files = spark.createDataFrame([("a.sql", "pwd='x' token='y'"), ("b.txt", "pwd='x'"), ("c.md", "fine")], "path string, content string")
    assert [tuple(r) for r in TX.secret_findings(files).collect()] == [("a.sql", 2)]
    found = TX.pii_findings(rows.withColumn("body", F.lit("a@b.co 0812345678")), "body", "id").where("id = 1").collect()
    assert [(r["class"], r.start, r.end) for r in found] == [("email", 0, 6), ("phone", 7, 17)]


def test_first_claimed_span_wins(spark, key):
    """A card number keeps its digits together although a phone pattern would match inside it."""
    text = "4111 0812 3456 7890 and 0812345678@x.org"
    assert [(s, e, n) for s, e, n, _ in S.spans(text)] == [(0, 19, 1), (24, 40, 0)]
    out = one(spark, text, S.scan_text("v", key))[0]
    assert re.fullmatch(r"0\d{3} \d{4} \d{4} \d{4} and user_[0-9a-f]{10}@example\.invalid", out)
    assert V is not None
