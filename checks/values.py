"""Checks of classification and value protection."""

import uuid

from pyspark.sql import functions as F

from checks.base import (
    CONTACTS, NAMES, THAI_IDS, Tables, check, ctes, digest_sql, digits_sql, duck, fake_digits_sql, hmac_sql, overlay_sql, pool_sql,
)
from checks.texts import PLANTED
from tableguard.functions import fixed as X, keyed as K, names as N, scan as S, values as V
from tableguard.operators import aliases as A, profiles as PR, protect as P
from tableguard.session import shared_folder


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(*words: str) -> str:
    return f"list_has_any(tk, {_in(list(words))})"


def _all(*words: str) -> str:
    return f"list_has_all(tk, {_in(list(words))})"


_TOKENS = (
    "list_filter(string_split_regex(lower(regexp_replace(column_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
)
_NAME_CASE = f"""CASE
 WHEN {_any('jwt')} THEN 'jwt'
 WHEN {_any('cookie', 'cookies')} THEN 'cookie'
 WHEN {_any('biometric', 'fingerprint')} OR {_all('face', 'template')} THEN 'biometric'
 WHEN {_all('private', 'key')} OR {_any('privatekey')} THEN 'private_key'
 WHEN {_all('api', 'key')} OR {_any('apikey')} THEN 'api_key'
 WHEN {_all('client', 'secret')} THEN 'client_secret'
 WHEN {_all('secret', 'key')} THEN 'secret_key'
 WHEN {_any('token', 'tokens')} THEN CASE WHEN {_any('refresh')} THEN 'refresh_token' WHEN {_any('session')} THEN 'session_token' ELSE 'access_token' END
 WHEN {_any('password', 'passwd', 'pwd', 'passcode', 'passphrase')} OR ({_any('pass')} AND NOT list_has_any(tk, {_in(X.PASS_NEUTRAL)}))
   THEN CASE WHEN {_any('hash', 'hashed', 'digest')} THEN 'password_hash' ELSE 'password' END
 WHEN {_any('secret', 'salt', 'otp', 'cvv', 'cvc')} OR {_all('pin', 'code')} THEN 'secret'
 WHEN {_any('citizen', 'citizenid', 'idcard', 'pid', 'passport', 'ssn', 'taxid')} OR {_all('id', 'card')} OR {_all('national', 'id')}
   OR {_all('personal', 'id')} OR {_all('tax', 'id')} OR glued IN ('nationalid', 'personalid') THEN 'national_id'
 WHEN {_all('credit', 'card')} OR {_any('cardno')} OR ({_any('card')} AND {_any('no', 'number', 'num')}) THEN 'credit_card'
 WHEN {_any('iban', 'promptpay', 'accno', 'accountno')} OR ({_any('bank')} AND {_any('acc', 'account', 'no', 'number')})
   OR ({_any('acc', 'account')} AND {_any('no', 'number', 'num')}) THEN 'financial_account'
 WHEN {_any('email', 'mail')} OR {_all('e', 'mail')} THEN 'email'
 WHEN {_any('phone', 'tel', 'telephone', 'mobile', 'fax', 'msisdn', 'cellphone')} THEN 'phone'
 WHEN {_any('username', 'login', 'loginid')} OR glued = 'username' OR ({_any('by')} AND list_has_any(tk, {_in(X.ACTOR_VERBS)})) THEN 'username'
 WHEN list_has_any(tk, {_in(X.NAME_COMPOUNDS)}) OR ({_any('name')} AND list_has_any(tk, {_in(X.NAME_QUALIFIERS + X.PERSON_NOUNS)}))
   OR list_contains({_in(X.NAME_COMPOUNDS)}, glued) THEN 'personal_name'
 WHEN {_any('address', 'addr', 'houseno', 'street', 'soi')} OR {_all('house', 'no')} OR {_all('house', 'number')} THEN 'address'
 WHEN {_any('dob', 'birth', 'birthday', 'birthdate', 'born')} THEN 'date_of_birth'
 WHEN list_has_any(tk, {_in(X.LOCATION_WORDS)}) THEN 'precise_location'
 WHEN list_has_any(tk, {_in(X.FREE_TEXT_WORDS)}) THEN 'free_text'
 ELSE 'public' END"""


def _treat(cls: str) -> str:
    rows = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in X.TREATMENT.items())
    return f"CASE {cls} {rows} ELSE 'redact' END"


_NAMED = f"""{ctes(names=NAMES)},
counted AS (SELECT column_name, count(*) AS n FROM names GROUP BY column_name),
split AS (SELECT *, {_TOKENS} AS tk FROM counted),
glue AS (SELECT *, array_to_string(tk, '') AS glued FROM split)"""


@check("name_tokens", f"{_NAMED} SELECT column_name, array_to_string(tk, ' ') AS words, n FROM glue")
def name_tokens(t: Tables):
    names = t.sql(NAMES).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("column_name", F.array_join(N.name_tokens("column_name"), " ").alias("words"), "n")


@check("column_name_classes", f"{_NAMED} SELECT column_name, {_NAME_CASE} AS class, n FROM glue")
def column_name_classes(t: Tables):
    names = t.sql(NAMES).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("column_name", N.classify_column_name("column_name").alias("class"), "n")


# Declared labels of generated columns: one label row per order.
LABELS = """
select 'T' || cast(o_custkey % 40 as string) as table_name,
       split_part('FIRST_NAME,ID_CARD,TEL,CODE,REMARK,AREA,Email,NOTE_NO', ',', cast(1 + o_orderkey % 8 as int)) as column_name,
       split_part('Contact Info Email,Credit Card,Networking,Name,National ID,,Date Of Birth,Financial,Credentials,Home Address,GPS location,phone,identification', ',', cast(1 + o_orderkey % 13 as int)) as information_type,
       split_part('Confidential, public ,PUBLIC,,Highly Confidential', ',', cast(1 + o_custkey % 5 as int)) as label
from {orders}"""
_LABEL_CASE = """CASE
 WHEN info = '' AND tag IN ('', 'public') THEN 'public'
 WHEN contains(info, 'credential') OR contains(info, 'password') THEN 'password'
 WHEN contains(info, 'name') THEN 'personal_name'
 WHEN contains(info, 'national') OR contains(info, 'ssn') OR info IN ('id', 'identification') THEN 'national_id'
 WHEN contains(info, 'credit') THEN 'credit_card'
 WHEN contains(info, 'financial') OR contains(info, 'bank') THEN 'financial_account'
 WHEN contains(info, 'birth') THEN 'date_of_birth'
 WHEN contains(info, 'email') THEN 'email'
 WHEN contains(info, 'phone') THEN 'phone'
 WHEN contains(info, 'address') THEN 'address'
 WHEN contains(info, 'location') THEN 'precise_location'
 ELSE 'unknown_sensitive' END"""
_LABELED = f"""{ctes(labels_in=LABELS)},
norm AS (SELECT *, lower(trim(information_type)) AS info, lower(trim(label)) AS tag FROM labels_in),
classed AS (SELECT table_name, lower(column_name) AS column_name, information_type, label, {_LABEL_CASE} AS class FROM norm)"""
_RANK = "list_position(['public','scan','generalize','alias','fake','redact'], treat)"
_DECLARED = f"""{_LABELED},
ranked AS (SELECT table_name, column_name, class, {_treat('class')} AS treat FROM classed WHERE class <> 'public'),
top AS (SELECT table_name, column_name, max(lpad(CAST({_RANK} AS VARCHAR), 2, '0') || class) AS best FROM ranked GROUP BY ALL),
declared AS (SELECT table_name, column_name, substr(best, 3) AS class FROM top)"""


@check("label_classes", f"{_LABELED} SELECT information_type, label, class, count(*) AS n FROM classed GROUP BY ALL")
def label_classes(t: Tables):
    rows = t.sql(LABELS).withColumn("class", N.classify_label("information_type", "label"))
    return rows.groupBy("information_type", "label", "class").agg(F.count(F.lit(1)).alias("n"))


@check("declared_labels", f"{_DECLARED} SELECT * FROM declared")
def declared_labels(t: Tables):
    return P.declared_labels(t.sql(LABELS))


@check(
    "column_classes",
    f"""{_DECLARED},
cols AS (SELECT DISTINCT table_name, column_name FROM labels_in),
split AS (SELECT *, {_TOKENS} AS tk FROM cols),
glue AS (SELECT *, array_to_string(tk, '') AS glued FROM split),
named AS (SELECT *, {_NAME_CASE} AS by_name FROM glue),
settled AS (SELECT n.table_name, n.column_name, d.class AS declared,
  CASE WHEN d.class IS NULL OR (d.class = 'unknown_sensitive' AND by_name NOT IN ('public', 'free_text')) THEN by_name ELSE d.class END AS class
  FROM named n LEFT JOIN declared d ON d.table_name = n.table_name AND d.column_name = lower(n.column_name))
SELECT *, {_treat('class')} AS treatment FROM settled""",
)
def column_classes(t: Tables):
    labels = t.sql(LABELS)
    return P.column_classes(labels.select("table_name", "column_name").distinct(), labels)


_SHAPE = """CASE
 WHEN v IS NULL OR v = '' THEN 'public'
 WHEN regexp_full_match(v, '[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+') AND NOT regexp_full_match(v, '[0-9.]+') THEN 'jwt'
 WHEN regexp_full_match(v, '[^@\\s"''{}\\[\\]<>,;:]+@[^@\\s"''{}\\[\\]<>,;:]+\\.[A-Za-z]{2,}') THEN 'email'
 WHEN regexp_full_match(v, '[0-9](?:[ -]?[0-9]){12}') THEN 'national_id'
 WHEN regexp_full_match(v, '(?:\\+66[ -]?|0)[0-9]{1,2}[ -]?[0-9]{3}[ -]?[0-9]{3,4}|\\+[1-9][0-9 ()-]{7,20}[0-9]') THEN 'phone'
 WHEN regexp_full_match(v, '(?:[0-9][ -]*?){14,19}') THEN 'credit_card'
 WHEN regexp_full_match(v, '(Mr|Mrs|Ms|Miss|Dr)\\.?\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?') THEN 'personal_name'
 ELSE 'public' END"""


@check("value_classes", f"{ctes(contacts=CONTACTS)} SELECT c_custkey, contact, {_SHAPE} AS class FROM (SELECT *, trim(contact) AS v FROM contacts)")
def value_classes(t: Tables):
    return t.sql(CONTACTS).select("c_custkey", "contact", V.classify_value("contact").alias("class"))


_PROFILED = ["c_name", "c_mktsegment", "contact"]


@check(
    "sensitivity_profile",
    f"""{ctes(contacts=CONTACTS)}, cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, trim({c}) AS v FROM contacts WHERE {c} IS NOT NULL" for c in _PROFILED)})
SELECT column_name, {_SHAPE} AS class, count(*) AS n FROM cells GROUP BY ALL""",
)
def sensitivity_profile(t: Tables):
    return P.profile_sensitivity(t.sql(CONTACTS).select(*_PROFILED))


_DOC_COLUMNS = ["text", "lang", "source"]


@check(
    "document_profile",
    f"""WITH cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, trim({c}, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM documents WHERE {c} IS NOT NULL" for c in _DOC_COLUMNS)})
SELECT column_name, {_SHAPE} AS class, count(*) AS n FROM cells GROUP BY ALL""",
)
def document_profile(t: Tables):
    return P.profile_sensitivity(t.documents.select(*_DOC_COLUMNS))


_CHECKSUM = "(11 - (" + " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INTEGER) * {13 - i}" for i in range(12)) + ") % 11) % 10"


@check(
    "thai_id_validity",
    f"""{ctes(ids=THAI_IDS)}, digits AS (SELECT thai_id, replace(thai_id, '-', '') AS d FROM ids)
SELECT substr(thai_id, 1, 1) AS first_digit, ({_CHECKSUM}) = CAST(substr(d, 13, 1) AS INTEGER) AS valid, count(*) AS n FROM digits GROUP BY ALL""",
)
def thai_id_validity(t: Tables):
    rows = t.sql(THAI_IDS).select(F.substring("thai_id", 1, 1).alias("first_digit"), V.thai_id_valid("thai_id").alias("valid"))
    return rows.groupBy("first_digit", "valid").agg(F.count(F.lit(1)).alias("n"))


@check("treatments_of_names", f"{_NAMED}, c AS (SELECT {_NAME_CASE} AS class, n FROM glue) SELECT class, {_treat('class')} AS treatment, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")
def treatments_of_names(t: Tables):
    rows = t.sql(NAMES).select(N.classify_column_name("column_name").alias("class"))
    counted = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("class", N.treatment("class").alias("treatment"), "n")


# Keyed fakes ----------------------------------------------------------------------------------


@check("keyed_digests", f"SELECT c_custkey, {digest_sql('username', 'c_name')} AS digest FROM customer")
def keyed_digests(t: Tables):
    return t.customer.select("c_custkey", K.keyed_digest("username", "c_name", t.key).alias("digest"))


@check(
    "digest_digits",
    f"WITH h AS (SELECT c_custkey, {digest_sql('phone', 'c_name')} AS h FROM customer) SELECT c_custkey, {digits_sql('h', 9)} AS nine, {digits_sql('h', 12)} AS twelve, {digits_sql('h', 18)} AS eighteen FROM h",
)
def digest_digits(t: Tables):
    h = t.customer.select("c_custkey", K.keyed_digest("phone", "c_name", t.key).alias("h"))
    return h.select("c_custkey", *[K.digest_digits("h", k).alias(n) for n, k in (("nine", 9), ("twelve", 12), ("eighteen", 18))])


@check(
    "fake_account_digits",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS v, '0' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS acc FROM lineitem),
h AS (SELECT *, {digest_sql('financial_account', 'v')} AS h1, {digest_sql('phone', 'acc')} AS h2 FROM v),
f AS (SELECT l_linenumber, {fake_digits_sql('v', 'h1')} AS a, {fake_digits_sql('acc', 'h2')} AS p FROM h)
SELECT l_linenumber, a AS account, p AS phone, count(*) AS n FROM f GROUP BY ALL""",
)
def fake_account_digits(t: Tables):
    acc = F.concat(F.lit("0"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.select("l_linenumber", F.col("l_extendedprice").alias("account"), acc.alias("phone"))
    masked = P.protect(rows, {"account": X.FINANCIAL_ACCOUNT}, t.key)
    return masked.groupBy("l_linenumber", "account", "phone").agg(F.count(F.lit(1)).alias("n"))


def _fake_thai_sql(v: str, h: str, twelve: str | None = None) -> str:
    twelve = twelve or f"('0' || {digits_sql(h, 11)})"
    total = " + ".join(f"CAST(substr({twelve}, {i + 1}, 1) AS INTEGER) * {13 - i}" for i in range(12))
    return overlay_sql(v, f"({twelve} || CAST((11 - ({total}) % 11) % 10 AS VARCHAR))")


@check(
    "fake_thai_ids",
    f"""{ctes(ids=THAI_IDS)}, d AS (SELECT DISTINCT thai_id FROM ids), h AS (SELECT thai_id, {digest_sql('national_id', 'thai_id')} AS h FROM d),
w AS (SELECT thai_id, '0' || {digits_sql('h', 11)} AS twelve FROM h)
SELECT thai_id, {_fake_thai_sql('thai_id', 'h', 'twelve')} AS fake FROM w""",
)
def fake_thai_ids(t: Tables):
    ids = t.sql(THAI_IDS).select("thai_id").distinct()
    # Public binary passes unchanged, so it carries the original next to the fake.
    pairs = ids.select(F.encode("thai_id", "UTF-8").alias("raw"), F.col("thai_id").alias("ID_CARD"))
    masked = P.protect(pairs, None, t.key)
    return masked.select(F.decode("raw", "UTF-8").alias("thai_id"), F.col("ID_CARD").alias("fake"))


def _name_digest(salt: str, raw: str) -> str:
    return hmac_sql(f"'personal_name|' || lower(trim('{salt}|' || {raw}))")


@check(
    "fake_names",
    f"""WITH h AS (SELECT c_custkey, {_name_digest('given', 'c_name')} AS g, {_name_digest('family', 'c_name')} AS f FROM customer)
SELECT c_custkey, {pool_sql(X.LATIN_GIVEN, 'g')} AS first_name, {pool_sql(X.LATIN_FAMILY, 'f')} AS surname,
 {pool_sql(X.LATIN_GIVEN, 'g')} || ' ' || {pool_sql(X.LATIN_FAMILY, 'f')} AS full_name FROM h""",
)
def fake_names(t: Tables):
    name = F.col("c_name")
    return P.protect(
        t.customer.select("c_custkey", name.alias("first_name"), name.alias("surname"), name.alias("full_name")), None, t.key
    )


@check(
    "fake_titled_names",
    f"""{ctes(contacts=CONTACTS)}, m AS (SELECT contact, trim(contact) AS w FROM contacts),
t AS (SELECT *, regexp_extract(w, '^(Mr|Dr)', 1) AS title, regexp_matches(w, '^(?:Mr|Dr)\\.? [A-Z][a-z]+ [A-Z]') AS two FROM m), s AS (SELECT *, CASE WHEN title <> '' THEN w ELSE contact END AS said FROM t),
p AS (SELECT *, {_name_digest('given', 'said')} AS g, {_name_digest('family', 'said')} AS f FROM s)
SELECT contact, CASE WHEN title <> '' THEN title || ' ' ELSE '' END || {pool_sql(X.LATIN_GIVEN, 'g')} || CASE WHEN two OR title = '' THEN ' ' || {pool_sql(X.LATIN_FAMILY, 'f')} ELSE '' END AS fake, count(*) AS n FROM p GROUP BY ALL""",
)
def fake_titled_names(t: Tables):
    # Public binary passes unchanged, so it carries the original next to the fake.
    pairs = t.sql(CONTACTS).select(F.encode("contact", "UTF-8").alias("raw"), F.col("contact").alias("full_name"))
    titled = P.protect(pairs, None, t.key)
    rows = titled.select(F.decode("raw", "UTF-8").alias("contact"), F.col("full_name").alias("fake"))
    return rows.groupBy("contact", "fake").agg(F.count(F.lit(1)).alias("n"))


@check(
    "aliases",
    f"""SELECT c_custkey, 'user_' || substr({digest_sql('username', 'c_name')}, 1, 10) AS username,
 'user_' || substr({digest_sql('email', "c_name || '@x.org'")}, 1, 10) || '@example.invalid' AS email FROM customer""",
)
def aliases(t: Tables):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("username"), F.concat("c_name", F.lit("@x.org")).alias("email"))
    return P.protect(rows, None, t.key)


_BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


@check(
    "alias_registry",
    f"""WITH v AS (SELECT DISTINCT o_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders),
h AS (SELECT name, {hmac_sql('lower(name)')} AS digest FROM v),
b AS (SELECT name, digest, CAST(('0x' || substr(digest, 1, 12)) AS BIGINT) >> 2 AS top FROM h)
SELECT 'username' AS class, digest, 'user_' || {' || '.join(f"substr('{_BASE32}', 1 + CAST((top >> {5 * (9 - i)}) & 31 AS INTEGER), 1)" for i in range(10))} AS alias FROM b""",
)
def alias_registry(t: Tables):
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    values = t.orders.select(F.lit("username").alias("class"), name.alias("value"))
    empty = t.spark.createDataFrame([], "class string, digest string, alias string")
    return A.alias_registry(values, empty, t.key)


@check(
    "birth_years",
    """WITH v AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS from_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'born ' || CAST(1800 + o_custkey % 900 AS VARCHAR) || ' or so' WHEN 1 THEN CAST(o_totalprice AS VARCHAR) WHEN 2 THEN '12/05/25' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') ELSE NULL END AS t FROM orders),
x AS (SELECT from_date, t, regexp_extract(t, '(?:^|[^0-9])(1[89][0-9][0-9]|2[0-6][0-9][0-9])(?:$|[^0-9])', 1) AS y FROM v)
SELECT from_date, CASE WHEN t IS NULL THEN NULL WHEN y = '' THEN '[DATE_OF_BIRTH]' ELSE y END AS from_text, count(*) AS n FROM x GROUP BY ALL""",
)
def birth_years(t: Tables):
    text = t.sql(
        """select o_orderdate as dob, case o_orderkey % 4 when 0 then 'born ' || cast(1800 + o_custkey % 900 as string) || ' or so'
           when 1 then cast(o_totalprice as string) when 2 then '12/05/25' || lpad(cast(o_custkey % 100 as string), 2, '0') end as birth_text from {orders}"""
    )
    masked = P.protect(text, None, t.key).select(F.col("dob").alias("from_date"), F.col("birth_text").alias("from_text"))
    return masked.groupBy("from_date", "from_text").agg(F.count(F.lit(1)).alias("n"))


@check(
    "coarse_locations",
    """WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'north' WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.25' WHEN 2 THEN '-0.0' || CAST(c_custkey % 10 AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS v FROM customer)
SELECT c_custkey, v, CASE WHEN TRY_CAST(v AS DECIMAL(38, 8)) IS NULL THEN '[PRECISE_LOCATION]'
 ELSE CASE WHEN TRY_CAST(v AS DECIMAL(38, 8)) < 0 AND round_even(TRY_CAST(v AS DECIMAL(38, 8)), 1) = 0 THEN '-' ELSE '' END || CAST(CAST(round_even(TRY_CAST(v AS DECIMAL(38, 8)), 1) AS DECIMAL(30, 1)) AS VARCHAR) END AS latitude FROM v""",
)
def coarse_locations(t: Tables):
    v = t.sql(
        """select c_custkey, case c_custkey % 5 when 0 then 'north' when 1 then cast(c_custkey as string) || '.25'
           when 2 then '-0.0' || cast(c_custkey % 10 as string) else cast(c_acctbal as string) end as v from {customer}"""
    )
    return v.select("c_custkey", "v", V.coarse_location("v").alias("latitude"))


@check(
    "generalised_and_redacted",
    """SELECT s_suppkey, '[ADDRESS]' AS address, CASE WHEN s_acctbal > 0 THEN '[REDACTED]' END AS pwd, CASE WHEN s_nationkey > 5 THEN '[REDACTED]' END AS photo FROM supplier""",
)
def generalised_and_redacted(t: Tables):
    rows = t.supplier.select(
        "s_suppkey",
        F.col("s_name").alias("address"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("pwd"),
        F.when(F.col("s_nationkey") > 5, F.encode("s_name", "UTF-8")).alias("photo"),
    )
    return P.protect(rows, {"photo": "unknown_sensitive"}, t.key)


_MASKED = f"""WITH c AS (SELECT c.*, n_name, CAST(c_acctbal AS VARCHAR) AS bal FROM customer c JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT *, {_name_digest('given', 'c_name')} AS g, {_name_digest('family', 'c_name')} AS f, {digest_sql('financial_account', 'bal')} AS a FROM c)
SELECT c_custkey, {pool_sql(X.LATIN_GIVEN, 'g')} || ' ' || {pool_sql(X.LATIN_FAMILY, 'f')} AS c_name, {fake_digits_sql('bal', 'a')} AS c_acctbal, c_mktsegment, n_name FROM h"""


@check("masked_customers", _MASKED)
def masked_customers(t: Tables):
    masked = P.protect(t.customer, {"c_name": X.PERSONAL_NAME, "c_acctbal": X.FINANCIAL_ACCOUNT}, t.key)
    joined = masked.join(t.nation, masked["c_nationkey"] == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name")


# The value-shape path of a public column, per customer.
_CONTACT_SQL = f"""{ctes(contacts=CONTACTS)},
k AS (SELECT c_custkey, contact, {_SHAPE} AS class FROM (SELECT *, trim(contact) AS v FROM contacts)),
h AS (SELECT *, {hmac_sql("class || '|' || lower(trim(contact))")} AS h, {_name_digest('given', 'trim(contact)')} AS g, {_name_digest('family', 'trim(contact)')} AS f FROM k),
m AS (SELECT c_custkey, contact, class, CASE class
  WHEN 'public' THEN contact WHEN 'jwt' THEN '[REDACTED]'
  WHEN 'email' THEN 'user_' || substr(h, 1, 10) || '@example.invalid'
  WHEN 'national_id' THEN CASE WHEN length(regexp_replace(contact, '[^0-9]', '', 'g')) = 13 THEN {_fake_thai_sql('contact', 'h')} ELSE {fake_digits_sql('contact', 'h')} END
  WHEN 'personal_name' THEN regexp_extract(contact, '(Mr|Dr)', 1) || ' ' || {pool_sql(X.LATIN_GIVEN, 'g')} || CASE WHEN contact LIKE '% Smith' THEN ' ' || {pool_sql(X.LATIN_FAMILY, 'f')} ELSE '' END
  ELSE {fake_digits_sql('contact', 'h')} END AS masked FROM h)"""


@check("protected_by_shape", f"{_CONTACT_SQL} SELECT c_custkey, masked AS contact FROM m")
def protected_by_shape(t: Tables):
    return P.protect(t.sql(CONTACTS).select("c_custkey", "contact"), None, t.key)


_ACTION = "CASE WHEN class = 'public' THEN 'keep' WHEN class = 'jwt' OR masked = '[REDACTED]' THEN 'redact' WHEN class = 'email' THEN 'alias' ELSE 'fake' END"


@check(
    "masking_decisions",
    f"""{_CONTACT_SQL}, a AS (SELECT *, {_ACTION} AS action FROM m) SELECT c_custkey, class, action,
 CASE action WHEN 'keep' THEN 'public' WHEN 'redact' THEN 'high-risk-secret' WHEN 'alias' THEN 'snapshot-hmac' ELSE 'snapshot-hmac-fake' END AS rule, masked AS masked_value FROM a""",
)
def masking_decisions(t: Tables):
    rows = P.explain_masking(t.sql(CONTACTS).select("c_custkey", "contact"), "contact", None, t.key)
    return rows.select("c_custkey", "decision.*")


@check(
    "treatment_counts",
    f"{_CONTACT_SQL}, a AS (SELECT {_ACTION} AS treatment FROM m UNION ALL SELECT 'fake' FROM customer UNION ALL SELECT 'generalize' FROM customer) SELECT treatment, count(*) AS n FROM a WHERE treatment <> 'keep' GROUP BY ALL",
)
def treatment_counts(t: Tables):
    rows = t.sql(CONTACTS).select("c_custkey", "contact", F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("latitude"))
    return P.treatment_counts(rows, None, t.key)


@check(
    "column_markers",
    f"""{_CONTACT_SQL} SELECT 'customer_name' AS column_name, '⟨FAKE:PERSONAL_NAME⟩' AS marker UNION ALL SELECT 'pin_code', '⟨REDACTED:SECRET⟩'
UNION ALL SELECT 'remark', '⟨SCANNED:FREE_TEXT⟩' UNION ALL SELECT * FROM (SELECT 'contact', CASE WHEN bool_or(contact <> masked) THEN '⟨SCANNED⟩' END AS marker FROM m) WHERE marker IS NOT NULL""",
)
def column_markers(t: Tables):
    c = t.sql(CONTACTS)
    rows = c.select("contact", "c_mktsegment", F.col("c_name").alias("customer_name"), F.col("c_custkey").alias("pin_code"), F.col("c_name").alias("remark"))
    return P.markers(rows, None, t.key)


@check(
    "distinct_map_masking",
    f"""WITH v AS (SELECT l_suppkey, lpad(CAST(l_suppkey AS VARCHAR), 10, '2') AS acc FROM lineitem), h AS (SELECT *, {digest_sql('financial_account', 'acc')} AS h FROM v)
SELECT {fake_digits_sql('acc', 'h')} AS bank_acc_no, count(*) AS n FROM h GROUP BY ALL""",
)
def distinct_map_masking(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.lpad(F.col("l_suppkey").cast("string"), 10, "2").alias("bank_acc_no"))
    return P.protect_distinct(rows, "bank_acc_no", {}, t.key).groupBy("bank_acc_no").agg(F.count(F.lit(1)).alias("n"))


def _bounded(c: str, payload: bool, large: bool) -> str:
    size = f"CAST(octet_length(encode({c})) AS VARCHAR)"
    look = "true" if payload or large else f"length({c}) > 200"
    keep = "true" if payload else f"length({c}) > 200"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN ({look}) AND json_valid({c}) THEN '...json string payload...(' || {size} || ' bytes)...' "
        f"WHEN ({look}) AND ({keep}) THEN '...long text payload...(' || {size} || ' bytes)...' ELSE {c} END"
    )


@check(
    "bounded_texts",
    f"""WITH a AS (SELECT 'doc' AS kind, doc_id AS id, {_bounded('text', False, False)} AS shown FROM documents UNION ALL
SELECT 'event', event_id, {_bounded('props', False, True)} FROM events UNION ALL SELECT 'page', page_id, {_bounded('url', True, False)} FROM pages) SELECT * FROM a""",
)
def bounded_texts(t: Tables):
    docs = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), V.bounded_text("text", "text").alias("shown"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), V.bounded_text("props", "props", "json").alias("shown"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), V.bounded_text("url", "url_payload").alias("shown"))
    return docs.unionByName(events).unionByName(pages)


JSON_EVENTS = """
select event_id, '{{"member_name":"u' || cast(user_id as string) || '","kind":"' || event_type || '","n":' || cast(user_id as string)
  || ',"contact":{{"phone":"08' || lpad(cast(user_id as string), 8, '5') || '","tags":["a","08' || lpad(cast(user_id as string), 8, '6') || '"]}},"api_key":["x"],"note":null}}' as props
from {events}"""


@check(
    "json_protection",
    f"""WITH e AS (SELECT event_id, event_type, user_id, 'u' || CAST(user_id AS VARCHAR) AS u, '08' || lpad(CAST(user_id AS VARCHAR), 8, '5') AS p5, '08' || lpad(CAST(user_id AS VARCHAR), 8, '6') AS p6 FROM events),
h AS (SELECT *, {_name_digest('given', 'u')} AS g, {_name_digest('family', 'u')} AS f, {digest_sql('phone', 'p5')} AS h5, {digest_sql('phone', 'p6')} AS h6 FROM e)
SELECT event_id, '{{"member_name":"' || {pool_sql(X.LATIN_GIVEN, 'g')} || ' ' || {pool_sql(X.LATIN_FAMILY, 'f')} || '","kind":"' || event_type || '","n":' || CAST(user_id AS VARCHAR)
 || ',"contact":{{"phone":"' || {fake_digits_sql('p5', 'h5')} || '","tags":["a","' || {fake_digits_sql('p6', 'h6')} || '"]}},"api_key":"[REDACTED]","note":null}}' AS props FROM h""",
)
def json_protection(t: Tables):
    return P.protect(t.sql(JSON_EVENTS), None, t.key)


@check(
    "nested_protection",
    f"""WITH e AS (SELECT event_id, value, 'u' || CAST(user_id AS VARCHAR) AS u, '08' || lpad(CAST(user_id AS VARCHAR), 8, '5') AS p FROM events),
h AS (SELECT *, 'user_' || substr({digest_sql('username', 'u')}, 1, 10) AS a, {digest_sql('phone', 'p')} AS hp FROM e)
SELECT event_id, a AS login, {fake_digits_sql('p', 'hp')} AS first_tag, CAST(floor(value) AS BIGINT) AS v FROM h""",
)
def nested_protection(t: Tables):
    phone = F.concat(F.lit("08"), F.lpad(F.col("user_id").cast("string"), 8, "5"))
    rows = t.events.select(
        "event_id",
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login"), F.array(phone).alias("tags"), F.col("value").alias("v")).alias("who"),
    )
    masked = P.protect(rows, None, t.key)
    return masked.select("event_id", F.col("who.login").alias("login"), F.col("who.tags")[0].alias("first_tag"), F.floor("who.v").alias("v"))


@check("masked_embeddings", "SELECT vec_id, label, len(embedding) AS dims, CAST(round(embedding[1] * 10000) AS BIGINT) AS first FROM embeddings")
def masked_embeddings(t: Tables):
    masked = P.protect(t.embeddings, None, t.key)
    first = F.round(F.col("embedding")[0] * 10000).cast("long")
    return masked.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), first.alias("first"))


def _thai_or_latin(thai: list[str], latin: list[str], digest: str) -> str:
    return f"CASE WHEN thai THEN {pool_sql(thai, digest)} ELSE {pool_sql(latin, digest)} END"


@check(
    "planted_texts",
    f"""{ctes(p=PLANTED)}, h AS (SELECT *, {digest_sql('email', 'email')} AS he, {digest_sql('phone', 'phone')} AS hp, {digest_sql('credit_card', 'card')} AS hc, {_name_digest('given', 'name')} AS hg, {_name_digest('family', 'name')} AS hf FROM p),
f AS (SELECT k, 'à user_' || substr(he, 1, 10) || '@example.invalid tel ' || {fake_digits_sql('phone', 'hp')} || ' / ' || {fake_digits_sql('card', 'hc')} || ' for ' ||
 CASE WHEN k % 3 = 2 THEN name ELSE CASE WHEN thai THEN 'นาย' ELSE 'Dr ' END || {_thai_or_latin(X.THAI_GIVEN, X.LATIN_GIVEN, 'hg')} || ' ' || {_thai_or_latin(X.THAI_FAMILY, X.LATIN_FAMILY, 'hf')} END || '!' AS scanned FROM h)
SELECT k, scanned, scanned AS message FROM f""",
)
def planted_texts(t: Tables):
    """Planted values replaced in free text, by the scan and by whole-table protection."""
    rows = t.sql(PLANTED).select("k", "message").withColumn("raw", F.encode("message", "UTF-8"))
    masked = P.protect(rows, {"message": X.FREE_TEXT}, t.key)
    return masked.select("k", S.scan_text(F.decode("raw", "UTF-8"), t.key).alias("scanned"), "message")


@check("scanned_texts")
def scanned_texts(t: Tables):
    """Whole documents with embedded personal values replaced; SQL has no look-around."""
    return t.documents.select("doc_id", S.scan_text("text", t.key).alias("text"))


@check("scanned_conversations")
def scanned_conversations(t: Tables):
    return P.protect(t.conversations.withColumnRenamed("text", "message"), None, t.key)


_DAYS = "select cast(ts as date) as day, case user_id % 5 when 0 then 'u' || cast(user_id as string) || '@mail.example.com' when 1 then '08' || lpad(cast(user_id as string), 8, '3') else 'plain' end as code, event_type as tag from {events}"


@check(
    "merged_profiles",
    f"""{ctes(e=_DAYS)}, c AS (SELECT unnest([{{'c': 'code', 'v': code}}, {{'c': 'tag', 'v': tag}}]) AS cell FROM e), p AS (SELECT cell.c AS column_name, cell.v AS x, trim(cell.v) AS v FROM c), k AS (SELECT column_name, x, {_SHAPE} AS class FROM p),
f AS (SELECT column_name, class, x, count(*) AS m FROM k GROUP BY ALL)
SELECT column_name, class, CAST(sum(m) AS BIGINT) AS n, min(length(x)) AS shortest, max(length(x)) AS longest, true AS close, CASE WHEN class = 'public' THEN CAST(max(m) AS BIGINT) END AS top FROM f GROUP BY column_name, class""",
)
def merged_profiles(t: Tables):
    """Thirty stored daily profiles added up, held against an exact count of distinct values."""
    folder = f"{shared_folder(t.spark)}/profiles-{uuid.uuid4().hex}"
    rows = t.sql(_DAYS)
    PR.profile_parts(rows, ["day"]).write.partitionBy("day").parquet(folder)
    whole = PR.estimated(PR.merge_profiles(t.spark.read.parquet(folder)), 1)
    exact = [rows.select(F.lit(c).alias("column_name"), V.classify_value(c).alias("class"), F.col(c).alias("v")).groupBy("column_name", "class").agg(F.count_distinct("v").alias("exact")) for c in ("code", "tag")]
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.06)
    top = F.when(F.col("class") == "public", F.get("most_frequent", F.lit(0))["count"])
    return whole.join(exact[0].unionByName(exact[1]), ["column_name", "class"]).select("column_name", "class", "n", "shortest", "longest", close.alias("close"), top.alias("top"))


@check(
    "profile_rollup",
    f"""{ctes(e=_DAYS)}, c AS (SELECT CAST(day AS VARCHAR) AS day, unnest([{{'c': 'code', 'v': code}}, {{'c': 'tag', 'v': tag}}]) AS cell FROM e), p AS (SELECT day, cell.c AS column_name, trim(cell.v) AS v FROM c), k AS (SELECT day, column_name, {_SHAPE} AS class FROM p)
SELECT day, column_name, class, CAST(count(*) AS BIGINT) AS n, CAST(3 - (grouping(day) + grouping(column_name) + grouping(class)) AS INTEGER) AS level FROM k GROUP BY ROLLUP (day, column_name, class)""",
)
def profile_rollup(t: Tables):
    rows = t.sql(_DAYS).withColumn("day", F.col("day").cast("string"))
    return PR.rollup_profiles(PR.profile_parts(rows, ["day"]), "day", "column_name", "class").select("day", "column_name", "class", "n", F.col("level").cast("int").alias("level"))
