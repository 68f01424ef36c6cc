"""Checks of text scanning and redaction."""

from pyspark.sql import functions as F

from checks.base import CONTACTS, SECRET, Tables, check, ctes, digest_sql, fake_digits_sql
from tableguard.functions import surface, text as Tx
from tableguard.functions.keyed import key_table
from tableguard.operators import texts as TX

_ASSIGN = "(?i)(password|passwd|pwd|secret|api[_-]?key|token)\\s*=\\s*(?:''[^''\\n]*''|\"[^\"\\n]*\")"
_BEARER = "(?i)bearer\\s+[A-Za-z0-9._~-]+"
_PEM = "(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"


def _n(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


_DONE = "(?i)(?:password|passwd|pwd|secret|api[_-]?key|token)\\s*=\\s*(?:''\\[REDACTED\\]''|\"\\[REDACTED\\]\")"


def _secret_steps(source: str, text: str, more: str = "*") -> str:
    return f"""s0 AS (SELECT {more}, {text} AS t0 FROM {source}),
s1 AS (SELECT *, regexp_replace(t0, '{_ASSIGN}', '\\1=''[REDACTED]''', 'g') AS t1, {_n('t0', _ASSIGN)} - {_n('t0', _DONE)} AS n1 FROM s0),
s2 AS (SELECT *, regexp_replace(t1, '{_BEARER}', '[REDACTED]', 'g') AS t2, {_n('t1', _BEARER)} AS n2 FROM s1),
s3 AS (SELECT *, regexp_replace(t2, '{_PEM}', '[REDACTED]', 'g') AS clean, n1 + n2 + {_n('t2', _PEM)} AS secrets FROM s2)"""


# Patterns without look-around: the neighbours are captured and written back.
_PII = [
    ("EMAIL", "", "[^@\\s<>()\\[\\],;:\"'']{1,64}@[^@\\s<>()\\[\\],;:\"'']{1,253}\\.[A-Za-z]{2,24}", ""),
    ("CREDIT_CARD", "(^|[^0-9])", "[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -]?[0-9]{1,3})?", "($|[^0-9])"),
    ("NATIONAL_ID", "(^|[^0-9])", "[0-9](?:[ -]?[0-9]){12}", "($|[^0-9])"),
    ("PHONE", "(^|[^0-9])", "(?:\\+66[ -]?|0)[0-9]{1,2}[ -]?[0-9]{3}[ -]?[0-9]{3,4}", "($|[^0-9])"),
    ("PHONE", "(^|[^0-9])", "\\+[1-9][0-9 ()-]{7,20}[0-9]", ""),
    ("PERSONAL_NAME", "\\b", "(?:Mr|Mrs|Ms|Miss|Dr)\\.?\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?", ""),
]


# A second round finds the number that shared its neighbour with the one before.
_PII = [step for step in _PII for _ in range(2 if step[1].startswith("(") else 1)]
_LABELS = [step[0] for step in _PII]


def _total(*labels: str) -> str:
    return " + ".join(f"c{i}" for i, label in enumerate(_LABELS) if not labels or label in labels)


def _pii_steps(source: str, text: str) -> str:
    out, last = [], text
    for i, (label, before, body, after) in enumerate(_PII):
        pattern = before + body + after
        head = "\\1" if before.startswith("(") else ""
        tail = ("\\2" if head else "\\1") if after else ""
        out.append(
            f"p{i} AS (SELECT *, regexp_replace({last}, '{pattern}', '{head}[REDACTED:{label}]{tail}', 'g') AS m{i}, {_n(last, pattern)} AS c{i} FROM {source})"
        )
        source, last = f"p{i}", f"m{i}"
    return ",\n".join(out)


_LAST = len(_PII) - 1


@check("redacted_documents", f"WITH {_secret_steps('documents', 'text')} SELECT doc_id, sha256(clean) AS text, CAST(secrets AS BIGINT) AS secrets FROM s3")
def redacted_documents(t: Tables):
    clean, n = Tx.redact_secrets("text")
    return t.documents.select("doc_id", F.sha2(clean, 256).alias("text"), n.cast("long").alias("secrets"))


@check(
    "redacted_corpus",
    f"""WITH {_secret_steps('documents', 'text', 'doc_id, lang')}, {_pii_steps('s3', 'clean')}
SELECT doc_id, lang, sha256(m{_LAST}) AS text, CAST(secrets AS BIGINT) AS secrets, CAST({_total()} AS BIGINT) AS marks FROM p{_LAST}""",
)
def redacted_corpus(t: Tables):
    rows = TX.redact_corpus(t.documents.select("doc_id", "lang", "text"), "text")
    return rows.select("doc_id", "lang", F.sha2("text", 256).alias("text"), F.col("secrets").cast("long"), F.col("marks").cast("long"))


_COUNTS = ", ".join(f"CAST(sum({_total(label)}) AS BIGINT) AS {label.lower()}" for label in dict.fromkeys(_LABELS))


@check("pii_counts_by_lang", f"WITH {_pii_steps('documents', 'text')} SELECT lang, {_COUNTS} FROM p{_LAST} GROUP BY lang")
def pii_counts_by_lang(t: Tables):
    rows = TX.personal_counts(t.documents.select("lang", "text"), "text")
    return rows.groupBy("lang").agg(*[F.sum(c).cast("long").alias(c) for c in rows.columns if c != "lang"])


@check("secret_findings_by_source", f"WITH {_secret_steps('documents', 'text')} SELECT source, count(*) AS docs, CAST(sum(secrets) AS BIGINT) AS n FROM s3 WHERE secrets > 0 GROUP BY source")
def secret_findings_by_source(t: Tables):
    rows = t.documents.select("source", Tx.secret_count("text").alias("n")).where("n > 0")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("n"))


_PATHS = """select lang || '/' || cast(doc_id as string) || case doc_id % 4 when 0 then '.sql' when 1 then '.md' when 2 then '.jsonl' else '.txt' end as path, text as content from {documents}"""


@check(
    "secret_files",
    f"{ctes(files=_PATHS)}, {_secret_steps('files', 'content')} SELECT path, CAST(secrets AS BIGINT) AS n FROM s3 WHERE secrets > 0 AND regexp_matches(path, '\\.(sql|json|jsonl|yaml|md|csv)$')",
)
def secret_files(t: Tables):
    return TX.secret_findings(t.sql(_PATHS)).select("path", F.col("n").cast("long"))


# A secret that only shows after the token inside it was replaced.
_GATED = """select doc_id, case when doc_id % 20 = 0 then text || ' password=' || chr(39) || 'bearer' || chr(10) || 'abc def' || chr(39) else text end as text from {documents}"""


@check(
    "residual_gate",
    f"""{ctes(gated=_GATED)}, {_secret_steps('gated', 'text', 'doc_id')},
again AS (SELECT doc_id, clean, secrets, {_n('clean', _ASSIGN)} - {_n('clean', _DONE)} + {_n('clean', _BEARER)} AS residual FROM s3)
SELECT doc_id, CASE WHEN residual > 0 THEN 'RAW_SECRET_DETECTED' ELSE sha256(clean) END AS outcome, CASE WHEN residual = 0 THEN CAST(secrets AS BIGINT) END AS secrets FROM again""",
)
def residual_gate(t: Tables):
    rows = TX.gated(t.sql(_GATED), "text")
    secrets = F.when(F.col("error_code").isNull(), F.col("secrets_redacted").cast("long"))
    return rows.select("doc_id", F.coalesce("error_code", F.sha2("text", 256)).alias("outcome"), secrets.alias("secrets"))


_STATEMENTS = f"""select c_custkey, 'insert into t values (N' || chr(39) || 'to ' || contact || ' it' || chr(39) || chr(39) || 's' || chr(39) || ', 1); -- tel 0812345678 ' || chr(39) || c_mktsegment || chr(39) as body
from ({CONTACTS}) x"""


@check(
    "pii_in_literals",
    f"""{ctes(statements=_STATEMENTS)},
cut AS (SELECT c_custkey, body, regexp_extract_all(body, 'N?''(?:[^'']|'''')*''') AS lits FROM statements),
lit AS (SELECT c_custkey, body, lits[1] AS first FROM cut), {_pii_steps('lit', 'first')}
SELECT c_custkey, replace(body, first, m{_LAST}) AS body, CAST({_total()} AS BIGINT) AS n FROM p{_LAST}""",
)
def pii_in_literals(t: Tables):
    clean, n = Tx.redact_pii_in_literals("body")
    return t.sql(_STATEMENTS).select("c_custkey", clean.alias("body"), n.cast("long").alias("n"))


_MESSAGES = """select conv_id, turn, 'Error at /srv/data/' || cast(conv_id as string) || '.sql in  C:/x/y' || chr(10) || ' pwd = ' || chr(39) || 'abc' || chr(39) || ' '
  || case when turn % 3 = 0 then text else '' end || case when turn % 2 = 0 then ' near create or alter procedure p as select 1' else '' end as message from {conversations}"""


@check(
    "safe_messages",
    f"""{ctes(messages=_MESSAGES)},
line AS (SELECT conv_id, turn, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS m FROM messages),
body AS (SELECT conv_id, turn, regexp_replace(m, '(?is)\\b(?:CREATE|ALTER)\\s+(?:OR\\s+ALTER\\s+)?(?:PROCEDURE|PROC|FUNCTION|TABLE|VIEW)\\b.*', '[REDACTED]', 'g') AS b FROM line),
{_secret_steps('body', 'b', 'conv_id, turn')},
path AS (SELECT conv_id, turn, regexp_replace(regexp_replace(clean, '[A-Za-z]:[\\\\/][^\\s''"]*', '[REDACTED]', 'g'), '(^|[^\\w.])/[^\\s''"]*', '\\1[REDACTED]', 'g') AS p FROM s3)
SELECT conv_id, turn, CASE WHEN length(p) > 200 THEN rtrim(substr(p, 1, 199)) || '…' ELSE p END AS message FROM path""",
)
def safe_messages(t: Tables):
    return t.sql(_MESSAGES).select("conv_id", "turn", Tx.safe_message("message").alias("message"))


_DRIVER = """select event_id, '[HY000] [Driver][SQL Server]Login failed for ' || event_type || ' (' || cast(18000 + user_id as string) || ')  pwd=' || props || ';UID = u' || cast(user_id as string) || ' end' as message from {events}"""


@check(
    "driver_errors",
    f"""{ctes(logs=_DRIVER)}, line AS (SELECT event_id, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS m FROM logs),
cut AS (SELECT event_id, substr(regexp_replace(m, '(?i)\\b(pwd|password|uid|user id)\\s*=\\s*[^;\\s]*', '\\1=<redacted>', 'g'), 1, 1000) AS message FROM line)
SELECT event_id, message, array_to_string(regexp_extract_all(message, '\\[SQL Server\\][^\\[]*?\\((\\d+)\\)', 1), ',') AS native_errors FROM cut""",
)
def driver_errors(t: Tables):
    rows = TX.redact_log(t.sql(_DRIVER), "message", "driver")
    return rows.withColumn("native_errors", F.array_join(F.col("native_errors").cast("array<string>"), ","))


_TOOL = """select page_id, 'L1 | token: ' || url || ' | found ' || chr(34) || url || chr(34) || ' near N' || chr(39) || 'a' || chr(39) || chr(39) || 'b' || chr(39) || chr(10) || html as output from {pages}"""


@check(
    "tool_diagnostics",
    f"""{ctes(logs=_TOOL)}, a AS (SELECT page_id, trim(output, chr(32) || chr(10) || chr(9) || chr(13)) AS raw FROM logs),
b AS (SELECT page_id, raw, regexp_replace(raw, '(?i)\\b(password|passwd|pwd|secret|token|api[_-]?key|key)\\s*[:=]\\s*\\S+', '\\1=[REDACTED]', 'g') AS x FROM a),
c AS (SELECT page_id, raw, x, regexp_extract_all(x, 'N?''(?:[^'']|'''')*''|"(?:[^"]|"")*"') AS lits, string_split_regex(x, 'N?''(?:[^'']|'''')*''|"(?:[^"]|"")*"') AS parts FROM b),
d AS (SELECT page_id, raw, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i <= len(lits) THEN '''<redacted ' || CAST(length(lits[i]) AS VARCHAR) || ' chars>''' ELSE '' END), '') AS y FROM c),
e AS (SELECT page_id, raw, replace(replace(y, chr(13), ' '), chr(10), ' ') AS z FROM d)
SELECT page_id, substr(z, 1, 512) AS first_line, CASE WHEN length(z) > 512 THEN 'diagnostic truncated: showing 512 of ' || CAST(length(z) AS VARCHAR) || ' characters' END AS cut, 'diagnostic fingerprint: ' || substr(sha256(raw), 1, 12) AS mark FROM e""",
)
def tool_diagnostics(t: Tables):
    rows = TX.redact_log(t.sql(_TOOL), "output", "tool")
    d = F.col("diagnostics")
    return rows.select(
        "page_id",
        d[0].alias("first_line"),
        F.when(F.size(d) == 3, d[1]).alias("cut"),
        F.element_at(d, -1).alias("mark"),
    )


@check(
    "pii_findings_by_class",
    f"""WITH {_pii_steps('documents', 'text')}, c AS (SELECT lang, unnest(['email', 'credit_card', 'national_id', 'phone', 'personal_name']) AS class, unnest([{', '.join(_total(x) for x in dict.fromkeys(_LABELS))}]) AS n FROM p{_LAST})
SELECT lang, class, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL HAVING sum(n) > 0""",
)
def pii_findings_by_class(t: Tables):
    found = TX.pii_findings(t.documents, "text", "doc_id", "lang")
    return found.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


@check("pii_findings")
def pii_findings(t: Tables):
    """Class and character range of every personal value in every conversation and document."""
    a = TX.pii_findings(t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"), "text", "kind", "id")
    b = TX.pii_findings(t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "text"), "text", "kind", "id")
    return a.unionByName(b)


# Texts put together from values of known class, so that SQL can say what is found and replaced.
PLANTED = """
select k, email, phone, card, name, thai,
       'à ' || email || ' tel ' || phone || ' / ' || card || ' for ' || name || '!' as message
from (select c_custkey as k,
             case when c_custkey % 4 = 0 then '08' || lpad(cast(c_custkey as string), 8, '1') || '@x.org'
                  else 'user' || cast(c_custkey as string) || '@mail.example.com' end as email,
             '08' || lpad(cast(c_custkey as string), 8, '2') as phone,
             '4111 1111 2222 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') as card,
             case c_custkey % 3 when 0 then 'Dr. ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Stone'
                                when 1 then 'นายสมชาย ใจดี' else 'nobody' end as name,
             c_custkey % 3 = 1 as thai
      from {customer}) c"""
_PIECES = "email, phone, credit_card, personal_name".split(", ")
_AT = {"email": "2", "phone": "7 + length(email)", "credit_card": "10 + length(email) + length(phone)", "personal_name": "15 + length(email) + length(phone) + length(card)"}
_SIZE = {"email": "email", "phone": "phone", "credit_card": "card", "personal_name": "name"}


@check(
    "planted_findings",
    f"{ctes(p=PLANTED)} " + " UNION ALL ".join(f"SELECT k, '{c}' AS class, CAST({_AT[c]} AS INTEGER) AS start, CAST({_AT[c]} + length({_SIZE[c]}) AS INTEGER) AS \"end\" FROM p" + (" WHERE k % 3 <> 2" if c == "personal_name" else "") for c in _PIECES),
)
def planted_findings(t: Tables):
    """Every planted value, and nothing else: a phone number inside an address is the address's."""
    return TX.pii_findings(t.sql(PLANTED), "message", "k")


# Functions for SQL text -----------------------------------------------------------------------------


@check(
    "lateral_findings",
    f"{ctes(p=PLANTED)} " + " UNION ALL ".join(f"SELECT k, '{c}' AS class, CAST({_AT[c]} AS INTEGER) AS start, CAST({_AT[c]} + length({_SIZE[c]}) AS INTEGER) AS \"end\" FROM p" + (" WHERE k % 3 <> 2" if c == "personal_name" else "") for c in _PIECES),
)
def lateral_findings(t: Tables):
    """The table function beside the text it reads."""
    surface.register(t.spark, key_table(t.spark, SECRET))
    return t.spark.sql("SELECT k, f.* FROM {planted}, LATERAL pii_findings(message) AS f", planted=t.sql(PLANTED))


@check(
    "surface_functions",
    f"""WITH e AS (SELECT event_id, '08' || lpad(CAST(user_id AS VARCHAR), 8, '5') AS p FROM events), h AS (SELECT *, {digest_sql('phone', 'p')} AS d FROM e), f AS (SELECT event_id, {fake_digits_sql('p', 'd')} AS fake FROM h)
SELECT event_id, 'call ' || fake AS scanned, '{{"phone":"' || fake || '","pwd":"[REDACTED]"}}' AS walked, CAST(NULL AS VARCHAR) AS no_json, 'create view v as select   from t' AS visible FROM f""",
)
def surface_functions(t: Tables):
    """The scanners as functions of SQL text; the key stays in its table."""
    surface.register(t.spark, key_table(t.spark, SECRET))
    phone = F.concat(F.lit("08"), F.lpad(F.col("user_id").cast("string"), 8, "5"))
    rows = t.events.select(
        "event_id", phone.alias("p"), F.concat(F.lit('{"phone": "'), phone, F.lit('", "pwd": 5}')).alias("j"), F.concat(F.lit("create view v as select '"), phone, F.lit("' from t")).alias("s")
    )
    return t.spark.sql(
        "SELECT event_id, scan_text('call ' || p) AS scanned, protect_json(j, 'props') AS walked, protect_json(p, 'props') AS no_json, declaration_surface(s) AS visible FROM {rows}",
        rows=rows,
    )
