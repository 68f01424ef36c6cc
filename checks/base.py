"""Registry of checks, and tables derived from the test tables by SQL both engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableguard.functions.keyed import Key, key_blocks, key_table, table_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECRET = b"key used by the checks only"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def check(name: str, sql: str | None = None):
    """Register a query function ``(t: Tables) -> DataFrame`` and its SQL."""

    def add(fn: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(Tables(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """Test tables of one scale, tables derived from them, and the key."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def sql(self, text: str, shuffled: tuple[str, ...] = ()) -> DataFrame:
        """Derived table; ``{name}`` stands for a test table. Joins never broadcast the ``shuffled`` ones,
        whose rows take far more memory than their file's size tells."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **{n: df.hint("shuffle_hash") if n in shuffled else df for n, df in used.items()})

    @property
    def key(self) -> Key:
        return table_key(key_table(self.spark, SECRET))


def duck(text: str) -> str:
    """The same derived table as DuckDB text."""
    return text.format(**{n: n for n in TABLES})


def ctes(**named: str) -> str:
    """WITH clause of derived tables."""
    return "with " + ",\n".join(f"{n} as ({duck(t)})" for n, t in named.items())


# SQL forms of the keyed primitives ------------------------------------------------------------

_INNER, _OUTER = (b.hex() for b in key_blocks(SECRET))


def hmac_sql(message: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({message}))))"


def digest_sql(cls: str, value: str) -> str:
    return hmac_sql(f"'{cls}|' || lower(trim({value}))")


def digits_sql(digest: str, k: int) -> str:
    """Last k <= 18 decimal digits: 32-bit limbs weighted by their power modulo 10^18."""
    parts = [
        f"CAST(('0x' || substr({digest}, {1 + 8 * i}, 8)) AS HUGEINT) * {(1 << (32 * (7 - i))) % 10**18}::HUGEINT"
        for i in range(8)
    ]
    return f"right(lpad(CAST(({' + '.join(parts)}) % 1000000000000000000::HUGEINT AS VARCHAR), 18, '0'), {k})"


def overlay_sql(value: str, fresh: str) -> str:
    """Digits of ``value`` replaced one by one from ``fresh``."""
    return (
        f"array_to_string(list_transform(range(1, length({value}) + 1), lambda i: "
        f"CASE WHEN substr({value}, i, 1) BETWEEN '0' AND '9' THEN "
        f"substr({fresh}, length(regexp_replace(substr({value}, 1, i), '[^0-9]', '', 'g')), 1) "
        f"ELSE substr({value}, i, 1) END), '')"
    )


def fake_digits_sql(value: str, digest: str) -> str:
    """Digit fake of a value with at most 19 digits; ``digest`` should be a column name."""
    n = f"length(regexp_replace({value}, '[^0-9]', '', 'g'))"
    fresh = f"('0' || right({digits_sql(digest, 18)}, {n} - 1))"
    return f"CASE WHEN {n} = 0 THEN '[REDACTED]' ELSE {overlay_sql(value, fresh)} END"


def pool_sql(pool: list[str], digest: str) -> str:
    items = ", ".join(f"'{x}'" for x in pool)
    return f"list_extract([{items}], 1 + CAST(CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) % {len(pool)} AS INTEGER))"


def sealed_sql(source: str, payload: str, key: str, by: str, more: str = "") -> str:
    """CTEs ``r`` (rows) and ``g`` (buckets) of a sealed digest; ``more`` is a column to add up."""
    add, sum_ = (f", {more}", f", sum({more}) AS {more}") if more else ("", "")
    return (
        f"r AS (SELECT {by}, substr(sha256({key}), 1, 3) AS b, sha256({payload}) AS h{add} FROM {source}), "
        f"g AS (SELECT {by}, b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n{sum_} FROM r GROUP BY {by}, b)"
    )


SEAL = "'sha256:' || sha256(string_agg(b || h, '' ORDER BY b))"


# Derived tables -------------------------------------------------------------------------------

# Column names put together from two words picked by the keys of a line item.
NAMES = """
select split_part('FIRST,LAST,customer,bank,card,national,api,private,client,refresh,session,TOKEN,pwd,hash,is,pass,pin,id,tax,credit,acc,e,mail,phone,user,created,full,house,dob,lat,remark,STATUS,area,face,jwt,salt,no,date,cookie,nick', ',', cast(1 + l_partkey % 40 as int))
       || case when l_linenumber % 2 = 0 then '_' else '' end
       || split_part('Name,ID,Key,secret,CARD,No,By,hash,Code,Number,Token,Account,template,Mail,Address,Date,Count,Value,x,digest', ',', cast(1 + l_suppkey % 20 as int)) as column_name
from {lineitem}"""

# One sensitive-looking value of varying shape per customer.
CONTACTS = """
select c_custkey, c_nationkey,
       case c_custkey % 11
         when 0 then lower(replace(c_name, '#', '.')) || '@mail' || cast(c_nationkey as string) || '.example.com'
         when 1 then '08' || lpad(cast(c_custkey as string), 8, '1')
         when 2 then '+66 8' || lpad(cast(c_nationkey as string), 1, '0') || ' 345 ' || lpad(cast(c_custkey % 9999 as string), 4, '7')
         when 3 then '4111 1111 2222 ' || lpad(cast(c_custkey % 10000 as string), 4, '0')
         when 4 then '1-2034-' || lpad(cast(c_custkey % 100000 as string), 5, '0') || '-56-' || cast(c_custkey % 10 as string)
         when 5 then 'tok' || cast(c_custkey as string) || '.body-' || lower(c_mktsegment) || '.sig_' || cast(c_nationkey as string)
         when 6 then 'Mr. ' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || ' Smith'
         when 7 then 'Dr ' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2))
         when 8 then cast(c_custkey as string) || '.25.' || cast(c_nationkey as string)
         when 9 then '  ' || c_mktsegment || ' '
         else '2024-01-31'
       end as contact,
       c_name, c_acctbal, c_mktsegment
from {customer}"""

# Thirteen-digit numbers with the digits of a line item's keys.
THAI_IDS = """
select l_orderkey, l_linenumber, l_partkey,
       substr(lpad(cast(l_orderkey * 7919 + l_partkey as string), 13, '3'), 1, 1) || '-' ||
       substr(lpad(cast(l_orderkey * 7919 + l_partkey as string), 13, '3'), 2, 4) || '-' ||
       substr(lpad(cast(l_orderkey * 7919 + l_partkey as string), 13, '3'), 6, 5) || '-' ||
       substr(lpad(cast(l_orderkey * 7919 + l_partkey as string), 13, '3'), 11, 2) || '-' ||
       substr(lpad(cast(l_orderkey * 7919 + l_partkey as string), 13, '3'), 13, 1) as thai_id
from {lineitem}"""

# Every part is a catalog object.
OBJECTS = """
select p_partkey,
       lower(replace(p_brand, '#', '_')) as schema_name,
       case when p_size <= 8 then 'LUT_' when p_size <= 18 then 'UM_' when p_size <= 26 then 'CONTENT_' else '' end
         || upper(replace(p_name, ' ', '_')) || '_' || cast(p_partkey as string) as object_name,
       case p_type when 'STANDARD' then 'BASE TABLE' when 'PROMO' then 'U' when 'LARGE' then 'table'
                   when 'SMALL' then 'Stored Procedure' when 'ECONOMY' then 'FN' else 'view' end as raw_type,
       case when p_type in ('SMALL') then 'procedure' when p_type in ('ECONOMY', 'MEDIUM') then 'function' else 'table' end as object_type,
       case when p_type in ('SMALL') then 'procedure' when p_type in ('ECONOMY', 'MEDIUM') then 'function' else 'table' end
         || ':' || lower(replace(p_brand, '#', '_')) || '.'
         || case when p_size <= 8 then 'LUT_' when p_size <= 18 then 'UM_' when p_size <= 26 then 'CONTENT_' else '' end
         || upper(replace(p_name, ' ', '_')) || '_' || cast(p_partkey as string) as object_id,
       case when p_size % 5 = 0 then 'Reference Data about ' || p_name when p_size % 7 = 0 then 'users may publish ' || p_name end as native_comment,
       '2024-01-' || lpad(cast(1 + p_size % 28 as string), 2, '0') as modified_at
from {part}"""

# Columns of objects: one per (part, line number) seen in the line items.
COLUMNS = f"""
select o.object_id, o.schema_name, o.object_name as table_name, c.ordinal,
       split_part('ROLE_ID,USERNAME,CONTENT_ID,STATUS,BODY,PUBLISHED_AT,CODE_NO', ',', c.ordinal) as column_name,
       split_part('bigint,string,bigint,string,string,timestamp,int', ',', c.ordinal) as data_type
from (select distinct l_partkey, l_linenumber as ordinal from {{lineitem}}) c
join ({OBJECTS}) o on o.p_partkey = c.l_partkey"""

# Dependencies: the object of a line item's part uses the object numbered like its supplier, and
# every fourth one a single object.
EDGES = f"""
select s.object_id as source_object_id, t.object_id as target_object_id,
       case l_returnflag when 'A' then 'routine_read' when 'N' then 'foreign_key' else 'routine_write' end as edge_type
from {{lineitem}} l
join ({OBJECTS}) s on s.p_partkey = l.l_partkey
join ({OBJECTS}) t on t.p_partkey = case when l_partkey % 4 = 0 then 1 + l_partkey % 10 else l_suppkey end"""

# Foreign keys: one to three per part, and constraints on one to four columns, from all line items.
FOREIGN_KEYS = f"""
select 'FK_' || cast(k.l_partkey as string) || '_' || cast(k.ordinal as string) as name,
       s.object_id as source_object_id, coalesce(t.object_id, 'table:gone.T' || cast(k.target as string)) as target_object_id,
       split_part('ROLE_ID,USERNAME,CONTENT_ID', ',', cast(k.ordinal as int)) as source_column, 'ID' as target_column, k.ordinal
from (select l_partkey, 1 + l_linenumber % (1 + l_partkey % 3) as ordinal, max(l_suppkey) * 21 as target from {{lineitem}}
      group by l_partkey, 1 + l_linenumber % (1 + l_partkey % 3)) k
join ({OBJECTS}) s on s.p_partkey = k.l_partkey
left join ({OBJECTS}) t on t.p_partkey = k.target"""

CONSTRAINT_ROWS = f"""
select o.object_id, case when k.ordinal = 3 then 'UQ_' else 'PK_' end || o.object_name as constraint_name,
       case when k.ordinal = 3 then 'UNIQUE' else 'primary key' end as constraint_type,
       split_part('role_id,username,content_id,status', ',', cast(k.ordinal as int)) as column_name, k.ordinal,
       case when k.ordinal = 3 then 'CONTENT_ID > 0' end as expression
from (select distinct l_partkey, 1 + l_linenumber % (1 + l_partkey % 4) as ordinal from {{lineitem}}) k
join ({OBJECTS}) o on o.p_partkey = k.l_partkey"""

# Index rows from customers, entries from customers with orders and from suppliers.
INDEX = """
select c_custkey as id, 'seg_' || lower(c_mktsegment) as schema_name, 'CUST_' || cast(c_custkey as string) as object_name,
       case c_nationkey % 3 when 0 then 'table' when 1 then 'procedure' else 'function' end as object_type,
       case when c_acctbal > 0 then case when c_nationkey < 12 then 'um' else 'content' end end as context,
       'about ' || c_name as description,
       case when c_acctbal > 0 then case when c_nationkey < 12 then 'base,um' else 'content' end else '' end as tags_csv,
       case when c_acctbal > 0 then 'confirmed' else 'unresolved' end as classification_status,
       case when c_acctbal > 5000 then 'owner' when c_acctbal > 0 then 'rule' else 'unknown' end as classification_source,
       'sha256:' || sha256(c_name) as source_fingerprint,
       'sha256:' || sha256(c_mktsegment || c_name) as content_hash,
       'um/tables/CUST_' || cast(c_custkey as string) || '.sql' as managed_relative_path,
       1 as header_version, '2' as output_format_version, 'ev_a,ev_b' as evidence_csv,
       c_custkey % 10 <> 9 as active
from {customer}"""

ENTRIES = """
select 'seg_' || lower(c_mktsegment) as schema_name, 'CUST_' || cast(c_custkey as string) as object_name,
       case c_nationkey % 3 when 0 then 'table' when 1 then 'procedure' else 'function' end as object_type,
       case when c_acctbal > 0 then case when n % 4 = 0 then 'lut' when c_nationkey < 12 then 'um' else 'content' end end as context,
       'about ' || c_name as description,
       case when c_acctbal > 0 then case when n % 4 = 0 then 'lut' when c_nationkey < 12 then 'base,um' else 'content' end else '' end as tags_csv,
       case when c_acctbal > 0 then 'confirmed' else 'unresolved' end as classification_status,
       case when c_acctbal > 0 then case when n % 8 = 0 then 'owner' else 'rule' end else 'unknown' end as classification_source,
       'sha256:' || sha256(c_name || case when n % 3 = 0 then 'x' else '' end) as source_fingerprint,
       'sha256:' || sha256(c_mktsegment || c_name) as content_hash,
       'um/tables/CUST_' || cast(c_custkey as string) || '.sql' as managed_relative_path,
       1 as header_version, '2' as output_format_version, 'ev_a,ev_b' as evidence_csv, true as active
from {customer} join (select o_custkey, count(*) as n from {orders} group by o_custkey) o on o_custkey = c_custkey
union all
select 'supply', s_name, 'table', null, null, '', 'unresolved', 'unknown', null, 'sha256:' || sha256(s_name),
       'unknowns/tables/' || s_name || '.sql', 1, '2', '', true
from {supplier}"""

# Files of output batches: a document is a file of the batch named by its source.
FILES = """
select source as batch, lang || '/' || case when doc_id % 3 = 0 then 'shared_' || cast(n_chars as string) else cast(doc_id as string) end || '.md' as path,
       text as content, case when doc_id % 50 = 7 then 'ai' else 'full' end as output_profile, doc_id
from {documents}"""

# Versioned records: every order is a stored run of a customer.
RECORDS = """
select o_orderkey as record_id, case when o_custkey % 50 = 0 then null else cast(o_custkey as string) end as session_key,
       o_orderpriority as request, o_orderdate as created_at, o_orderdate + interval '400' day as expires_at,
       case o_orderstatus when 'F' then 'completed' when 'O' then 'ready' else
         case when o_orderkey % 4 = 0 then 'running' else 'completed_with_warnings' end end as status,
       case when o_orderkey % 9 = 0 then 'ask' when o_orderkey % 9 = 1 then null else 'all' end as selection_mode,
       o_orderkey % 97 = 0 as corrupt
from {orders}"""


def with_lists(df: DataFrame) -> DataFrame:
    """``tags_csv`` and ``evidence_csv`` as arrays without empty items."""
    from pyspark.sql import functions as F

    def items(c: str):
        return F.filter(F.split(c, ","), lambda x: x != "")

    return df.withColumn("tags", items("tags_csv")).withColumn("evidence", items("evidence_csv")).drop(
        "tags_csv", "evidence_csv"
    )


def sha_text(sql: str) -> str:
    """Spark names the hash function sha2."""
    import re

    out, at = "", 0
    for m in re.finditer(r"sha256\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        if m.start() < at:
            continue
        out += sql[at : m.start()] + "sha2(" + sql[m.end() : i - 1] + ", 256)"
        at = i
    return out + sql[at:]
