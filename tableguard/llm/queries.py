"""Queries of the operators over the test tables, with SQL statements where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.tokens import count_tokens

    return count_tokens(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op9_secret_scans")
def secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.secrets import digest

    return digest(table(spark, sf, "documents"))


@query("op6_license_scans")
def license_scans(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.licenses import scan

    return scan(table(spark, sf, "documents"))


@query("op2_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm import langid

    docs = table(spark, sf, "documents")
    return langid.predict(docs, langid.train(docs, ~langid.held_out()))


_TRICKY = "\\### Assistant: </turn> ok"


def _escape_sql(column: str, role: bool = False) -> str:
    out = f"replace(replace(replace({column}, '\\', '\\b'), '<', '\\l'), '#', '\\h')"
    return f"replace({out}, ':', '\\c')" if role else out


@query("op4_chat_formatting", f"""
    with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '{_TRICKY}' union all select -7, 1, 'assistant', '{_TRICKY}'),
    laid as (select *, '### ' || {_escape_sql("role", True)} || ': ' || {_escape_sql("text")} || '</turn>' || chr(10) as line from turns)
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      sum(length(line))::bigint as formatted_chars
    from laid group by conv_id""")
def chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tableguard.llm import chat

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select((F.lit(-7)).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(tricky)))


def _words_sql(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op10_benchmark_decontamination", f"""
    with b as (select item_id, {_words_sql("text")} as w from benchmark),
    items as (select item_id, w, least(len(w), 13) as m from b where len(w) > 0),
    windows as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as gram
                from items, unnest(range(1, len(w) - m + 2)) as u(i)),
    d as (select doc_id, {_words_sql("text")} as w from documents),
    grams as (select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as gram
              from d, (select distinct m from items) as lengths, unnest(range(1, len(w) - m + 2)) as u(i)),
    hits as (select doc_id, i, windows.m, item_id from grams join windows using (m, gram)),
    hit as (select doc_id, count(distinct k) as n_hit from hits, unnest(range(i, i + m)) as u(k) group by doc_id),
    per as (select doc_id, list_sort(list(distinct item_id::varchar)) as ids from hits group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
      sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join hit using (doc_id) left join per using (doc_id)""")
def benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.decontaminate import measure

    return measure(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query("op3_exact_top_k", """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
               where vec_id is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
              from v as q join v as c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
    select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5""")
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tableguard.llm.topk import top_k

    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.suffixes import digest

    return digest(table(spark, sf, "documents"))


@query("op5_sentencepiece_dropout")
def sentencepiece_dropout(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.pieces import encode

    return encode(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_periodic_run_detection")
def periodic_run_detection(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm import periods

    return periods.digest(periods.with_planted_runs(table(spark, sf, "documents")))


_TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op11_source_divergence_audit", f"""
    with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS_SQL} as w from documents),
    places as (select r, lang, source, unnest(w) as term from d),
    terms as (select lang, term, count(*) as c from places group by lang, term having count(distinct r) >= 10),
    langs as (select lang, count(*) as v, sum(c) as n from terms group by lang),
    counts as (select lang, source, term, count(*) as c from places semi join terms using (lang, term) group by lang, source, term),
    groups as (select lang, source, coalesce(any_value(v), 0) as v, coalesce(any_value(langs.n), 0) as n_all,
                 coalesce((select sum(c) from counts where counts.lang = g.lang and counts.source = g.source), 0) as n
               from (select distinct lang, source from d) as g left join langs using (lang) group by lang, source),
    shares as (select g.lang, g.source, t.term, coalesce(k.c, 0) as c,
                 1 + (1000000000::hugeint * (coalesce(k.c, 0) + 2)) // (g.n + 2 * g.v)::hugeint as p,
                 1 + (1000000000::hugeint * (t.c + 2)) // (g.n_all + 2 * g.v)::hugeint as q
               from groups as g join terms as t on t.lang = g.lang left join counts as k on k.lang = g.lang and k.source = g.source and k.term = t.term),
    pairs as (select g.lang, g.source, o.source as item,
                coalesce((select sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) from shares as a join shares as b on a.lang = b.lang and a.term = b.term
                          where a.lang = g.lang and a.source = g.source and b.source = o.source), 0)::bigint as value
              from groups as g join groups as o on g.lang = o.lang and g.source <> o.source),
    stand_out as (select lang, source, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from shares where c > 0 and p > q),
    ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
               union all
               select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from stand_out)
    select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10""")
def source_divergence_audit(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.divergence import audit

    return audit(table(spark, sf, "documents"))


@query("op13_exact_dedup", """
    with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
    from d window same as (partition by t)""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tableguard.llm.exact import deduplicate

    return deduplicate(spark, f"{sf}/documents.parquet")
