import re
from collections import Counter, defaultdict

import pytest

from tableguard.llm import divergence as D


def plain_audit(rows, least=10, best=10):
    """Result rows of (lang, source, text) rows, group by group and term by term."""
    groups, documents, places = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        documents[lang].update(set(terms))
        places[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        whole = Counter()
        for (other_lang, _), counts in places.items():
            if other_lang == lang:
                whole.update(counts)
        p, q = shares(places[lang, source]), shares(whole)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares(places[lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept), other.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode()) for t in kept if places[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(docs):
    return [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_against_brute_force(spark, documents):
    from tableguard.llm.queries import QUERIES

    got = result(QUERIES["op11_source_divergence_audit"](spark, "/root/testdata/sf0.001"))
    assert got == plain_audit(rows_of(documents)) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("groups, terms", [(1, 16), (3, 50), (64, 4096)])
def test_cells_of_any_size_add_up(documents, groups, terms):
    few = documents.where("length(text) < 2000")
    assert result(D.audit(few, least=3, groups=groups, terms=terms)) == plain_audit(rows_of(few), least=3)


def test_odd_rows(messy, nothing, spark):
    assert result(D.audit(messy, least=2)) == plain_audit(rows_of(messy), least=2)
    kept_none = result(D.audit(messy, least=1000))
    assert kept_none == plain_audit(rows_of(messy), least=1000) and all(r[4] == 0 for r in kept_none)
    assert D.audit(nothing).count() == 0
    odd = [("", "a", "Zebra ÄÖ"), (None, "a", "zebra äö"), ("x", None, None), ("x", "b", ""), ("x", "é", "k " * 50), ("x", "z", "k m k")]
    docs = spark.createDataFrame(odd * 3, "lang string, source string, text string")
    assert result(D.audit(docs, least=2)) == plain_audit(odd * 3, least=2)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 7 * 10**11 + 1, 3 * 10**13 + 7, 123_456
    row = spark.range(1).select(D._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 16)
    text = "Alpha beta-GAMMA ünï 12 " * 20 + "x" * 100
    terms = [t for block in D.blocks_of_terms(text.encode()) for t in block]
    assert terms == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("GAMMA", "gamma").replace("Alpha", "alpha"))]
