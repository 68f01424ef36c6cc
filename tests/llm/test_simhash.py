import re

import numpy as np
import pytest
import xxhash

from tableguard.llm import simhash as S
from tableguard.llm.components import components
from tests.llm.conftest import by_id


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(fingerprints):
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_components(want)
    from tableguard.llm.queries import QUERIES

    rows = QUERIES["op1_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{want[i]:016x}", roots[i]) for i in texts}


def test_odd_rows(messy, nothing):
    rows = S.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    got = by_id(rows)
    assert got[0].fingerprint == got[1].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 0
    assert got[6].component_id == 5 and got[None].fingerprint is not None
    assert {r.doc_id: r.fingerprint for r in rows} == {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in messy.collect()}
    assert S.near_duplicates(nothing).count() == 0
    kept = S.keep_one(messy)
    assert kept.columns == messy.columns and S.keep_one(nothing).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 5 in ids and 6 not in ids


def test_keep_one_tells_documents_by_id_and_text(spark):
    a, b, c = ("one two three four five six", "quite another text about nothing at all", "a third document of other words again")
    rows = [(1, a), (1, b), (2, b), (2, c), (3, c), (None, c), (None, "no id here but several words"), (None, "no id here but several words"), (4, a), (4, a), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _place int")
    kept = S.keep_one(docs)
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and got == sorted([(1, a), (1, b), (2, c), (None, "no id here but several words"), (5, "")], key=str)
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    hot = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same words in every row' as text")
    assert [r.text for r in S.keep_one(hot).collect()] == ["the same words in every row"]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(5000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "TEXT_BLOCK", 100)
    assert S.fingerprint(text.encode()) == whole
    assert S.fingerprint(b"one " + b" " * 300 + b"two three") == S.fingerprint(b"one two three")


@pytest.mark.parametrize("cut", [False, True])
def test_links_of_a_dense_group(spark, monkeypatch, cut):
    """Near copies around one centre, chains, and noise; with buckets cut into cells as well."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)}
    chain, x = [], int(rng.integers(1 << 62))
    for _ in range(12):
        chain.append(x)
        x ^= sum(1 << int(b) for b in rng.choice(63, 4, replace=False))
    noise = [int(v) for v in rng.integers(1 << 62, size=300)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in [*near, *chain, *noise]})
    if cut:
        monkeypatch.setattr(S, "BUCKET", 20)
        monkeypatch.setattr(S, "MOST_CUT", 10**6)
        monkeypatch.setattr(S, "CELL_OTHERS", 50)
        grid = S._cut_buckets(spark.createDataFrame([(v,) for v in values], "fp long"))
        assert any(x != (1, 1) for x in grid.values())
    links = S.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components({v: v for v in values})
    groups = lambda m: {frozenset(v for v in values if m.get(v, v) == r) for r in set(m.get(v, v) for v in values)}
    assert groups(got) == groups({v: want[v] for v in values})


def test_every_near_word_reaches_the_home():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(1 << 62), 1 << 62, 50)
    key, place, home = S.replicas(fp)
    assert home.sum() == 3 * len(fp)
    for n in range(len(fp)):
        for _ in range(20):
            other = np.array([fp[n] ^ np.int64(1 << int(rng.integers(63)))])
            k2, p2, h2 = S.replicas(other)
            assert set(k2[h2].tolist()) <= set(key[place == n].tolist())


@pytest.mark.parametrize("hot", [1000, 50])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, hot):
    from tableguard.llm import components as C

    monkeypatch.setattr(C, "HOT_LINKS", hot)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
