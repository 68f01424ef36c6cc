import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tableguard.llm import periods as P
from tests.llm.conftest import by_id


def plain_runs(words, least=24, times=3):
    """(start, length, smallest period) of every run, by comparing each word with the one a period on."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(text, h):
    words = (text or "").encode().split()
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def made_up(rng, n):
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 10, 50]))}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(a + p, rng.randint(a, n)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_made_up_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [made_up(rng, rng.randint(0, 220)) for _ in range(rng.randint(1, 6))]
        least = rng.choice([24, 24, 3, 6])
        words = P.words_of(pa.array([rng.choice([" ", "\n", " \t"]).join(t) for t in texts]))
        runs = P.runs_of(words, least)
        for row, text in enumerate(texts):
            at = slice(runs.first[row], runs.first[row + 1])
            assert list(zip(runs.start[at].tolist(), runs.length[at].tolist(), runs.period[at].tolist())) == plain_runs(text, least)


def test_grammar_tells_how_far_places_agree():
    rng = np.random.default_rng(5)
    for size, letters in ((3000, 2), (500, 1), (4000, 5)):
        words = rng.integers(0, letters, size)
        words[size // 2 :] = words[: size - size // 2]
        sequence = np.concatenate([[letters], words, [letters + 1]])
        grammar = P.Grammar(sequence, letters)
        assert grammar.up and len(grammar.symbols[-1]) <= P.SHORT + 2
        i = rng.integers(1, size // 2, 300)
        j = i + rng.integers(1, size // 2, 300)
        for sign in (1, -1):
            want = []
            for a, b in zip(i, j):
                n = 0
                while 0 <= a + sign * n and b + sign * n < len(sequence) and sequence[a + sign * n] == sequence[b + sign * n]:
                    n += 1
                want.append(n)
            assert grammar.reach(i, j, sign).tolist() == want


def test_query_against_brute_force(spark, documents):
    from tableguard.llm.queries import QUERIES

    rows = QUERIES["op12_periodic_run_detection"](spark, "/root/testdata/sf0.001").collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    want = {r.doc_id: plain_row(r.text, zlib.crc32(str(r.doc_id).encode())) for r in documents.collect() if len((r.text or "").split()) < 4000}
    assert {k: got[k] for k in want} == want and len(rows) == documents.count()
    assert any(w[0] for w in want.values())


def test_odd_rows(messy, nothing):
    rows = P.digest(messy).collect()
    assert len(rows) == messy.count()
    got = by_id(rows)
    for r in messy.collect():
        assert tuple(got[r.doc_id])[1:] == plain_row(r.text, None)
    assert got[0].n_runs == 0 and got[0].start is None and got[0].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[8].start, got[8].length, got[8].period) == (0, 12_000, 1)
    assert P.digest(nothing).count() == 0 and P.find_runs(nothing).count() == 0
    planted = by_id(P.with_planted_runs(messy).collect())
    assert planted[None].text == "text without an id, long enough to be a sentence of words" and planted[0].text is None


def test_found_and_collapsed(messy, nothing):
    assert [tuple(r) for r in P.find_runs(messy).where("doc_id = 8").collect()] == [(8, 0, 12_000, 1)]
    left = P.collapse(messy)
    assert left.columns == messy.columns and P.collapse(nothing).count() == 0
    before, after = by_id(messy.collect()), by_id(left.collect())
    assert after[8].text == "na" and all(after[i].text == before[i].text for i in before if i != 8)


def test_long_text_of_one_word():
    words = P.words_of(pa.array(["na " * 200_000, "x" * 1_000_000]))
    runs = P.runs_of(words)
    assert (runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), runs.first.tolist()) == ([0], [200_000], [1], [0, 1, 1])
    with pytest.raises(ValueError):
        P.runs_of(words, times=2)
