"""Suffix arrays, passage dedup, decontamination, top-k search, chats and pieces."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import arrays, chat, decontaminate, pieces, suffixes, topk
from tableguard.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.conftest import SF, by_id


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 50, 300):
        text = np.append(rng.integers(0, 3, size), 99)
        sa, rank = arrays.suffix_array(text, len(text))
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = arrays.common_prefixes(text, sa, 5)
        for k in range(1, len(text)):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            assert shared[k] == (differ[0] if len(differ) else n)
        low, high = arrays.prefix_ranges(text, sa, text, np.arange(len(text) - 2), np.full(len(text) - 2, 2))
        for i in range(len(text) - 2):
            assert sorted(sa[low[i] : high[i]].tolist()) == [j for j in range(len(text) - 1) if text[j : j + 2].tolist() == text[i : i + 2].tolist()]


def plain_removal(rows, window):
    seen = collections.Counter()
    for text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + window] for i in range(len(data) - window + 1))
    out = []
    for text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if seen[data[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_repeats_against_brute_force(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    want = sorted(((-1 if r.doc_id is None else r.doc_id), *w) for r, w in zip(rows, plain_removal([r.text for r in rows], 200), strict=True))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), *tuple(r)[1:]) for r in suffixes.digest(docs).collect())
    assert got == want


def test_repeats_with_a_hot_passage_in_several_shards(spark, monkeypatch, nothing):
    """One passage in every document, whose runs under one key are split over shards."""
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 4000)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = word(260)
    texts = [word(int(rng.integers(0, 120))) + passage + word(int(rng.integers(0, 120))) for _ in range(60)] + [word(500)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffixes.digest(docs).orderBy("doc_id").collect()]
    assert got == plain_removal(texts, 200)
    kept = suffixes.remove_repeats(docs).where("doc_id = 61").first()
    assert bytes(kept.kept) == b"" and suffixes.digest(nothing).count() == 0


def test_repeats_of_short_windows(spark):
    rng = np.random.default_rng(9)
    texts = ["".join("ab"[c] for c in rng.integers(0, 2, rng.integers(0, 80))) for _ in range(40)] + ["a" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = suffixes.repeated_spans(docs, window=12, gram=4).collect()
    want = plain_removal(texts, 12)
    by = collections.defaultdict(list)
    for r in spans:
        by[r["_id"]] += [s.asDict() for s in r["spans"]]
    for i, text in enumerate(texts):
        starts, ends = suffixes._union(by[i], 12)
        assert (len(text), int((ends - starts).sum()), len(starts)) == want[i][:3]


def test_spans_of_equal_rows_count_once(spark):
    text = " ".join(f"word{i * 7919 % 613}" for i in range(120))
    rows = [(None, text)] * 30 + [(1, "prefix " + text)] * 5 + [(2, "w " * 300)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = suffixes.repeated_spans(docs).collect()
    assert spans and all(len(r.spans) == len({tuple(s) for s in r.spans}) <= 1000 for r in spans)
    got = suffixes.digest(docs).collect()
    assert len(got) == len(rows) and all(r.n_removed == r.n_bytes for r in got if r.doc_id is None)


def test_decontamination_odd_rows(spark, messy, nothing, monkeypatch):
    from tests.llm.conftest import PASSAGE

    words = PASSAGE.split()
    items = [(1, " ".join(words[5:25])), (2, "Lazy DOG, near"), (3, None), (4, "..."), (5, "absent words only"), (2, "quick brown"), (6, " ".join(words[:13]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.measure(messy, benchmark).collect())
    assert (got[12].n_hit, got[12].n_items, got[12].contaminated) == (25, 2, True)
    assert (got[5].n_hit, got[5].n_items, got[5].contaminated) == (5, 1, True)
    assert got[5].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert (got[0].n_words, got[0].n_hit, got[0].contaminated) == (0, 0, False)
    kept = decontaminate.remove(messy, benchmark)
    assert kept.columns == messy.columns and kept.count() == sum(not r.contaminated for r in decontaminate.measure(messy, benchmark).collect())
    assert decontaminate.measure(nothing, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.measure(messy, benchmark.limit(0)).collect())
    few, whole = (decontaminate.matched(messy, benchmark, chunk_bytes=n) for n in (30, 1 << 20))
    assert few.columns == [*messy.columns, "matched"]
    assert few.select("doc_id", "matched").exceptAll(whole.select("doc_id", "matched")).count() == 0
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 30)
    assert by_id(decontaminate.measure(messy, benchmark).collect()) == got
    assert decontaminate.remove(messy, benchmark).count() == kept.count()


def plain_top(vectors, k):
    whole = [(i, [math.floor(256.0 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (10 if i % 7 == 0 else 1)]) for i in range(230)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, []), (350, [0.5, 0.5])]
    rows += [(400 + i, [1.0] * 6) for i in range(80)]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, norm string")
    want = plain_top(rows, 5)
    for block in (topk.BLOCK_BYTES, 1000):
        monkeypatch.setattr(topk, "BLOCK_BYTES", block)
        got = collections.defaultdict(list)
        for r in topk.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == {q: v for q, v in want.items() if v}
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    none = topk.top_k(table, F.lit(False))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    big = spark.createDataFrame([(0, [1e15, 3.0]), (1, [1e15, 1.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    rows = topk.top_k(big, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [1, 2] and rows[0].score == (1 << 63) - 1


def test_top_k_orders_scores_beyond_64_bits_exactly(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 0.0]), (2, [3e15, 0.0]), (3, [2e15, 1.0]), (4, [2e15, 2.0]), (5, [-1e15, 0.0]), (6, [-2e15, 0.0]), (7, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") == 0, 9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 3, 1, 7, 5, 6]
    assert [r.score for r in got] == [topk.HIGH] * 4 + [65536] + [topk.LOW] * 2


def test_top_k_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (7, [3.0, 0.5]), (7, [3.0, 0.5]), (8, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, 3).collect())
    want: collections.Counter = collections.Counter()
    for q, (i, a) in enumerate(rows):
        if i == 50:
            scores = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(a, b)), j) for n, (j, b) in enumerate(rows) if n != q)[:3]
            want.update((50, r + 1, j, -s) for r, (s, j) in enumerate(scores))
    assert got == want


def test_top_k_sends_blocks_only_where_they_reach(spark, monkeypatch):
    """Floors rise from band to band, and short blocks stay away from queries with high ones."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 3 * 0.995**i]) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64 * 20)  # 60 blocks of vectors, 2 of queries
    pairs, bands = [], []
    meet = topk._meetings

    def counted(blocks, asked, steps, size):
        met = meet(blocks, asked, steps, size)
        pairs.append(met.count())
        bands.append(blocks.count() * asked.count())
        return met

    monkeypatch.setattr(topk, "_meetings", counted)
    for most in (topk.BROADCAST_BYTES, 0):
        monkeypatch.setattr(topk, "BROADCAST_BYTES", most)
        pairs.clear(), bands.clear()
        got = collections.defaultdict(list)
        for r in topk.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == plain_top(rows, 5)
        assert pairs[0] == bands[0] and sum(pairs) < 60 * 2 / 2


def plain_chats(rows):
    out = {}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 200])
def test_chats_round_trip(spark, part_bytes):
    """Control strings, nulls, ties, and one conversation that holds a third of all rows."""
    nasty = ["\\### Assistant: </turn> ok", "\\b\\l\\h\\c", "</turn>\n### user: x", "", None, "é日😀", "\\", "###", "long " * 500]
    rows = [(c, t, ["user", "assistant", None, "a: b#<\\"][t % 4], nasty[(c + t) % len(nasty)]) for c in range(12) for t in range(1 + c % 7)]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(40)] + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "user", "no id"), (None, None, "assistant", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    old, chat.PART_BYTES = chat.PART_BYTES, part_bytes
    try:
        got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(turns)).collect()}
    finally:
        chat.PART_BYTES = old
    assert got == plain_chats(rows)
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_chat_parts_in_small_batches():
    """Runs that go on over batches, and parts of a run that is too large."""
    import pyarrow as pa

    rows = [(i // 5, i, "assistant" if i % 2 else "user", f"text {i} <#") for i in range(23)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a : a + 3]]), pa.array([r[1] for r in rows[a : a + 3]]), pa.array([r[2] for r in rows[a : a + 3]]), pa.array([r[3] for r in rows[a : a + 3]])], ["_id", "_turn", "_role", "_text"]) for a in range(0, 23, 3)]
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
    for limit in (1 << 20, 10):
        old, chat.PART_BYTES = chat.PART_BYTES, limit
        try:
            out = [r for b in chat._formatted(iter(batches), schema) for r in b.to_pylist()]
        finally:
            chat.PART_BYTES = old
        assert sum(r["last"] for r in out) == 5
        text = "".join(r["formatted"] for r in out)
        assert [(a.decode(), b.decode()) for a, b in chat.read_turns(text.encode())] == [(r[2], r[3]) for r in rows]
        assert [r["part"] for r in out if r["conv_id"] == 1] == list(range(sum(r["conv_id"] == 1 for r in out)))


def test_pieces_without_dropout_are_the_library_s(messy, documents):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (messy, documents):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in pieces.encode(docs, path, dropout=0.0).collect():
            assert r.lossless and r.n_pieces == len(r.pieces)
            if pieces.BLANK not in texts[r.doc_id]:
                assert r.pieces == coder.encode(texts[r.doc_id]), r.doc_id


def plain_pieces(text, key, processor, dropout):
    """One merge after the other over a list of (symbol, start, end): of the candidates that the keyed
    hash lets pass, the best score and of equal ones the leftmost; no arrays, no agenda, no linked list."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    limit = int(dropout * 2.0**64)
    known = {processor.id_to_piece(i): i for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))}
    marked = (" " + text if text else "").replace(" ", "\u2581")
    units, at = [], 0
    for k in range(1, len(marked) + 1):
        if k == len(marked) or marked[k] == "\u2581" and marked[k - 1] != "\u2581":
            units.append(marked[at:k])
            at = k
    out = []
    for number, unit in enumerate(units if marked else []):
        unit_key = mix(key ^ mix(number))
        parts = [(c, k, k + 1) for k, c in enumerate(unit)]
        while True:
            able = []
            for j in range(len(parts) - 1):
                (a, start, middle), (b, _, end) = parts[j], parts[j + 1]
                spot = (start << 42) ^ (middle << 21) ^ end
                if a + b in known and not mix(unit_key ^ mix(spot)) < limit:
                    able.append((-processor.get_score(known[a + b]), j))
            if not able:
                break
            j = min(able)[1]
            parts[j : j + 2] = [(parts[j][0] + parts[j + 1][0], parts[j][1], parts[j + 1][2])]
        for symbol, _, _ in parts:
            out += [known[symbol]] if symbol in known else [processor.piece_to_id(f"<0x{b:02X}>") for b in symbol.encode()]
    return out


@pytest.mark.parametrize("longest", [pieces.LONGEST, 3])
def test_pieces_with_dropout_are_those_of_the_plain_loop(monkeypatch, longest):
    """Units side by side and units with an agenda, against merging one pair after the other."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    processor, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.vocabulary(path)
    monkeypatch.setattr(pieces, "LONGEST", longest)
    texts = ["", " ", "  two  blanks ", "international tokenization of counterrevolutionaries", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve 日本語 \U0001F600 x", "ab" * 60, "unbroken" * 9, "The quick brown fox, 1234567890!"]
    keys = np.array([(i * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(len(texts))], np.uint64)
    for dropout in (0.0, 0.1, 0.5, 0.9):
        ids, at = pieces.encode_texts(texts, keys, v, dropout)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain_pieces(text, int(keys[i]), processor, dropout), (dropout, text)


def test_pieces_with_dropout(messy, nothing, documents):
    path = tokenizer_path("piece_bpe_32k.model")
    one, again, other = (pieces.encode(documents, path, 0.2, seed).orderBy("doc_id").collect() for seed in (1, 1, 2))
    assert one == again and one != other and all(r.lossless for r in one)
    plain = pieces.encode(documents, path, 0.0).agg(F.sum("n_pieces")).first()[0]
    assert sum(r.n_pieces for r in one) > 1.05 * plain
    texts = sorted((str(r.doc_id), r.text or "") for r in messy.collect())
    encoded = pieces.encode(messy, path, 0.5)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded, path).collect()) == texts
    added = pieces.with_pieces(messy, path, 0.5)
    assert added.columns == [*messy.columns, "pieces_", "n_pieces_"]
    assert sorted((str(r.doc_id), r.text or "") for r in added.collect()) == texts
    assert pieces.encode(nothing, path).count() == 0 and pieces.with_pieces(nothing, path).count() == 0
    every = pieces.encode(documents.limit(5), path, 1.0).collect()
    assert all(r.lossless for r in every)


def test_long_units_merge_as_short_ones(monkeypatch):
    v = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    texts = ["internationalisation theoretically misunderstood", "thethethe " * 9, "  éàü thing"]
    keys = np.arange(len(texts)).astype(np.uint64)
    want = [pieces.encode_texts(texts, keys, v, d) for d in (0.0, 0.3, 0.9)]
    monkeypatch.setattr(pieces, "LONGEST", 3)
    for d, (ids, at) in zip((0.0, 0.3, 0.9), want, strict=True):
        got = pieces.encode_texts(texts, keys, v, d)
        assert np.array_equal(got[0], ids) and np.array_equal(got[1], at)


def test_registered_queries(spark):
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda x: int(x[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) < set(QUERIES)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against the operator's plain meaning, on the smallest tables."""
    import corpus_pipeline as pipeline
    from tests.llm.test_simhash import plain_components, plain_fingerprint

    plain = spark.read.parquet(f"{SF}/documents.parquet")
    columns = plain.columns
    planted = [(10**6, "a note with password = abcdef123456 in it", "en", "s", 41), (10**6 + 1, None, None, None, None), (10**6 + 2, "12 -- 34", "en", "s", 8)]
    docs = plain.unionByName(spark.createDataFrame(planted, plain.schema))
    seen = [docs.collect()]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.collect())
        assert docs.columns[: len(columns)] == columns
    whole = plain.unionByName(spark.createDataFrame(planted, plain.schema))
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert ids[1] == {r.doc_id for r in seen[0] if any(c.isalpha() for c in r.text or "")}
    roots = plain_components({r.doc_id: plain_fingerprint(r.text) for r in seen[1]})
    assert ids[2] == set(roots.values()) and len(seen[2]) == len(ids[2])
    measured = decontaminate.measure(whole, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids[3] == ids[2] - {r.doc_id for r in measured.where("contaminated").collect()}
    assert ids[4] == ids[3] == ids[5]
    before, after, last = by_id(seen[3]), by_id(seen[4]), by_id(seen[5])
    assert all(("[SECRET]" in after[i].text) == (after[i].text != before[i].text) and after[i].text == last[i].text for i in ids[4])
    assert after[10**6].text == "a note with [SECRET] in it" and after[10**6].n_chars == 26
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == ids[5] - {10**6}
