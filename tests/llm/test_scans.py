"""Language ID, license scans, secret scans and token counts."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import langid, licenses, secrets, tokens, trigrams
from tableguard.llm.queries import QUERIES, tokenizer_path
from tests.llm.conftest import SF, by_id

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_secrets_against_plain_search(request, table):
    docs = request.getfixturevalue(table)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.digest(docs).collect():
        want = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_secret_rules_and_redaction(spark, messy, nothing):
    text = "é secret: 'abcdefgh12' gh" + "p_" + "A" * 36 + " Bearer abcdefghijklmnopqrst x" + "oxb-1234567890ab https://u:pw@h.example"
    docs = spark.createDataFrame([(1, text, 99), (2, "clean", 5)], "doc_id long, text string, n_chars int")
    kinds = {s["kind"] for s in secrets.scan(docs).where("doc_id = 1").first()["found"]}
    assert {"assign", "forge", "bearer", "chat", "login"} <= kinds
    out = by_id(secrets.redact(docs).collect())
    assert "abcdefgh12" not in out[1].text and out[1].n_chars == len(out[1].text) and tuple(out[2]) == (2, "clean", 5)
    again = secrets.redact(messy)
    assert again.columns == messy.columns and again.count() == messy.count()
    assert secrets.redact(nothing).count() == 0 and secrets.digest(nothing).count() == 0


def _key_texts():
    """Texts that hold a private key, and the parts of it that must go."""
    import base64

    raw = base64.b64encode(bytes(i * 89 % 251 for i in range(1210))).decode()
    lines = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    for label in ("PRIVATE KEY", "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK", "A" * 60 + " PRIVATE KEY"):
        begin, end = f"-----BEGIN {label}-----", f"-----END {label}-----"
        headers = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C", ""] if "RSA" in label else ["Version: GnuPG v1", ""] if "PGP" in label else []
        body = [*headers, *lines, *(["=aB3d"] if "PGP" in label else [])]
        parts = [begin, *(b for b in body if b)]
        for eol in ("\n", "\r\n", "\\n", "\n    ", "\n> ", "\n\n"):
            yield "before " + eol.join([begin, *body, end]) + eol + "after it", [*parts, end]
            yield "before " + eol.join([begin, *body]) + eol + "after it", parts
            yield "before " + eol.join([begin, *body[:-2], body[-2][:9]]), [*parts[:-2], body[-2][:9]]
        yield f"before {begin}\n{lines[0]}\n-----BEGIN CERTIFICATE-----\n after it", [begin, lines[0]]
        yield "before " + " ".join([begin, *lines, end]) + " after it", [*lines, end]


def test_no_line_of_a_private_key_is_left(spark):
    cases = list(_key_texts())
    docs = spark.createDataFrame([(i, text, len(text)) for i, (text, _) in enumerate(cases)], "doc_id long, text string, n_chars long")
    out = by_id(secrets.redact(docs).collect())
    for i, (text, gone) in enumerate(cases):
        assert not [g for g in gone if g in out[i].text], (text, out[i].text)
        assert out[i].text.startswith("before [SECRET]") and out[i].n_chars == len(out[i].text)
        assert out[i].text.endswith("after it") or not text.endswith("after it"), (text, out[i].text)
    pem = next(r for r in secrets.RULES if r.kind == "pem")
    assert trigrams.query_of(pem.pattern, pem.flags)
    # Prose after a marker stays, and many markers take no time that grows with their square.
    search = re.compile(pem.pattern, pem.flags)
    assert search.sub("", "-----BEGIN PRIVATE KEY----- is how it begins\n\nThen it goes on.") == " is how it begins\n\nThen it goes on."
    assert len(search.findall("-----BEGIN PRIVATE KEY-----\nx y - " * 50_000)) == 50_000
    assert search.sub("", "-----BEGIN PRIVATE KEY-----" + "\n" * 200_000 + "- x") == "\n" * 200_000 + "- x"


@pytest.mark.parametrize("url", ["https://u:" + "q" * 5000 + "@h.example", "https://" + "u" * 300 + ":pw@h.example", "redis://:pw@cache.example", "ftp://u:pw@HOST.EXAMPLE"])
def test_logins_of_any_length_user_and_host(spark, url):
    docs = spark.createDataFrame([(1, f"see {url} there", 9), (2, "http://h.example:80/a@b and ://::/@x", 9)], "doc_id long, text string, n_chars long")
    out = by_id(secrets.redact(docs).collect())
    assert out[1].text == f"see {url.split(':')[0]}[SECRET]{url.split('@')[1][1:]} there"
    assert "[SECRET]" not in out[2].text


def test_trigram_queries_never_miss():
    """Whatever a pattern matches passes its query; patterns without trigrams have none."""
    cases = [("ab(cd|ef)gh", "xxABefghyy", re.I), ("abc?def", "abdef", 0), ("(foo|ba[rz]+)x", "barzrzx", 0), ("[a-z]+", "hello", 0), ("a{3}b", "aaab", 0), ("(x|y)(abc|abd)*q", "xq", 0)]
    import numpy as np

    for pattern, text, flags in cases:
        query = trigrams.query_of(pattern, flags)
        postings = trigrams.Postings([query])
        data = np.frombuffer(text.encode() + b"zzz", np.uint8)
        found = postings.index(data, np.array([0, len(text), len(text) + 3]))
        assert postings.rows(found, query)[0], pattern
    assert trigrams.query_of("[0-9a-f]{32,}") == [] and len(trigrams.query_of(ASSIGN, re.I)) == 1


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_license_places_against_plain_search(request, table):
    docs = request.getfixturevalue(table)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places, labels = [i for i, _ in found], sorted({x for _, x in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_priorities_and_containment(nothing):
    labels = lambda text: sorted({r.label for *_, r in licenses.detections(licenses.words_text(text.encode()))})
    assert labels("Licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2"]
    assert labels("licensed under CC BY-NC-SA 4.0, docs under the MIT License") == ["cc-by-nc-sa", "mit"]
    assert labels("licensed to drive") == [] and len(licenses.rules()) > 300
    assert licenses.scan(nothing).count() == 0
    # Every detection's keyword and stem are there, so the gates lose nothing.
    for rule in licenses.rules():
        assert rule.keywords


def _spellings(tree):
    """Strings a rule matches, every option of every part among them."""
    out = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            part = [chr(value)]
        elif name == "IN":
            part = [c for c in "0123456789abcdefghijklmnopqrstuvwxyz" if any(str(k) == "CATEGORY" or (v == ord(c) if str(k) == "LITERAL" else v[0] <= ord(c) <= v[1]) for k, v in value)]
        elif name == "SUBPATTERN":
            part = _spellings(value[3])
        elif name == "BRANCH":
            part = [s for option in value[1] for s in _spellings(option)]
        elif name == "MAX_REPEAT":
            part = ["", *_spellings(value[2])]
        else:
            assert name == "ASSERT"  # the spaces around
            continue
        # Each option stands in a string, though not each pair of options.
        out = [out[k % len(out)] + part[k % len(part)] for k in range(len(out) * len(part) if len(out) * len(part) <= 64 else max(len(out), len(part)))]
    return out


def test_license_gates_lose_no_match_of_any_rule():
    for rule in licenses.rules():
        for text in _spellings(re._parser.parse(rule.pattern.pattern.decode())):
            words = licenses.words_text(f"data {text} end".encode())
            assert rule.pattern.search(words), (rule, text)
            assert not rule.keywords.isdisjoint(words.split()) and (not rule.cues or not rule.cues.isdisjoint(words.split())), (rule, text)
            found = licenses.scan_words(words)[1]
            assert found and found == licenses.detections(words), text
    for text, label in [("data: ODbL 1.0", "odbl-1"), ("WTFPL", "wtfpl"), ("PDDL", "pddl-1"), ("GFDL", "gfdl-1.3"), ("Apache 2.0", "apache-2")]:
        assert [r.label for *_, r in licenses.scan_words(licenses.words_text(text.encode()))[1]] == [label]


def test_token_counts_are_the_library_s(messy, nothing, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    special = documents.sparkSession.createDataFrame([(1, "a <|endoftext|>b  Ć 'S don't 12"), (2, "<|startoftext|><|endoftext|>")], "doc_id long, text string")
    for docs in (messy, documents, special):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in tokens.count_tokens(docs, path).collect():
            text = texts[r.doc_id]
            n = len(coder.encode(text, add_special_tokens=False))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048), r.doc_id
    assert tokens.count_tokens(nothing, path).count() == 0


def test_token_counts_of_a_sentencepiece_model(documents):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.n_tokens == len(coder.encode(texts[r.doc_id])) for r in tokens.count_tokens(documents, path).collect())


def test_language_of_held_out_documents(spark, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == documents.count() and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    want = documents.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: r.h for r in want}


def test_language_odd_rows(documents, messy, nothing):
    model = langid.train(documents, ~langid.held_out())
    rows = langid.predict(messy, model).collect()
    got = by_id(rows)
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and got[0].score == 0
    assert got[17].lang_pred == "de" and got[None].held_out is False
    kept = langid.keep_known(messy, model, 0.0)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4
    assert langid.predict(nothing, model).count() == 0
    empty = langid.train(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.predict(messy, empty).collect()} == {"und"}


def test_texts_with_letters_stay_if_there_is_nothing_to_learn(spark, messy, nothing):
    empty = langid.train(nothing, F.lit(True))
    assert langid.keep_known(messy, empty, 0.0).count() == langid.keep_known(messy, empty).count() == messy.count() - 4
    import corpus_pipeline

    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == messy.count() - 4
    assert langid.keep_known(nothing, empty).count() == 0


def test_language_scores_do_not_depend_on_blocks(documents, monkeypatch):
    model = langid.train(documents, ~langid.held_out(), rows=20)
    texts = [r.text for r in documents.limit(40).collect()] + ["", "12"]
    want = langid.score_texts(texts, model)
    monkeypatch.setattr(langid, "BLOCK", 97)
    got = langid.score_texts(texts, model)
    assert got[0] == want[0] and all(abs(a - b) < 1e-3 for a, b in zip(got[1], want[1], strict=True))


def plain_bayes(training, texts):
    """Naive Bayes with dictionaries: hashed n-grams of letters one by one, half a count more for every bucket."""
    import unicodedata

    def grams(text):
        points = [c if unicodedata.category(c)[0] == "L" else " " for c in f"  {text.lower()}    "]
        for size in langid.SIZES:
            for i in range(len(points) - 2):
                h = ord(points[i]) * 0x9E3779B1 % (1 << 32)
                for k in range(1, size):
                    h = (h ^ ord(points[i + k])) * (0x85EBCA6B, 0xC2B2AE35)[k - 1] % (1 << 32)
                yield (h ^ h >> 15) * (0x2C1B3C6D + 2 * size) % (1 << 32) >> (32 - langid.BUCKET_BITS)

    counts = {}
    for lang, text in training:
        counts.setdefault(lang, collections.Counter()).update(grams(text))
    out = []
    for text in texts:
        if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
            out.append(("und", 0.0))
            continue
        mine = collections.Counter(grams(text))
        total = {k: sum(n * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (1 << langid.BUCKET_BITS))) for g, n in mine.items()) for k, c in counts.items()}
        best = min(total, key=lambda k: (-total[k], k))
        out.append((best, 1 / sum(math.exp(x - total[best]) for x in total.values())))
    return out


def test_language_against_plain_bayes_in_one_slab_and_several(spark, messy, monkeypatch):
    """Any number of labels; rows without id are learnt from; equal rows once, rows of one id each for itself."""
    rows = [(i, f"{'abcdefg'[i % 7] * 3}{'xyz'[i % 3]} word{'qrstuvw'[i % 7]} Été {i}", f"l{i % 7}") for i in range(40)]
    rows += [(None, "without any id zzz", "l8"), (None, "without any id zzz", "l8"), (5, "other text of the same id", "l9"), (5, "a third text of it", "l9"), (77, None, "l1"), (78, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = sorted({(i, t, x) for i, t, x in rows if t is not None and x is not None}, key=str)
    texts = [t for _, t, _ in rows] + ["", "12", "zzz without", "WORDQ été"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_so_far", F.lit("clash")).withColumn("_lang", F.lit("clash"))
    want = plain_bayes([(x, t) for _, t, x in training], texts)
    for slab, sizes in ((1024, 100_000), (4, 100_000), (1, 0)):
        monkeypatch.setattr(langid, "SLAB_LANGUAGES", slab)
        monkeypatch.setattr(langid, "SIZES_BROADCAST", sizes)
        model = langid.train(docs, F.lit(True))
        assert len(model.more) == (0 if slab > 9 else -(-9 // slab) - 1)
        got = by_id(langid.predict(asked, model).collect())
        for k, (lang, score) in enumerate(want):
            assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-3, (slab, texts[k])
        kept = langid.keep_known(asked, model, 0.3)
        assert kept.columns == asked.columns
        assert sorted(r.doc_id for r in kept.collect()) == [k for k, r in got.items() if r.score >= 0.3 and r.lang_pred != "und"]


def test_language_sample_is_bounded_and_spread(spark):
    """A row repeated ten thousand times fills one place of the sample; others are learnt beside it."""
    many = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'same text again' as text", "'a' as lang")
    docs = many.unionByName(spark.range(500).selectExpr("id as doc_id", "concat('text number ', repeat(chr(97 + id % 26), 3)) as text", "'a' as lang"))
    model = langid.train(docs, F.lit(True), rows=10)
    assert model.languages == ["a"] and len(langid.train(docs.limit(0), F.lit(True)).languages) == 0
    few = langid.train(many, F.lit(True), rows=10)
    grams = 2 * (len("same text again") + 4)
    once = 0.5 / (grams + 0.5 * (1 << langid.BUCKET_BITS))  # the text was counted once
    assert few.languages == ["a"] and np.isclose(np.exp(few.weights.astype(np.float64)).min(), once, rtol=1e-3)


def test_pipeline_keeps_what_the_prediction_tells(spark, documents, messy, monkeypatch):
    """The stage's threshold decides, and it costs no held-out document."""
    import corpus_pipeline

    assert corpus_pipeline.language_id(spark, documents, SF).count() == documents.count()
    split = messy.withColumn("lang", F.lit(None).cast("string")).unionByName(documents, allowMissingColumns=True).select(messy.columns)
    letters = F.explode(F.split(F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z"), " "))
    split = split.unionByName(split.limit(1).withColumn("doc_id", F.lit(-5).cast("long")).withColumn("text", letters))
    told = langid.predict(split, langid.train(split, ~langid.held_out())).collect()
    for least in (corpus_pipeline.LEAST, 0.999):
        monkeypatch.setattr(corpus_pipeline, "LEAST", least)
        want = collections.Counter(r.doc_id for r in told if r.lang_pred != "und" and r.score >= least)
        kept = corpus_pipeline.language_id(spark, split, SF)
        assert kept.columns == split.columns and collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == want
    assert want[-5] < 26  # single letters do not tell a language for sure
