"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled rows per language; the counts are
summed by Spark, and the matrix of log-probabilities (languages by buckets, a fixed size per
language) is broadcast. Prediction scores whole texts in numpy: n-gram numbers of a part of a
batch, gathered from the matrix and summed per text. Labels may be of any number: beyond
``SLAB_LANGUAGES`` the matrix is broadcast in slabs of that many, one pass over the texts for each,
which keeps the best language so far and the sum of the posteriors.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there is
nothing to learn from (``keep_known`` then keeps every text with a letter); ties go to the language that sorts first; a text of any length is scored
whole, block by block; repeated rows give repeated results; a null id is never held out and its row
is learnt from; equal rows are learnt once, rows that share an id each for itself. Only the id, the
text and, in training, the language are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableguard.llm.batches import arrow_schema, id_type, keep_rows, map_arrow, map_batches, slices, starts_of
from tableguard.operators.spread import spread_left_join
from tableguard.session import cut_lineage

UNKNOWN = "und"
#: n-gram sizes, buckets (a power of two), characters handled at a time, bytes of text per part.
SIZES, BUCKET_BITS, BLOCK, PART = (2, 3), 16, 1 << 19, 1 << 20
_PAD = " " * (max(SIZES) - 1)
#: Rows per language that the model learns from, the bound of the training sample.
SAMPLE_ROWS = 2000
#: Languages whose log-probabilities are broadcast at once: 256 MB.
SLAB_LANGUAGES = 1024
#: Most languages whose numbers of rows are broadcast; more are joined by a shuffle.
SIZES_BROADCAST = 100_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets by languages, log-probabilities
    more: list["Slab"] = field(default_factory=list)  # of the languages that sort behind


@dataclass(frozen=True)
class Slab:
    """Languages of a model whose weights are still counts in a table."""

    counts: DataFrame  # lang, bucket, n
    languages: list[str]

    def load(self) -> Model:
        first, last = self.languages[0], self.languages[-1]
        counted = self.counts.where(F.col("lang").between(first, last)).toArrow()
        weights = np.full((1 << BUCKET_BITS, len(self.languages)), 0.5)
        column = {x: k for k, x in enumerate(self.languages)}
        place = np.array([column[x] for x in counted["lang"].to_pylist()], np.int64)
        weights[counted["bucket"].to_numpy(), place] += counted["n"].to_numpy()
        return Model(self.languages, (np.log(weights) - np.log(weights.sum(axis=0))).astype(np.float32))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    return table


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, other than letters as 32, and the rows' offsets.

    Blanks stand before and behind every text and at the very end, so the n-grams that begin in a
    text and its blanks are the same whatever texts stand beside it.
    """
    lower = [_PAD + t.lower() + _PAD for t in texts]
    at = starts_of(np.array([len(t) for t in lower], dtype=np.int64))
    points = np.frombuffer("".join([*lower, _PAD]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[points], points, np.uint32(32)), at


def _grams(points: np.ndarray, start: int, end: int, size: int) -> np.ndarray:
    """Buckets of the n-grams that begin in a block."""
    end = min(end, len(points) - len(_PAD))
    if end <= start:
        return np.zeros(0, dtype=np.uint32)
    h = points[start:end] * np.uint32(0x9E3779B1)
    for k in range(1, size):
        h = (h ^ points[start + k : end + k]) * np.uint32((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[k - 1])
    return (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * size) >> np.uint32(32 - BUCKET_BITS)


def _blocks(points: np.ndarray):
    for start in range(0, len(points) - len(_PAD), BLOCK):
        for size in SIZES:
            yield start, _grams(points, start, start + BLOCK, size)


def train(docs: DataFrame, labelled: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the rows where ``labelled`` holds: of each language those with the smallest hashes.

    Only rows whose hash lies below twice the expected place of the last one are ranked, so the
    ranking sees about twice the sample, however many rows a language has. A row's hash is that of
    its id, or of its text where it has none.
    """
    names = (F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    usable = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(*names)
    place = F.shiftrightunsigned(F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.xxhash64("_id")), 33)  # 31 bits
    usable = usable.withColumn("_place", place)
    # Repeated rows share a place, so what counts is the number of places.
    sizes = cut_lineage(usable.groupBy("_lang").agg(F.approx_count_distinct("_place", 0.02).alias("_n")))
    labels = sizes.count()
    sized = usable.join(F.broadcast(sizes), "_lang") if labels <= SIZES_BROADCAST else spread_left_join(usable, sizes, "_lang")
    low = sized.where(F.col("_place") <= F.lit(2.0**31) * 2 * rows / F.col("_n"))
    once = low.withColumn("_row", F.xxhash64("_id", "_text")).groupBy("_lang", "_place", "_row").agg(F.min("_text").alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_place", "_row"))
    sample = once.withColumn("_rank", rank).where(F.col("_rank") <= rows).select("_text", "_lang")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def part(batch: pa.RecordBatch) -> dict:
        langs, names = batch.column("_lang").to_pylist(), []
        buckets, counts = [], []
        texts = batch.column("_text").to_pylist()
        for lang in sorted(set(langs)):
            points, _ = _points([t for t, x in zip(texts, langs, strict=True) if x == lang])
            total = sum((np.bincount(g, minlength=1 << BUCKET_BITS) for _, g in _blocks(points)), np.zeros(1 << BUCKET_BITS, np.int64))
            there = np.flatnonzero(total)
            buckets.append(there)
            counts.append(total[there])
            names += [lang] * len(there)
        return {"lang": names, "bucket": np.concatenate(buckets).astype(np.int32), "n": np.concatenate(counts)}

    counted = map_batches(sample, part, schema, "_text").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if labels > SLAB_LANGUAGES:
        counted = cut_lineage(counted)
        languages = sorted(r["lang"] for r in counted.select("lang").distinct().toLocalIterator())
        slabs = [Slab(counted, languages[k : k + SLAB_LANGUAGES]) for k in range(0, len(languages), SLAB_LANGUAGES)]
        head = slabs[0].load()
        return Model(head.languages, head.weights, slabs[1:])
    table = counted.toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    weights = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    column = np.searchsorted(languages, table["lang"].to_pylist()) if languages else np.zeros(0, int)
    weights[table["bucket"].to_numpy(), column] += table["n"].to_numpy()
    return Model(languages, (np.log(weights) - np.log(weights.sum(axis=0))).astype(np.float32))


def _count_letters(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of each text."""
    return np.add.reduceat(np.append(points != 32, False), at[:-1], dtype=np.int64) if len(at) > 1 else np.zeros(0, np.int64)


def _totals(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each text in each language, and its letters."""
    points, at = _points(texts)
    rows = len(texts)
    total = np.zeros((rows, len(model.languages)))
    for start, grams in _blocks(points):
        if not len(grams):
            continue
        first = int(np.searchsorted(at, start, side="right")) - 1
        last = int(np.searchsorted(at, start + len(grams), side="left"))
        cuts = np.maximum(at[first:last] - start, 0)
        for k in range(len(model.languages)):
            total[first:last, k] += np.add.reduceat(model.weights[:, k][grams], cuts, dtype=np.float64)
    return total, _count_letters(points, at)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Best language of each text and its posterior probability, all languages being as likely."""
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total, letters = _totals(texts, model)
    best = total.argmax(axis=1)
    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, [p if n else 0.0 for p, n in zip(posterior.tolist(), letters.tolist(), strict=True)]


_SO_FAR = T.StructType([T.StructField("lang", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("sum", T.DoubleType())])


def _by_slabs(docs: DataFrame, model: Model, text_col: str, lang: str, score: str) -> DataFrame:
    """All rows and columns, with the best language and its score, one slab of languages after the other.

    Each pass writes the rows with their best language so far, so no task and no executor holds
    more than one slab.
    """
    state = "_so_far"
    while state in docs.columns:
        state += "_"
    place = docs.columns.index(text_col)
    docs = docs.withColumn(state, F.lit(None).cast(_SO_FAR))
    arrow = arrow_schema(docs.schema)

    def one_pass(df: DataFrame, slab: Model) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(_fast(slab))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, place, PART):
                    total, letters = _totals(part.column(place).fill_null("").to_pylist(), shared.value)
                    old = part.column(part.num_columns - 1).to_pylist()
                    new = [_fold(o, t, shared.value.languages) if n else None for o, t, n in zip(old, total, letters.tolist(), strict=True)]
                    kind = arrow.field(len(arrow) - 1).type
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(new, kind)], schema=arrow)

        done = cut_lineage(map_arrow(df, run, docs.schema))
        shared.unpersist()
        return done

    for slab in (Model(model.languages, model.weights), *model.more):
        docs = one_pass(docs, slab if isinstance(slab, Model) else slab.load())
    found = F.col(state)
    told = {lang: F.coalesce(found["lang"], F.lit(UNKNOWN)), score: F.coalesce(1 / found["sum"], F.lit(0.0))}
    return docs.withColumns(told).drop(state)


def _fold(old: dict | None, total: np.ndarray, languages: list[str]) -> dict:
    """The best language so far, its log-probability, and the sum of all relative to it."""
    k = int(total.argmax())
    top = float(total[k])
    part = float(np.exp(total - top).sum())
    if old is None or top > old["top"]:
        return {"lang": languages[k], "top": top, "sum": part + (old["sum"] * float(np.exp(old["top"] - top)) if old else 0.0)}
    return old | {"sum": old["sum"] + part * float(np.exp(top - old["top"]))}


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _fast(model: Model) -> Model:
    return Model(model.languages, np.asfortranarray(model.weights))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every text."""
    if model.more:
        narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
        told = _by_slabs(narrow, model, "_text", "lang_pred", "score")
        return told.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(_fast(model))
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def part(batch: pa.RecordBatch) -> dict:
        names, scores = score_texts(batch.column("_text").fill_null("").to_pylist(), shared.value)
        return {id_col: batch.column("_id"), "held_out": batch.column("_held"), "lang_pred": names, "score": scores}

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), held_out(id_col).alias("_held"))
    return map_batches(narrow, part, schema, "_text", limit=PART)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows with a language that scores ``least`` or more, with all their columns.

    A model without languages cannot reject a text: then all rows with a letter stay.
    """
    if model.more:
        names = []
        for name in ("_lang", "_score"):
            while name in docs.columns:
                name += "_"
            names.append(name)
        told = _by_slabs(docs, model, text_col, *names)
        return told.where((F.col(names[1]) >= least) & (F.col(names[0]) != UNKNOWN)).drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(_fast(model))

    def mask(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column(text_col).fill_null("").to_pylist()
        if not shared.value.languages:
            return _count_letters(*_points(texts)) > 0
        names, scores = score_texts(texts, shared.value)
        return (np.array(scores) >= least) & (np.array(names) != UNKNOWN)

    return keep_rows(docs, text_col, mask, PART)
