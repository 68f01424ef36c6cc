"""How far the words of each source are from those of its language and of its other sources.

A group is a pair of language and source. Terms are counted per task and added up by shuffles, so a
source that holds a third of all rows costs as many rows as it has different terms. A language keeps
the terms that enough of its documents hold. Shares of terms are whole numbers of a billionth, with
every count raised a little, and the divergence of two groups is the sum over the kept terms of
floor((p - q)^2 / (p + q)).

All pairs of groups are compared in a cube: groups are dealt to blocks (two axes) and terms to
blocks (the third), both by hash. A task owns a cell (group block, group block, term block). The
slice of a group block and a term block is sent to every cell of that group block's row and column,
and each cell adds up what its terms give for its pairs; only terms that some group of the cell
holds are laid out, since all others give each pair one known number. A sum along the term axis
finishes the pairs. A cell holds about 2 x ``GROUPS`` groups times ``TERMS`` terms whatever the
input; every pair is wanted, so the output has the square of the number of sources of a language.

Nulls in language, source or text are read as ''. A group without terms has counts of 0; a language
that keeps no term gives its pairs 0. Rows need no id; repeated rows count repeatedly. An empty table
gives no rows. Other columns are not read, so their names cannot clash. Text of any length is cut
into blocks between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableguard.llm.batches import hand_over, map_arrow
from tableguard.llm.tables import new_folder, remove, written
from tableguard.session import cut_lineage

#: Documents of its language that hold a kept term, and best terms reported of a group.
LEAST_DOCUMENTS, BEST_TERMS = 10, 10
#: About so many groups and terms in a block.
GROUPS, TERMS = 64, 4096
#: Shares are in units of 1 / SCALE; a count is raised by RAISED.
SCALE, RAISED = 1_000_000_000, 2
#: Different terms a task holds before it hands them on, and bytes of a text looked at together.
HELD_TERMS, BLOCK_BYTES = 400_000, 4 << 20

#: A-Z in lower case; every byte that is neither a letter nor part of a longer character is a space.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def blocks_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in the order they stand, some at a time."""
    laid = text.translate(_TERM_BYTES)
    at = 0
    while len(laid) - at > BLOCK_BYTES:
        cut = laid.find(b" ", at + BLOCK_BYTES)
        if cut < 0:
            break
        yield laid[at:cut].split()
        at = cut
    yield laid[at:].split()


class _Counts:
    """Counts by group and term of the documents seen so far."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        places, documents = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before = len(places)
        seen: set[bytes] = set()
        for terms in blocks_of_terms(text):
            places.update(terms)
            seen.update(terms)
        documents.update(seen)
        self.held += len(places) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (places, documents) in self.groups.items():
            terms = [None, *places]  # the row without a term stands for the group
            n = [0, *places.values()]
            d = [0, *map(documents.__getitem__, places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                names=["lang", "source", "term", "n", "d"],
            )


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (places) and d (documents), and one row without term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary())):
                counts.add(lang, source, text.as_py())
                if counts.held > HELD_TERMS:
                    yield from counts.batches()
                    counts = _Counts()
        yield from counts.batches()

    read = docs.select(*(F.coalesce(docs[c], F.lit("")) for c in (lang_col, source_col, text_col)))
    parts = map_arrow(read, run, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + RAISED) / (total + RAISED * kept)), exactly; 1 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + RAISED)
    return F.when(kept > 0, F.call_function("div", top, wide(total + RAISED * kept)) + 1).otherwise(F.lit(1).cast("long"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Counts of the terms that at least ``least`` documents of the language hold, with ``c`` places
    in the language and ``lead``, true for one group of each term; rows without term stay."""
    terms = (
        counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
        .agg(F.sum("d").alias("_d"), F.sum("n").alias("c"), F.min("source").alias("_lead")).where(F.col("_d") >= least)
    )
    joined = counts.join(terms, ["lang", "term"], "left")
    kept = joined.where(F.col("term").isNull() | F.col("c").isNotNull())
    return kept.select("lang", "source", "term", "n", "c", F.coalesce(F.col("_lead") == F.col("source"), F.lit(False)).alias("lead"))


def _groups(kept: DataFrame) -> DataFrame:
    """Places of each group, and of its language: places, kept terms and groups."""
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("_own"),
        F.sum(F.col("lead").cast("long")).alias("_kept"),
        F.sum(F.when(F.col("lead"), F.col("c")).otherwise(0)).alias("_all"),
    )
    langs = groups.groupBy("lang").agg(F.sum("_kept").alias("kept"), F.sum("_all").alias("all"), F.count(F.lit(1)).alias("groups"))
    own = F.coalesce(F.col("_own"), F.lit(0)).alias("own")
    return groups.join(langs, "lang").select("lang", "source", own, "kept", "all", "groups")


def _cell_sums(table: pa.Table) -> pa.Table:
    """What the terms of one cell give for each pair of its groups, in both directions."""
    sides = []
    marks = table.filter(pa.compute.is_null(table["term"]))
    cells = table.filter(pa.compute.is_valid(table["term"]))
    terms = pa.concat_arrays(cells["term"].chunks) if cells.num_rows else pa.array([], pa.string())
    coded = terms.dictionary_encode()
    place, n_terms = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    block = cells["block"].to_numpy()
    for side in ("a", "b"):
        number = marks[side][0].as_py()
        own = marks.filter(pa.compute.equal(marks["block"], number))
        names = own["source"].to_pylist()
        row = {name: i for i, name in enumerate(names)}
        absent = own["p"].to_numpy()
        shares = np.repeat(absent[:, None], n_terms, axis=1)
        mine = np.flatnonzero(block == number)
        held = cells["source"].take(pa.array(mine)).to_pylist()
        shares[np.fromiter((row[s] for s in held), np.int64, len(held)), place[mine]] = cells["p"].to_numpy()[mine]
        sides.append((names, shares, absent))
    (names_a, left, absent_a), (names_b, right, absent_b) = sides
    same = marks["a"][0].as_py() == marks["b"][0].as_py()
    out: dict[str, list] = {c: [] for c in ("source", "item", "part", "absent")}
    for i, name in enumerate(names_a):
        at = i + 1 if same else 0
        part = ((left[i] - right[at:]) ** 2 // (left[i] + right[at:])).sum(axis=1).tolist()
        absent = ((absent_a[i] - absent_b[at:]) ** 2 // (absent_a[i] + absent_b[at:])).tolist()
        for one, other in ((([name] * len(part)), names_b[at:]), (names_b[at:], [name] * len(part))):
            out["source"] += one
            out["item"] += other
            out["part"] += part
            out["absent"] += absent
    n = len(out["part"])
    return pa.table({
        "lang": pa.array([marks["lang"][0].as_py()] * n, pa.string()), "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()),
        "part": pa.array(out["part"], pa.int64()), "absent": pa.array(out["absent"], pa.int64()),
        "terms": pa.array([n_terms] * n, pa.int64()), "kept": pa.array([marks["kept"][0].as_py()] * n, pa.int64()),
    })


def _pairs(shares: DataFrame, marks: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, by cells."""
    columns = ["lang", "source", "term", "p", "kept", "slot", "block", "blocks"]
    slices = marks.withColumn("term", F.lit(None).cast("string")).select(*columns).unionByName(shares.select(*columns))
    met = slices.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select(
        "lang", "source", "term", "p", "kept", "slot", "block",
        F.least("block", "_met").alias("a"), F.greatest("block", "_met").alias("b"),
    )
    sums = cells.groupBy("lang", "a", "b", "slot").applyInArrow(
        _cell_sums, "lang string, source string, item string, part long, absent long, terms long, kept long"
    )
    value = F.sum("part") + (F.max("kept") - F.sum("terms")) * F.max("absent")
    return sums.groupBy("lang", "source", "item").agg(value.alias("value"))


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, best: int = BEST_TERMS, groups: int = GROUPS, terms: int = TERMS,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value and rank: divergence from each other source of the language
    (part ``pair``), and the ``best`` terms that stand out against the language (part ``term``).

    The counts are written to the shared folder and removed again.
    """
    spark = docs.sparkSession
    hand_over(spark)
    folder = new_folder(spark, "divergence")
    counts = written(term_counts(docs, lang_col, source_col, text_col), f"{folder}/counts")
    kept = written(kept_terms(counts, least), f"{folder}/kept")
    known = written(_groups(kept), f"{folder}/groups")
    most = known.agg(F.max("kept")).first()[0] or 0
    slots = max(1, -(-most // terms))
    blocks = F.ceil(F.col("groups") / groups).cast("int")
    slot = F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int").alias("slot")
    # Each group meets its terms slot by slot, so that a group of many terms is not one task.
    marks = known.select(
        "lang", "source", "own", "kept", "all", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"),
        _share(F.lit(0).cast("long"), F.col("own"), F.col("kept")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    held = kept.where(F.col("term").isNotNull()).select("lang", "source", "term", "n", "c", slot)
    shares = held.join(marks.drop("p"), ["lang", "source", "slot"]).withColumns({
        "p": _share(F.col("n"), F.col("own"), F.col("kept")), "q": _share(F.col("c"), F.col("all"), F.col("kept")),
    })
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(shares, marks).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})
    stand_out = shares.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select(
        "lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value")
    )
    top = stand_out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = cut_lineage(pairs.select(*columns).unionByName(top.select(*columns)))
    remove(spark, folder)
    return out
