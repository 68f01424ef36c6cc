"""Secret scans: regular expressions behind a trigram index.

Each rule's pattern yields a Boolean query over trigrams that every match must contain. For each
part of a batch the postings of those trigrams are built in numpy, intersected per rule, and only
the rows that remain are searched with the rule's pattern. A rule without a mandatory trigram is
searched in every row.

Null texts count as empty; matches of one rule are leftmost and do not overlap, matches of
different rules may; positions are code points, the end is exclusive; repeated rows give repeated
results; no other column is read by ``scan``, and ``redact`` passes all columns through. A private
key goes from its BEGIN line to the first END line of a private key; if another BEGIN or the end of
the text comes before, over the key's header and base64 lines that follow, however many.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tableguard.llm.batches import column_bytes, doc_columns, id_type, map_arrow, map_batches, slices
from tableguard.llm.trigrams import Postings, query_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` and ``least``: the group that needs so many characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    flags: int = re.ASCII


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Lines may end in an escape, as in JSON, and be quoted or indented.
_EOL, _MARGIN, _B64 = r"(?:\r\n?|\n|(?:\\+r)?\\+n)", r"[\x20\t>|#*\"']*+", r"[A-Za-z0-9+/=]"
_REST = rf"""[\x20\t"',;+]*+(?={_EOL}|\Z)"""
_HEADER = rf"(?:{_EOL}{_MARGIN})++(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*+"
# A line is of the key where it follows at once; after blank lines or a space if it is long or ends
# the text, and after blank lines also if it holds more than letters.
_LINE = rf"{_EOL}{_MARGIN}{_B64}++{_REST}|(?:{_EOL}{_MARGIN})++(?:{_B64}{{16,}}+{_REST}|(?=[A-Za-z]*+[0-9+/=]){_B64}++{_REST}|{_B64}++(?=\s*+\Z))|[\x20\t]++(?:{_B64}{{16,}}+|{_B64}++(?=\s*+\Z))"
_LABEL = r"[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_TO_END = rf"(?:[^-]++|-(?!----BEGIN\x20|----END\x20{_LABEL}))*+-----END\x20{_LABEL}"
MORE = (
    Rule("pem", rf"-----BEGIN\x20{_LABEL}(?:{_TO_END}|(?:{_HEADER}|{_LINE})*+)"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"sk_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", flags=re.ASCII | re.IGNORECASE),
    Rule("login", r"://[^\s/:@]*+:[^\s/@]++@[A-Za-z0-9]", flags=re.ASCII),
)
RULES = BASE + MORE


class Scanner:
    """Rules compiled for one worker."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        # A run of one class that is long enough is found faster when the length is in the pattern.
        texts = [r.pattern[:-1] + f"{{{r.least},}}" if re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else r.pattern for r in rules]
        self.patterns = [re.compile(t, r.flags) for t, r in zip(texts, rules, strict=True)]
        self.queries = [query_of(r.pattern, r.flags) for r in rules]
        self.postings = Postings(self.queries)

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every row, sorted."""
        found = self.postings.index(*column_bytes(column))
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for number, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries, strict=True)):
            for row in np.flatnonzero(self.postings.rows(found, query)).tolist():
                if row not in texts:
                    texts[row] = column[row].as_py() or ""
                for m in pattern.finditer(texts[row]):
                    start, end = m.span(rule.group)
                    if end - start >= rule.least:
                        out[row].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``, an array of (kind, start, end), of every text."""
    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("found", found)])

    def part(batch: pa.RecordBatch) -> dict:
        spans = scanner(rules).spans(batch.column("_text"))
        return {id_col: batch.column("_id"), "found": [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in row] for row in spans]}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and positions of every text, with the base kinds also on their own."""
    names = ["n_assign", "n_access", "n_hex"]
    schema = T.StructType(
        [T.StructField(id_col, id_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in names)]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def joined(spans) -> str:
        return ",".join(f"{RULES[n].kind}:{a}:{b}" for a, n, b in spans)

    def part(batch: pa.RecordBatch) -> dict:
        spans = scanner(RULES).spans(batch.column("_text"))
        base = [[s for s in row if s[1] < len(BASE)] for row in spans]
        counts = {name: [sum(s[1] == k for s in row) for row in base] for k, name in enumerate(names)}
        hashes = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
        return {id_col: batch.column("_id"), "base_sha256": hashes, "spans": [joined(row) for row in spans]} | counts

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with every secret in the text replaced by ``mark``.

    Overlapping secrets become one mark. The length column, if there is one, follows a changed text.
    """
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield redacted(part)

    def redacted(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(text_col)
        spans = scanner(rules).spans(column)
        changed = {row: _replace(column[row].as_py(), found, mark) for row, found in enumerate(spans) if found}
        if not changed:
            return part
        texts = column.to_pylist()
        lengths = part.column(length_col).to_pylist() if length_col in part.schema.names else None
        for row, text in changed.items():
            texts[row] = text
            if lengths:
                lengths[row] = len(text)
        columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
        columns[text_col] = pa.array(texts, column.type)
        if lengths:
            columns[length_col] = pa.array(lengths, part.column(length_col).type)
        return pa.RecordBatch.from_arrays([columns[n] for n in part.schema.names], schema=part.schema)

    return map_arrow(docs, run, schema)


def _replace(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
