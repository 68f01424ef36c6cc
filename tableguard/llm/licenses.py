"""License scans: ordered signature rules behind a keyword prefilter.

A text is reduced to its words in lower case (letters and digits, and every character beyond
ASCII). The rules are regular expressions over the words joined by single spaces. A text is searched
only by the rules whose keyword and cue are among its words; both are words that every match of
the rule holds. Detections are resolved by interval containment: a detection that lies inside one of higher
priority, or of equal priority and greater length, is suppressed. The base phrases are never
suppressed.

Null texts count as empty; every occurrence counts, overlapping ones too; ties of equal intervals
go to the earlier rule; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from tableguard.llm.batches import doc_columns, id_type, map_batches

#: Phrases whose places are counted, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses by label: the names they go by, as regular expressions over words.
NAMES = {
    "mit": ["mit", "expat", "mit expat", "x11"],
    "apache-2": ["apache(?: license| licence)?(?: version| v)? 2(?: 0)?", "asl 2(?: 0)?", "apache2"],
    "apache-1.1": ["apache(?: software)?(?: license)?(?: version)? 1 1"],
    "gpl-2": ["(?:gnu )?(?:general public license|gpl)(?: version| v)? 2(?: 0)?", "gplv2", "gpl2"],
    "gpl-3": ["(?:gnu )?(?:general public license|gpl)(?: version| v)? 3(?: 0)?", "gplv3", "gpl3"],
    "lgpl-2.1": ["(?:gnu )?(?:lesser general public license|library general public license|lgpl)(?: version| v)? 2(?: 1)?", "lgplv2(?: 1)?"],
    "lgpl-3": ["(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? 3(?: 0)?", "lgplv3"],
    "agpl-3": ["(?:gnu )?(?:affero general public license|agpl)(?: version| v)? 3(?: 0)?", "agplv3"],
    "gfdl-1.3": ["(?:gnu )?free documentation license(?: version)?(?: 1 [23])?", "gfdl"],
    "bsd-2-clause": ["(?:simplified|freebsd|2 clause|two clause) bsd", "bsd 2 clause"],
    "bsd-3-clause": ["(?:new|modified|revised|3 clause|three clause) bsd", "bsd 3 clause"],
    "bsd-4-clause": ["(?:original|4 clause|four clause) bsd", "bsd 4 clause"],
    "bsd": ["bsd", "bsd style"],
    "isc": ["isc"],
    "mpl-1.1": ["mozilla public license(?: version| v)? 1 1", "mpl 1 1"],
    "mpl-2": ["mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2(?: 0)?"],
    "epl-1": ["eclipse public license(?: version| v)? 1(?: 0)?", "epl 1(?: 0)?"],
    "epl-2": ["eclipse public license(?: version| v)? 2(?: 0)?", "epl 2(?: 0)?"],
    "cddl-1": ["common development and distribution license(?: version)?(?: 1 [01])?", "cddl(?: 1 [01])?"],
    "eupl-1.2": ["european union public licence(?: version)?(?: 1 [12])?", "eupl(?: 1 [12])?"],
    "artistic-2": ["artistic license(?: version)? 2(?: 0)?", "artistic 2(?: 0)?"],
    "zlib": ["zlib", "zlib libpng"],
    "boost-1": ["boost software license(?: version)?(?: 1 0)?", "bsl 1 0"],
    "unlicense": ["unlicense", "the unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "python-2": ["python software foundation license(?: version)?(?: 2)?", "psf"],
    "openssl": ["openssl"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "osl-3": ["open software license(?: version)? 3(?: 0)?", "osl 3 0"],
    "ofl-1.1": ["sil open font license(?: version)?(?: 1 1)?", "ofl(?: 1 1)?"],
    "odbl-1": ["open database license(?: version)?(?: 1 0)?", "odbl(?: 1 0)?"],
    "odc-by": ["open data commons attribution license", "odc by"],
    "pddl-1": ["public domain dedication and license", "pddl"],
    "cc0": ["cc0(?: 1 0)?", "cc zero", "creative commons zero"],
    "cc-by": ["cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"],
    "cc-by-sa": ["cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?"],
    "cc-by-nd": ["cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv\\w*(?: [1-4] [05])?"],
    "cc-by-nc": ["cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?"],
    "cc-by-nc-sa": ["cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"],
    "cc-by-nc-nd": ["cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv\\w*(?: [1-4] [05])?"],
    "proprietary": ["commercial", "proprietary"],
}
#: Sentences a license name stands in: pattern around the name, its cues (words one of which every
#: such sentence holds), priority, certainty.
NOTICES = (
    ("(?:dual )?licensed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?", "licensed", 5, 1.0),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?", "under", 5, 0.95),
    ("subject to (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?", "subject", 4, 0.9),
    ("(?:spdx )?licen[sc]e identifier {}(?: only| or later)?", "identifier", 6, 1.0),
    ("licen[sc]e {}", "license licence", 3, 0.8),
    ("under (?:the )?{} licen[sc]e", "license licence", 3, 0.85),
    ("{} licen[sc]e", "license licence", 2, 0.7),
)
#: Names that say by themselves that they are licenses.
SPEAKING = re.compile(r"licen|cc0|cc by|creative commons|gpl|public domain|wtfpl|odbl|pddl|gfdl")
#: Rules without a name.
OTHERS = (
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "domain", 5, 0.9),
    ("public-domain", "public domain", "domain", 1, 0.4),
    ("all-rights-reserved", "all rights reserved", "reserved", 1, 0.3),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern[bytes]
    keywords: frozenset[bytes]
    cues: frozenset[bytes]  # empty: none needed
    priority: int
    certainty: float


def _keywords(name: str) -> frozenset[bytes]:
    """Words one of which every match of a name holds: its first whole words, one per option."""
    plain = re.sub(r"\(\?:[^)]*\)\??", " ", name)  # what stands outside groups is mandatory
    words = [w for w in plain.split() if w.isalnum() and not w.isdigit()]
    if words:
        return frozenset([max(words, key=len).encode()])
    options = re.search(r"\(\?:([^)]*)\)(?!\?)", name)[1].split("|")
    return frozenset(max(o.split(), key=len).encode() for o in options)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every name in every notice, names that speak for themselves, and the others; in order."""
    out = []

    def add(label: str, text: str, keywords: frozenset[bytes], priority: int, certainty: float, cues: str = "") -> None:
        out.append(Rule(label, re.compile(f"(?<= ){text}(?= )".encode()), keywords, frozenset(cues.encode().split()), priority, certainty))

    for around, cues, priority, certainty in NOTICES:
        for label, names in NAMES.items():
            for name in names:
                add(label, around.format(f"(?:{name})"), _keywords(name), priority, certainty, cues)
    for label, names in NAMES.items():
        for name in names:
            if SPEAKING.search(name):
                add(label, f"(?:{name})", _keywords(name), 2, 0.6)
    for label, text, keyword, priority, certainty in OTHERS:
        add(label, text, frozenset([keyword.encode()]), priority, certainty)
    return tuple(out)


@lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[int]]:
    """Numbers of the rules that have a keyword."""
    out: dict[bytes, list[int]] = {}
    for number, rule in enumerate(rules()):
        for word in rule.keywords:
            out.setdefault(word, []).append(number)
    return out


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAPS = re.compile(rb"  +")


def words_text(text: bytes) -> bytes:
    """The words in lower case, with one space before, between and after them."""
    inner = _GAPS.sub(b" ", text.translate(_WORDS)).strip(b" ")
    return b" " + inner + b" " if inner else b" "


def _base_places(words: bytes) -> list[tuple[int, str]]:
    out = []
    for phrase, label in BASE:
        needle, at = f" {phrase} ".encode(), -1
        while (at := words.find(needle, at + 1)) >= 0:
            out.append((at, label))
    return out


def detections(words: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what is left after containment."""
    present, by_keyword = set(words.split()), _by_keyword()
    found = []
    for number in sorted({n for word in by_keyword.keys() & present for n in by_keyword[word]}):
        rule = rules()[number]
        if not rule.cues or not rule.cues.isdisjoint(present):
            found += [(-rule.priority, m.start() - m.end(), number, m.start(), m.end(), rule) for m in rule.pattern.finditer(words)]
    found.sort(key=lambda x: x[:4])
    # Kept intervals never contain one another, so starts and ends are both in order.
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for *_, start, end, rule in found:
        i = bisect_left(starts, start + 1) - 1
        if i >= 0 and ends[i] >= end:
            continue
        j = i + 1 if i < 0 or starts[i] < start else i
        k = j
        while k < len(ends) and ends[k] <= end:
            k += 1
        starts[j:k], ends[j:k] = [start], [end]
        kept.append((start, end, rule))
    return kept


def scan_words(words: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """Base places (byte position, label) and detections of one text."""
    return _base_places(words), detections(words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word count, places of the base phrases, labels and score of every text.

    The score is the greatest certainty of a detection; a base place alone counts 0.8.
    """
    long, string = T.LongType(), T.StringType()
    kinds = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": string, "labels": string, "score": T.DoubleType()}
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), *(T.StructField(n, t) for n, t in kinds.items())])

    def part(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in kinds}
        for text in pc.cast(batch.column("_text"), pa.binary()):
            words = words_text(text.as_py() or b"")
            base, found = scan_words(words)
            labels = sorted({label for _, label in base})
            places = [words.count(b" ", 0, at) for at, _ in base]
            out["n_words"].append(words.count(b" ") - 1)
            out["n_base"].append(len(base))
            out["first_word"].append(min(places, default=None))
            out["last_word"].append(max(places, default=None))
            out["base_labels"].append(",".join(labels))
            out["labels"].append(",".join(sorted({*labels, *(r.label for *_, r in found)})))
            out["score"].append(max([0.8 * bool(base), *(r.certainty for *_, r in found)]))
        return {id_col: batch.column("_id")} | out

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")
