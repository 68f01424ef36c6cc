import hashlib
import uuid
from collections import defaultdict

import pytest

from tableguard.llm import exact as X
from tableguard.session import shared_folder

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(rows):
    """Decisions on (doc_id, text) rows, in any order."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def result(frame):
    assert set(COLUMNS) == set(frame.columns)
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def python_nodes(frame):
    return [w for w in ("Python", "Pandas", "InArrow") if w in frame._jdf.queryExecution().toString()]


def test_query_against_brute_force(spark, documents):
    from tableguard.llm.queries import QUERIES

    frame = QUERIES["op13_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert result(frame) == plain([(r.doc_id, r.text) for r in documents.collect()]) and not python_nodes(frame)


def test_odd_rows_and_clashing_names(spark, messy, nothing):
    path = folder(spark)
    clash = messy.withColumnsRenamed({"fp": "digest", "key": "file", "_id": "row", "_text": "size", "_hash": "kept", "spans": "_metadata"})
    clash.repartition(3).write.parquet(path)
    want = plain([(r.doc_id, r.text) for r in messy.collect()])
    assert result(X.deduplicate(spark, path)) == want
    nothing.write.parquet(f"{path}-empty")
    assert result(X.deduplicate(spark, f"{path}-empty")) == []


@pytest.mark.parametrize("broadcast_hits", [0, 1000])
def test_texts_that_share_a_key_are_told_apart_by_their_bytes(spark, broadcast_hits):
    rows = [(i, f"Text {i % 37}" if i % 3 else f"TEXT {i % 5}") for i in range(400)] + [(None, "text 1"), (None, "lone"), (7, "lone"), (None, None), (None, "")]
    path = folder(spark)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    frame = X.deduplicate(spark, path, key_bytes=1, broadcast_hits=broadcast_hits, partitions=2)
    assert result(frame) == plain(rows)


def test_state_goes_on_with_new_files(spark):
    path, state = folder(spark), folder(spark)
    first = [(i, f"words {i % 10}") for i in range(40)]
    later = [(i, f"Words {i % 12}") for i in range(100, 150)]
    both = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    both(first).write.parquet(path)
    assert result(X.deduplicate(spark, path, state=state, partitions=2)) == plain(first)
    both(later).write.mode("append").parquet(path)
    assert result(X.deduplicate(spark, path, state=state, partitions=2)) == plain(first + later)
    assert result(X.deduplicate(spark, path, state=state, partitions=2)) == plain(first + later)
    assert X.entries(spark, state).agg({"size": "sum", "key": "count"}).first().asDict() == {"sum(size)": 90, "count(key)": 12}


def test_hot_text_is_not_dealt_by_its_key(spark):
    rows = [(i, "the same" if i % 3 else f"other {i}") for i in range(3000)]
    path = folder(spark)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    assert result(X.deduplicate(spark, path, partitions=2)) == plain(rows)
