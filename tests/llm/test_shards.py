"""Rendezvous sharding against a plain version in Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyshop.llm import shards
from tallyshop.llm.queries import op13_sharding

FOLDER = "/root/testdata/sf0.001"


def plain(rows, n, weights=None, new=1.0):
    weights = [*(weights or [1.0] * n), new]

    def score(key, i):
        digest = hashlib.md5(f"{key}:{i}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 16**13) / weights[i]

    placed = []
    for doc_id, text in rows:
        key, data = "" if doc_id is None else str(doc_id), (text or "").encode()
        scores = [(score(key, i), i) for i in range(n + 1)]
        order = (hashlib.md5(key.encode()).hexdigest()[:2], doc_id is not None, doc_id or 0, zlib.crc32(data), len(data))
        placed.append((min(scores[:n])[1], order, doc_id, len(data) + 16, zlib.crc32(data), min(scores)[1]))
    found, slots = [], Counter()
    for shard, _, doc_id, size, crc, grown in sorted(placed, key=lambda p: p[:2]):
        found.append((doc_id, size, crc, "key", shard, slots[shard], grown))
        slots[shard] += 1
    return found


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


ROWS = [(7, "same"), (7, "same"), (7, "other"), (None, None), (None, ""), (8, ""), (9, None), (-3, "é中\U0001f600"), (10, "x" * 300_000)]
ROWS += [(i, random.Random(i).choice(["a", "b", f"t{i}"])) for i in range(20, 400)]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_equals_plain(spark, docs, n):
    assert as_rows(shards.assign(docs(ROWS), n)) == sorted(plain(ROWS, n), key=repr)


def test_weights_share_and_growth_moves_into_the_new_shard_only(spark, docs):
    rows = [(i, "t") for i in range(3000)]
    found = as_rows(shards.assign(docs(rows), 3, [1.0, 2.0, 3.0], new_weight=2.0))
    assert found == sorted(plain(rows, 3, [1.0, 2.0, 3.0], 2.0), key=repr)
    sizes = Counter(r[4] for r in found)
    assert all(abs(sizes[s] - 500 * (s + 1)) < 100 for s in range(3))
    moved = [r for r in found if r[4] != r[6]]
    assert all(r[6] == 3 for r in moved) and abs(len(moved) - 3000 * 2 / 8) < 100


def test_slots_are_gapless_and_do_not_depend_on_the_partitioning(spark, docs):
    hot = [(1, "same")] * 500 + [(i % 50, f"t{i % 70}") for i in range(400)]
    one, many = (as_rows(shards.assign(docs(hot).repartition(n), 5)) for n in (1, 13))
    assert one == many == sorted(plain(hot, 5), key=repr)
    slots = defaultdict(list)
    for r in one:
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table_and_clashing_columns(spark, docs):
    assert shards.assign(docs([])).collect() == []
    clash = docs(ROWS[:6]).selectExpr("*", "1 AS shard", "'x' AS law", "2 AS slot", "3 AS size", "4 AS copies", "5 AS key", "6 AS part")
    assert as_rows(shards.assign(clash, 4)) == sorted(plain(ROWS[:6], 4), key=repr)


def test_wrong_weights_are_refused(spark):
    for bad in ([1.0], [1.0, 0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            shards.shard_of("doc_id", 2, bad)


def test_files_hold_every_row_in_its_shard(spark, docs, tmp_path):
    folder = str(tmp_path / "out")
    shards.write(docs(ROWS).selectExpr("*", "99 AS shard"), folder, 4)
    back = spark.read.parquet(folder)
    expected = Counter((r[0], r[4]) for r in plain(ROWS, 4))
    assert Counter((r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()) == expected
    assert back.where("doc_id = 10").first().text == "x" * 300_000


def test_query_and_its_twin(spark):
    frame = op13_sharding(spark, FOLDER)
    assert frame.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    types = dict(frame.dtypes)
    assert [types[c] for c in ("size", "text_crc32", "shard", "slot", "grown_shard")] == ["bigint", "bigint", "int", "bigint", "int"]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    theirs = connection.execute(shards.ORACLE).fetchall()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(frame) == sorted(theirs, key=repr) == sorted(plain(rows, 40), key=repr)
