"""The conversation prefix trie against a plain version in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tallyshop.llm import trie
from tallyshop.llm.queries import op11_trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def originals(rows):
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            found[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(own):
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        found[c] = own.get(source, [])[:h] + turns[h:]
    return found


def plain(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def as_rows(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def made(seed, n=60, words=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["u", "a"]), r.choice("xyé"[:words]) * r.choice([1, 2])) for c in range(n) for t in range(r.randint(1, 9))]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain(spark, seed):
    rows = made(seed)
    assert as_rows(trie.build(table(spark, rows))) == plain(originals(rows))
    assert as_rows(trie.build_respliced(table(spark, rows))) == plain(rebuilt(originals(rows)))


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "u", text) for c in range(300) for t, text in enumerate(["hello", "same", "same too"] if c < 150 else ["hello", f"own {c}", "end"])]
    found = as_rows(trie.build(table(spark, rows)))
    assert found == plain(originals(rows))
    assert (0, 1, 0, 300, 151, 151, 299 * 5 + 149 * 12, trie.NO_IDS) in found


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = [
        (1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "a", "b"), (2, None, "", ""), (2, 5, "u", "a"),
        (None, 0, "u", "a"), (None, 1, "u", "b"), (-3, 0, "u", "a"), (-3, 1, "u", "b"), (-5, 0, "u", "a"), (0, 0, "u", "c"), (7, 3, "u", "a" * 200_000),
    ]
    for parts in (1, 5):
        assert as_rows(trie.build(table(spark, rows, parts))) == plain(originals(rows))
        assert as_rows(trie.build_respliced(table(spark, rows, parts))) == plain(rebuilt(originals(rows)))


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "u", "a") for c in range(1000, 1040) if c % 5]
    convs = rebuilt(originals(rows))
    assert sum(not t for t in convs.values()) > 10
    assert as_rows(trie.build_respliced(table(spark, rows))) == plain(convs)
    gone = [(c, 0, "u", "a") for c in convs if not convs[c]][:3]
    assert as_rows(trie.build_respliced(table(spark, gone))) == plain(rebuilt(originals(gone)))


def test_empty_table_and_clashing_columns(spark):
    assert as_rows(trie.build(table(spark, []))) == []
    assert as_rows(trie.build(table(spark, [(None, 0, "u", "a")]))) == []
    rows = made(5, 20)
    clash = table(spark, rows).selectExpr("*", "1 AS n", "2 AS size", "3 AS d0", "4 AS block", "5 AS part", "6 AS bytes", "7 AS head", "8 AS depth")
    assert as_rows(trie.build_respliced(clash)) == plain(rebuilt(originals(rows)))


def test_long_conversations_go_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 3)
    long = [(t, "u", f"t{t}") for t in range(60)]
    rows = [(c, *t) for c in range(12) for t in long[: 60 - c // 2]] + made(9, 30)[40:]
    rows = [(c if i < 600 else c + 100, *r) for i, (c, *r) in enumerate(rows)]
    assert as_rows(trie.build(table(spark, rows, 7))) == plain(originals(rows))


@pytest.mark.parametrize("most", [2, 5, 20])
def test_a_full_sketch_changes_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(trie, "MOST_BITS", most)
    monkeypatch.setattr(trie, "SLICE_BITS", 3)
    monkeypatch.setattr(trie, "COUNT_AT_ONCE", 16)
    rows = made(11, 80, 3)
    assert as_rows(trie.build(table(spark, rows))) == plain(originals(rows))


def test_marks_are_proofs_and_most_tails_are_marked(spark):
    rows = [(c, t, "u", f"first {c % 10}" if t == 0 else f"{c} {t}") for c in range(200) for t in range(6)]
    chains = trie.prefixes(*(lambda turns: (turns, trie.roster_of(turns)))(trie.numbered(table(spark, rows))))
    marked = trie.screened(chains).collect()
    assert all(r.n > 1 for r in marked if r.alone) and all(r.n > 2 for r in marked if r.above)
    assert sum(r.alone for r in marked) >= 0.95 * 1000


def test_query_and_its_twin(spark):
    frame = op11_trie(spark, FOLDER)
    assert all(t == ("string" if c == "ends_sha256" else "bigint") for c, t in frame.dtypes)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mine = as_rows(frame)
    assert mine == plain(rebuilt(originals(rows)))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    assert mine == sorted(connection.execute(trie.ORACLE).fetchall(), key=repr)
