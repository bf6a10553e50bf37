import random

import numpy as np
import pytest

from tallyshop.llm import lines
from tallyshop.llm.common import released_shuffles

VOCABULARY = [f"w{i:x}z" for i in range(3000)]


def edited(r, words, edits):
    own = list(words)
    for _ in range(edits):
        at, new = r.randrange(len(own)), r.choice(VOCABULARY)
        own[at : at + 1] = r.choice([[], [new], [own[at], new]])
    return own


def test_folded_sketches_never_part_lines_within_the_bound():
    r = random.Random(21)
    found = []
    for size in (4, 20, 100, 155, 160, 161, 165, 200, 400):
        first = r.choices(VOCABULARY, k=size)
        found += [first, edited(r, first, size // 5), r.choices(VOCABULARY, k=size)]
    sketches = np.array(lines._sketches(found, lines._WordHash()), dtype=object)
    assert {len(s) for s, x in zip(sketches, found, strict=True) if len(x) <= lines.SLIM_WORDS} == {lines.SKETCH_BITS // 32}
    assert {len(s) for s, x in zip(sketches, found, strict=True) if len(x) > lines.SLIM_WORDS} == {lines.SKETCH_BITS // 8}
    sizes, bits = np.array([len(x) for x in found]), lines._Bits(sketches)
    for i in range(0, len(found), 3):
        rest = np.array([i + 1, i + 2])
        near = lines._may_match(i, rest, sizes, bits)
        within = lines.edit_distance(found[i], found[i + 1]) <= max(sizes[i], sizes[i + 1]) // 5
        assert near[0] or not within
        assert not near[1]
        assert lines._may_match(np.array([i, i]), rest, sizes, bits).tolist() == near.tolist()


def test_sketches_of_short_lines_only_and_of_none():
    bits = lines._Bits(np.array(lines._sketches([["a", "b"]], lines._WordHash()), dtype=object))
    assert bits.differ(np.array([0]), np.array([0])).tolist() == [0]
    assert len(lines._Bits(np.array([], dtype=object)).slim) == 0


def test_lines_on_both_sides_of_the_fold_group_as_brute_force_does(docs):
    r = random.Random(22)
    rows = []
    for b in range(12):
        first = r.choices(VOCABULARY, k=r.choice([150, 158, 162, 170]))
        rows += [(10 * b + v, edited(r, first, e)) for v, e in enumerate((0, 8, 20, 30, 60))]
    texts = dict(rows)
    leader = {x: x for x in texts}
    for a in texts:
        for b in texts:
            if a < b and lines.edit_distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])) // 5:
                low, high = sorted((leader[a], leader[b]))
                leader = {x: low if y == high else y for x, y in leader.items()}
    kept = {x.doc_id for x in lines.dedup(docs([(d, " ".join(x)) for d, x in rows]), whole=True).collect() if x.text}
    assert kept == set(leader.values()) and len(kept) < len(rows)


def test_null_ids_and_repeated_rows_are_compared_once(docs):
    r = random.Random(23)
    first = r.choices(VOCABULARY, k=30)
    near = edited(r, first, 3)
    rows = [(None, " ".join(near))] * 3 + [(0, " ".join(first))] * 4 + [(1, None), (2, "")]
    found = lines.dedup(docs(rows), whole=True).collect()
    assert sorted((x.doc_id is not None, x.text or "", x.n_dropped) for x in found if x.doc_id in (None, 0)) == sorted(
        [(False, " ".join(near), 0)] * 3 + [(True, "", 1)] * 4
    )
    assert {(x.doc_id, x.text) for x in found if x.doc_id in (1, 2)} == {(1, None), (2, "")}


def test_shuffle_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), released_shuffles(spark):
        assert spark.conf.get(name) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_texts_are_split_as_word_by_word():
    texts = ["", "One two, THREE\n\n  12 3٤ x_y éÉ ΣΑΣ\r½² İstanbul", "\n", "two one", "\U0001d54f three"]
    split, named = lines._Split(texts), {}
    own = [line for t in texts for line in t.split("\n")]
    assert [texts[r].split("\n")[n] for r, n in zip(split.rows, split.numbers, strict=True)] == own
    for line, size, end in zip(own, split.sizes.tolist(), split.ends.tolist(), strict=True):
        words = lines.normal_words(line)
        assert size == len(words)
        assert all(named.setdefault(w, h) == h for w, h in zip(words, split.words[end - size : end].tolist(), strict=True))
    assert len(set(named.values())) == len(named)
    assert len(lines._Split([]).words) == len(lines._Split(["", " "]).words) == 0


def coded(words):
    return np.array([hash(w) & 0xFFFFFFFF for w in words], dtype=np.uint32)


def test_large_components_compare_few_pairs_and_group_as_brute_force_does(monkeypatch):
    r = random.Random(24)
    rows = []
    for b in range(150):  # lines of one length over few words, which sketches alone may not part
        first = r.choices(VOCABULARY[:400], k=40)
        rows += [edited(r, first, e) for e in (0, 3, 7, 9)]
    sketches = np.array(lines._sketches(rows, lines._WordHash()), dtype=object)
    keys, sizes = np.arange(len(rows), dtype=np.int64) + 10, np.array([len(x) for x in rows])
    codes = np.array([coded(x).tobytes() for x in rows], dtype=object)
    asked = []
    match = lines._Lines.match
    monkeypatch.setattr(lines._Lines, "match", lambda self, x, y: asked.append((x, y)) or match(self, x, y))
    monkeypatch.setattr(lines, "_may_match", lambda x, y, words, bits: np.ones(len(y), dtype=bool))  # sketches that part nothing
    found = lines._verified([np.zeros(len(rows), dtype=np.int64), keys, sizes, sketches, codes]).to_pydict()
    leader = {x: x for x in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if lines.edit_distance(rows[a], rows[b]) <= max(len(rows[a]), len(rows[b])) // 5:
                low, high = sorted((leader[a], leader[b]))
                leader = {x: low if y == high else y for x, y in leader.items()}
    several = {x for x in leader.values() if list(leader.values()).count(x) > 1}
    assert dict(zip(found["key"], found["group"], strict=True)) == {x + 10: y + 10 for x, y in leader.items() if y in several}
    assert len(several) > 100 and len(asked) < len(rows) ** 2 / 4  # all pairs are 180,000
    assert len(asked) == len(set(asked))
