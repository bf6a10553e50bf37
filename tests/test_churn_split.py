"""Exact class quotas and rank-based AUC against plain Python."""

import hashlib
import random

import pytest

from tallyshop.operators import models


def position(key):
    return int(hashlib.md5(f"{key}:{models.SEED}".encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("share", [0.8, 0.5, 0.0, 1.0])
def test_quotas_hold_to_the_row(spark, share):
    r = random.Random(3)
    rows = [(i, 1.0 if r.random() < 1 / 3 else 0.0) for i in range(777)]
    found = models.stratified_split(spark.createDataFrame(rows, "id long, label double").repartition(5), "label", "id", share).collect()
    train = {x.id for x in found if x.is_train}
    for label in (0.0, 1.0):
        ids = sorted((i for i, v in rows if v == label), key=position)
        assert train & set(ids) == set(ids[: int(len(ids) * share + 0.5)])
    assert len(found) == len(rows)


def test_split_keeps_repeats_nulls_and_does_not_depend_on_partitions(spark):
    rows = [(5, "a")] * 6 + [(i, "b") for i in range(9)] + [(100 + i, None) for i in range(4)] + [(None, "a")]
    df = spark.createDataFrame(rows, "id long, label string")
    one, many = (sorted((x.label or "", x.id or -1, x.is_train) for x in models.stratified_split(df.repartition(n), "label", "id").collect()) for n in (1, 7))
    assert one == many and len(one) == len(rows)
    assert [sum(t for c, _, t in one if c == v) for v in ("a", "b", "")] == [6, 7, 3]
    assert models.stratified_split(df.limit(0), "label", "id").collect() == []


def test_auc_with_ties_and_a_hot_score(spark):
    r = random.Random(8)
    rows = [(float(r.random() < 0.4), r.choice([0.0, 0.0, 0.25, 0.5, r.random()])) for _ in range(300)] + [(None, 0.5), (1.0, None)]
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    pairs = [(a, b) for y, a in known if y for z, b in known if not z]
    expected = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "label double, score double").repartition(4)
    row = models.auc_by_ranks(df, "label", "score").first()
    assert row.auc == pytest.approx(expected) and row.positives * row.negatives == len(pairs)
    assert models.auc_by_ranks(df.where("label = 1"), "label", "score").first().auc is None
    assert tuple(models.auc_by_ranks(df.limit(0), "label", "score").first()) == (0, 0, None)
