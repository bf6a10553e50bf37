"""The pipeline's stages on the smallest tables, each against a plain version of what it decides."""

import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import normal, plain_counts, plain_simhash, roots
from tokenizers import Tokenizer

from tallyshop.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "near_dedup", "packing"]
    assert all(r.dtypes == results[0].dtypes for r in results[1:5])


def test_filters_only_drop_rows(results):
    for before, after in ((0, 1), (1, 2)):
        assert set(map(tuple, rows(results[after]).values())) <= set(map(tuple, rows(results[before]).values()))
    kept = rows(results[2])
    for doc, r in rows(results[1]).items():
        words, _, _, _, repeated = plain_counts(r.text)
        if words < 20 or 100 * repeated > 30 * words:
            assert doc not in kept


def test_lines_stay_once_and_others_are_untouched(results):
    before, after = rows(results[2]), rows(results[3])
    assert set(before) == set(after)
    seen = collections.Counter(normal(x) for r in after.values() for x in r.text.split("\n") if len(normal(x).split()) >= 3)
    assert max(seen.values()) == 1
    for doc, r in after.items():
        lines = iter(before[doc].text.split("\n"))
        assert r.text == "" or all(x in lines for x in r.text.split("\n"))
        assert r.n_chars == len(r.text)


def test_one_document_of_each_group_stays(results):
    before, after = rows(results[3]), rows(results[4])
    prints = {d: plain_simhash(r.text) for d, r in before.items()}
    distinct = sorted(set(prints.values()))
    group = roots(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4])
    heads = collections.defaultdict(list)
    for d, p in prints.items():
        heads[group[p]].append(d)
    assert set(after) == {min(v) for v in heads.values()}


def test_packing_holds_all_that_is_left(results):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = collections.Counter()
    for r in results[5].collect():
        lengths[r.doc_id] += r.length
    expected = {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in rows(results[4]).items()}
    assert dict(lengths) == expected


def test_run_gives_the_same_rows(spark, results):
    mine = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert mine == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in results[5].collect())
    assert np.all([re.fullmatch(r"\d+", str(c)) for _, _, _, c in mine])
