"""Each operator against a brute-force version, and on nulls, empty tables, ties and clashing columns."""

import collections
import difflib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyshop.llm import chat, components, forest, html_text, lines, packing, pieces, quality, rules, simhash, toxicity
from tallyshop.llm.common import staged

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components_match_union_find(spark):
    random.seed(1)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)]
    rows = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in rows} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_all_pairs(spark, docs, corpus):
    rows = corpus + [(900 + i, corpus[i][1], "en") for i in range(5)] + [(5000, None, "en"), (5001, "", "en"), (5002, " \t ", "en"), (None, "x y z w v", "en")]
    prints = {r: plain_simhash(r[1]) for r in rows}
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4]
    group = roots(distinct, links)
    least = collections.defaultdict(list)
    for r, p in prints.items():
        if r[0] is not None:
            least[group[p]].append(r[0])
    expected = sorted((str(r[0]), f"{p:016x}", min(least[group[p]], default=None)) for r, p in prints.items())
    found = simhash.near_duplicates(docs(rows).withColumn("component", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected


def test_deletion_variants_find_every_pair_once(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    near = [p ^ sum(1 << b for b in random.sample(range(64), k)) for p in base for k in (1, 2, 3, 4, 4, 4, 5)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in base + near})
    expected = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    assert sorted((r.u, r.v) for r in found) == expected


def test_keep_one_keeps_columns_and_rows_without_id(docs):
    rows = [(2, "one two three four five"), (1, "One two three four five"), (1, "One two three four five"), (3, "else"), (None, "one two three four five")]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_keep_one_chooses_rows_not_ids(docs, parts):
    a, b = "alpha beta gamma delta epsilon", "one two three four five"
    kept = simhash.keep_one(docs([(0, b), (1, a), (1, b), (1, a), (2, None), (3, ""), (2, a)]).repartition(parts)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(0, b), (1, a)]
    assert [r.doc_id for r in kept if not r.text] == [2]
    assert simhash.keep_one(docs([])).collect() == []


# --- pages -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><article>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li>Home<li>News</ul></nav><!-- x --><div class="with-sidebar"><article class="post comments-open"><header><h1>A &amp; b</h1></header>
<p>One <b>two</b>
 three&nbsp;four<br>five<p>Six<div class="cookie-notice">no</div><aside>no</aside><form><p>no</form><style>p{}</style>
<section id="comments"><article>no</article></section><ul><li>a<li>b</ul></article></div><div class="sidebar">no</div><footer>no"""


def test_article_without_chrome():
    found = html_text.blocks(PAGE)
    assert html_text.main_text(found, [False] * len(found)) == "A & b\n\nOne two three four five\n\nSix\n\na\n\nb"
    assert html_text.blocks("") == [] and html_text.main_text([], []) == ""
    assert [t for _, t in html_text.blocks("a < b &lt;c&gt; <b>d<p>e<script>x")] == ["a < b <c> d", "e"]


def test_shared_runs_go_outside_articles_only(spark):
    foot = "<div>all rights are kept by the people of this place</div>"
    same = "<p>this passage of more than eight words is on every page here</p>"
    rows = [(i, f"http://a.org/{i}", f"<div>page {i} says number {i} of many words that only it has</div>{foot}") for i in range(4)]
    rows += [(10 + i, f"http://b.org/{i}", f"<article><p>number {i}</p>{same}</article>{foot}") for i in range(3)]
    rows += [(20, None, None), (21, "x", ""), (None, "http://a.org/z", foot + "<p>alone</p>"), (None, "http://a.org/z", foot + "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    by_array, by_join = (html_text.extract(pages, n).collect() for n in (1000, 0))
    assert sorted(map(str, by_array)) == sorted(map(str, by_join))
    texts = {r.page_id: r.text for r in by_array}
    assert texts[2] == "page 2 says number 2 of many words that only it has"
    assert texts[11] == "number 1\n\nthis passage of more than eight words is on every page here"
    assert texts[20] == texts[21] == "" and texts[None] == "alone" and len(by_array) == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0


# --- conversations ---------------------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "yes"), ("user", None), (None, "end")]
    rows = [(1, i, *t) for i, t in enumerate(talk[:2])] + [(2, i, *t) for i, t in enumerate(talk)] + [(3, i, *t) for i, t in enumerate(talk)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", ""), (6, 0, "user", None), (None, 0, "user", "nobody"), (4, 1, "assistant", "no")]
    rows += [(7, i, "user", str(i)) for i in range(600)] + [(8, i, "user", str(i)) for i in range(599)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(9)).repartition(4)
    found = chat.render(table).collect()
    assert sorted({str(r.conv_id) for r in found}) == ["2", "4", "5", "6", "7", "None"]
    assert sorted(r.n_turns for r in found if r.conv_id == 7) == [88, 256, 256]
    texts = {r.conv_id: r.text for r in found if r.part == 0}
    assert texts[2] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n<|unknown|>\nend<|end|>\n"
    assert chat.render(table.limit(0)).count() == 0


# --- neighbours ------------------------------------------------------------------------------------------------------


def test_forest_recall_and_exact_scores(spark, monkeypatch):
    random = np.random.default_rng(5)
    vectors = random.standard_normal((3000, 32)).astype(np.float32)
    vectors[:40] = vectors[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [math.nan] * 32), (5003, [None] + [1.0] * 31), (5004, [math.inf] * 32), (5005, [1.0] * 3), (None, [1.0] * 32), (5006, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    monkeypatch.setattr(forest, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(forest, "LEAST", 50)
    found = forest.nearest(table, table.where("vec_id % 100 = 0")).collect()
    got = collections.defaultdict(dict)
    for r in found:
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 3000, 100):
        distance = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), distance)) if i != q][:10]
        hits += len(set(order) & {v for v, _ in got[q].values()})
        assert all(abs(s - distance[v]) < 1e-12 for v, s in got[q].values())
        assert sorted(got[q]) == list(range(1, 11))
    assert [got[0][r][0] for r in range(1, 11)] == list(range(1, 11))
    assert hits >= 0.9 * 300 and set(got) == set(range(0, 3000, 100))
    few = table.where("vec_id < 5 OR vec_id = 5005")
    assert forest.nearest(few, few.where("vec_id IN (0, 5005)")).count() == 4
    assert forest.nearest(table.limit(0), table.limit(0)).count() == 0


# --- classifiers -----------------------------------------------------------------------------------------------------


def word(random, letters="abcdefgh"):
    return "".join(random.choice(letters) for _ in range(random.randint(2, 7)))


def made(toxic, seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [word(r) for _ in range(r.randint(30, 80))]
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["wretch", "villain", "scoundrel"])
        out.append(" ".join(words))
    return out


def test_toxicity_on_held_out(spark, docs):
    texts = made(True, 1, 150) + made(False, 2, 300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "x" * 100_000), (None, "wretch villain scoundrel wretch")]
    labels = spark.createDataFrame([(i, None, int(i < 150)) for i in range(450)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    table = docs(rows).withColumn("toxicity", F.lit("clash"))
    model = toxicity.learn(table, labels)
    scored = toxicity.score(table, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.toxicity <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 450 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.toxicity >= 0.5) == (r.doc_id < 150) for r in held) >= 0.97 * len(held) and len(held) > 50
    assert {r.doc_id: r.toxicity >= 0.5 for r in scored}[900] is False
    assert {r.toxicity for r in toxicity.score(table, toxicity.learn(table, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs([]), model).count() == 0


def test_quality_on_held_out(spark, docs):
    r = random.Random(4)
    good = [" ".join(word(r) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(word(r).upper() + "!!" for _ in range(60)) for _ in range(75)] + [" ".join([word(r)] * 9 + [word(r)] * 9) for _ in range(75)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (902, "ab " * 200_000)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs(rows), labels)
    scored = quality.score(docs(rows).withColumn("quality_score", F.lit(1)), model).collect()
    held = [x for x in scored if x.doc_id < 300 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert sum((x.quality_score >= 0.5) == (x.doc_id < 150) for x in held) >= 0.95 * len(held) and len(held) > 60
    assert len(scored) == len(rows)
    assert {x.quality_score for x in quality.score(docs(rows), None).collect()} == {0.5}


def test_features_do_not_depend_on_runs(monkeypatch):
    r = random.Random(6)
    text = "".join(r.choice("abcé  \n") for _ in range(5000))
    whole = np.sort(np.concatenate(list(quality.Features().runs(text))))
    monkeypatch.setattr(quality, "CHUNK", 300)
    cut = np.sort(np.concatenate(list(quality.Features().runs(text))))
    assert np.array_equal(whole, cut)


# --- SentencePiece ---------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library(spark, docs, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(8)
    texts = [t for _, t, _ in corpus[:60]] + ["", None, "a" * 3000, "ab" * 700 + " " * 90 + "ing" * 400, " x  y ", "漢字😀\x00é\n\t"]
    texts += ["".join(r.choice("abeint  sroé\n.漢") for _ in range(r.randint(1, 300))) for _ in range(60)]
    rows = list(enumerate(texts))
    encoded = pieces.encode(docs(rows), PIECES)
    got = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in rows}
    back = {x.doc_id: x.text for x in pieces.decode(encoded, PIECES).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert all(x.same for x in pieces.round_trip(docs(rows), PIECES).collect())
    assert pieces.encode(docs([]), PIECES).count() == 0


def test_window_commits_before_the_end():
    search = pieces.Viterbi(PIECES)
    parts = list(search._commits("theing" * 500))
    assert len(parts) > 5 and sum(map(len, parts)) == len(search.library.encode("theing" * 500))


# --- quality rules ---------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def plain_kneser_ney(texts, order=rules.ORDER):
    """Log probabilities by the textbook recursion over dictionaries."""
    padded = ["\x02" * (order - 1) + re.sub(r"\s+", " ", t).strip() for t in texts]
    counts = {order: collections.Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount, total, left = {}, {}, {}
    for k, own in counts.items():
        c = [0, *(sum(v == i for v in own.values()) for i in (1, 2, 3, 4))]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        discount[k] = [0] + [min(i, max(0, i - (i + 1) * y * c[i + 1] / c[i])) if c[i] and c[1] else i / 2 for i in (1, 2, 3)]
        for g, n in own.items():
            total[g[:-1], k] = total.get((g[:-1], k), 0) + n
            left[g[:-1], k] = left.get((g[:-1], k), 0) + discount[k][min(n, 3)]

    def p(gram):
        k = len(gram)
        below = 1 / (len(counts[1]) + 1) if k == 1 else None
        context = gram[:-1], k
        if below is None:
            below = p(gram[1:])
        if context not in total:
            return below
        n = counts[k][gram]
        return max(n - discount[k][min(n, 3)], 0) / total[context] + left[context] / total[context] * below

    return [-sum(math.log(p(t[i : i + order])) for i in range(len(t) - order + 1)) for t in padded]


def test_rules_match_plain_counts_and_model(spark, docs, corpus):
    extra = ["", None, "one two\n\none two\n \n \nx", "a b c d e f g h " * 5, "w " * 400, "é # | % & < > $ *" * 3, " x  y"]
    rows = [(i, t, "en") for i, (_, t, lang) in enumerate(corpus) if lang == "en"][:40] + [(1000 + i, t, "en") for i, t in enumerate(extra)]
    table = docs(rows)
    judged = {r.doc_id: r for r in rules.judge(table.withColumn("kept", F.lit("clash"))).collect()}
    assert len(judged) == len(rows)
    own = [(i, t) for i, t, _ in rows if t and t.split()]
    expected = dict(zip([i for i, _ in own], plain_kneser_ney([t for _, t in own]), strict=True))
    for i, text, _ in rows:
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        if i in expected:
            # Hash slots of 22 bits let a few n-grams share a probability.
            assert r.log_perplexity * max(1, r.n_words) == pytest.approx(expected[i], rel=0.01)
    assert rules.judge(docs([])).count() == 0


def test_every_ngram_has_its_own_probability(spark, docs):
    r = random.Random(31)
    # Tens of thousands of different n-grams over 3,000 characters in each language, so that 22 bits cannot tell them apart.
    texts = {lang: ["".join(chr(r.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(4000)) + " \U0010fffd" for _ in range(25)] for lang in ("aa", "bb")}
    rows = [(100 * i + j, t, lang) for i, (lang, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    model = rules.learn(docs(rows))
    grams = {lang: {t[i : i + 4] for t in ("\x02\x02\x02" + x for x in own) for i in range(len(t) - 3)} for lang, own in texts.items()}
    assert {lang: len(model[lang][0, 4][0]) for lang in texts} == {lang: len(x) for lang, x in grams.items()}
    assert all((np.diff(keys) > 0).all() for own in model.values() for keys, _ in own.values())
    for lang, own in texts.items():
        other = texts["bb" if lang == "aa" else "aa"]
        found = rules._surprise(model, [lang] * 4, [own[0], own[1], other[0], "\0ab"])
        assert found[:2] == pytest.approx(plain_kneser_ney(own)[:2], rel=1e-5)
        assert found[2] > found[0]  # the grams of one language are not those of the other
    assert rules._surprise(model, ["zz"], ["ab"])[0] == pytest.approx(2 * -math.log(1e-6))


def test_bands_reject_strange_text_and_keep_plain(docs):
    r = random.Random(9)
    vocabulary = [word(r, "abcdefghijklmnop") for _ in range(300)]
    plain = [(i, " ".join(r.choice(vocabulary) for _ in range(100)), "xx") for i in range(200)]
    strange = [(1000 + i, " ".join("".join(r.choice("QWXZ#$%&0123456789") for _ in range(8)) for _ in range(100)), "xx") for i in range(10)]
    kept = {x.doc_id for x in rules.judge(docs(plain + strange + [(3000, plain[0][1], None), (3001, plain[1][1], "")])).where("kept").collect()}
    assert {i for i, _, _ in plain} <= kept and not kept & {i for i, _, _ in strange}


# --- lines -----------------------------------------------------------------------------------------------------------


def normal(line):
    return " ".join(re.findall(r"\w+", re.sub(r"\d", "0", line.lower())))


def test_exact_lines_stay_once(docs, corpus):
    rows = corpus + [(5000, None, "en"), (5001, "", "en"), (5002, "ok", "en"), (5003, "ok", "en"), (None, "a line of null id here", "en"), (7, "a line of null id here", "en")]
    table = docs(rows).withColumn("n_dropped", F.lit("clash"))
    found = lines.dedup(table).collect()
    assert len(found) == len(rows)
    left = collections.Counter(normal(x) for r in found for x in (r.text or "").split("\n") if len(normal(x).split()) >= 3)
    before = {normal(x) for _, t, _ in rows for x in (t or "").split("\n") if len(normal(x).split()) >= 3}
    assert max(left.values()) == 1
    texts = {r.doc_id: r.text for r in found}
    assert texts[5000] is None and texts[5001] == "" and texts[5002] == texts[5003] == "ok" and texts[None] and texts[7] == ""
    gone = before - set(left)  # fuzzy ones: each has a near line that stays
    assert all(max(difflib.SequenceMatcher(None, g, k, autojunk=False).ratio() for k in left if abs(len(k) - len(g)) < 0.3 * len(g)) > 0.7 for g in list(gone)[:5])
    assert lines.dedup(docs([])).count() == 0


def test_fuzzy_lines_group_as_all_pairs_do(spark, docs):
    r = random.Random(10)
    base = [[word(r) for _ in range(60)] for _ in range(20)]
    rows = []
    for b, words in enumerate(base):
        for v in range(6):
            own = list(words)
            if v:
                own[r.randrange(60)] = word(r)
            rows.append((100 * b + v, " ".join(own)))
    got = lines.signatures(docs(rows)).collect()
    prints = {x.doc_id: x.print for x in got}
    texts = dict(rows)
    near = [(a, b) for a in texts for b in texts if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3]
    group = roots(texts, near)
    kept = {x.doc_id for x in lines.dedup(docs(rows)).collect() if x.text}
    assert kept == set(group.values()) and len(kept) < len(rows)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_whole_lines_group_as_brute_force_does(docs):
    r = random.Random(11)
    rows = []
    for b in range(40):
        words = [word(r) for _ in range(r.choice([4, 5, 7, 8, 9, 12, 20, 45]))]
        for v in range(4):
            own = list(words)
            for _ in range(v * max(1, len(words) // 10)):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], [word(r)], [own[at], word(r)]]) or own[at : at + 1][: len(own) == 1]
            rows.append((100 * b + v, " ".join(own) + " x y"[: 0 if len(own) > 2 else 4]))
    rows += [(9000, "the the the the the the the the"), (9001, "the the the the the the the the the")]
    texts = {d: t.split() for d, t in rows}
    near = [(a, b) for a in texts for b in texts if a < b and 5 * plain_distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b]))]
    group = roots(texts, near)
    kept = {x.doc_id for x in lines.dedup(docs(rows), whole=True).collect() if x.text}
    assert kept == set(group.values()) and len(near) > 50  # recall 1 against brute force
    assert kept < {x.doc_id for x in lines.dedup(docs(rows)).collect() if x.text}


def test_edit_distance_is_that_of_the_plain_table():
    r = random.Random(12)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(90))] for _ in range(2))
        assert lines.edit_distance(a, b) == plain_distance(a, b)


def test_links_outside_the_leader_and_long_lines_are_verified(docs):
    r = random.Random(13)
    chain = [[word(r) for _ in range(50)]]
    for _ in range(5):  # each is 8 edits from the one before; the ends are not alike
        own = list(chain[-1])
        for at in r.sample(range(50), 8):
            own[at] = word(r)
        chain.append(own)
    long = [word(r) for _ in range(9000)]
    spread = [w if i % 6 else word(r) for i, w in enumerate(long)]  # a sixth of the words changed, evenly spread
    rows = [(i, " ".join(x)) for i, x in enumerate(chain)] + [(10, " ".join(long)), (11, " ".join(spread))]
    assert {x.doc_id for x in lines.dedup(docs(rows), whole=True).collect() if x.text} == {0, 10}


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_is_a_round_trip(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = corpus[:120] + [(7000, None, "en"), (7001, "", "en"), (7002, "a  b\n\n c <|endoftext|> d", "en"), (7003, " lead\n x \t y", "en"), (None, "no id", "en"), (7000, "again", "en")]
    found = packing.pack(docs(rows).withColumn("piece", F.lit("clash")), TOKENIZER, open_bins=8).collect()
    by_doc = collections.defaultdict(list)
    for x in found:
        assert len(x.ids) == 4 * x.length <= 4096
        by_doc[x.doc_id].append(x)
    for doc, text, _ in rows:
        if doc != 7000:
            own = sorted(by_doc[doc], key=lambda x: x.piece)
            ids = [i for x in own for i in np.frombuffer(x.ids, "<u4").tolist()]
            assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist()
            assert all(x.length == 1024 for x in own[1:]) and [x.piece for x in own] == list(range(len(own)))
    sequences = collections.defaultdict(list)
    for x in found:
        sequences[x.sequence_id].append((x.offset, x.length))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    total = sum(x.length for x in found)
    assert len(sequences) <= 1.2 * math.ceil(total / 1024)
    assert packing.pack(docs([]), TOKENIZER).count() == 0


def test_open_bins_match_a_plain_search():
    r = random.Random(11)
    bins, plain, closed = packing.OpenBins(100, 5, 0), {}, 0
    for _ in range(2000):
        size = r.randint(1, 100)
        sequence, offset = bins.place(size)
        fitting = [f for f in plain.values() if f >= size]
        if fitting:
            assert plain[sequence] == min(fitting) and offset == 100 - min(fitting)
            plain[sequence] -= size
        else:
            assert offset == 0 and sequence not in plain
            if size < 100 and len(plain) == 5:
                fullest = min(plain.values())
                gone = next(s for s in plain if plain[s] == fullest and s not in bins.by_free[fullest])
                del plain[gone]
                closed += 1
            plain[sequence] = 100 - size
        if plain[sequence] == 0:
            del plain[sequence]
    assert closed > 100


def test_staged_tables_keep_their_rows(spark):
    table = spark.range(10).withColumn("x", F.col("id").cast("string"))
    again = staged(table, "test")
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect())) and again.schema.names == table.schema.names
