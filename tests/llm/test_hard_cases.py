"""Cases that the operators' contracts name: rows without ids, repeated rows, clashing names, very long texts, hot texts."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.llm import bpe, crf, exact_dedup, html_text, mix, ngram_join, queries, toxicity, training, warc_fixity, wordpiece
from scenemill.llm.common import table

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


def test_mix_of_rows_without_ids_is_near_its_targets(spark):
    rows = [(None if k % 10 else k, prose(k % 400, 4), f"s{k % 2}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix.mix_taken(docs).collect()
    assert len(got) == len(rows)
    for source in ("s0", "s1"):
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 4 and all(r.taken <= 3 * r.size for r in part)
    again = mix.mix_taken(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix.mix(docs).count() == sum(r.times for r in got)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["mix_key", "mix_hash", "mix_source", "mix_base", "mix_threshold", "mix_time", "join_key", "slice", "__key", "hash", "base"]
    docs = spark.createDataFrame([(k, prose(k, 9), "a" if k % 3 else None, *(f"{n}{k}" for n in names)) for k in range(40)] * 2, ["doc_id", "text", "source", *names])
    got = mix.mix(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)


def test_no_source_gives_a_word_more_than_three_times(spark):
    rows = [(k, prose(k, 30 if k % 7 == 0 else 2) if k % 5 else "", f"s{min(k % 7, 1)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert max(Counter(r.doc_id for r in mix.mix(docs).collect()).values()) <= 3


def test_copies_with_clashing_names_and_other_columns(spark):
    rows = [(k % 4 if k % 5 else None, f"t{k % 3}", f"a{k}", f"b{k}", [k], {"x": k}) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, __sha string, row array<int>, extra map<string,int>")
    for drop in (exact_dedup.drop_copies, lambda d: ngram_join.drop_near_copies(d, words=1)):
        first, second = (sorted(map(str, drop(docs.repartition(n)).collect())) for n in (1, 5))
        assert len(first) == 3 and first == second
        kept = drop(docs)
        assert kept.columns == docs.columns and all(r.key[1:] == r["__sha"][1:] == str(r.row[0]) for r in kept.collect())


def test_a_record_missing_in_mid_file_changes_no_other(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"body {k}") for k in range(700)], "page_id long, url string, html string")
    bad = pages.where("page_id <> 10").withColumn("html", F.when(F.col("page_id") == 50, "x").otherwise(F.col("html")))
    bad = bad.unionByName(spark.createDataFrame([(300, "u300b", "new")], pages.schema))
    hashed = lambda d: warc_fixity.hashed_records(d, F.col("page_id"), F.shiftright("page_id", 8), F.col("url"), F.col("html"))
    found = warc_fixity.audit(hashed(pages), hashed(bad)).collect()
    assert sorted((r.fault, (r.a or r.b).key) for r in found if r.fault != "moved") == [("added", 300), ("changed", 50), ("missing", 10)]
    assert {r.file for r in found} <= {0, 1}


def test_deep_nesting_and_long_attributes_take_linear_time():
    start = time.perf_counter()
    found = html_text.blocks_of("<div>" * 100_000 + "<p>text</p>" + "<ul><li class=x>a" * 2000)
    found += html_text.blocks_of(f'<img alt="{"x > y " * 170_000}"><p>after</p>') + html_text.blocks_of("<svg>" * 50_000 + "<div><p>x" * 20_000)
    assert [b[3] for b in found[:1]] == ["text"] and "after" in {b[3] for b in found} and not any(">" in b[3] for b in found)
    assert time.perf_counter() - start < 6


def test_held_out_pages_of_the_labelled_table():
    pages, right, wrong, lost = html_text.labelled_pages(), 0, 0, 0
    for k in range(0, len(pages), 2):
        x, y = (np.concatenate(c) for c in zip(*(p for i, p in enumerate(pages) if i != k)))
        main, truth = html_text.Tree(x, y).shares(pages[k][0]) >= 0.5, pages[k][1] == 1
        right, wrong, lost = right + (main & truth).sum(), wrong + (main & ~truth).sum(), lost + (~main & truth).sum()
    assert right / (right + wrong) > 0.9 and right / (right + lost) > 0.9


def test_the_tree_asks_for_words_links_and_neighbours():
    used = {html_text.FEATURE_NAMES[f].split()[0] for f in html_text.trained().feature if f >= 0}
    assert {"words", "links", "share"} <= used


GOOD, BAD = "The committee met on Tuesday and agreed on the plan for the coming year.", "$$$ BUY buy BUY !!! >>> click ### 9999 %% win"


def test_lines_of_a_mixed_document_are_told_apart():
    docs = [[GOOD] * 6] * 30 + [[BAD] * 4 + [GOOD] * 2] * 30
    x = np.concatenate([crf.observed(d) for d in docs]).astype(np.float32)
    sizes, lengths = np.array([len(d) for d in docs]), np.array([len(line) for d in docs for line in d], float)
    field = crf.Field.fit(x, sizes, lengths, np.array([1.0] * 30 + [0.0] * 30))
    mixed = [GOOD] * 5 + [BAD] * 5 + [GOOD] * 5
    p = field.marginals(field.line_odds(mixed), np.array([len(mixed)]))
    assert p[[1, 2, 3, 11, 12, 13]].min() > 0.5 > p[[6, 7, 8]].max()


def enumerated(odds, step):
    """Marginals by the sum over all labellings."""
    n, total, good, pairs = len(odds), 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(o for o, v in zip(odds, y) if v) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return good / total, pairs / total


@pytest.mark.parametrize("sizes", ([1, 3, 2, 5], [9], [4] * 12))
def test_recursions_equal_the_sum_over_all_labellings(sizes, monkeypatch):
    rng = np.random.default_rng(1)
    odds, step, sizes = rng.normal(size=sum(sizes)) * 2, rng.normal(size=(2, 2)), np.array(sizes)
    for longest in (64, 2):  # together, and one by one
        p, pairs = crf.recursions(odds, sizes, step, True)
        want = [enumerated(o, step) for o in np.split(odds, np.cumsum(sizes)[:-1])]
        assert np.allclose(p, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))
        f, g = crf._odds_of_one(odds[: sizes[0]].tolist(), step)
        assert np.allclose(training.sigmoid(f + g), want[0][0])


def test_a_text_of_very_many_lines():
    field = crf.Field(np.full(crf.FEATURES, 0.1), np.array([[1.0, -1], [-1, 1]]), (1.0, 0.0))
    lines = [f"line {k} of many" for k in range(200_000)]
    start = time.perf_counter()
    p = field.marginals(field.line_odds(lines), np.array([len(lines)]))
    assert len(p) == len(lines) and np.isfinite(p).all() and time.perf_counter() - start < 10
    at = crf.BLOCK
    assert np.allclose(field.line_odds(lines[: at + 9])[at - 3 : at + 3], (crf.observed(lines[: at + 9]).astype(np.float32) @ field.weights)[at - 3 : at + 3], atol=1e-4)


def test_the_sample_is_bounded_whatever_the_tables_hold(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(3000)] + [(k, "x") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (None, 1)], "doc_id long, toxic int")
    found = training.labelled_sample(docs, labels, ["toxic"], rows=4000).collect()
    assert len(found) == 2 and {(r.doc_id, r.toxic) for r in found} == {(7, 1), (8, 1)}


def test_chain_predicts_categories_it_was_not_told(spark):
    rng = random.Random(2)
    bad = [["grumbo", "vlith"], ["snarfle", "quodge"]]
    rows, labels = [], []
    for k in range(600):
        words = prose(k, 40).split()
        if toxic := k % 3 == 0:
            words[5] = rng.choice(bad[k // 3 % 2])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id < 400"), ["toxic"], derived=2)
    assert model.categories == ["toxic_1", "toxic_2", "toxic"]
    got = toxicity.with_toxicity(docs.withColumn("p", F.lit(1)), model).where("doc_id >= 400").collect()
    wrong = sum((r.p_toxic >= 0.5) != (r.doc_id % 3 == 0) for r in got)
    assert wrong <= 4 and {"p", "p_toxic_1"} <= set(got[0].asDict())
    assert sum(r.p_toxic_1 >= 0.5 or r.p_toxic_2 >= 0.5 for r in got) >= 60


def test_copies_fall_into_one_fold():
    text = prose(3, 100)
    assert toxicity.group_of(text) == toxicity.group_of(text + " ") and toxicity.group_of(None) == toxicity.group_of("") == 0


def pieces_of(word, starts, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else starts
        end = next((e for e in range(min(len(word), at + 40), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_op8_equals_greedy_pieces_of_the_real_vocabulary(spark):
    starts, rest = map(set, wordpiece.sentencepiece_vocabulary(queries.PIECES))
    assert max(map(len, starts | rest)) <= 40
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    memo = {}
    for r in queries.op8_token_counts(spark, SF).collect():
        words = wordpiece.WORD.findall(texts[r.doc_id])
        counts = [memo.setdefault(w, pieces_of(w, starts, rest)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(1 if c is None else c for c in counts), counts.count(None))


def test_bpe_encodes_a_hot_long_text_once(spark):
    long = prose(1, 1500)
    docs = spark.createDataFrame([(None, long)] * 50 + [(k, long) for k in range(30)] + [(1, "short")], "doc_id long, text string").repartition(6)
    data = queries.rank_file()
    import public_tokenizers

    got = bpe.bpe_encode(docs, data, public_tokenizers.PATTERN, chunk=700, overlap=60).collect()
    assert len(got) == 81 and len({bytes(r.ids) for r in got}) == 2 and all(bytes(r.decoded).decode() in (long, "short") for r in got)
