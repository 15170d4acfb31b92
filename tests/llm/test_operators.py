"""The dealt operators on small tables of hard rows, against brute force."""

import hashlib
import random
import re
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.llm import bpe, crf, exact_dedup, html_text, mix, ngram_join, queries, tiff, toxicity, warc_fixity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, node long"
WORDS = [f"w{k}" for k in range(300)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(1, 15_000) + " " + "x" * 3000 + "\n\n" + prose(2, 9_000) + " ünï 漢字 🙂"
NEAR = prose(3, 200).split()
TEXTS = [None, "", "", "one two", "one two", LONG, LONG, " ".join(NEAR), " ".join(NEAR[:-4]), " ".join(NEAR[6:]), prose(4, 90), "  \t\n", "\U0001f642" * 40]
ROWS = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "x", 1.0, 5) for k, t in enumerate(TEXTS)] + [(None, "null id", "en", "s1", 1, None, None, None), (3, "one two", "en", "s0", 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tiff_round_trip(docs):
    read = tiff.tiff_read(tiff.tiff_store(docs.select("doc_id", "text"), "doc_id"), "doc_id")
    found = read.select("doc_id", F.aggregate("pages", F.lit(b""), lambda a, p: F.concat(a, p["samples"])).alias("payload")).collect()
    want = []
    for r in ROWS:
        raw = (r[1] or "").encode()
        want.append((r[0], raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.payload)) for r in found), key=key) == sorted(want, key=key)


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    same = {}
    for r in ROWS:
        same.setdefault(hashlib.sha256((r[1] or "").encode()).digest(), []).append(r[0])
    for r in got:
        ids = same[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(same)


def test_exact_groups_when_digests_collide_and_are_hot(docs):
    plain = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    clash = exact_dedup.exact_groups(docs, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)), hot_share=1000).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, plain)) == sorted(map(str, clash))


def test_mix_reaches_its_targets(docs):
    got = mix.mix_taken(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r.size for r in got)
    for source in {r.source for r in got}:
        part = [r for r in got if r.source == source]
        largest = max(r.size for r in part)
        assert abs(sum(r.taken for r in part) - part[0].target) <= largest
    salted = mix.mix_taken(docs, limit=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, salted))


def grams(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def test_ngram_join_finds_every_link(docs):
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(ROWS)
    sets = {g for g in (grams(r[1]) for r in ROWS) if g}
    links = {g: 0 for g in sets} | {frozenset(): 0}
    for a, b in combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            links[a] += 1
            links[b] += 1
    want = sorted((str(r[0]), links[grams(r[1])]) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id[7] == by_id[8] == by_id[9] == 7 and by_id[10] == 10


def test_bpe_agrees_with_tiktoken(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    data = queries.rank_file(path)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(data), special_tokens={})
    want = sorted((str(r[0]), tuple(plain.encode_ordinary(r[1] or ""))) for r in ROWS)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (500, 40)):
        got = bpe.bpe_encode(docs, data, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
        ids = lambda b: tuple(int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4))
        assert sorted((str(r.doc_id), ids(bytes(r.ids))) for r in got) == want
        texts = {str(r[0]): (r[1] or "").encode() for r in ROWS}
        assert all(bytes(r.decoded) == texts[str(r.doc_id)] for r in got)


def greedy(word, starts, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return wordpiece.UNKNOWN
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    rng = random.Random(5)
    for _ in range(300):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        starts, rest = [piece() for _ in range(8)], [piece() for _ in range(8)]
        automaton = wordpiece.Automaton(starts, rest)
        for _ in range(40):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, set(starts), set(rest)), (word, starts, rest)


def test_token_counts_handle_every_row(docs):
    got = wordpiece.token_counts(docs, *wordpiece.sentencepiece_vocabulary(queries.PIECES)).collect()
    assert len(got) == len(ROWS) and all(r.n_words == 0 == r.n_tokens for r in got if r.doc_id in (0, 1, 2))


def test_fixity_finds_changed_missing_and_added_records(spark):
    pages = spark.createDataFrame([(k, f"u{k}", None if k == 4 else "b" * k) for k in range(700)], "page_id long, url string, html string")
    hashed = lambda d: warc_fixity.hashed_records(d, F.col("page_id"), F.floor(F.col("page_id") / 256), F.col("url"), F.col("html"))
    bad = pages.withColumn("html", F.when(F.col("page_id").isin(5, 300), F.translate("html", "b", "c")).otherwise(F.col("html"))).where("page_id <> 699")
    found = {(r.file, r.place, r.fault) for r in warc_fixity.audit(hashed(pages), hashed(bad)).collect()}
    assert found == {(0, 5, "changed"), (1, 44, "changed"), (2, 187, "missing")}
    assert warc_fixity.audit(hashed(pages), hashed(pages)).isEmpty()


def test_main_text(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A &amp; B</h1><p>" + "word  " * 50 + "</p><script>var x = '<p>no</p>';</script><p>" + "more " * 30 + "</p></article><div class='comments'><p>nice post</p></div><footer><p>Copyright</p></footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    assert got[1] == "A & B\n" + " ".join(["word"] * 50) + "\n" + " ".join(["more"] * 30)
    assert got[2] == got[3] == ""


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.op6_quality_crf(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert auc([(r.score, r.quality) for r in scored.collect()]) > 0.85


def test_toxicity_chain_on_documents_it_did_not_see(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"), queries.CATEGORIES)
    seen = toxicity.toxicity(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert auc([(r.p_toxic, r.toxic) for r in seen]) > 0.9


def test_scores_of_hard_rows_and_missing_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in crf.quality(docs, crf.train(docs, none)).collect()} == {0.5}
    model = toxicity.train(docs, none, ["toxic"])
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.p_toxic < 0.01 for r in got)


def test_empty_tables(spark, empty):
    data, none = queries.rank_file(), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        tiff.tiff_read(tiff.tiff_store(empty.select("doc_id", "text"), "doc_id"), "doc_id"),
        exact_dedup.exact_groups(empty),
        mix.mix_taken(empty),
        ngram_join.ngram_join(empty),
        bpe.bpe_encode(empty, data, public_tokenizers.PATTERN),
        wordpiece.token_counts(empty, ["a"], ["b"]),
        toxicity.toxicity(empty, toxicity.train(empty, none, ["toxic"])),
        crf.quality(empty, crf.train(empty, none)),
        html_text.main_text(empty.withColumn("html", F.lit(None).cast(T.StringType()))),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
