"""Families of near copies: linear verification equals the pairwise one, and no link of real rows is lost."""

import random

from scenemill.llm import ngram_join, queries
from scenemill.llm.graph import components

from .test_operators import grams

SF = "/root/testdata/sf0.01"


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def families():
    """Tight families, chains whose ends aren't similar, and texts alone."""
    rows = []
    for f in range(4):
        base = prose(f, 150)
        rows += [" ".join(base[: 150 - k % 9]) for k in range(60)]
    for f in range(3):
        base = prose(100 + f, 400)
        rows += [" ".join(base[10 * k : 10 * k + 200]) for k in range(20)]
    rows += [" ".join(prose(500 + k, 60)) for k in range(30)] + ["", None, "one two", "one two"]
    random.Random(1).shuffle(rows)
    return [(k if k % 11 else None, t) for k, t in enumerate(rows)]


def test_kept_rows_are_the_same_with_and_without_pairs(spark, monkeypatch):
    docs = spark.createDataFrame(families(), "doc_id long, text string").repartition(4)
    for block in (512, 16):
        monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
        read = ngram_join.keyed(docs, "doc_id", "text")
        found = []
        for count in (True, False):
            signed, info = ngram_join.near_classes(read, 0.8, 0.9999, 5, count_links=count)
            rows = signed.select("doc_id", "digest").join(info.select("digest", "class_id"), "digest").collect()
            of = {}
            for r in rows:
                of.setdefault((r.class_id,) if r.class_id is not None else bytes(r.digest), set()).add(bytes(r.digest))
            found.append(sorted(map(sorted, of.values())))
        assert found[0] == found[1]


def test_every_link_of_ids_divisible_by_100(spark):
    """Recall against brute force on real rows: all links, counted exactly."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {i: grams(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in queries.op7_ngram_jaccard(spark, SF).collect()}
    assert set(got) == set(texts)
    n = 0
    for i in (i for i in texts if i % 100 == 0):
        links = set()
        for j, other in sets.items():
            common = len(sets[i] & other)
            if common and common >= 0.8 * (len(sets[i]) + len(other) - common):
                n += j != i
                assert got[j].class_id == got[i].class_id
                if other != sets[i]:
                    links.add(other)
        assert got[i].n_links == len(links)
    assert n > 0


def test_components_with_a_hub(spark):
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(200)] + [(rng.randrange(7000, 7100), rng.randrange(7000, 7100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
