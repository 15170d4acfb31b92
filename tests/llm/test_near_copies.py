"""One row stays of every near-duplicate group, with null and repeated ids too."""

import random

from scenemill.llm import ngram_join


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(300)}" for _ in range(n)]


def test_one_row_stays_of_every_group(spark):
    a, b, c, d = (prose(k, 200) for k in range(4))
    rows = [
        *((None, " ".join(a[k:])) for k in range(4)),  # a group without ids
        *((None, " ".join(a)) for _ in range(3)),
        (7, " ".join(b)),
        (2, " ".join(b[2:])),  # leads, and its id is repeated by a row that loses to 1
        (1, " ".join(c)),
        (2, " ".join(c[3:])),
        (5, " ".join(d)),
        (5, " ".join(d)),
        (9, None),
        (8, " "),
        (None, ""),
    ]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, extra long").repartition(3)
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in kept if x[0] is not None] == [(1, " ".join(c)), (2, " ".join(b[2:])), (5, " ".join(d)), (8, " ")]
    assert [x for x in kept if x[0] is None] and sum(x[0] is None for x in kept) == 1 and kept[-1][1] in {" ".join(a[k:]) for k in range(4)}
