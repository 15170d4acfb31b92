"""The pipeline's whole result against a plain version, on the smallest tables."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from scenemill.llm import bpe, queries, toxicity
from scenemill.llm.training import Sparse

from .test_operators import grams

SF = "/root/testdata/sf0.001"


def test_whole_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    chain = queries.toxicity_chain(spark, SF)
    rows = [r for r in docs if chain.scores(Sparse.of([toxicity.features(r.text)]))[0, -1] < 0.5]
    last = {}
    for r in rows:
        last[r.text or ""] = max(last.get(r.text or "", r), r, key=lambda x: x.doc_id)
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    sets = [grams(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    size = {r.doc_id: len([w for w in _words(r.text)]) for r in rows}
    times = mixed(rows, size)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(queries.rank_file()), special_tokens={})
    want = Counter()
    for r in rows:
        ids = plain.encode_ordinary(r.text or "")
        raw = np.array(ids, "<u4").tobytes()
        want[(r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += times[r.doc_id]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


def _words(text):
    import re

    return re.findall(r"[^ \t-\r]+", text or "")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def mixed(rows, size):
    """How often each row is taken: targets filled by weight, then rows in order of their hashes."""
    totals = defaultdict(int)
    for r in rows:
        totals[r.source] += size[r.doc_id]
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    everything, open_, target = sum(totals.values()), set(names), {}
    while True:
        left = everything - sum(3 * totals[s] for s in names if s not in open_)
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * totals[s]}
        if not full:
            break
        open_ -= full
    target = {s: share[s] if s in open_ else 3.0 * totals[s] for s in names}
    times = {}
    for s in names:
        base = min(3, int(target[s] // totals[s])) if totals[s] else 0
        rest, done = target[s] - base * totals[s], 0
        part = sorted((int(md5("mix-2:" + md5(md5(f"={r.doc_id}") + md5("" if s is None else f"={s}") + md5(r.text or "")) + ":1")[:15], 16), r.doc_id) for r in rows if r.source == s)
        taking = True
        for _, i in part:
            if taking and done + size[i] > rest:
                taking = False
                extra = done + size[i] - rest < rest - done
            else:
                extra = taking
            times[i] = base + int(extra and base < 3)
            done += size[i]
    return times
