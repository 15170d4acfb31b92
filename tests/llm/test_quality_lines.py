"""The field is fitted on whole texts."""

import numpy as np

from scenemill.llm import crf


def test_long_texts_train_with_all_their_lines(spark, monkeypatch):
    texts = ["\n".join(f"line {k} of {n}." if k % 3 else "!!" for k in range(n)) for n in (900, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(crf.Field, "fit", classmethod(lambda cls, x, sizes, lengths, good: seen.append((x, sizes, lengths))))
    crf.train(docs, labels)
    x, sizes, lengths = seen[0]
    assert list(sizes) == [900, 5] and len(lengths) == 905
    assert np.allclose(x, np.concatenate([crf.observed(t.split("\n")) for t in texts]), atol=1e-6)
