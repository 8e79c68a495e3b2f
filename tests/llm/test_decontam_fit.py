import random
import zlib

import numpy as np

from hazardgrid.llm import decontam as D


def test_sketch_holds_every_passage_of_every_text(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    number = {w.encode(): i for i, w in enumerate(vocab[:30])}
    texts = [" ".join(rng.choices(vocab, k=n)) for n in (1, 24, 25, 48, 49, 72, 500, *range(2, 90))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (900, None), (901, "")]
    want, df = np.zeros((D.SKETCH, 30), np.int64), np.zeros(31, np.int64)
    for key, text in rows:
        ws = (text or "").split()
        df[-1] += 1
        for w in {w.encode() for w in ws} & number.keys():
            df[number[w]] += 1
        spots, signs = D.passage_spots([zlib.crc32((text or "").encode(), zlib.crc32(repr(None if key is None else str(key)).encode()))], np.array([len(ws) // D.STEP + 1]))
        for p, start in enumerate(range(0, max(1, len(ws) - D.STEP), D.STEP)):
            for w in ws[start:start + D.PASSAGE]:
                if w.encode() in number:
                    want[spots[p], number[w.encode()]] += signs[p]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["row"]: np.frombuffer(r["counts"], np.int64) for r in D.added(D.scan(docs, number)).collect()}
        assert (got.pop(-1) == df).all()
        have = np.zeros_like(want)
        for row, counts in got.items():
            have[row] = counts
        assert (have == want).all()


def test_space_follows_what_texts_share():
    items = np.eye(3, 12)
    sketch = np.zeros((D.SKETCH, 12))
    sketch[:, 7:9] = 1.0
    space = D.latent_space(items, sketch, 4)
    shared = np.zeros(12)
    shared[7:9] = np.sqrt(0.5)
    assert np.allclose(space @ (space.T @ shared), shared, atol=1e-3) and np.allclose(space @ (space.T @ items.T), items.T, atol=1e-3)
