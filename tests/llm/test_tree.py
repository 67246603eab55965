"""The k-means tree walked with several leaves, and tensors in the media query's result."""

import hashlib

import numpy as np

from engram.llm import ann, jpeg
from tests.llm.test_operators import docs, empty  # noqa: F401


def test_small_tables_have_several_leaves(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16))
    tree = ann.grow(x, ann.leaves_for(300, 300))
    assert tree.leaves >= 8 and len(np.unique(tree.assign(x))) >= 8
    assert sorted(tree.order(x[0])) == list(range(tree.leaves)) and next(tree.order(x[0])) == tree.assign(x[:1])[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, every=10).collect()
    hit = 0
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 300 >= 0.9 and len(got) == 300
    assert all(r.calibrated_recall >= 0.96 for r in got)
    assert ann.leaves_for(40, 40) < 8 and ann.leaves_for(10**9, 20_000) <= ann.MOST_LEAVES


def test_tensors_are_returned(docs):  # noqa: F811
    for r in jpeg.media_digest(docs.limit(30)).collect():
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert jpeg.feature_of(rgb) == r.feature
    long = docs.limit(1).selectExpr("1L as doc_id", "repeat('long text ', 30000) as text").collect()
    data = jpeg.padded(long[0].text.encode())
    image = jpeg.decode(jpeg.encode_payload(data))
    assert hashlib.sha256(jpeg.payload_of(image)).digest() == hashlib.sha256(data).digest()
