"""The classifiers held against plain re-implementations of their features, ratios, updates and scores."""

import collections
import math
import re
import zlib

import numpy as np

from engram.llm import labelled, quality, toxicity
from tests.llm.test_operators import docs, empty  # noqa: F401

MASK = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def place(gram, bits):
    """An n-gram's hashed place: a character is its UTF-8 bytes, the first one highest."""
    run = 0
    for c in gram:
        run = (run * 0x9E3779B97F4A7C15 + mixed(int.from_bytes(c.encode(), "big") + 1)) & MASK
    return mixed((run + len(gram)) & MASK) >> (64 - bits)


def grams(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    plain = re.sub(" +", " ", " " + re.sub(r"[\x20\x09-\x0D]", " ", lower) + " ")
    runs = {plain[i : i + k] for k in range(3, 9) for i in range(len(plain) - k + 1)}
    return {g for g in runs if " " not in g[1:-1]}


TEXTS = ["Bad réeux words\t\there", "good words here", "", "  ", "bad RÉEUX again 漢字テスト 𝄞x", "a", "nothing to see", "réeux réeux", "x" * 50]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_character_ngrams():
    row, at = toxicity.present(*packed(TEXTS), 40)
    for i, text in enumerate(TEXTS):
        assert sorted(at[row == i].tolist()) == sorted(place(g, 40) for g in grams(text))
    assert len(toxicity.present(np.zeros(0, np.uint8), np.zeros(1, np.int64), 20)[0]) == 0


def test_toxicity_against_plain(spark):
    rows = [(i, f"{'vile ' * (i % 3)}réeux{i % 7} text {i % 5} about {'clean' if i % 2 else 'dull'} things {i % 11}" + (" achlich" if i % 4 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (999, 1), (1, None)], "doc_id long, toxic int")
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(documents, labels, bits=18, least=0.5)
    taught = sorted((i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2))
    p, q = collections.Counter(), collections.Counter()
    for i in taught:
        (p if i % 4 == 0 else q).update({place(g, 18) for g in grams(rows[i][1])})
    positive = sum(i % 4 == 0 for i in taught)
    want = {}
    for f in p | q:
        r = math.log((p[f] + 0.5) / (positive + 1)) - math.log((q[f] + 0.5) / (len(taught) - positive + 1))
        if p[f] + q[f] >= 4 and abs(r) >= 0.5:
            want[f] = r
    assert set(np.flatnonzero(model.weights).tolist()) <= set(want)
    # Each weight is the regression's weight times the ratio: the update by plain arithmetic, in the sample's order.
    sample = labelled.training_sample(documents, labels, "toxic", 4, 2, 3000, lambda d, o: toxicity.present(d, o, 18)).selectExpr("o", "k", "y").orderBy("o", "k").collect()
    assert sorted(r.k for r in sample) == taught
    w, g2, b, b2 = collections.Counter(), collections.defaultdict(lambda: 1e-8), 0.0, 1e-8
    for _ in range(8):
        for r in sample:
            f = [x for x in {place(g, 18) for g in grams(rows[r.k][1])} if x in want]
            e = 1 / (1 + math.exp(-(sum(w[x] * want[x] for x in f) + b))) - r.y
            for x in f:
                g = e * want[x] + 1e-4 * w[x]
                g2[x] += g * g
                w[x] -= 0.3 * g / math.sqrt(g2[x] + 1)
            b2 += e * e
            b -= 0.3 * e / math.sqrt(b2 + 1)
    assert abs(b - model.bias) < 1e-6 and all(abs(model.weights[f] - w[f] * want[f]) < 1e-5 for f in want)
    for r in toxicity.score_toxicity(documents, model).collect():
        total = sum(float(model.weights[x]) for x in {place(g, 18) for g in grams(rows[r.doc_id][1])})
        assert abs(r.score - 1 / (1 + math.exp(-(total + model.bias)))) < 1e-6


def test_quality_update_against_plain():
    rng = np.random.default_rng(4)
    rows = [(int(i % 3 == 0), np.append(np.unique(rng.integers(0, 60, 9)), 64 + i % 5)) for i in range(40)]
    model = quality.train(rows, bits=7)
    size, z, n = 128, collections.Counter(), collections.Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= 0.02 else -(z[f] - math.copysign(0.02, z[f])) / ((1 + math.sqrt(n[f])) / 4 + 0.1)

    for _ in range(3):
        for y, f in rows:
            value = dict.fromkeys(f[:-1].tolist(), 1 / math.sqrt(len(f) - 1)) | {int(f[-1]): 1.0, size: 1.0}
            e = 1 / (1 + math.exp(-sum(weight(x) * v for x, v in value.items()))) - y
            for x, v in value.items():
                old, g = weight(x), e * v
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / 4 * old
                n[x] += g * g
    assert abs(model.bias - weight(size)) < 1e-9 and all(abs(model.weights[f] - weight(f)) < 1e-6 for f in range(size))


def test_odd_rows(spark, docs, empty):  # noqa: F811
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    twice = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(docs.select("doc_id", "text"))
    for rows, folds, held in ((toxicity.toxicity(twice, labels).collect(), 4, 2), (quality.quality(twice, labels).collect(), 3, 1)):
        assert len(rows) == twice.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out is None if r.doc_id is None else r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    assert [r.score for r in toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()] == [0.5]
    assert quality.quality(empty, labels).count() == toxicity.toxicity(empty, labels).count() == 0


def test_sample_bounds(spark):
    documents = spark.createDataFrame([(i, f"word{i} and more") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    few = labelled.training_sample(documents, labels, "quality", 3, 1, 10, lambda d, o: quality.places_of(d, o, 12))
    assert few.count() == 10
    assert len(labelled.within(few, 4, 10**6)) == 4 and sum(len(f) for _, f in labelled.within(few, 100, 20)) <= 20
    assert labelled.within(few.limit(0), 4, 10) == []
