"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import ann, bpe, jpeg, near, packing, quality, queries, secrets, sstable, suffix, toxicity
from engram.llm.components import components
from engram.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b   c", "a\n b \n c\t\td", "x<|endoftext|>y <|endoftext|>", "<|startoftext|>Hi", "ΣΑΣ İstanbul", "éa   b", "日本語 テスト 123", "it's we'll I'd  can't",
    "\x1cabc\x1d d", "a b 　c", "🙂🙂 ok 👩‍👩‍👧", "x" * 3000, "ab" * 2000, "­ soft­hyphen", "a\r\nb\r\n", "  lead", "trail  ", "aaaaaaa aaaa aaa", "\x00\x01 z", "ﬁ ½ ² ①", "a\u0085b", "<|endoftext",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Real texts, and every odd case: nulls, empties, repeats, clashing columns."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no identifier"), (2001, "same"), (2001, "same"), (2001, "other")], "doc_id long, text string")
    return real.unionByName(odd).withColumns({"score": F.lit("clash"), "ids": F.lit(1), "key": F.lit(None).cast("int"), "h": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# --- token files ---


def test_encoders_equal_library():
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(" abcdeé'\n\tst<|>1́ß ") for _ in range(60)) for _ in range(150)]
    for path in (WORD, BYTE):
        for kind in (bpe.TrieBpe, bpe.LibraryBpe):
            e = bpe.Encoder(path, kind)
            for t in texts:
                want = e.vocabulary.tokenizer.encode(t, add_special_tokens=False).ids
                assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == want, (path, kind, t)
                assert e.decode(np.array(want, "<u4")).decode() == e.vocabulary.tokenizer.decode(want, skip_special_tokens=False)


def test_encoder_with_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    e = bpe.Encoder(BYTE, bpe.TrieBpe)
    for t in ["one two three four five one", "x" * 200 + " two nine", "one two"]:
        assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == e.vocabulary.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.kept) <= 3


def test_encoding_digest(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, text in rows_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.encoding_digest(docs, WORD).collect()) == want
    assert bpe.encoding_digest(empty, WORD).count() == 0


def test_table_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = sstable.write_tables(docs, WORD, 2)
    assert sorted(map(tuple, sstable.read_tables(manifest).collect()), key=lambda r: r[1]) == want
    m = manifest.orderBy("shard").collect()
    found = [sstable.Reader(open(r.path[7:], "rb")).get(1002) for r in m if r.first_id is None or r.first_id <= 1002 <= r.last_id]
    assert [x.tolist() for x in found if x is not None] == [[*t.encode(ODD[2], add_special_tokens=False).ids, 2]]
    assert all(sstable.Reader(open(r.path[7:], "rb")).get(77_777) is None for r in m)
    assert sstable.token_tables(empty, WORD).count() == 0


def test_table_blocks(tmp_path):
    entries = [(sstable.key_of(i), np.arange(i % 900, dtype="<u2").tobytes()) for i in range(0, 4000, 2)]
    told = {}
    (tmp_path / "x").write_bytes(b"".join(sstable.table_bytes(entries, 2, told)))
    r = sstable.Reader(open(tmp_path / "x", "rb"))
    assert list(r) == entries and told["entries"] == 2000 and len(r.places) > 5
    assert all(r.get(i).tolist() == list(range(i % 900)) for i in (0, 2, 1998, 3998)) and all(r.get(i) is None for i in (1, -5, 4001))
    data = bytearray((tmp_path / "x").read_bytes())
    data[10] ^= 1
    (tmp_path / "y").write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.Reader(open(tmp_path / "y", "rb")))


# --- media ---


def test_jpeg_round_trip():
    rnd = random.Random(2)
    for n in (0, 1, 575, 576, 577, 5000):
        p = jpeg.padded(rnd.randbytes(n))
        image = jpeg.decode(jpeg.encode_payload(p))
        assert len(p) % 576 == 0 and jpeg.payload_of(image) == p and jpeg.to_rgb(image).shape == (image.height, image.width, 3)


def general_file(coefficients):
    """A grey progressive file with real Huffman tables, runs, several bands, refinement and restarts, written by the standard's rules."""
    out = [b"\xff\xd8", jpeg.segment(0xDB, bytes([0]) + bytes(range(1, 65)))]
    rows, columns, _ = coefficients.shape
    out.append(jpeg.segment(0xC2, bytes([8, 0, rows * 8, 0, columns * 8, 1, 1, 0x11, 0])))
    symbols = sorted({r << 4 | s for r in range(16) for s in range(11)} | {r << 4 for r in range(15)})
    out += [jpeg.segment(0xC4, bytes([0] + [0] * 3 + [12] + [0] * 12) + bytes(range(12))), jpeg.segment(0xC4, bytes([0x10] + [0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))]
    bits = lambda v, n: [(v >> (n - 1 - i)) & 1 for i in range(n)]
    code = lambda s: bits(symbols.index(s), 8)
    amp = lambda v, s: bits(v if v > 0 else v + (1 << s) - 1, s)
    flat = coefficients.reshape(-1, 64)
    shift = lambda v, n: -(-v >> n) if v < 0 else v >> n
    stream, before = [], 0
    for b in flat:
        v = int(b[0]) >> 1
        s = abs(v - before).bit_length()
        stream += bits(s, 4) + (amp(v - before, s) if s else [])
        before = v
    out += [jpeg.scan_head([(1, 0)], (0, 0), 0, 1), jpeg.packed(np.array(stream, np.uint8))]
    for lo, hi in ((1, 9), (10, 63)):
        stream, run = [], 0
        for b in flat:
            values = [shift(int(v), 1) for v in b[lo : hi + 1]]
            zeros = 0
            if any(values) and run:
                n = run.bit_length() - 1
                stream += code(n << 4) + bits(run - (1 << n), n)
                run = 0
            last = max((i for i, v in enumerate(values) if v), default=-1)
            for v in values[: last + 1]:
                if v == 0:
                    zeros += 1
                    continue
                while zeros > 15:
                    stream += code(0xF0)
                    zeros -= 16
                s = abs(v).bit_length()
                stream += code(zeros << 4 | s) + amp(v, s)
                zeros = 0
            run += last + 1 < len(values)
        if run:
            n = run.bit_length() - 1
            stream += code(n << 4) + bits(run - (1 << n), n)
        out += [jpeg.scan_head([(1, 0)], (lo, hi), 0, 1), jpeg.packed(np.array(stream, np.uint8))]
    out += [jpeg.scan_head([(1, 0)], (0, 0), 1, 0), jpeg.packed(np.array([int(b[0]) & 1 for b in flat], np.uint8))]
    stream = []
    for b in flat:
        zeros, waiting = 0, []
        known = [shift(int(v), 1) for v in b[1:]]
        new = [k for k in range(63) if not known[k] and b[k + 1]]
        for k in range(63):
            v = int(b[k + 1])
            if known[k]:
                waiting.append(abs(v) & 1)
            elif v:
                stream += code(zeros << 4 | 1) + [1 if v > 0 else 0] + waiting
                zeros, waiting = 0, []
            else:
                if zeros == 15 and any(k <= x for x in new):
                    stream += code(0xF0) + waiting
                    zeros, waiting = 0, []
                else:
                    zeros += 1
        if zeros or waiting:
            stream += code(0) + waiting
    out += [jpeg.scan_head([(1, 0)], (1, 63), 1, 0), jpeg.packed(np.array(stream, np.uint8)), b"\xff\xd9"]
    return b"".join(out)


def test_jpeg_general_decoder():
    rng = np.random.default_rng(4)
    c = np.zeros((3, 4, 64), np.int64)
    c[..., 0] = rng.integers(-200, 200, (3, 4))
    c[..., 1:] = np.where(rng.random((3, 4, 63)) < 0.15, rng.integers(-30, 31, (3, 4, 63)), 0)
    c[1, 1, 1:] = 0
    image = jpeg.decode(general_file(c))
    got = image.components[0].coefficients.copy()
    # A zero run of exactly the rest of a band may end a block either way; values must agree everywhere.
    assert (got == c).all()
    rgb = jpeg.to_rgb(image)
    natural = np.zeros((8, 8))
    natural.ravel()[jpeg.ZIGZAG] = c[2, 3] * np.arange(1, 65)
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    want = np.clip(np.rint(basis.T @ natural @ basis + 128), 0, 255)
    assert np.abs(rgb[16:24, 24:32, 0] - want).max() <= 1 and (rgb[..., 0] == rgb[..., 2]).all()


def test_media_digest(docs, empty):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in jpeg.media_digest(docs).collect())
    pad = lambda t: t + b"\xff" * (-len(t) % 576 or (0 if t else 576))
    want = collections.Counter((i, len(t.encode()), len(p := pad(t.encode())), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t in rows_of(docs))
    assert got == want
    assert jpeg.media_digest(empty).count() == 0
    tensors = jpeg.decode_media(jpeg.encode_media(docs.limit(3))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in tensors)


# --- repeated passages ---


def brute_windows(texts, n):
    c = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    return [np.array([c[t[i : i + n]] > 1 for i in range(len(t) - n + 1)], bool) for t in texts]


def test_merged_transforms():
    rnd = random.Random(3)
    for _ in range(12):
        base = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 120))) for _ in range(6)]
        texts = [b"".join(rnd.choice(base)[rnd.randint(0, 20) :] for _ in range(rnd.randint(1, 4))) + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(12)]
        texts += [b"ab" * 50, b"x" * 90, b"short"]
        got = suffix.repeated_windows([np.frombuffer(t, np.uint8) for t in texts], 40, 10, shard_bytes=300)
        assert all((a == b).all() for a, b in zip(got, brute_windows(texts, 40)))


def removal_brute(rows, n):
    texts = [t.encode() for _, t in rows]
    out = collections.Counter()
    for (i, _), t, starts in zip(rows, texts, brute_windows(texts, n)):
        cover = np.zeros(len(t), bool)
        for p in np.flatnonzero(starts):
            cover[p : p + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("splits", [None, ((2, 0.99),), ((2, 0.84),)])
def test_removal(spark, docs, monkeypatch, splits):
    if splits:
        monkeypatch.setattr(suffix, "SPLITS", splits)
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(700))
    extra = spark.createDataFrame([(5000 + i, f"{i} start " * 20 + passage[i * 9 : 600 + i * 9] + f" end {i}" * 30) for i in range(8)] + [(6000, "na " * 400), (6001, passage[:399]), (6002, "é" * 500)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    assert collections.Counter(tuple(r) for r in suffix.removal_digest(df).collect()) == removal_brute(rows_of(df), 400)


def test_removal_text(spark, tmp_path):
    passage = " ".join("".join(random.Random(7 * i).choice("abcdefgh") for _ in range(9)) for i in range(60))
    halves = "".join(random.Random(i).choice("ijklmnop") for i in range(420))
    rows = [(1, f"left one {passage} right one"), (2, f"before two {passage} behind two"), (3, "alone"), (4, None), (5, "xé" + halves + "éy"), (6, "z©" + halves + "èw")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_bwt_merge(spark, str(tmp_path)).collect()}
    assert list(got[1].asDict())[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert [got[i].text for i in range(1, 7)] == ["left oneright one", "before twobehind two", "alone", "", "xy", "zw"]
    assert all(got[i].kept_sha256 == hashlib.sha256(got[i].text.encode()).hexdigest() for i in range(1, 5))
    assert got[5].n_removed == got[6].n_removed == 1 + 420 + 1


def test_removal_empty(empty, docs):
    assert suffix.removal_digest(empty).count() == 0
    same = suffix.remove_repeats(docs, 200, 50)
    assert same.columns == docs.columns and same.count() == docs.count()


# --- near-duplicates ---


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near_brute(rows, n):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near(spark, docs, empty):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(150)]
    copies = []
    for k in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        copies.append((7000 + k, " ".join(w)))
    extra = spark.createDataFrame(copies + [(8000, "Only Three words"), (8001, "only three WORDS"), (8002, "\t\n")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    got, rows = near.near_duplicates(df, n=4).collect(), rows_of(df)
    want = near_brute(rows, 4)
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(shingle_set(t, 4))) for i, t in rows)
    assert near.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[400:]
    assert (near.merged(near.registers(a), near.registers(b)) == near.registers(x[: len(x)])).all()
    regs = [r[None, :] for r in (near.registers(a), near.registers(b))]
    above, below = (regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1)
    grid = np.linspace(0, 0.76, 77)
    best = grid[np.argmax([near.log_likelihood(np.array([2000 / 4600]), np.array([j]), above, below)[0] for j in grid])]
    assert abs(best - 1600 / 3000) < 0.2
    same = near.registers(a)[None, :]
    assert near.plausible(np.array([2000.0]), np.array([2000.0]), same, same, 0.8)[0]
    other = near.registers(rng.integers(0, 2**63, 2000, dtype=np.uint64))[None, :]
    assert not near.plausible(np.array([2000.0]), np.array([2000.0]), same, other, 0.8)[0]


def test_star_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == got[100] == 100
    assert components(edges.limit(0)).count() == 0


# --- neighbours ---


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0, None] + [0.0] * 10), (5004, [1.0]), (None, [1.0] * 12), (5100, rows[7][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.nearest_neighbours(df, every=50).collect()
    ids, m = np.array([*range(1500), 5100]), np.vstack([x, x[7:8]]).astype(float)
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        d = np.sqrt(((m - m[list(ids).index(q)]) ** 2).sum(1))
        true = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and all(abs(s - d[list(ids).index(v)]) < 1e-12 for _, v, s in mine)
        hit, total = hit + len({v for _, v, _ in mine} & set(ids[true])), total + 10
    assert hit / total >= 0.9
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 100] == list(range(10)) and all(r.score == 0 for r in got)


# --- classifiers ---


def accuracy(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    return sum(a == b for a, b in held) / len(held)


def test_quality(spark, docs, empty):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{data}/documents.parquet"), labels).collect()
    assert accuracy(rows, labels, "quality") >= 0.93 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    odd = quality.quality(docs, labels.where("quality = 1"))
    assert odd.count() == docs.count() and odd.where("score is null").count() == 0
    assert quality.quality(empty, labels).count() == 0
    none = quality.quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.keep_quality(docs, quality.FtrlModel(np.zeros(0), 0.0, 4, 0.9)).count() == docs.count()


def test_toxicity(spark, docs, empty):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{data}/documents.parquet"), labels).collect()
    assert accuracy(rows, labels, "toxic") >= 0.97
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0


# --- secrets ---


def test_base_patterns():
    key = "A" * 4 + "KIA"
    text = f'password: "hunter22" token=abc\nAPI_KEY = sk-123456789 x {key[3:]}ABCDEFGHIJKLMNOP deadbeef {"0af9" * 9} password=token:abcdefghij ſecret=12345678'
    want = []
    for kind, pattern in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                want.append((m.start(), m.end(), kind))
    assert sorted(secrets.base_spans(text)) == sorted(want) and len(want) == 4


def test_assignments():
    text = 'KEY_MATERIAL = "x9Kq2mZp7LwT4"\nconn = KEY_MATERIAL\ndb_password = conn\nname = "John Smith 12"\ncolor: "blue-green-77"\npassword = "changeme"\na = b\nb = a\n'
    assert [text[a:b] for a, b, k in secrets.scan(text) if k == "named"] == ["x9Kq2mZp7LwT4"]
    assert secrets.redact("abc password=12345678 def", secrets.scan("abc password=12345678 def")) == "abc [SECRET] def"
    assert secrets.scan("") == [] and secrets.scan("z" * 200_000 + " = ") == []


def test_secret_digest(docs, empty):
    got = secrets.secret_digest(docs).collect()
    assert len(got) == docs.count() and all(r.base_sha256 for r in got) and secrets.secret_digest(empty).count() == 0
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.where("text is null").count() == docs.where("text is null").count()


# --- packing ---


def test_packing(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    t, df = Tokenizer.from_file(BYTE), docs.repartition(20)
    want, total = collections.Counter(), 0
    for i, text in rows_of(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    rows = packing.pack(df, BYTE, size=256).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= -(-total // 256) * 1.05 + 2
    assert packing.pack(empty, BYTE).count() == 0


def test_best_fit():
    where, offset, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert len(fills) == 2 and fills.tolist() == [10, 10] and where[0] == where[2] and offset.tolist() == [0, 0, 6, 5, 8]
    assert len(packing.best_fit(np.zeros(0, np.int64), 10)[2]) == 0 and packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1, 1024) == [(0, 1)] and packing.cut(1024, 1024) == [(0, 1024)]
