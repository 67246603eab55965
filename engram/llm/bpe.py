"""BPE encoding and decoding of whole texts by the vocabulary file of a public tokenizer.

Texts are cut into chunks at white space in such a way that no merge crosses a cut; a chunk's pre-tokens
are encoded once for a worker and kept in a bounded table. Two ways encode the distinct pre-tokens:

- ``TrieBpe`` inserts them into a trie (their sorted order is its depth-first order, shared prefixes are
  kept on a stack) and passes each node's last token on: the last token of a prefix ending at d is the one
  token t over [k, d) that stays apart from the last token of the prefix ending at k. The encoding of a
  shared prefix is thus computed once, and a word's tokens are read back along the last tokens.
- ``LibraryBpe`` asks the tokenizers library's model for each.

Both give the library's ids, which tests hold them to, special tokens in the text included.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded each for itself; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents_of, kept_for_tasks

KEPT_CHUNKS = 800_000
KEPT_WORDS = 400_000
NO_RANK = 1 << 60


def byte_chars() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: its parts, and how texts fall into chunks and chunks into pre-tokens."""

    #: Characters whose normal form, case and class are the same in all Unicode versions in use.
    SAFE = re.compile(r"[!-~¡-ɏ]*")

    UNSURE = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
    SURE_CUT = re.compile(rb"(?<=[!-~])(?= [!-~])")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pre = spec["pre_tokenizer"]
        #: White space is dropped and so parts chunks, or a space belongs to the word after it.
        self.dropped = pre["type"] == "Sequence"
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"] if self.dropped else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.words = regex.compile(pattern)
        self.table = {b: c for b, c in byte_chars().items()}
        self.decoder = spec["decoder"]
        self.tokens = [b""] * (max([*self.vocab.values(), *self.special.values()], default=-1) + 1)
        self.plain = list(self.tokens)
        back = {c: b for b, c in self.table.items()}
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
            self.plain[i] = bytes(back[c] for c in t) if all(c in back for c in t) and t not in self.special else t.encode()

    def chunks(self, text: bytes) -> list[bytes]:
        """Keys of a text's parts, whose encodings, one after the other, are the text's.

        Where spaces belong to the words after them, a key stands for a space and the word; one that starts with a space for what follows it."""
        if self.dropped:
            return text.split()  # ASCII white space only: it never lies in a pre-token
        # A space between two other characters starts a pre-token. Where white space comes in runs or in other kinds, only cuts between plain characters are sure.
        if any(w in text for w in self.UNSURE):
            return [b" " + x for x in self.SURE_CUT.split(text)]
        parts = text.split(b" ")
        parts[0] = b" " + parts[0]
        return parts

    def pretokens(self, chunk: bytes) -> list[str | int]:
        """Byte-level words of a chunk; special tokens as their ids."""
        if not self.dropped:
            chunk = chunk[1:] if chunk.startswith(b" ") else b" " + chunk
        return self._words_of(chunk.decode("utf-8", "replace"))

    def _words_of(self, text: str) -> list[str | int]:
        if self.special_cut and "<" in text and self.special_cut.search(text):
            out: list[str | int] = []
            for part in self.special_cut.split(text):
                out += [self.special[part]] if part in self.special else self._words_of(part) if part else []
            return out
        if not self.SAFE.fullmatch(text.lstrip(" ") if not self.dropped else text):
            if self.tokenizer.normalizer is not None:
                text = self.tokenizer.normalizer.normalize_str(text)
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if self.dropped:
            text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        if text.isascii():
            return [w.replace(" ", "Ġ") for w in ([text] if text.isalpha() else self.words.findall(text))]
        return [w.encode().decode("latin-1").translate(self.table) for w in self.words.findall(text)]


class LibraryBpe:
    """Pre-tokens by the tokenizers library's own model."""

    def __init__(self, vocabulary: Vocabulary):
        self.model = vocabulary.tokenizer.model

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        of = self.model.tokenize
        return {w: array("I", [t.id for t in of(w)]).tobytes() for w in words}


class TrieBpe:
    """Pre-tokens by depth-first propagation of last tokens through their trie."""

    def __init__(self, vocabulary: Vocabulary):
        v, suffix = vocabulary.vocab, vocabulary.suffix
        self.inner = {t: i for t, i in v.items() if not (suffix and t.endswith(suffix))}
        self.last = {t[: -len(suffix)]: i for t, i in v.items() if t.endswith(suffix)} if suffix else self.inner
        self.longest = max(map(len, [*self.inner, *self.last]), default=1)
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, (a, b) in enumerate(vocabulary.merges):
            made = v[a + b]
            self.merge[v[a], v[b]] = rank
            self.parts[made] = (v[a], v[b], rank)
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's edge as it is built, each with the rank that ends it."""
        out, rank = [(token, NO_RANK)], 0
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, rank))
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam between two tokens before they are complete. Of equal ranks the left merges first."""
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            known = not any((m := self.merge.get((x, y))) is not None and m < ends and m <= ending for x, ends in self._spine(a, 1) for y, ending in self._spine(b, 0))
            self.apart[key] = known
            if len(self.apart) > 3_000_000:
                self.apart.clear()
        return known

    def is_whole(self, token: int) -> bool:
        """Whether a token's own string encodes to that token."""
        known = self.whole.get(token)
        if known is None:
            known = token not in self.parts or (self.is_whole(self.parts[token][0]) and self.is_whole(self.parts[token][1]) and self._joined(token))
            self.whole[token] = known
        return known

    def _joined(self, token: int) -> bool:
        a, b, rank = self.parts[token]
        return not any((m := self.merge.get((x, y))) is not None and m < min(ends, rank) and m <= min(ending, rank) and (x, y) != (a, b) for x, ends in self._spine(a, 1) for y, ending in self._spine(b, 0))

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        inner, last, apart, longest = self.inner, self.last, self.apart, self.longest
        before = ""
        token, start = [0], [0]  # along the trie's path: the last token of each prefix, and where it starts
        for w in sorted(words):
            n = len(w)
            if n == 0:
                out[w] = b""
                continue
            shared, most = 0, min(len(before), n) - 1
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del token[shared + 1 :], start[shared + 1 :]
            for d in range(shared + 1, n + 1):
                table = last if d == n else inner
                for k in range(d - 1, max(-1, d - longest - 1), -1):
                    t = table.get(w[k:d])
                    if t is None:
                        continue
                    if k == 0:
                        if not self.is_whole(t):
                            continue
                    elif token[k] < 0:
                        continue
                    else:
                        ok = apart.get(token[k] << 32 | t)
                        if not (self.stay_apart(token[k], t) if ok is None else ok):
                            continue
                    token.append(t)
                    start.append(k)
                    break
                else:
                    token.append(-1)  # no encoding ends here: a character outside the vocabulary
                    start.append(d - 1)
            ids, d = [], n
            while d > 0:
                if token[d] >= 0:
                    ids.append(token[d])
                d = start[d]
            ids.reverse()
            out[w] = array("I", ids).tobytes()
            token.pop(), start.pop()  # the last character's token is of the word's end, not of the path
            before = w[: n - 1] if n else ""
        return out


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, bpe: type = TrieBpe):
        self.vocabulary = Vocabulary(path)
        self.bpe = bpe(self.vocabulary)
        self.kept: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, new: Iterable[bytes]) -> dict[bytes, bytes]:
        parts = {c: self.vocabulary.pretokens(c) for c in new}
        missing = {w for p in parts.values() for w in p if isinstance(w, str) and w not in self.words}
        fresh = self.bpe.encode(missing)
        words = self.words
        if len(words) + len(fresh) <= KEPT_WORDS:
            words.update(fresh)
            fresh = {}
        return {c: b"".join([(fresh.get(w) or words.get(w, b"")) if isinstance(w, str) else w.to_bytes(4, "little") for w in p]) for c, p in parts.items()}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        chunks = [self.vocabulary.chunks(t) for t in texts]
        found = self.kept
        new = set().union(*chunks).difference(found)
        learned = self._learn(new) if new else {}
        # Short ones are kept; once the table is full, the first ones seen, which hold the frequent ones, stay.
        kept = set(islice((c for c in learned if len(c) < 64), max(0, KEPT_CHUNKS - len(found))))
        found.update(learned)
        get = found.__getitem__
        out = [b"".join(map(get, x)) for x in chunks]
        for c in learned.keys() - kept if len(kept) < len(learned) else ():
            del found[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode with special tokens kept, as UTF-8."""
        v = self.vocabulary
        if v.decoder is None:
            return b" ".join(map(v.tokens.__getitem__, ids.tolist()))
        return v.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()


def encoder(path: str, bpe: type = TrieBpe) -> Encoder:
    """One for each worker process, kept from task to task until one of another kind lets it go."""
    if (path, bpe) not in kept_for_tasks:
        kept_for_tasks[path, bpe] = Encoder(path, bpe)
    return kept_for_tasks[path, bpe]


def in_groups(texts: list[bytes | None], most: int = 1 << 21) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t or b"")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            at = 0
            for group in in_groups(b.column(1).cast(pa.binary()).to_pylist()):
                ids = [np.frombuffer(x, "<u4") for x in e.encode(group)]
                listed = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                decoded = pa.array([e.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)), listed, decoded], ["doc_id", "ids", "decoded"])
                at += len(group)

    return documents_of(documents).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same encoding, digested where it is made."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for group in in_groups(b.column(1).cast(pa.binary()).to_pylist()):
                for x in e.encode(group):
                    n.append(len(x) // 4)
                    ids_sha.append(sha256(x).hexdigest())
                    decoded_sha.append(sha256(e.decode(np.frombuffer(x, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
