"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts texts into chunks of about 1 KB, at places that depend on what is there
and not on where: documents that share a passage share its chunks.  A task encodes each chunk once.  A cut may fall
inside a word, so a chunk keeps its first and last piece as text; at every join the word across the cut and its
neighbours are encoded again, together, and the join is accepted if the neighbours' tokens agree with those of their
chunks.  If they don't, the stretch that is encoded again doubles until its ends agree or the whole text is in it.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: A cut is made at one byte in MEAN; texts are cut nowhere else.
MEAN = 1024
#: What a task remembers; past that it forgets and starts again.
MEMO_WORDS, MEMO_CHUNKS = 600_000, 15_000


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before which the bytes are cut: a rolling hash of 16 bytes, never inside a character."""
    gear = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    h = gear[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h >> np.uint32(12)) % np.uint32(MEAN) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


class Coder:
    """One task's tokenizer and what it has encoded so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Without a decoder of its own the library joins tokens by spaces.
        self.joined = self.tokenizer.decoder is None
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.tokens = [n.encode() for n in names]
        self.final = np.array([n.endswith("</w>") for n in names])
        self.sizes = np.array([len(n.removesuffix("</w>")) for n in names])
        self.words: dict = {}
        self.chunks: dict = {}

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words, many at a time where the tokens can be dealt back to them by their bytes."""
        plain = [w for w in words if self._plain(w)] if self.joined else []
        for s in range(0, len(plain), 512):
            if not self._together(plain[s : s + 512]):
                for w in plain[s : s + 512]:
                    self.words.pop(w, None)
        rest = [w for w in words if w not in self.words]
        ids = self._encode(rest)
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        for w, i, t in zip(rest, ids, texts, strict=True):
            self.words[w] = (array("I", i).tobytes(), t.encode())

    @staticmethod
    def _plain(word: bytes) -> bool:
        """Normalising keeps the number of its bytes, and no special token is in it."""
        if word.isascii():
            return b"<|" not in word
        text = word.decode()
        return unicodedata.is_normalized("NFC", text) and len(text.lower().encode()) == len(word) and b"<|" not in word

    def _together(self, words: list[bytes]) -> bool:
        """One encoding of all words: a word's tokens end where its bytes do.  False if any doesn't."""
        ids = np.array(self._encode([b" ".join(words)])[0], np.int64)
        done, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.searchsorted(done, ends)
        if not len(ids) or at[-1] != len(ids) - 1 or (done[at] != ends).any() or not self.final[ids[at]].all():
            return False
        raw, texts = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
        text = b" ".join(texts)
        upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        begin = start = 0
        for w, last, end in zip(words, (at + 1).tolist(), upto[at].tolist(), strict=True):
            self.words[w] = (raw[4 * begin : 4 * last], text[start : end - 1])
            begin, start = last, end
        return True

    def batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        if len(self.chunks) > MEMO_CHUNKS:
            self.chunks.clear()
        split, new, seen = [], {}, set()
        for t in texts:
            edges = [0, *cuts(np.frombuffer(t, np.uint8)).tolist(), len(t)]
            keys = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                chunk = t[a:b]
                key = xxhash.xxh3_128_intdigest(chunk)
                keys.append(key)
                if key not in self.chunks and key not in new:
                    new[key] = self._cut(chunk)
                    seen.update(new[key][1])
            split.append(keys)
        parts = [[self.chunks.get(k) or new[k] for k in keys] for keys in split]
        joins = [self._joins(p) for p in parts]
        seen.update(w for j in joins for w, _, _ in j)
        seen.update(w for j in joins for _, a, b in j for w in (a, b))
        self._learn([w for w in seen if w and w not in self.words])
        for k, (head, words, tail, inner) in new.items():
            got = [self.words[w] for w in words]
            self.chunks[k] = (head, (words[0], words[-1]) if words else (), tail, inner, b"".join([x for x, _ in got]), b" ".join([y for _, y in got if y]))
        fresh = {b" ".join([a, w, b]) for j in joins for w, a, b in j if w}
        again = dict(zip(fresh, self._encode(list(fresh)), strict=True))
        for t, keys, join in zip(texts, split, joins, strict=True):
            agrees = all(array("I", again[b" ".join([a, w, b])]).tobytes() == b"".join(self.words[x][0] for x in (a, w, b) if x) for w, a, b in join if w)
            if not agrees:
                yield self._repaired(t)
                continue
            ids, out, pending = [], [], iter(join)
            for n, key in enumerate(keys):
                head, _, tail, inner, own, text = self.chunks[key]
                if inner:
                    w = next(pending)[0]
                    if w:
                        ids.append(self.words[w][0])
                        out.append(self.words[w][1])
                    ids.append(own)
                    out.append(text)
            for w, _, _ in pending:
                if w:
                    ids.append(self.words[w][0])
                    out.append(self.words[w][1])
            yield b"".join(ids), b" ".join([x for x in out if x])

    @staticmethod
    def _cut(chunk: bytes) -> tuple:
        """(piece before the first white space, words between, piece after the last, has white space)."""
        words = chunk.split()
        if chunk[:1].strip() and chunk[-1:].strip() and len(words) == 1:
            return words[0], [], b"", False
        head = words.pop(0) if words and chunk[:1].strip() else b""
        tail = words.pop() if words and chunk[-1:].strip() else b""
        return head, words, tail, bool(chunk)

    @staticmethod
    def _joins(parts: list) -> list[tuple[bytes, bytes, bytes]]:
        """Per chunk with white space, and for the end of the text: the word across the cut before it, and the whole
        words on both sides."""
        found, across, before = [], b"", b""
        for head, words, tail, inner, *_ in parts:
            across += head
            if inner:
                found.append((across, before, words[0] if words else b""))
                before = words[-1] if words else across or before
                across = tail
        found.append((across, before, b""))
        return found

    def _repaired(self, text: bytes) -> tuple[bytes, bytes]:
        """Word by word; where a word's tokens don't agree with those of a longer stretch, that stretch's count."""
        words = text.split()
        self._learn(list({w for w in words if w not in self.words}))
        got, k = [], 0
        while k < len(words):
            reach = 1
            while True:
                a, b = max(0, k - reach), min(len(words), k + reach + 1)
                ids = array("I", self._encode([b" ".join(words[a:b])])[0]).tobytes()
                if ids == b"".join(self.words[w][0] for w in words[a:b]):
                    got.append(self.words[words[k]][0])
                    break
                if a == 0 and b == len(words):
                    return ids, self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
                reach *= 2
            k += 1
        ids = b"".join(got)
        return ids, self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs -> docs with ids (token ids as little-endian unsigned 32-bit integers), n_tokens and decoded.

    As the tokenizers library encodes and decodes whole texts without added special tokens; a null or empty text
    has no tokens and decodes to "".  vocabulary is a path that every executor has; public_tokenizers gives it by
    default.  Columns of the input stay, but for those named ids, n_tokens and decoded, which are replaced.
    """
    small_batches(docs.sparkSession, 128)
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    docs = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        coder = Coder(path)
        for b in batches:
            done = list(coder.batch([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]))
            n = pa.array([len(i) // 4 for i, _ in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i for i, _ in done], pa.binary()), n, pa.array([t for _, t in done], pa.binary()).cast(pa.string())], [*own, "ids", "n_tokens", "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, ids binary, n_tokens long, decoded string")
