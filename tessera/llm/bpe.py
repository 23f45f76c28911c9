"""Byte-pair encoding with a word-end marker, and decoding.

Each word is split by a priority queue of merge ranks over a doubly linked list
of symbols.  An entry of the queue that no longer describes two neighbouring
symbols is skipped when it comes out (stale entries are never searched for).
Decoding joins the vocabulary strings.

Everything is per row, so no shuffle is needed and a lost executor costs only
its tasks.  A worker keeps what it has found in two caches: whole stretches
between white space (at most ``CACHE_CHUNKS``), and, for stretches that are not
there, the words in them (at most ``CACHE_WORDS``), as rare stretches are mostly
known words with other punctuation.  Words beyond both are encoded again each time.

Defined results: a null text is encoded as the empty text (0 tokens, digests of
the empty string); rows with a null ``doc_id`` or repeated rows give one row
each; other columns are ignored whatever their names; an empty table gives an
empty result; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, small_batches, texts_of

#: Stretches between white space, and words, whose encoding a worker remembers.
CACHE_CHUNKS, CACHE_WORDS = 125_000, 250_000
#: Stretches and words longer than this are encoded each time they occur and never remembered.
CACHE_WORD_CHARS = 64
#: White space as the normalizer of the vocabulary file knows it.
_SPACE = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What Python's ``split()`` takes for white space and the normalizer does not.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Tokenizer:
    """Encodes and decodes with the vocabulary of a ``tokenizers`` JSON file (BPE, byte level, word-end suffix)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        #: Left id, right id and merged id by rank, and ranks by left id and right id.
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values(), default=-1) + 1)]
        for rank, (left, right, _) in enumerate(self.merges):
            self.ranks[left][right] = rank
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in ids.items()} | {i: s for s, i in self.specials.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        symbols = byte_symbols()
        self.inner = [ids.get(s) for s in symbols]
        self.last = [ids.get(s + self.suffix) for s in symbols]
        self.chunks: dict[str, tuple[int, bytes, str]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def normalize(self, text: str) -> str:
        """NFC and lower case letter by letter (so without the final sigma rule)."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def encode_word(self, word: str) -> list[int]:
        """Merge the word's symbols, lowest rank first, leftmost among equals."""
        data, merges, ranks = word.encode("utf-8"), self.merges, self.ranks
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # one number holds rank and place: such entries compare faster than tuples
        queue = [rank * n + at for at in range(n - 1) if (rank := ranks[ids[at]].get(ids[at + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            left, right, made = merges[rank]
            if ids[at] != left or (nxt := after[at]) >= n or ids[nxt] != right:
                continue  # stale: one of the two has been merged since
            ids[at], ids[nxt] = made, -1
            after[at] = far = after[nxt]
            if far < n:
                before[far] = at
                if (rank := ranks[made].get(ids[far])) is not None:
                    heapq.heappush(queue, rank * n + at)
            if (back := before[at]) >= 0 and (rank := ranks[ids[back]].get(made)) is not None:
                heapq.heappush(queue, rank * n + back)
        return [i for i in ids if i >= 0]

    def _new_word(self, word: str) -> tuple[int, ...]:
        got = tuple(self.encode_word(word))
        if len(self.words) < CACHE_WORDS and len(word) <= CACHE_WORD_CHARS:
            self.words[word] = got
        return got

    def _known(self, chunk: str) -> tuple[int, bytes, str]:
        """Token count, ids as little-endian 32-bit integers, and decoded text of what stands between white space (normalized).

        No token holds white space, so chunks are encoded apart.
        """
        get, new = self.words.get, self._new_word
        if not (ids := get(chunk)):  # a word by itself is one match of the pattern
            ids = []
            for w in self.word.findall(chunk):
                ids += get(w) or new(w)
        got = (len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids]))
        if len(self.chunks) < CACHE_CHUNKS and len(chunk) <= CACHE_WORD_CHARS:
            self.chunks[chunk] = got
        return got

    def _plain(self, text: str) -> list[tuple[int, bytes, str]]:
        text = self.normalize(text)
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        get, known = self.chunks.get, self._known
        return [get(c) or known(c) for c in chunks if c]

    def pieces(self, text: str) -> list[tuple[int, bytes, str]]:
        """The encoded chunks and special tokens of a text, in order."""
        if not self.special or not (found := list(self.special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [*self._plain(text[at : m.start()]), (1, struct.pack("<I", self.specials[m[0]]), m[0])]
            at = m.end()
        return out + self._plain(text[at:])

    def encode(self, text: str) -> list[int]:
        return [i for n, b, _ in self.pieces(text) for i in struct.unpack(f"<{n}I", b)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ``ids``; with no decoder in the file they are joined by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, SHA-256 digests of the ids and of the decoded text, and both themselves.

    Without ``with_ids`` or ``with_text`` these never leave the worker.
    The vocabulary file is read by each worker from ``vocab_path``, which is part of the environment.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocab_path)
        for b in batches:
            counts, digests, decoded_digests, ids, decoded = [], [], [], [], []
            for text in texts_of(b.column(1)):
                parts = t.pieces(text)
                packed = b"".join([p[1] for p in parts])
                plain = " ".join([p[2] for p in parts if p[0]])
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded_digests.append(hashlib.sha256(plain.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
                if with_text:
                    decoded.append(plain)
            fields = [pa.field("doc_id", b.column(0).type), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
            columns = [b.column(0), counts, digests, decoded_digests]
            if with_ids:
                fields, columns = [*fields, pa.field("ids", pa.list_(pa.int32()))], [*columns, ids]
            if with_text:
                fields, columns = [*fields, pa.field("decoded", pa.string())], [*columns, decoded]
            yield batch(pa.schema(fields), columns)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id and the text that its token ids decode to (null ids: null)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocab_path)
        for b in batches:
            texts = [None if ids is None else t.decode(ids) for ids in b.column(1).to_pylist()]
            yield batch(pa.schema([pa.field("doc_id", b.column(0).type), pa.field("decoded", pa.string())]), [b.column(0), texts])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
