"""Byte-level BPE encoding and decoding (operator 1).

Encoding keeps a doubly linked list of symbols and a priority queue of merge ranks. A popped
entry is stale when the pair at its place no longer has the entry's rank; it is then skipped.
Decoding concatenates the vocabulary's byte strings.

Defined results: texts of any length are encoded whole; a null text counts as empty; an empty text has no ids and decodes to "";
repeated rows are encoded each on their own; other columns of the input are ignored, so names
that clash with the outputs do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longer words are encoded but not remembered.
CACHED_WORD_CHARS = 48


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves,
    the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    chars = {chr(b): b for b in plain}
    shifted = (b for b in range(256) if chr(b) not in chars)
    return chars | {chr(256 + i): b for i, b in enumerate(shifted)}


class BpeCodec:
    """Encoder and decoder for one vocabulary file; lives in a Python worker."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *specials.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        # a pair of ids is one int, left << 20 | right; a merge's rank is its place in the list
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 20 | vocab[right], r)
            self.merged.append(vocab[left + right])
        self.specials = {t: struct.pack("<I", i) for t, i in specials.items()}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.words = regex.compile(WORD_PATTERN)
        self.cache = _WordCache(self, cache_words)

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank, self.merged
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # an entry is rank << 32 | place: the lowest rank first, the leftmost place among equals
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = following[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 20 | ids[j]) != entry >> 32:
                continue  # stale: one of the two symbols has been merged since
            ids[i] = new = merged[entry >> 32]
            ids[j] = -1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (r := rank.get(new << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] << 20 | new)) is not None:
                push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed little-endian unsigned 32-bit integers."""
        known = self.cache.__getitem__
        if self.special_split is None or not any(t in text for t in self.specials):
            return b"".join(map(known, self.words.findall(text)))
        out = []
        for part in self.special_split.split(text):
            out.append(self.specials[part] if part in self.specials else b"".join(map(known, self.words.findall(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _WordCache(dict):
    """Packed ids by word, bounded in entries and in the length of a word."""

    def __init__(self, codec: BpeCodec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.encode_word(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The worker's codec for a vocabulary file, loaded once per Python process."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, n_tokens (long), ids (binary: little-endian unsigned 32-bit integers) and
    decoded (string). ``tokenizer_path`` must be readable on every executor. No shuffle: each
    task streams its input in slices of ``batch_rows`` texts, so its memory is bounded.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                packed = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([bpe.decode(p) for p in packed], pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    out = source.mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
