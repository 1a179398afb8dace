"""Byte-level BPE encoding and decoding; merges are picked by a segment tree over the ranks of adjacent pairs.

The tree's leaves hold rank and position of each pair of neighbours; its root is the leftmost pair of lowest rank. A merge
changes three leaves, each by a point update along the path to the root, and merging ends when the root holds no mergeable
pair. So a run of n bytes takes n log n steps, however long it is. Every run goes through the tree, short ones too.

Defined cases: null is the empty text (no ids); equal rows each give a row; a special token's string in a text is that
token; texts are never cut. The ids of frequent chunks are kept in a table of bounded size. A worker holds one Arrow batch (16 MB
of texts or one text, see common) with its ids, and some 120 bytes for each byte of the longest run without a blank.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import bounded_batches

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Over any pair's key: a leaf without a mergeable pair.
NONE = 1 << 62
#: Bits of a key that hold the position, and their mask.
PLACE, MASK = 32, (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def merge_all(ids: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Merge adjacent ids by the lowest rank, leftmost first, until no pair has a rank. made: the new id of each rank.

    tree[1] is the root, tree[k] the least of tree[2k] and tree[2k + 1], and the leaves from tree[size] on hold the pairs.
    """
    n, get = len(ids), ranks.get
    if n < 2:
        return ids
    leaves = [NONE if (r := get(p)) is None else r << PLACE | i for i, p in enumerate(zip(ids, ids[1:]))]
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * size + leaves + [NONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    root = tree[1]
    if root == NONE:
        return ids
    ids = ids[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while root != NONE:
        i = root & MASK
        j = after[i]
        left, new = before[i], made[root >> PLACE]
        ids[i], ids[j] = new, -1
        right = after[i] = after[j]
        # the pair at j is gone, the pairs at i and to its left have a new member
        changed = []
        if right < n:
            before[right] = i
            changed.append((j, NONE))
            r = get((new, ids[right]))
        else:
            r = None
            if j < n - 1:
                changed.append((j, NONE))
        changed.append((i, NONE if r is None else r << PLACE | i))
        if left >= 0:
            r = get((ids[left], new))
            changed.append((left, NONE if r is None else r << PLACE | left))
        for k, v in changed:
            k += size
            if tree[k] != v:
                tree[k] = v
                while k > 1:
                    w = tree[k ^ 1]
                    if w < v:
                        v = w
                    k >>= 1
                    if tree[k] == v:
                        break
                    tree[k] = v
        root = tree[1]
    return [x for x in ids if x >= 0]


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class ByteBPE:
    """A byte-level BPE of a tokenizer file. kept: how many chunks' ids are kept for reuse."""

    def __init__(self, path: str, kept: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.start = [vocab.get(c, -1) for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = dict(sorted((i, s) for s, i in vocab.items()))
        size = max([*names, *self.special.values()]) + 1
        self.bytes = [b""] * size
        for i, s in names.items():
            self.bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.chunks = _Chunks(self, kept // 2)
        self.kept = kept

    def piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token."""
        packed = self.pieces.get(piece)
        if packed is None:
            packed = pack(merge_all([self.start[b] for b in piece.encode("utf-8", "replace")], self.ranks, self.made))
            if len(self.pieces) < self.kept and len(piece) < 48:
                self.pieces[piece] = packed
        return packed

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk. Letters after at most one space are one pre-token, and so is a comma or full stop at the end behind them; for the rest the pattern decides."""
        core = chunk[1:] if chunk[0] == " " else chunk
        if core.isalpha():
            return self.piece(chunk)
        if core[-1] in ",." and core[:-1].isalpha():
            return self.piece(chunk[:-1]) + self.piece(core[-1])
        return self.packed(chunk)

    def plain(self, text: str) -> list[bytes]:
        """Packed ids of a text without special tokens. A single space between other characters always starts a pre-token, so the chunks there are encoded alone."""
        if "  " in text or text[-1:] == " ":
            return [self.packed(text)]
        first, *rest = text.split(" ")
        if not rest:
            return [self.chunks[first]] if first else []
        get = self.chunks.__getitem__
        out = [get(first)] if first else []
        out += map(get, [f" {x}" for x in rest])
        return out

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.piece, PATTERN.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(self.plain(text))
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.special[part].to_bytes(4, "little")] if k % 2 else self.plain(part) if part else []
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


class _Chunks(dict):
    def __init__(self, bpe: ByteBPE, kept: int):
        super().__init__()
        self.bpe, self.kept = bpe, kept

    def __missing__(self, chunk: str) -> bytes:
        out = self.bpe.chunk(chunk)
        if len(self) < self.kept and len(chunk) < 48:
            self[chunk] = out
        return out


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One tokenizer a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed, little-endian unsigned 32-bit), decoded (text of the ids) for each row of docs."""
    return _run(docs, path, "doc_id bigint, ids binary, decoded string", lambda ids, texts: [pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["ids", "decoded"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same rows with digests in place of the ids and texts."""

    def columns(ids: list[bytes], texts: list[str]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
        ]

    return _run(docs, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, path: str, schema: str, columns, names: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns(ids, [bpe.decode(x) for x in ids])], ["doc_id", *names])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, schema)
