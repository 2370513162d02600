"""Byte-level BPE encoding and decoding as a tree reduction.

The splitting pattern's matches are encoded separately. A match is cut in halves down to short leaves; two encoded
neighbours are joined by encoding a window of tokens around the seam again, growing it until its outer tokens
come out unchanged (or the side is used up). Then everything outside is final: a token sequence is the
encoding of its bytes exactly if each two neighbouring tokens are the encoding of theirs, and all pairs outside the window
and across its borders are pairs that were there before. Decoding concatenates halves up the same tree.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows are
encoded one by one; ids beyond the vocabulary raise.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF, CACHED, CHUNK = 24, 1_200_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, cached: int = CACHED):
        self.ranks = read_ranks(path)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        # The pattern's blanks are Unicode's White_Space.
        self.matches = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                     .replace(r"\S", r"\P{White_Space}")).findall
        self.leaf, self.cached = leaf, cached
        self.known: dict[str, bytes] = {}
        self.table = None

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank until none can be merged."""
        ranks, get = self.ranks, self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            i = pairs.index(low)
            joined = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(joined + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + joined, _NONE)
        return [ranks[p] for p in parts]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match by halves."""
        own = self.ranks.get(piece)
        if own is not None:
            return [own]
        if len(piece) <= self.leaf:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two encoded neighbours."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            head, tail = left[len(left) - a:], right[:b]
            new = self.merge(self.decode(head) + self.decode(tail))
            grow_a = a < len(left) and new[0] != head[0]
            grow_b = b < len(right) and new[-1] != tail[-1]
            if not grow_a and not grow_b:
                return left[:len(left) - a] + new + right[b:]
            a, b = a + (a if grow_a else 0), b + (b if grow_b else 0)

    def decode(self, ids) -> bytes:
        """Bytes of ids, halves concatenated up the tree; a leaf's tokens are gathered from one table."""
        n = len(ids)
        if n <= 8:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        if n > 1 << 15:
            return self.decode(ids[:n // 2]) + self.decode(ids[n // 2:])
        if self.table is None:
            size = max(self.bytes_of) + 1
            self.size_of = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
            self.start_of = np.cumsum(self.size_of) - self.size_of
            self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        ids = np.asarray(ids)
        if ids.min() < 0 or ids.max() >= len(self.size_of) or not self.size_of[ids].all():
            raise ValueError("an id beyond the vocabulary")
        size = self.size_of[ids]
        end = np.cumsum(size)
        return self.table[np.repeat(self.start_of[ids] - (end - size), size) + np.arange(end[-1])].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers in native order."""
        found = self.matches(text)
        known = self.known
        ids = list(map(known.get, found))
        left = ids.count(None)
        at, passing = -1, {}
        for _ in range(left):
            at = ids.index(None, at + 1)
            m = found[at]
            new = known.get(m) or passing.get(m)
            if new is None:
                new = _pack(self.encode_piece(m.encode()))
                if len(known) < self.cached:
                    known[m] = new
                else:
                    passing[m] = new
            ids[at] = new
        return b"".join(ids)


_NONE = 1 << 62


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(p) // 4 for p in parts]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = BytePairs(path, pattern)
        for batch in batches:
            texts, out, at, size = batch.column(1), [], 0, 0
            for r in range(batch.num_rows):
                out.append(coder.encode(texts[r].as_py() or ""))
                size += len(out[-1])
                if size > CHUNK:
                    yield batch_of(**{id_col: batch.column(0).slice(at, len(out)), "ids": _lists(out)})
                    at, out, size = at + len(out), [], 0
            if out:
                yield batch_of(**{id_col: batch.column(0).slice(at, len(out)), "ids": _lists(out)})

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode(rows: DataFrame, id_col="doc_id", ids_col="ids", path: str = RANKS) -> DataFrame:
    """The rows' id and ids, and the decoded bytes; null ids count as none."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = BytePairs(path)
        for batch in batches:
            ids = batch.column(1)
            step = 256
            for i in range(0, batch.num_rows, step):
                some = ids.slice(i, step)
                filled = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
                stops = np.cumsum(filled)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                out = [coder.decode(flat[a - n:a]) for a, n in zip(stops.tolist(), filled.tolist())]
                yield batch_of(**{id_col: batch.column(0).slice(i, step), "ids": some, "decoded": pa.array(out, pa.binary())})

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded binary")
