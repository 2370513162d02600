"""Sequence packing by the online sum-of-squares rule.

A document's ids end with one closing id. Whole windows are cut off its front; the rest goes to
the fill level that keeps the sum of squared counts of partially filled windows smallest, read off
a level array. Each task packs the documents it reads, so nothing is gathered;
when its input ends the emptiest open windows are cut up to fill the fullest, which leaves one padded window per task at
most. The rule keeps about as many windows open as would fill the levels once, some hundreds.

Texts that hold the string of one of the tokenizer's added tokens are encoded by the unchanged tokenizer as a whole.

Defined results: a null text counts as empty, and an empty text still has its closing id;
repeated rows are packed one by one; a null id stays null.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of, chunks

WINDOW, CLOSING = 2048, 1
CACHED_WORDS = 1_500_000
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # the apostrophe starts units of its own
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, remembered per blank-separated word.

    The tokenizer drops white space, never looks across it and folds case, so lower-cased words can be encoded on
    their own. A word of letters is one unit of the tokenizer, which ends with its only word-end token.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # parts of their strings in a word are ordinary text
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not remembered; kept as long as there is room."""
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        plain, other, joined, new, known = [], [], [], {}, self.known
        letters = list(map(str.isalpha, texts))
        plain += [x for x, ok in zip(zip(words, texts), letters) if ok]
        asked = set(words)
        odd = [x for x, ok in zip(zip(words, texts), letters) if not ok]
        # Letters and a tail of signs are two units, encoded one by one; letters are mostly known already.
        for (w, t), a in zip(odd, [w.rstrip(SIGNS) for w, _ in odd]):
            core = t[:len(t) - len(w) + len(a)]
            if not core.isalpha():
                other.append((w, t))
                continue
            b = w[len(a):]
            joined.append((w, a, b))
            if a not in known and a not in asked:
                asked.add(a)
                plain.append((a, core))
            if b not in known and b not in asked:
                asked.add(b)
                other.append((b, b.decode()))
        for i in range(0, len(plain), 20_000):
            part = plain[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a letter the tokenizer's own tables don't take for one
                other += part
                continue
            raw, stops = ids.tobytes(), (4 * stops).tolist()
            new.update(zip([w for w, _ in part], map(raw.__getitem__, map(slice, [0, *stops], stops))))
        found = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
        new |= {w: np.array(e.ids, "<u4").tobytes() for (w, _), e in zip(other, found)}
        new |= {w: (known[a] if a in known else new[a]) + (known[b] if b in known else new[b]) for w, a, b in joined}
        if len(self.known) + len(new) <= self.most:
            self.known.update(new)
        return new

    def of(self, given: list[bytes]) -> list[bytes]:
        texts = [t.lower() for t in given]
        marked = {i: raw for i, (raw, t) in enumerate(zip(given, texts)) if any(a in t for a in self.added)}
        split = [[] if i in marked else t.split() for i, t in enumerate(texts)]
        out = self._joined(split)
        if marked:
            self.tokenizer.encode_special_tokens = False  # as it comes
            for i, raw in marked.items():
                out[i] = np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            self.tokenizer.encode_special_tokens = True
        return out

    def _joined(self, split: list[list[bytes]]) -> list[bytes]:
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        open_ = [i for i, ids in enumerate(found) if None in ids]
        if open_:
            new = self.learn(list({w: None for i in open_ for w, ids in zip(split[i], found[i]) if ids is None}))
            for i in open_:
                found[i] = [new[w] if ids is None else ids for w, ids in zip(split[i], found[i])]
        return [b"".join(ids) for ids in found]


class Levels:
    """Open windows by fill level, and the rule that picks one."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.stacks: dict[int, list[list]] = {}
        self.open = 0

    def choose(self, n: int) -> int:
        """Level (0 is a new window) whose use for n ids makes the sum of squared counts smallest; ties to the fullest."""
        c = self.counts
        at = np.flatnonzero(c[1:self.size - n + 1]) + 1
        landed = np.where(at + n < self.size, 2 * c[at + n] + 1, 0)
        best, cost = 0, 2 * c[n] + 1
        if len(at):
            change = landed - 2 * c[at] + 1
            i = len(at) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(at[i])
        return best

    def take(self, level: int) -> list:
        window = self.stacks[level].pop()
        self.counts[level] -= 1
        self.open -= 1
        return window

    def put(self, level: int, window: list) -> None:
        self.stacks.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1

    def place(self, piece: tuple):
        """Put a piece (id, start, ids, document size) shorter than a window; returns the window if that fills it."""
        n = len(piece[2]) // 4
        level = self.choose(n)
        window = self.take(level) if level else []
        window.append(piece)
        if level + n == self.size:
            return window
        self.put(level + n, window)
        return None

    def settle(self):
        """Cut up the emptiest open windows to fill the fullest until one is open at most; yields full ones."""
        while self.open > 1:
            levels = np.flatnonzero(self.counts)
            top, bottom = int(levels[-1]), int(levels[0])
            target, source = self.take(top), self.take(bottom)
            space, rest = self.size - top, bottom
            while space and source:
                key, start, ids, total = source.pop()
                n = len(ids) // 4
                if n > space:
                    source.append((key, start, ids[:4 * (n - space)], total))
                    start, ids, n = start + n - space, ids[4 * (n - space):], space
                target.append((key, start, ids, total))
                space, rest = space - n, rest - n
            if rest:
                self.put(rest, source)
            if space:
                self.put(self.size - space, target)
            else:
                yield target

    def drain(self):
        yield from self.settle()
        for level in np.flatnonzero(self.counts):
            while self.counts[level]:
                yield self.take(int(level))


def pack(docs: DataFrame, id_col="doc_id", text_col="text", path: str = TOKENIZER, window: int = WINDOW,
         closing: int = CLOSING) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32 bit), doc_tokens, sequence_id, offset."""
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    end = np.array([closing], "<u4").tobytes()

    def run(batches):
        words, levels = WordIds(path), Levels(window)
        number = TaskContext.get().partitionId() << 40
        done: list[tuple] = []

        def close(pieces):
            nonlocal number
            at = 0
            for key, start, ids, total in pieces:
                done.append((key, start, len(ids) // 4, ids, total, number, at))
                at += len(ids) // 4
            number += 1

        def rows():
            cols = list(zip(*done)) if done else [[]] * 7
            done.clear()
            kinds = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return batch_of(**{n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds)})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, data, off in chunks(batch.column(1)):
                raw = data.tobytes()
                for key, ids in zip(keys[i:j], words.of([raw[off[r]:off[r + 1]] for r in range(j - i)])):
                    ids += end
                    total = len(ids) // 4
                    cut = total - total % window
                    for at in range(0, cut, window):
                        close([(key, at, ids[4 * at:4 * (at + window)], total)])
                    if cut < total:
                        full = levels.place((key, cut, ids[4 * cut:], total))
                        if full:
                            close(full)
                if done:
                    yield rows()
        for left in levels.drain():
            close(left)
        if done:
            yield rows()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, "
             "sequence_id long, offset long")
