"""Substring dedup on a de Bruijn graph: words covered by a window of ``WINDOW`` words that also starts elsewhere go.

The graph's edges are the word k-mers of one window's length, its nodes the k-mers shorter by a word, so that a
repeated edge is a repeated window. Documents are written once, in chunks of some megabytes that keep their number;
every later step sends packed arrays from chunks to buckets of hashes and joins the answers back by chunk:

1. Candidates. All occurrences of an edge have the same minimiser, the gram of ``GRAM`` words with the smallest hash.
   Chunks send their distinct minimisers, buckets answer which of them occur twice or more in the corpus. Edges with
   a lone minimiser are unique and go no further.
2. Edges. Every other k-mer becomes an edge with the words before and after it. Chunks merge equal edges first, so an
   edge of very many documents costs an entry per chunk. Buckets answer whether an edge is repeated, whether all
   its occurrences have one successor and whether they have one predecessor.
3. Compaction. The join of these answers with the chunks gives the repeated nonbranching paths: an edge and the next
   one are joined where the node between them has one way in and one way out. Every occurrence of an edge then runs
   through its whole path, so the occurrences of a path have the same extent, and one row stands for all its windows.
4. Verification. The words at the source coordinates of every path are read again and digested with 128 bits; a path
   is removed only where another place has the same words. Hashes alone never decide; a repeat could stay hidden only
   where two different words with equal 64-bit hashes stand in equal surroundings.

Every step but the last join moves fixed-width hashes; texts travel compressed, by chunk, three times.

Defined results: a null text has no words; fewer than ``WINDOW`` words lose nothing; repeated rows are copies like any
other and both lose what they share; ids of any type are carried along and may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.batches import batch_of, chunks, mix, powers, span_hashes, word_bounds
from labelloom.llm.components import groups
from labelloom.session import checked_broadcast, materialize, shuffle_width

WINDOW = 35
GRAM = 8
CHUNK_BYTES = 2 << 20
PART_BYTES = 24 << 20  # text behind one partition of hash buckets
PER_PART = 6  # buckets per partition, so that partitions are even
EDGE, NONE, MIXED = np.uint64(1), np.uint64(2), np.uint64(0)
REPEATED, ONE_NEXT, ONE_BEFORE = 1, 2, 4
_LOW = np.uint64(0xFFFFFFFF)


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, size, ids, ends, blob): consecutive documents with their compressed texts under one number."""

    def run(batches):
        part, n, codec = TaskContext.get().partitionId(), 0, pa.Codec("zstd")
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1), CHUNK_BYTES):
                ids = batch.column(0).slice(i, j - i)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.concat_arrays([ids]))
                yield batch_of(chunk=np.array([(part << 32) | n]), size=np.array([len(data)]), ids=ids,
                               ends=pa.array([off[1:].tobytes()], pa.binary()),
                               blob=pa.array([codec.compress(data.tobytes(), asbytes=True)], pa.binary()))
                n += 1

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("ends", T.BinaryType()),
        T.StructField("blob", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


class Chunk:
    """Words of a chunk, hashes of its windows and their minimisers."""

    def __init__(self, size: int, ends: bytes, blob: bytes):
        self.data = np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        self.off = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.starts, self.ends, self.row = word_bounds(self.data, self.off) if size else (np.zeros(0, np.int64),) * 3

    def hash_windows(self) -> None:
        """Window starts, window hashes and, per window, the index of its minimiser's run."""
        n = len(self.starts)
        self.words = span_hashes(self.data)(self.starts, self.ends) if n else np.zeros(0, np.uint64)
        if n < WINDOW:
            self.at, self.edges, self.grams, self.run = np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64)
            return
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=sums[1:])

        def rolled(k):
            return mix((sums[k:] - sums[:-k]) * down[:n - k + 1])

        gram = rolled(GRAM)
        # Smallest gram of every window, the leftmost on ties: the hash's upper half, then the place.
        low = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        width, step = WINDOW - GRAM + 1, 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
        self.at = np.flatnonzero(self.row[WINDOW - 1:] == self.row[:n - WINDOW + 1])
        self.edges = rolled(WINDOW)[self.at]
        place = (low[self.at] & _LOW).astype(np.int64)
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]
        self.run = np.cumsum(fresh) - 1
        self.grams = mix(gram[place[fresh]])  # the smallest hashes lie close together, their own hashes do not

    def candidates(self, bounds, answers) -> np.ndarray:
        """Indices of the windows whose minimiser is repeated, by the buckets' answers."""
        keys, back = np.unique(self.grams, return_inverse=True)
        return np.flatnonzero(_answered(keys, bounds, answers)[back][self.run] > 0)

    def neighbours(self, some: np.ndarray):
        """Hashes of the words after and before the windows ``some``, NONE at the ends of a document."""
        first, n = self.at[some], len(self.words)
        after, before = np.minimum(first + WINDOW, n - 1), np.maximum(first - 1, 0)
        inside = (first + WINDOW < n) & (self.row[after] == self.row[first])
        preceded = (first > 0) & (self.row[before] == self.row[first])
        return np.where(inside, self.words[after] | EDGE, NONE), np.where(preceded, self.words[before] | EDGE, NONE)

    def written(self):
        """All words, each followed by a blank, and the place of every word in it."""
        size = self.ends - self.starts
        place = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        out[_spread(place[:-1], size)] = self.data[_spread(self.starts, size)]
        return out, place


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices first[i] .. first[i] + size[i] - 1, in order."""
    done = np.cumsum(size)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(first - (done - size), size)


def _bounds(buckets: int) -> np.ndarray:
    """Smallest hash of every bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _dealt(chunk: int, keys: np.ndarray, bounds: np.ndarray, **more):
    """A row per bucket with the chunk's sorted distinct keys in it, and the columns that go with them."""
    cut = np.concatenate([[0], np.searchsorted(keys, bounds, "left"), [len(keys)]])
    some = np.flatnonzero(cut[1:] > cut[:-1])

    def packed(values):
        return pa.array([values[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary())

    return batch_of(bucket=some.astype(np.int32), chunk=np.full(len(some), chunk), keys=packed(keys),
                    **{name: packed(values) for name, values in more.items()})


def _answered(keys: np.ndarray, bounds: np.ndarray, answers) -> np.ndarray:
    """The buckets' answers in the order of the keys; buckets that say nothing have no repeated key."""
    cut = np.concatenate([[0], np.searchsorted(keys, bounds, "left"), [len(keys)]])
    out = np.zeros(len(keys), np.uint8)
    for a in answers or ():
        out[cut[a["bucket"]]:cut[a["bucket"] + 1]] = np.frombuffer(a["said"], np.uint8)
    return out


def _merged(order_keys: np.ndarray):
    """(order, index of the first row of each run of equal keys, run of each ordered row)."""
    order = np.argsort(order_keys, kind="stable")
    key = order_keys[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _one(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run the value that all its rows have, or MIXED."""
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(low == high, low, MIXED)


def _per_chunk(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make(row, chunk)`` for every chunk, as batches."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):  # one chunk at a time in memory
                row = batch.slice(r, 1).to_pylist()[0]
                chunk = Chunk(row["size"], row.pop("ends"), row.pop("blob"))
                chunk.hash_windows()
                out = make(row, chunk)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, schema)


def _asked(dealt: DataFrame, parts: int, name: str, answer) -> DataFrame:
    """Answers of the buckets by chunk: (chunk, answers), written."""

    def run(batches):
        for rows in groups(batches, ["bucket"]):
            keys = [np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()]
            size = np.array([len(k) for k in keys])
            said = answer(rows, np.concatenate(keys))
            ends = np.cumsum(size)
            yield batch_of(chunk=rows["chunk"].to_numpy(), bucket=rows["bucket"].to_numpy(),
                           said=pa.array([said[e - s:e].tobytes() for s, e in zip(size, ends)], pa.binary()),
                           any=np.add.reduceat(said, ends - size, dtype=np.int64) > 0)

    said = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(run, "chunk long, bucket int, said binary, any boolean").where("any")
    return materialize(said.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "said")).alias(name)), name)


def _repeated_grams(table: DataFrame, bounds: np.ndarray) -> DataFrame:
    def send(row, chunk):
        if not len(chunk.grams):
            return None
        keys, count = np.unique(chunk.grams, return_counts=True)
        return _dealt(row["chunk"], keys, bounds, twice=(count > 1).astype(np.uint8))

    def answer(rows, keys):
        twice = np.frombuffer(b"".join(rows["twice"].to_pylist()), np.uint8)
        order, first, run = _merged(keys)
        often = np.add.reduceat(1 + twice[order].astype(np.int64), first) > 1
        said = np.empty(len(keys), np.uint8)
        said[order] = often[run]
        return said

    dealt = _per_chunk(table, "bucket int, chunk long, keys binary, twice binary", send)
    return _asked(dealt, (len(bounds) + 1) // PER_PART, "gram_answers", answer)


def _edge_verdicts(candidates: DataFrame, bounds: np.ndarray) -> DataFrame:
    def send(row, chunk):
        some = chunk.candidates(bounds, row["gram_answers"])
        if not len(some):
            return None
        after, before = chunk.neighbours(some)
        order, first, _ = _merged(chunk.edges[some])
        count = np.diff(np.append(first, len(order)))
        return _dealt(row["chunk"], chunk.edges[some][order][first], bounds, twice=(count > 1).astype(np.uint8),
                      after=_one(after[order], first), before=_one(before[order], first))

    def answer(rows, keys):
        twice = np.frombuffer(b"".join(rows["twice"].to_pylist()), np.uint8)
        after, before = (np.frombuffer(b"".join(rows[c].to_pylist()), np.uint64) for c in ("after", "before"))
        order, first, run = _merged(keys)
        often = np.add.reduceat(1 + twice[order].astype(np.int64), first) > 1
        verdict = often * (REPEATED + ONE_NEXT * (_one(after[order], first) > NONE) + ONE_BEFORE * (_one(before[order], first) > NONE))
        said = np.empty(len(keys), np.uint8)
        said[order] = verdict[run]
        return said

    dealt = _per_chunk(candidates, "bucket int, chunk long, keys binary, twice binary, after binary, before binary", send)
    return _asked(dealt, (len(bounds) + 1) // PER_PART, "edge_answers", answer)


def _paths(judged: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(chunk, first, windows, words): repeated nonbranching paths at their source coordinates, with the digest of their words."""

    def make(row, chunk):
        some = chunk.candidates(bounds, row["gram_answers"])
        keys, back = np.unique(chunk.edges[some], return_inverse=True)
        verdict = _answered(keys, bounds, row["edge_answers"])[back]
        some, verdict = some[verdict > 0], verdict[verdict > 0]
        if not len(some):
            return None
        first = chunk.at[some]
        # Windows that start at consecutive words share the node between them.
        fresh = np.ones(len(some), bool)
        fresh[1:] = ((first[1:] != first[:-1] + 1) | (chunk.row[first[1:]] != chunk.row[first[:-1]])
                     | (verdict[:-1] & ONE_NEXT == 0) | (verdict[1:] & ONE_BEFORE == 0))
        head = np.flatnonzero(fresh)
        windows = np.diff(np.append(head, len(some)))
        text, place = chunk.written()
        text, lo, hi = text.tobytes(), place[first[head]], place[first[head] + windows + WINDOW - 1]
        words = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
        return batch_of(chunk=np.full(len(head), row["chunk"]), first=first[head], windows=windows, words=pa.array(words, pa.binary()))

    return _per_chunk(judged, "chunk long, first long, windows long, words binary", make)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, kept) of every row: spans are the maximal removed runs of words [start, stop), kept the other
    words joined by one space."""
    spark = docs.sparkSession
    table = materialize(_chunked(docs, id_col, text_col), "chunks")
    size = table.agg(F.sum("size")).first()[0] or 0
    bounds = _bounds(PER_PART * max(shuffle_width(spark), size // PART_BYTES))
    grams = _repeated_grams(table, bounds)
    candidates = table.drop("ids").join(grams.hint("merge"), "chunk")
    edges = _edge_verdicts(candidates, bounds)
    paths = materialize(_paths(table.drop("ids").join(grams.join(edges, "chunk").hint("merge"), "chunk"), bounds), "paths")
    # Words that no other source coordinate has; counts combine before the shuffle, and few paths are left over.
    lone = paths.groupBy("words").agg(F.count("*").alias("n"), F.min("chunk").alias("chunk"), F.min("first").alias("first"))
    lone = materialize(lone.where("n = 1").select("chunk", "first"), "lone")
    gone = paths.join(checked_broadcast(lone), ["chunk", "first"], "left_anti").groupBy("chunk").agg(F.collect_list(F.struct("first", "windows")).alias("paths"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("size", "ends", "blob", "paths")}
                yield _cut(batch.column("ids")[r].values, Chunk(row["size"], row["ends"], row["blob"]), row["paths"] or [])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(
            "n_words long, spans array<struct<start:long,stop:long>>, kept string").fields])
    return table.join(gone.hint("merge"), "chunk", "left").select("ids", "size", "ends", "blob", "paths").mapInArrow(run, schema)


def _cut(ids: pa.Array, chunk: Chunk, paths: list[dict]) -> pa.RecordBatch:
    """The documents of a chunk without the words of the paths."""
    n, rows = len(chunk.starts), len(ids)
    step = np.zeros(n + 1, np.int64)
    first = np.array([p["first"] for p in paths], np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + np.array([p["windows"] for p in paths], np.int64) + WINDOW - 1, -1)
    gone = np.cumsum(step[:n]) > 0
    words = np.searchsorted(chunk.row, np.arange(rows + 1))  # first word of every document
    # Maximal runs inside one document.
    opens, closes = gone.copy(), gone.copy()
    edge = np.ones(n + 1, bool)
    edge[1:n] = chunk.row[1:] != chunk.row[:-1]
    opens[1:] &= ~gone[:-1] | edge[1:n]
    closes[:-1] &= ~gone[1:] | edge[1:n]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    base = words[chunk.row[start]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(start, words), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(stop - base, pa.int64())], ["start", "stop"]))
    text, place = chunk.written()
    keep = np.repeat(~gone, np.diff(place))
    # The blank after a document's last kept word goes as well.
    left = np.flatnonzero(~gone)
    last = left[np.append(chunk.row[left][1:] != chunk.row[left][:-1], True)] if len(left) else left
    keep[place[last + 1] - 1] = False
    ends = np.concatenate([[0], np.cumsum(keep)])[place[words]]
    kept = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text[keep].tobytes())])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(words), pa.int64()), spans, kept.cast(pa.string())],
                                      ["id", "n_words", "spans", "kept"])
