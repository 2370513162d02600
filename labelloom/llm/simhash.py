"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within four bits have a common variant within two bits of each. Every distinct
fingerprint therefore stands for all its variants within two bits; variants meet where they are equal.
The shuffle deals variants out by their leading bits: a fingerprint travels once per reachable
prefix, and its variants with that prefix are spelled out on arrival, which moves
a few dozen rows a fingerprint and not 2,081. Equal fingerprints are one node beforehand.
Colliding fingerprints are verified, and only a spanning forest of each bucket's links leaves its task.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; repeated rows share their fingerprint; a null id is never a component's
smallest id (a component of null ids alone has none).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of, chunks
from labelloom.llm.components import components, groups, local_roots
from labelloom.session import materialize, shuffle_width

RADIUS, SHINGLE, SEED = 4, 4, 42
BALL = 1 + 64 + 64 * 63 // 2
PER_BUCKET = 1 << 17  # variants a bucket holds on average
PER_PASS = 1 << 22  # variants a task holds at once
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit fingerprint: bits set in over half of the hashes of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())], np.uint64)
    by_byte = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                raw = data.tobytes()
                fps = [fingerprint(raw[off[r]:off[r + 1]]) for r in range(j - i)]
                yield batch_of(**{id_col: batch.column(0).slice(i, j - i), "fp": np.array(fps, np.uint64).view(np.int64)})

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def _masks(bits, most: int) -> list[np.ndarray]:
    """For 0..most flips: all masks with that many of the given bits set."""
    return [np.array([sum(1 << i for i in c) for c in combinations(bits, k)], np.uint64) for k in range(most + 1)]


def prefix_bits(n: int) -> int:
    """Leading bits that cut the variants of n fingerprints into buckets of PER_BUCKET on average."""
    return max(4, min(30, math.ceil(math.log2(max(1, n) * BALL / PER_BUCKET))))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (column fp) whenever they differ in at most ``radius`` bits."""
    half = radius // 2
    assert radius == 2 * half
    n, width = fps.count(), shuffle_width(fps.sparkSession)
    p = prefix_bits(n)
    shift = np.uint64(64 - p)
    top, low = _masks(range(64 - p, 64), half), _masks(range(64 - p), half)

    def send(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(x), 4096):
                part = x[i:i + 4096]
                for k, masks in enumerate(top):
                    if len(masks):
                        to = ((part[:, None] ^ masks[None, :]) >> shift).astype(np.int64).ravel()
                        yield batch_of(bucket=to, fp=np.repeat(part, len(masks)).view(np.int64),
                                       flips=np.full(len(to), k, np.int32))

    sent = fps.select("fp").mapInArrow(send, "bucket long, fp long, flips int")
    # A bucket with very many fingerprints is dealt to several tasks, each with a share of its variants.
    sizes = np.array([sum(len(m) for m in low[:half + 1 - k]) for k in range(half + 1)])
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("flips") + 1)
    hot = sent.groupBy("bucket").agg(F.sum(weight).alias("w")).where(F.col("w") > 8 * PER_BUCKET)
    hot = materialize(hot.select("bucket", F.ceil(F.col("w") / (4 * PER_BUCKET)).cast("int").alias("parts")), "hot")
    if not hot.isEmpty():
        sent = sent.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        sent = sent.withColumn("parts", F.lit(1))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = sent.repartition(width, "bucket", "part").sortWithinPartitions("bucket", "part")

    def meet(batches):
        for group in groups(batches, ["bucket", "part"]):
            fp = group["fp"].to_numpy().view(np.uint64)
            flips = group["flips"].to_numpy()
            parts, part = group["parts"][0].as_py(), group["part"][0].as_py()
            tail = fp & np.uint64((1 << (64 - p)) - 1)
            passes = max(1, -(-int(sizes[flips].sum()) // (PER_PASS * parts)))
            a_all, b_all = [], []
            for turn in range(passes):
                keys, owners = [], []
                for k in range(half + 1):
                    own = np.flatnonzero(flips == k)
                    masks = np.concatenate(low[:half + 1 - k])
                    for i in range(0, len(own), 1024):
                        some = own[i:i + 1024]
                        v = (tail[some][:, None] ^ masks[None, :]).ravel()
                        o = np.repeat(some, len(masks))
                        if parts * passes > 1:
                            share = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                            mine = share % np.uint64(parts * passes) == np.uint64(part * passes + turn)
                            v, o = v[mine], o[mine]
                        keys.append(v)
                        owners.append(o)
                v, o = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(v)
                v, o = v[order], o[order]
                same = np.flatnonzero(v[1:] == v[:-1])
                a, b = o[same], o[same + 1]
                near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
                a_all.append(a[near])
                b_all.append(b[near])
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            root = local_roots(len(fp), a, b)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            if len(moved):
                yield batch_of(u=fp[moved].view(np.int64), v=fp[root[moved]].view(np.int64))

    return dealt.mapInArrow(meet, "u long, v long")


def _rooted(own: DataFrame, first, radius: int) -> DataFrame:
    """(fp, first, component) of every distinct fingerprint; ``first`` aggregates its rows."""
    nodes = materialize(own.groupBy("fp").agg(first.alias("first")), "nodes")
    comp = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    return nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of every component, with all its columns.

    A null id counts as larger than any; equal ids are decided by a digest of their texts, and of rows equal in
    both one is kept.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("_llm_digest", digest)
    own = fingerprints(docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"))
                                   .alias("row"), text_col), "row", text_col)
    rooted = _rooted(own, F.min("row"), radius)
    kept = rooted.groupBy("component").agg(F.min("first").alias("k")).select(
        F.col("k.id").alias("_llm_id"), F.col("k.digest").alias("_llm_kept")).distinct()
    found = rows.join(kept, rows[id_col].eqNullSafe(kept["_llm_id"]) & (rows["_llm_digest"] == kept["_llm_kept"]))
    return found.dropDuplicates([id_col, "_llm_digest"]).select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is the smallest id reachable by links."""
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(own, F.min(id_col), radius)
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "component").select("fp", "component_id")
    return own.join(by_fp, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
