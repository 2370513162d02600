"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed.

Sorting every suffix would move each byte hundreds of times. Two equal strings choose the same anchor inside
them (the 64-byte gram with the smallest hash), so only suffixes that start at blocks of consecutive string
starts with one anchor are sorted, as sequences of tokens:

1. A block's suffix has two leading tokens: the hash of the core, the bytes that all strings of the block
   share, and the hash of all its bytes and its place around the anchor. Splitters taken from a
   sample of leading tokens range-partition the suffixes; a token so frequent that it spans splitters
   is dealt to all buckets between them. Buckets sort locally by multikey quicksort, token by token, and
   compare neighbours: equal in both tokens means every string of the block occurs elsewhere; alone in the first
   means none does.
2. The few blocks in between (a core found elsewhere, other bytes around it), one copy of each block they must
   be compared with, and what lies alone in its bucket while its leading token goes on beyond a boundary, are
   compared as bytes: sorted by core, by what precedes and by what follows it, string by string. This also is the
   comparison across bucket boundaries.

Documents keep their bytes in place; both steps carry references. Texts are shuffled once, by document.

Defined results: ids are integers; a null text counts as empty; texts shorter than ``LENGTH`` bytes lose nothing; a
repeated row is a copy like any other, so both lose what they share; rows with a null id are told apart by
their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.llm.batches import batch_of, chunks
from labelloom.session import checked_broadcast, materialize, shuffle_width

LENGTH = 200
GRAM, BLOCK = 64, 69  # anchors are grams; at most BLOCK string starts share a block
HOT_PIECE = 4096  # rows of hot cores whose strings a task adds up at once
HOT_CORE = 1000  # the strings of a core with more rows are counted one by one, without meeting in a task
CORE = LENGTH - BLOCK + 1
SEGMENT = 1 << 18
SAMPLE = 2000  # documents whose leading tokens give the splitters
BUCKET_ROWS = 400_000
NO_ID = -(1 << 63)
_TABLE = np.random.default_rng(20240517).integers(0, 2**64, 256, dtype=np.uint64)
_COUNT = (1 << 32) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
REF = "id long, tag long, place long"


def _pair(a, b):
    x = (a * _ODD) ^ (b + (a >> np.uint64(29)))
    return x ^ (x >> np.uint64(32))


def blocks(data: np.ndarray, off: np.ndarray):
    """(row, first start, count, place of the first start before its anchor's block, core hash, block hash) of all blocks."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < LENGTH:
        return none
    h, step = _TABLE[data], 1
    while step < 128:
        h = _pair(h[:-step], h[step:])
        step *= 2
        if step == GRAM:
            gram = h
    # Smallest gram of every string, the leftmost on ties: the hash's upper half, then the place.
    low = (gram & ~np.uint64(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    stop = np.repeat(off[1:], np.diff(off))[:len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= stop)
    if not len(start):
        return none
    back = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64) - start
    anchor, part = start + back, back // BLOCK
    cut = np.ones(len(start), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(start)))
    first, core = start[at], anchor[at] - part[at] * BLOCK
    reach = back[at] - part[at] * BLOCK  # bytes from the first start to the core
    core_hash = _pair(h[core], h[core + CORE - 128])
    end = first + count - 1 + LENGTH - 128
    whole = _pair(_pair(h[first], h[np.minimum(first + 128, end)]), h[end])
    place = (reach * 256 + count).astype(np.uint64)
    return np.searchsorted(off, first, "right") - 1, first, count, reach, core_hash, _pair(whole, place)


def _segments(texts: pa.Array):
    """(first row, end row, byte offset of a long row's part, bytes, offsets); long rows come in overlapping parts."""
    for i, j, data, off in chunks(texts, SEGMENT):
        if len(data) <= 2 * SEGMENT or j - i > 1:
            yield i, j, 0, data, off
        else:
            for base in range(0, len(data) - LENGTH + 1, SEGMENT):
                some = data[base:base + SEGMENT + LENGTH - 1]
                yield i, j, base, some, np.array([0, len(some)])


def _tagged(docs: DataFrame, id_col, text_col, carry=()) -> DataFrame:
    """(id, tag, text): the tag, 64 bits of the text's hash, tells texts of equal ids apart. Carried columns follow as one struct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tag = F.xxhash64(text)
    more = [F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tag.alias("tag"), text.alias("text"), *more)


def _block_rows(tagged: DataFrame, splitters: np.ndarray | None = None) -> DataFrame:
    """Blocks as (core, whole, id, tag, place) with the bucket of their leading token, or -1 - bucket where that spans several.

    A place holds the first start and the count.
    """

    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, base, data, off in _segments(batch.column(2)):
                row, first, count, _, core, whole = blocks(data, off)
                if not len(row):
                    continue
                id_, tag, place = ids[i + row], tags[i + row], ((first - off[row] + base) << 32) | count
                if splitters is None:
                    bucket = np.zeros(len(core), np.int32)
                else:
                    lo = np.searchsorted(splitters, core, "left")
                    wide = np.searchsorted(splitters, core, "right") - lo
                    # A leading token equal to several splitters is dealt to all buckets they bound.
                    turn = ((id_ ^ tag).view(np.uint64) * _ODD ^ place.view(np.uint64)) * _ODD >> np.uint64(33)
                    share = (turn % (wide + 1).astype(np.uint64)).astype(np.int64)
                    bucket = np.where(wide > 1, -1 - (lo + share), lo).astype(np.int32)
                yield batch_of(core=core.view(np.int64), whole=whole.view(np.int64), id=id_, tag=tag, place=place, bucket=bucket)

    return tagged.select("id", "tag", "text").mapInArrow(run, f"core long, whole long, {REF}, bucket int")


def multikey_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by the first token; only runs equal in it are sorted by the next one."""
    order = np.argsort(first, kind="quicksort")
    key = first[order]
    same = key[1:] == key[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    run = np.cumsum(np.concatenate([[0], ~same]))[at] if len(at) else at
    order[at] = order[at][np.lexsort((second[order[at]], run))]
    return order


def _runs(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def _verdicts(rows: DataFrame, width: int) -> DataFrame:
    """Blocks whose core occurs elsewhere: kind 1 all strings do, 2 some may, 3 is 1 and stands for its copies among 2."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        core, whole, bucket = (t[c].to_numpy() for c in ("core", "whole", "bucket"))
        order = multikey_order(core, whole)
        c, w, beyond = core[order], whole[order], bucket[order] < 0
        new_core = np.ones(len(c), bool)
        new_core[1:] = c[1:] != c[:-1]
        new_whole = new_core.copy()
        new_whole[1:] |= w[1:] != w[:-1]
        by_core, by_whole = _runs(new_core), _runs(new_whole)
        copies, mates = np.bincount(by_whole)[by_whole], np.bincount(by_core)[by_core]
        full = copies > 1
        some = ~full & ((mates > 1) | beyond)
        asked = np.bincount(by_core, some | beyond)[by_core] > 0
        kind = np.where(full, np.where(new_whole & asked, 3, 1), np.where(some, 2, 0)).astype(np.int32)
        keep = np.flatnonzero(kind)
        for i in range(0, len(keep), 1 << 17):
            k = keep[i:i + (1 << 17)]
            yield batch_of(**{c: t[c].to_numpy()[order[k]] for c in ("id", "tag", "place")}, kind=kind[k])

    return rows.repartition(width, "bucket").mapInArrow(run, f"{REF}, kind int")


def _splitters(tagged: DataFrame, documents: int, width: int) -> tuple[np.ndarray, int]:
    """Splitters of the leading tokens from the blocks of sampled documents, and the number of partitions."""
    share = min(1.0, SAMPLE / max(1, documents))
    sample = tagged.sample(False, share, 11) if share < 1 else tagged
    tokens = _block_rows(sample).select("core").toArrow()["core"].to_numpy().view(np.uint64)
    parts = max(width, int(len(tokens) / share / BUCKET_ROWS))
    n = min(4 * parts, len(tokens))
    return (np.sort(tokens)[np.arange(1, n) * len(tokens) // n] if n > 1 else np.zeros(0, np.uint64)), parts


def _strings(joined: DataFrame) -> DataFrame:
    """Bytes of the blocks to be compared: what precedes the core (nearest byte first), the core, what follows it."""

    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, kinds = batch.column(3), batch.column(4)
            for r in range(batch.num_rows):
                place, kind = np.array(places[r].as_py()), np.array(kinds[r].as_py())
                raw = batch.column(2)[r].as_py().encode()
                out = []
                # The text's part around each block gives its anchor again.
                for p, k in zip(place.tolist(), kind.tolist()):
                    first, count = p >> 32, p & _COUNT
                    string = raw[first:first + count - 1 + LENGTH]
                    out.append((string, p, k))
                data = np.frombuffer(b"".join(s for s, _, _ in out), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(s) for s, _, _ in out])])
                row, start, _, reach, core, _ = blocks(data, off)
                at = np.searchsorted(row, np.arange(len(out)))
                yield batch_of(
                    core=core[at].view(np.int64), string=pa.array([s for s, _, _ in out], pa.binary()),
                    reach=reach[at].astype(np.int32), id=np.full(len(out), ids[r]), tag=np.full(len(out), tags[r]), place=place,
                    kind=kind.astype(np.int32))

    return joined.mapInArrow(run, f"core long, string binary, reach int, {REF}, kind int")


def _classes(group: np.ndarray, bytes_: np.ndarray):
    """For rows of a byte matrix: order within groups and the length of the prefix shared with the row before."""
    wide = np.zeros((len(group), 8 + bytes_.shape[1]), np.uint8)
    wide[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    wide[:, 8:] = bytes_
    order = np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="quicksort")
    s = wide[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1]) - 8
    return order, np.concatenate([[-1], lcp])


def compare_strings(core, strings, reach, weight, block: int = BLOCK):
    """Flags (row, j): whether the string j bytes before the core occurs in another row or the row counts twice.

    Rows hold at most ``block`` strings each, whose common core starts ``reach`` bytes into the row.
    """
    n, size = len(strings), LENGTH - block + 1
    length = np.array([len(s) for s in strings])
    before, after = np.zeros((n, block - 1), np.uint8), np.zeros((n, block - 1), np.uint8)
    middle = np.zeros((n, size), np.uint8)
    for i, s in enumerate(strings):
        b, a = s[:reach[i]], s[reach[i] + size:]
        before[i, :len(b)] = np.frombuffer(b, np.uint8)[::-1]
        after[i, :len(a)] = np.frombuffer(a, np.uint8)
        middle[i] = np.frombuffer(s[reach[i]:reach[i] + size], np.uint8)
    # Rows of one group have the same bytes in the core, not only the same hash.
    order, lcp = _classes(core, middle)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(lcp < size)
    lo, l_lcp = _classes(group, before)
    ro, r_lcp = _classes(group, after)
    least, most = block - 1 - (length - reach - size), reach
    flags = np.zeros((n, block), bool)
    for j in range(block):
        at = np.flatnonzero((least <= j) & (j <= most))
        if not len(at):
            continue
        left, right = np.empty(n, np.int64), np.empty(n, np.int64)
        left[lo], right[ro] = np.cumsum(l_lcp < j), np.cumsum(r_lcp < block - 1 - j)
        key = left[at] * (n + 1) + right[at]
        by = np.argsort(key, kind="quicksort")
        new = np.ones(len(by), bool)
        new[1:] = key[by][1:] != key[by][:-1]
        run = _runs(new)
        flags[at[by], j] = np.bincount(run, weight[at[by]])[run] > 1
    return flags


def _counted(strings: DataFrame) -> DataFrame:
    """Places of the strings of kind 2 rows that occur elsewhere, each string counted by a digest of its bytes.

    For cores with very many rows, as of a passage in a large share of the documents: equal strings are added up in the
    task before anything is written, so that only strings it saw once go on with their places; those that stand alone are
    taken out by place. No core and no string gathers its rows.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, HOT_PIECE):
                some = batch.slice(i, HOT_PIECE)
                id_, tag, place, kind = (some.column(c).to_numpy() for c in ("id", "tag", "place", "kind"))
                n = place & _COUNT
                raw = b"".join(xxhash.xxh3_128_digest(s[j:j + LENGTH]) for s, k in zip(some.column("string").to_pylist(), n.tolist()) for j in range(k))
                digest, row = np.frombuffer(raw, np.uint64).reshape(-1, 2), np.repeat(np.arange(len(n)), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort(digest.T)
                new = np.ones(len(order), bool)
                new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
                run = _runs(new)
                total = np.bincount(run, np.where(kind == 3, 2, 1)[row[order]]).astype(np.int64)
                one = order[new]
                at = row[one]
                yield batch_of(digest=pa.array([raw[16 * k:16 * k + 16] for k in one.tolist()], pa.binary()), id=id_[at], tag=tag[at],
                               place=((place[at] >> 32) + within[one]) << 32 | 1, weight=total)
                # What occurs twice here needs no answer: runs of such strings as places without a digest.
                found = np.zeros(len(order), bool)
                found[order] = total[run] > 1
                found &= (kind == 2)[row]
                begin = found & ((within == 0) | ~np.concatenate([[False], found[:-1]]))
                count = np.bincount(np.cumsum(begin)[found] - 1, minlength=begin.sum())
                first = np.flatnonzero(begin)
                at = row[first]
                yield batch_of(digest=pa.nulls(len(first), pa.binary()), id=id_[at], tag=tag[at],
                               place=((place[at] >> 32) + within[first]) << 32 | count, weight=np.zeros(len(first), np.int64))

    each = materialize(strings.mapInArrow(run, f"digest binary, {REF}, weight long"), "hot-strings")
    sent, ref = each.where("digest is not null"), ["id", "tag", "place"]
    lone = sent.groupBy("digest").agg(F.sum("weight").alias("n"), *[F.min(c).alias(c) for c in ref]).where("n = 1").select(ref)
    asked = sent.where("weight = 1").join(lone, ref, "left_anti").select(ref)
    return each.where("digest is null").select(ref).unionByName(asked)


def _open_strings(strings: DataFrame, width: int) -> DataFrame:
    """Places (first start, count) of the strings of kind 2 blocks that occur elsewhere."""
    hot = materialize(strings.groupBy("core").count().where(F.col("count") > HOT_CORE).select("core"), "hot")
    if hot.isEmpty():
        return _judged(strings, width)
    cold = _judged(strings.join(checked_broadcast(hot), "core", "left_anti"), width)
    return cold.unionByName(_counted(strings.join(checked_broadcast(hot), "core", "left_semi")))


def _judged(strings: DataFrame, width: int) -> DataFrame:
    dealt = strings.repartition(width, "core").sortWithinPartitions("core")

    def judge(t):
        place, kind = t["place"].to_numpy(), t["kind"].to_numpy()
        reach = t["reach"].to_numpy().astype(np.int64)
        flags = compare_strings(t["core"].to_numpy().view(np.uint64), t["string"].to_pylist(), reach,
                                np.where(kind == 3, 2, 1))
        flags[kind == 3] = False
        # Column j of row i starts j bytes before the core; runs of set columns are runs of starts.
        step = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(step == 1)
        _, hi = np.nonzero(step == -1)
        first = (place[row] >> 32) + reach[row] - (hi - 1)
        return batch_of(id=t["id"].to_numpy()[row], tag=t["tag"].to_numpy()[row], place=(first << 32) | (hi - lo))

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            core = t["core"].to_numpy()
            # Whole cores only; the last one may go on in the next batch.
            cut = int(np.searchsorted(core, core[-1], "left"))
            if cut >= 20_000:
                yield judge(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
            left = t
        if left is not None:
            yield judge(left)

    return dealt.mapInArrow(run, REF)


def repeated_places(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, tag, places): per document the places whose strings occur elsewhere."""
    spark = docs.sparkSession
    tagged = _tagged(docs, id_col, text_col)
    documents = docs.select(id_col).count()
    splitters, width = _splitters(tagged, documents, shuffle_width(spark))
    kinds = materialize(_verdicts(_block_rows(tagged, splitters), width), "verdicts")
    width = max(shuffle_width(spark), width)
    compared = kinds.where("kind > 1").groupBy("id", "tag").agg(F.collect_list(F.struct("place", "kind")).alias("p"))
    compared = compared.select("id", "tag", F.col("p.place").alias("place"), F.col("p.kind").alias("kind"))
    joined = tagged.join(compared, ["id", "tag"]).select("id", "tag", "text", "place", "kind")
    opened = _open_strings(materialize(_strings(joined), "strings"), width)
    whole = kinds.where("kind <> 2").select("id", "place", "tag")
    return whole.unionByName(opened.select("id", "place", "tag")).groupBy("id", "tag").agg(
        F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", carry=()) -> DataFrame:
    """(id, n_bytes, spans of removed bytes, kept bytes) of every row, a null id staying null.

    With ``carry``, the columns of that name and the kept text as ``_llm_kept`` instead; a cut may fall inside a
    character, and what is left of it goes too.
    """
    places = repeated_places(docs, id_col, text_col)
    tagged = _tagged(docs, id_col, text_col, carry)
    rest = ["rest"] if carry else []

    def run(batches):
        for batch in batches:
            places, at = batch.column(3), 0
            for i, j, data, off in chunks(batch.column(2)):
                size, spans, kept = [], [], []
                for r in range(i, j):
                    own = data[off[r - i]:off[r - i + 1]]
                    p = np.array(places[r].as_py() or [], np.int64)
                    step = np.zeros(len(own) + 1, np.int32)
                    np.add.at(step, p >> 32, 1)
                    np.add.at(step, (p >> 32) + (p & _COUNT) - 1 + LENGTH, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.diff(np.pad(gone, 1).astype(np.int8))
                    size.append(len(own))
                    spans.append([{"start": a, "stop": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(),
                                                                           np.flatnonzero(edge == -1).tolist())])
                    kept.append(own[~gone].tobytes().decode("utf-8", "ignore") if carry else own[~gone].tobytes())
                yield batch_of(id=batch.column(0).slice(i, j - i), n_bytes=pa.array(size, pa.int64()),
                               spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                               kept=pa.array(kept, pa.string() if carry else pa.binary()), **{c: batch.column(4).slice(i, j - i) for c in rest})

    schema = StructType.fromDDL("id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept " + ("string" if carry else "binary"))
    schema = StructType([*schema.fields, *[tagged.schema[c] for c in rest]])
    out = tagged.join(places, ["id", "tag"], "left").select("id", "tag", "text", "places", *rest).mapInArrow(run, schema)
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    if not carry:
        return out.withColumn("id", own)
    return out.select(*[F.col(f"rest.`{c}`") for c in carry], F.col("kept").alias("_llm_kept"))


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents, all columns kept, with the repeated strings cut out of their texts; a null text stays null."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.withColumn("_llm_none", F.col(text_col).isNull())
    out = remove_repeats(rows, id_col, text_col, carry=(*others, "_llm_none"))
    text = F.when(~F.col("_llm_none"), F.col("_llm_kept")).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
