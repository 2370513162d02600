"""Importance resampling towards a target distribution over hashed word n-grams.

Features are the runs of 1 to 2 consecutive words of a lower-cased text, hashed by CRC-32 into ``BUCKETS`` buckets. The
checksums of a batch are computed over its distinct features: those of one length form a matrix of bytes, and one
table step per column updates all their checksums at once; buckets are then scattered back to the feature places.

Both corpora are counted by bucket, once per task, so what meets per bucket is a row per task. The buckets' gains,
``BUCKETS`` numbers, go to every task; a second pass sums them per document and adds the keyed Gumbel noise. Ranks are
exact and need no global sort: scores are whole numbers within fixed bounds, so the count per score gives the
rank at which each score begins, and rows are only ordered within their score.

Defined results: a null text has no words; no features give weight 0; a null id is hashed as an empty string and ranks after
all other ids of its score; repeated rows are ranked each on their own, in any order if all they show is equal; an
empty target counts nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.batches import LOWER, batch_of, chunks, span_hashes
from labelloom.session import checked_broadcast, materialize

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # per cent of the documents with enough words
SALT = "7:"
POLYNOMIAL = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


CRC = _crc_table()
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a byte matrix, one column for all rows at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = (crc >> np.uint32(8)) ^ CRC[(crc ^ column) & np.uint32(0xFF)]
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, cells: int = 1 << 23) -> np.ndarray:
    """CRC-32 of the byte spans: one matrix per length, of at most about ``cells`` bytes."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cut) if len(order) else []:
        length = int(size[same[0]])
        step = max(1, cells // max(1, length))
        for i in range(0, len(same), step):
            some = same[i:i + step]
            if length <= cells:
                out[some] = crc_matrix(data[start[some][:, None] + np.arange(length)])
            else:  # one span of many megabytes: its only row is read in place
                out[some] = crc_matrix(data[start[some[0]]:start[some[0]] + length][None, :])
    return out


def features(data: np.ndarray, off: np.ndarray):
    """(bytes, starts, sizes, rows) of all features of some texts, over a copy of their words joined by single spaces,
    and the row of every word."""
    low = LOWER[data]
    word = WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(off, start, "right") - 1
    size = stop - start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(place[-1], 0x20, np.uint8)
    text[np.flatnonzero(word) + np.repeat(place[:-1] - start, size)] = low[word]
    pair = np.flatnonzero(row[1:] == row[:-1])
    starts = np.concatenate([place[:-1], place[pair]])
    sizes = np.concatenate([size, size[pair] + 1 + size[pair + 1]])
    return text, starts, sizes, np.concatenate([row, row[pair]]), row


def bucketed(data: np.ndarray, off: np.ndarray, buckets: int = BUCKETS):
    """(bucket of every feature, its row, words per row): checksums are taken once per distinct feature."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    text, start, size, row, word_row = features(data, off)
    n_words = np.bincount(word_row, minlength=rows)
    if not len(start):
        return np.zeros(0, np.int64), row, n_words
    # Two hashes of 64 bits stand for a feature inside its chunk.
    key, check = (span_hashes(t)(start, start + size) for t in (text, ~text))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    first = order[fresh]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    crc = crc_spans(text, start[first], size[first])
    return (crc % np.uint32(buckets)).astype(np.int64)[which], row, n_words


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a corpus per bucket: ``buckets`` numbers, summed in the tasks before they meet."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                n += np.bincount(bucketed(data, off, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield batch_of(bucket=at.astype(np.int32), n=n[at])

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed bucket shares of target and source."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the floored mean gain of its features."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                bucket, row, words = bucketed(data, off, buckets)
                n = np.bincount(row, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, row, gain[bucket])
                yield batch_of(id=batch.column(0).slice(i, j - i), n_words=words.astype(np.int64), n_features=n.astype(np.int64),
                               weight=total // np.maximum(n, 1))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def noise(id_col: str, salt: str = SALT):
    """Floored thousandfold Gumbel noise, keyed by the id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it was not drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise("id"))
    rows = materialize(scored, "scored")
    able = F.col("n_words") >= least_words
    # Scores are whole numbers between fixed bounds of gain and noise: the table below has a row per score.
    per_score = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    counts = sorted(per_score.collect(), key=lambda r: -r["score"])
    draw, before, begin = sum(r["n"] for r in counts) * share // 100, 0, []
    for r in counts:
        if before < draw:
            begin.append((r["score"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(begin, "score long, before long")
    drawn = rows.where(able).join(checked_broadcast(starts, 1_000_000), "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last()))
    drawn = drawn.withColumn("rank", F.col("before") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("before")
    least = begin[-1][0] if begin else None
    rest = rows.where(~able | (F.col("score") < least)) if begin else rows
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.withColumn("rank", F.lit(None).cast("bigint")).select(*columns))
