"""Term features in long form and as sparse vectors, word vectors and encoders."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, SQLTransformer, Word2Vec, Word2VecModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import domain
from labelloom.functions.answers import fixed
from labelloom.functions.text import WORD, let, word_tokens
from labelloom.operators.cbow import cbow
from labelloom.operators.wordvectors import WordVectors
from labelloom.session import checked_broadcast, scratch_path, shuffle_width, table_size

PIECE_ROWS = 256  # rows whose terms a task weighs at once

# Long form: (key, term, tf).

def counted(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens: sorted, equal neighbours counted."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def lengths(at):
            return F.transform(at, lambda p, j: F.struct(
                F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), n) - p).cast("bigint").alias("tf")))

        return F.when(n > 0, let(starts, lengths))

    return let(F.sort_array(tokens), runs)


def term_counts(df: DataFrame, key: str, text: str = "text", tokens: Column | None = None, keep=()) -> DataFrame:
    """Term frequency per row (one per key), counted inside the row, so no token is shuffled.

    ``keep`` carries row columns such as the split along.
    """
    tokens = tokens if tokens is not None else word_tokens(text)
    return fixed(df, __counts=counted(tokens)).select(key, *keep, F.inline("__counts"))


def vocabulary(terms: DataFrame, n: int = domain.MAX_TERMS, min_count: int = 1) -> DataFrame:
    """The ``n`` most frequent terms, ties by term: (term, cf, df)."""
    totals = terms.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return totals.where(F.col("cf") >= min_count).orderBy(F.desc("cf"), "term").limit(n)


def in_vocabulary(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of the vocabulary terms; the vocabulary is broadcast only within its checked bound."""
    return terms.join(checked_broadcast(vocab), "term")


def bow(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    return in_vocabulary(terms, vocab).select(key, "term", "tf")


def one_hot(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    return in_vocabulary(terms, vocab).select(key, "term", F.lit(1).alias("present"))


def tfidf(terms: DataFrame, vocab: DataFrame, key: str, n_docs: int, sublinear: bool = False) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length; sublinear uses 1 + ln(tf)."""
    tf = F.log(F.col("tf")) + 1.0 if sublinear else F.col("tf").cast("double")
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    rows = in_vocabulary(terms, vocab).select(key, "term", (tf * idf).alias("w"))
    # A window group is one document, and one shuffle brings its terms together.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return rows.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf_rows(df: DataFrame, key: str, vocab: DataFrame, n_docs: int, text: str = "text", tokens: Column | None = None,
               sublinear: bool = False, keep=()) -> DataFrame:
    """(key, keep..., cells): per row its vocabulary terms as (idx, term, weight), of unit length together.

    As ``tfidf``, but terms are counted, weighted and normalised inside the row, so nothing is shuffled. The vocabulary goes to
    every task, a number of terms its maker has bounded; its size is checked.
    """
    spark = df.sparkSession
    if table_size(vocab)[1] > 256 << 20:
        raise ValueError("the vocabulary is too large for every task; use tfidf on term counts")
    table = vocab.orderBy(F.desc("cf"), "term").select("term", "df").toArrow()
    idf = np.log((1.0 + n_docs) / (1.0 + table["df"].to_numpy())) + 1.0
    shared = spark.sparkContext.broadcast((table["term"].combine_chunks().cast(pa.string()), idf))
    tokens = tokens if tokens is not None else word_tokens(text)
    rows = fixed(df, __counts=counted(tokens)).where("__counts is not null").select(key, *keep, F.col("__counts").alias("counts"))

    def pieces(batches):
        """A batch holds as many rows as come, long texts too; what is made of it at once is bounded."""
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE_ROWS):
                yield batch.slice(lo, PIECE_ROWS)

    def run(batches):
        terms, idf = shared.value
        for batch in pieces(batches):
            counts = batch.column("counts")
            flat = counts.flatten()
            size = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(flat.field("term").cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
            known = at >= 0
            row = np.repeat(np.arange(batch.num_rows), size)[known]
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[known].astype(float)
            weight = (np.log(tf) + 1.0 if sublinear else tf) * idf[at[known]]
            norm = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            weight = weight / norm[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            # Vectors want their indices in order.
            order = np.lexsort((at[known], row))
            cells = pa.StructArray.from_arrays(
                [pa.array(at[known][order].astype(np.int32)), terms.take(pa.array(at[known][order])), pa.array(weight[order])], ["idx", "term", "weight"])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *keep)], cells], [key, *keep, "cells"])

    cell = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    schema = T.StructType([*[rows.schema[c] for c in (key, *keep)], T.StructField("cells", T.ArrayType(cell))])
    return rows.mapInArrow(run, schema).where(F.size("cells") > 0)


def doc_vectors(df: DataFrame, key: str, tokens: Column, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean of the vectors of in-vocabulary tokens, zeros when there are none.

    ``vectors`` is (term, vector) with a vector column.
    """
    counts = term_counts(df, key, tokens=tokens)
    rows = counts.join(checked_broadcast(vectors), "term")
    means = rows.groupBy(key).agg(
        Summarizer.mean(F.col("vector"), F.col("tf").cast("double")).alias("doc_vector")
    )
    zero = array_to_vector(F.array(*[F.lit(0.0)] * dim))
    out = df.select(key).join(means, key, "left")
    return out.withColumn("doc_vector", F.coalesce("doc_vector", zero))


# Vector form, for model fitting.

class SmoothTfIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to unit-length tf-idf with the +1 that Spark's own IDF leaves out.

    The fitted result consists of built-in stages, so it saves and loads as is.
    """

    def __init__(self, inputCol: str = "counts", outputCol: str = "features"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df: DataFrame) -> PipelineModel:
        src, out = self.getInputCol(), self.getOutputCol()
        idf = IDF(inputCol=src, outputCol="__idf").fit(df).idf.toArray() + 1.0
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=src, outputCol=f"{out}_raw")
        return PipelineModel([scaled, Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out)])


def bag_vectors(df: DataFrame, tokens: str) -> DataFrame:
    """(term, vector) of continuous bag-of-words vectors."""
    return cbow(df.select(tokens), tokens)


def skip_gram(df: DataFrame, tokens: str) -> DataFrame:
    """(term, vector) of Spark's own word vectors."""
    return word2vec(df.select(tokens), tokens).getVectors().select(F.col("word").alias("term"), vector_to_array("vector", "float32").alias("vector"))


def vectorizer_stages(name: str, text: str = "text", n_terms: int = domain.MAX_TERMS, out: str = "features",
                      preprocess: str | None = None, tokenize: str | None = None) -> list:
    """Pipeline stages of ``one_hot``, ``bow``, ``tfidf`` or ``word2vec``; all of them are stored with the pipeline.

    ``preprocess`` is a SQL expression over the row that replaces the text, ``tokenize`` one that gives its array of tokens,
    in which ``prepared`` names the text. By default words of two letters and more, for word vectors what blanks separate.
    """
    steps, source = [], text
    if preprocess or tokenize:
        source = "prepared"
        steps.append(SQLTransformer(statement=f"SELECT *, {preprocess or f'`{text}`'} AS prepared FROM __THIS__"))
    if tokenize or name == "word2vec":
        steps.append(SQLTransformer(statement=f"SELECT *, {tokenize or f"split(`{source}`, ' ')"} AS tokens FROM __THIS__"))
    else:
        steps.append(RegexTokenizer(inputCol=source, outputCol="tokens", pattern=WORD, gaps=False, toLowercase=True))
    if name == "word2vec":
        return [*steps, WordVectors(bag_vectors, "tokens", out)]
    counts_out = "counts" if name == "tfidf" else out
    count = CountVectorizer(inputCol="tokens", outputCol=counts_out, vocabSize=n_terms, binary=name == "one_hot")
    if name in ("one_hot", "bow"):
        return [*steps, count]
    if name == "tfidf":
        return [*steps, count, SmoothTfIdf(inputCol="counts", outputCol=out)]
    raise ValueError(f"unknown vectoriser {name}")


def row_vectors(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Sparse vectors (key, features) of the rows of ``tfidf_rows``.

    The vector column type is stored as a struct of size, indices and values, so
    writing that struct and reading it back as a vector needs no Python per row.
    """
    packed = rows.select(key, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform("cells", lambda x: x["idx"]).alias("indices"), F.transform("cells", lambda x: x["weight"]).alias("values"),
    ).alias("features"))
    path = scratch_path(rows.sparkSession, "vectors")
    packed.write.parquet(path)
    schema = T.StructType([packed.schema[key], T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def word2vec(df: DataFrame, tokens: str, dim: int = 100, window: int = 5, min_count: int = 2,
             epochs: int = 10, seed: int = domain.SEED, max_words: int = 10_000_000) -> Word2VecModel:
    """Word vectors fitted over ``numPartitions`` tasks.

    The model (words x dim) sits on the driver, so its size is checked first; a
    larger corpus needs a higher ``min_count``.
    """
    totals = df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = totals.where(F.col("n") >= min_count).count()
    if words > max_words:
        raise ValueError(f"{words} words reach min_count={min_count}; raise it to stay within {max_words}")
    # A task per core, as long as each has a fair share of the words to learn from.
    tokens_seen = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, tokens_seen // 100_000))
    return Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
                    numPartitions=parts, inputCol=tokens, outputCol="doc_vector").fit(df)


# Encoder hook.

Encoder = Callable[[list[str]], np.ndarray]


class HashedEncoder:
    """Default encoder: every word token adds a fixed +-1 pattern, the bits of its md5.

    It stands in for a sentence encoder where no model weights are available.
    Rows have unit length.
    """

    KEPT = 200_000  # tokens remembered per task

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, dim), dtype=np.float32)

    def row(self, token: str) -> int:
        at = self.rows.get(token)
        if at is None:
            blocks = -(-self.dim // 128)
            digest = b"".join(hashlib.md5((token + "|" * i).encode()).digest() for i in range(blocks))
            bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8))[: self.dim]
            at = self.rows[token] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[at] = bits * 2.0 - 1.0
        return at

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            if len(self.rows) > self.KEPT:
                self.rows.clear()
            counts = Counter(re.findall(r"\w\w+", text.lower()))
            if counts:
                # Sums of whole numbers: exact in single precision.
                at = [self.row(t) for t in counts]
                out[i] = np.fromiter(counts.values(), dtype=np.float32, count=len(counts)) @ self.table[at]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def encode(df: DataFrame, key: str, text: str, factory: Callable[[], Encoder] = HashedEncoder,
           batch: int = 128, tasks: int | None = None) -> DataFrame:
    """(key, embedding): the encoder is built once per task and fed in batches; a null text counts as empty.

    ``tasks`` spreads the rows first, for inputs with too few partitions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "embedding": list(encoder(part[text].tolist()))})

    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return (rows.repartition(tasks, key) if tasks else rows).mapInPandas(run, schema)


def encode_cached(df: DataFrame, key: str, text: str, cache_path: str,
                  factory: Callable[[], Encoder] = HashedEncoder, encoder: str | None = None) -> DataFrame:
    """Encode each distinct text once and keep it in a parquet cache keyed by encoder and text.

    ``encoder`` names the encoder; by default its type and width do. An entry that was appended twice, as by a
    repeated run, counts once.
    """
    spark = df.sparkSession
    if encoder is None:
        made = factory()
        encoder = f"{type(made).__module__}.{type(made).__qualname__}:{getattr(made, 'dim', '')}"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(key, F.sha2(F.concat(F.lit(f"{encoder}|"), body), 256).alias("digest"), body.alias(text))
    texts = rows.groupBy("digest").agg(F.first(text).alias(text))
    empty = spark.createDataFrame([], "digest string, embedding array<float>")
    empty.write.mode("append").parquet(cache_path)
    cache = spark.read.schema(empty.schema).parquet(cache_path)
    missing = texts.join(cache.select("digest"), "digest", "left_anti")
    tasks = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    encode(missing, "digest", text, factory, tasks=tasks).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(empty.schema).parquet(cache_path).dropDuplicates(["digest"])
    return rows.select(key, "digest").join(cache, "digest").select(key, "embedding")
