"""Model-answer classification as table passes over a pluggable text-to-text scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import domain
from labelloom.functions import text as tx
from labelloom.functions.answers import parse_answer
from labelloom.functions.render import ZERO_SHOT, render
from labelloom.session import has_parts, materialize
from labelloom.sources.buckets import BucketTable
from labelloom.streaming.series import run_available

Scorer = Callable[[str], str]
CHUNK = 50  # rows whose answers are committed together
SHORTEN_ON = ("context", "time.?out", "timed out")  # errors of a client that call for a shorter text


def ask(df: DataFrame, prompt: str, factory: Callable[[], Scorer], out: str = "raw_response") -> DataFrame:
    """Add the scorer's answer to every prompt; a failing call gives null and its message in ``error``.

    The client is built once per task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()

        def call(text: str) -> tuple[str | None, str | None]:
            try:
                return scorer(text), None
            except Exception as e:  # noqa: BLE001 - any client error is a row value
                return None, str(e)

        for batch in batches:
            answers = [call(p) for p in batch.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([x[i] for x in answers], pa.string()) for i in (0, 1)]], [*batch.schema.names, out, "error"])

    return df.mapInArrow(run, schema)


def stored_pass(rows: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], chunk: int = CHUNK, wave: int | None = None) -> DataFrame:
    """``step(rows)`` with answers committed while the pass runs.

    The rows are written once as files of at most ``chunk`` rows. A stream then takes ``wave`` files at a time (one per core
    by default), and its file sink and checkpoint commit the answers of a wave exactly once. The same call on the same
    ``path`` goes on after the last committed wave; the rows of the first call count, even if ``rows`` has changed.
    """
    spark = rows.sparkSession
    if not has_parts(spark, f"{path}/written"):
        rows.write.mode("overwrite").option("maxRecordsPerFile", chunk).parquet(f"{path}/rows")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/written")  # from here on the rows stay
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", wave or spark.sparkContext.defaultParallelism) \
        .parquet(f"{path}/rows")
    answers = step(stream)
    run_available(answers, f"{path}/answers", f"{path}/checkpoint")
    return spark.read.schema(answers.schema).parquet(f"{path}/answers")


def classify_answers(
    df: DataFrame,
    key: str,
    text: str,
    factory: Callable[[], Scorer],
    labels=domain.LABELS,
    aliases=domain.LABEL_ALIASES,
    fallback: str = domain.FALLBACK_LABEL,
    template: str = ZERO_SHOT,
    descriptions=None,
    examples: str = "",
    passes: int = 3,
    shorten_on=SHORTEN_ON,
    store: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Prompt, score and parse every row; rows without a usable answer are asked again.

    A call that fails because the prompt is too long or takes too long is repeated with a shorter text, one
    step shorter each time and always zero-shot. Unreadable answers and other errors repeat the same prompt. A pass
    runs only on the rows the one before could not answer, so there are at most ``passes`` over a
    shrinking table. Empty texts are not asked: they get the fallback label and uniform scores.
    ``few_shot_block`` of training rows gives ``examples`` for a few-shot ``template``.

    With ``store``, a folder of this run, answers are kept as they come (``stored_pass``): the same call after a crash
    asks only what has no answer yet.
    """
    labels = list(labels)
    uniform = F.map_from_entries(F.array(*[
        F.struct(F.lit(l).alias("key"), F.lit(1.0 / len(labels)).alias("value")) for l in labels
    ]))
    # Blank and other rows are read apart, so the text is cleaned once and written.
    rows = materialize(df.withColumn("body", tx.truncate_words(tx.normalize_body(text))), "bodies")
    blank = rows.where(F.col("body") == "")
    kept = [*df.columns, "body"]
    flat = {
        "raw_response": F.lit(""), "predicted_label": F.lit(fallback), "confidence": F.lit(0.0),
        "class_scores": uniform, "attempts": F.lit(0),
    }
    done = [blank.withColumns({**flat, "parse_error": F.lit(False)})]
    todo = rows.where(F.col("body") != "").withColumn("__level", F.lit(0))
    too_long = F.lower("error").rlike("|".join(shorten_on))
    final = ["raw_response", "predicted_label", "confidence", "class_scores", "attempts", "parse_error"]
    for attempt in range(1, passes + 1):
        prompt = F.when(F.col("__level") == 0, render("body", labels, template, descriptions, examples))
        for level in (1, 2, 3):
            prompt = prompt.when(F.col("__level") == level, render(tx.shrink("body", level), labels, ZERO_SHOT, descriptions))

        def step(rows: DataFrame, prompt=prompt, attempt=attempt) -> DataFrame:
            parsed = parse_answer(ask(rows.withColumn("prompt", prompt), "prompt", factory), "raw_response", labels, aliases, fallback)
            parsed = parsed.withColumn("needs_retry", F.col("needs_retry") | F.col("error").isNotNull())
            shorter = F.least(F.lit(3), F.col("__level") + F.coalesce(too_long, F.lit(False)).cast("int"))
            return parsed.withColumn("__level", shorter).withColumn("attempts", F.lit(attempt)).drop("prompt", "json_state")

        parsed = stored_pass(todo, f"{store}/pass-{attempt}", step, chunk) if store else materialize(step(todo), "answers")
        done.append(parsed.where(~F.col("needs_retry")).select(*kept, *final))
        todo = parsed.where("needs_retry").select(*kept, "__level", F.coalesce("raw_response", F.lit("")).alias("__last"))
        if attempt < passes:
            todo = todo.drop("__last")
            if todo.isEmpty():
                return reduce(DataFrame.unionByName, [d.select(*kept, *final) for d in done])
    left = todo.withColumns({**flat, "raw_response": F.col("__last"), "attempts": F.lit(passes),
                             "parse_error": F.lit(True)})
    return reduce(DataFrame.unionByName, [d.select(*kept, *final) for d in [*done, left]])


def with_cache(df: DataFrame, cache: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached predictions where the key exists, freshly scored rows elsewhere."""
    columns = [c for c in cache.columns if c != key]
    hits = df.join(cache, key)
    misses = score(df.join(cache.select(key), key, "left_anti"))
    return hits.select(*df.columns, *columns).unionByName(misses.select(*df.columns, *columns))


def through_store(df: DataFrame, answers: BucketTable, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers of every row from a stored table, which keeps those asked now for the next run.

    Rows with the same ``key`` are asked once; only the buckets of new keys are rewritten.
    """
    known = answers.read()
    new = score(df.join(known.select(key), key, "left_anti").dropDuplicates([key]))
    answers.upsert(new.select(*answers.schema.names))
    return df.join(answers.read(), key)
