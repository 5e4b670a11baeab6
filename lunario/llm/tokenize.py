"""Encoding of a whole corpus with a public byte-level vocabulary, by the automaton of its merges."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.llm.automaton import compiled

#: Tokens in an output batch; bounds a worker's memory beside one text.
BATCH_TOKENS = 500_000
#: A vocabulary file is sent to the workers as it is; larger files are refused.
LARGEST_FILE = 32_000_000


def vocabulary(spark: SparkSession, path: str):
    """The file's content as a broadcast variable, after a check of its size."""
    if (size := Path(path).stat().st_size) > LARGEST_FILE:
        raise ValueError(f"{path} has {size} bytes; at most {LARGEST_FILE} are sent to workers")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode(df: DataFrame, text: str, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) with ``ids``, the token ids of each text as array<int>.

    Null and empty texts have an empty list; blank texts have the tokens of their blanks. Strings of special tokens in
    a text are ordinary text. Repeated rows are encoded alike; an empty table gives no rows. A column of ``df`` that
    is already called ``ids`` is replaced.

    Row by row in Arrow batches, without a shuffle; a worker keeps the paths of words it has met.
    """
    spark = df.sparkSession
    words = vocabulary(spark, path)
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c != ids]
    source = df.select(*kept, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(words.value)
        for b in batches:
            begin, size, found = 0, 0, []
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found.append(automaton.encode_bytes(text))
                size += len(found[-1])
                if size >= 4 * BATCH_TOKENS or k == b.num_rows - 1:
                    ends = np.cumsum([0, *map(len, found)]) // 4
                    lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(np.frombuffer(b"".join(found), np.int32)))
                    part = b.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*kept, ids])
                    begin, size, found = k + 1, 0, []

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{ids}` array<int>"])
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, text: str = "testo", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``ids``) with the text whose token ids ``ids`` are; null ids give null."""
    words = vocabulary(df.sparkSession, path)
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != ids]) if c != text]
    source = df.select(*kept, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(words.value)
        for b in batches:
            texts = [None if x.as_py() is None else automaton.decode(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*kept, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{text}` string"])
    return source.mapInArrow(run, schema)
