"""Embeddings: a pluggable model behind an Arrow UDF, and a model-free default.

The default hashes words into a vector of signed counts and scales it to unit length, all
in the JVM. A model is any object with ``embed(texts) -> rows of floats``; it is built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

#: Characters of a text that are embedded: what the models take.
EMBED_CHARS = 800
BATCH = 50
DIMENSIONS = 64


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda within uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Vector of signed word counts; a text without words has length 0.

    The first 32 bits of a word's MD5 give its place (their rest by ``dimensions``) and sign (bit 20). Places are
    sorted and summed in one fold, so the cost is that of the words plus that of the dimensions.
    """
    h = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"))
    sign = lambda x: F.when(F.shiftright(x, 20) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    places = F.array_sort(F.transform(h, lambda x: F.struct((x % dimensions).cast("int").alias("at"), sign(x).alias("n"))))
    none = F.array().cast("array<struct<at:int,n:double>>")
    start = F.struct(none.alias("done"), F.lit(-1).alias("at"), F.lit(0.0).alias("n"))

    def fold(seen: Column, x: Column) -> Column:
        more = F.struct(seen["done"].alias("done"), seen["at"].alias("at"), (seen["n"] + x["n"]).alias("n"))
        done = F.array_append(seen["done"], F.struct(seen["at"].alias("at"), seen["n"].alias("n")))
        return F.when(seen["at"] == x["at"], more).otherwise(F.struct(done.alias("done"), x["at"].alias("at"), x["n"].alias("n")))

    sums = F.aggregate(places, start, fold, lambda seen: F.map_from_entries(F.array_append(seen["done"], F.struct(seen["at"].alias("at"), seen["n"].alias("n")))))
    return once(sums, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))))


def scaled(vector: Column) -> Column:
    """A vector at unit length; one without length stays as it is."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
    divided = lambda v, n: F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))
    return once(vector, lambda v: once(length(v), lambda n: divided(v, n)))


def embed(df: DataFrame, text: str = "text", name: str = "embedding", model: Callable[[], object] | None = None) -> DataFrame:
    """``df`` with an array<float> column. ``model`` makes the model in each worker; without it words are hashed."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, EMBED_CHARS)
    if model is None:
        return df.withColumn(name, scaled(hashed_vector(head)))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for batch in batches:
            rows: list = []
            for at in range(0, len(batch), BATCH):
                rows += [list(map(float, v)) for v in own.embed(batch.iloc[at : at + BATCH].tolist())]
            yield pd.Series(rows)

    return df.withColumn(name, run(head))
