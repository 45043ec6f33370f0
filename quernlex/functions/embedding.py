"""Embedders: a hashed bag of words in built-in functions, and any service with an /embeddings endpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
#: Texts that are sent to a service at once.
BATCH = 100


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Element 0 is 1; a word (a-z) counts at 1 + crc32(word) mod (dimensions - 1)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    places = F.array_sort(F.transform(words, lambda w: (1 + F.crc32(w.cast("binary")) % (dimensions - 1)).cast("int")))
    # places in order, each counted by where it is first and where the next one begins
    distinct = F.array_distinct(places)
    firsts = F.transform(distinct, lambda p: F.array_position(places, p))
    ends = F.slice(F.concat(firsts, F.array((F.size(places) + 1).cast("long"))), F.lit(2), F.size(firsts))
    counts = F.map_from_arrays(distinct, F.zip_with(firsts, ends, lambda a, b: (b - a).cast("double")))
    rest = F.transform(F.sequence(F.lit(1), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0.0)))
    return F.concat(F.array(F.lit(1.0)), rest)


def posting(url: str, model: str, key: str) -> Callable[[list[str]], list[list[float]]]:
    """A function from texts to vectors that asks the service at url + "/embeddings"."""
    if not key:
        raise ValueError("an embedding service needs a key")

    def ask(texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        body = json.dumps({"model": model, "input": texts}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/embeddings", body, head), timeout=120) as reply:
            data = json.load(reply)["data"]
        return [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]

    return ask


def embed_all(texts: DataFrame, ask: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> DataFrame:
    """text, embedding: each different text of a table once, in batches of BATCH for each partition.

    Where a batch fails its texts are asked for one at a time; one that still fails is an error.
    """

    def vectors(some: list[str]) -> list[list[float]]:
        try:
            return ask(some)
        except Exception:
            return [ask([t])[0] for t in some]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            given = batch["text"].tolist()
            for i in range(0, len(given), BATCH):
                some = given[i : i + BATCH]
                yield pd.DataFrame({"text": some, "embedding": vectors(some)})

    return texts.select(F.col(text_col).alias("text")).where("text is not null").distinct().mapInPandas(run, "text string, embedding array<double>")
