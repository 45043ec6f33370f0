"""Token counts by the whole-token shortcut.

Offline, on the driver, each string of the vocabulary that ends a word is given to the tokenizer
alone; those that come back as one token are proven whole, and executors get their list. White
space never is part of a token here, so a text's count is the sum over its runs between ASCII
white space. A run is cut into the tokenizer's pre-tokens; a proven one counts as one token
without any merging, and only the rest is merged, by the library itself. A run with characters
about which the pattern's two implementations might disagree, or with what may be a special
string, goes to the library as it is; the runs around it don't. Counts of short runs and
pre-tokens are remembered, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlex.llm.words import column_bytes
from quernlex.session import ship

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Different runs, and different pre-tokens, whose counts a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 500_000, 64
#: The file's own pre-token pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Counter:
    """Counts the tokens of texts, given the pre-tokens that are proven to be one token."""

    def __init__(self, path: str, proven: list[str]) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(PIECES).findall
        # Up to U+024F, library and regex module agree about letters, digits and white space.
        self.plain = regex.compile("[\\x00-\\u024f]*").fullmatch
        self.proven = dict.fromkeys(proven, 1)
        self.runs: dict[bytes, int] = {}
        self.merged: dict[str, int] = {}

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        """A pre-token's count."""
        n = self.proven.get(piece) or self.merged.get(piece)
        if n is None:
            n = self.library(piece)
            if len(piece) <= LONGEST:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[piece] = n
        return n

    def run(self, raw: bytes) -> int:
        """The count of a run between white space."""
        text = raw.decode()
        if "<|" in text or not self.plain(text):
            n = self.library(text)
        else:
            folded = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
            n = sum(map(self.piece, self.pieces(folded)))
        if len(raw) <= LONGEST:
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            self.runs[raw] = n
        return n

    def count(self, text: bytes) -> int:
        total, known, run = 0, self.runs.get, self.run
        for raw in text.split():  # bytes are split at ASCII white space only
            n = known(raw)
            total += run(raw) if n is None else n
        return total


def prove(path: str) -> list[str]:
    """The vocabulary strings that are, alone, one pre-token and one token."""
    counter = Counter(path, [])
    ends = [v[:-4] for v in counter.tokenizer.get_vocab(with_added_tokens=False) if v.endswith("</w>")]
    words = [v for v in ends if v.isascii() and v == v.lower() and counter.pieces(v) == [v]]
    encoded = counter.tokenizer.encode_batch(words, add_special_tokens=False)
    return sorted(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


#: On the driver, what was proven; on workers, the counter of each vocabulary.
_PROVEN: dict[str, list[str]] = {}
_COUNTERS: dict[str, Counter] = {}


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if vocabulary.startswith("/") else public_tokenizers.path(vocabulary)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library for the whole text, without added special tokens; strings
    of special tokens inside a text are one token each, as is the library's default. A null
    text is empty: 0 bytes, 0 tokens. Ids may be null or repeated. `vocabulary` is a file of
    the public_tokenizers package or an absolute path that every executor has.
    """
    spark = ship(docs.sparkSession)
    if vocabulary not in _PROVEN:
        _PROVEN[vocabulary] = prove(_path(vocabulary))
    shared = spark.sparkContext.broadcast(_PROVEN[vocabulary])  # no more strings than the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(_path(vocabulary), shared.value)
        count = _COUNTERS[vocabulary].count
        for batch in batches:
            n = pa.array([count(t) if t else 0 for t in column_bytes(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
