"""Language identification: averaged hashed subword embeddings and a linear softmax.

Three and four neighbouring bytes of a word (its ends marked by blanks) and the word itself are
hashed into buckets; each bucket has an embedding, a text's embeddings are averaged, and a
linear softmax names the language. Embeddings and softmax are trained together by stochastic
gradient descent. Part of the sample is kept back for calibration: a temperature that makes
the score a probability, and the score below which a prediction isn't to be trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlex.llm.batches import map_texts
from quernlex.llm.words import LOWER, mix, word_hashes
from quernlex.session import checkpoint

#: The most documents that fitting uses: those with the least hashes of their ids.
SAMPLE_ROWS = 6_000
BUCKETS = 1 << 13
DIMENSIONS = 16
EPOCHS, BATCH, RATE = 12, 32, 40.0
#: Of the sample, one row in so many is for calibration.
KEPT_BACK = 5
#: Accepted predictions are right in at least this share of the rows kept back.
PRECISION = 0.99
UNKNOWN = "und"

_U = np.uint64
_BYTE = np.arange(256)
_WORDY = np.where(((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0x80), LOWER, 0x20).astype(np.uint8)
_SALT = mix(np.arange(1, 1025, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)).reshape(4, 256)


def fold_number(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def subwords(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts' subwords, text after text, and where each text's begin."""
    raw = b"  \n  " + b"\n  ".join((t or b"") + b" " for t in texts) + b"   "
    b = _WORDY[np.frombuffer(raw, np.uint8)]
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    begin = np.concatenate(([4], 4 + np.cumsum(lengths + 4)))  # a blank before each text
    n = len(b) - 3
    word = b != 0x20
    part = _SALT[0][b[:n]] + _SALT[1][b[1 : n + 1]] + _SALT[2][b[2 : n + 2]]
    shift = _U(64 - 13)
    three = np.flatnonzero(word[1 : n + 1])
    four = np.flatnonzero(word[1 : n + 1] & word[2 : n + 2])
    places = [three, four]
    codes = [part[three] * _U(0x9E3779B97F4A7C15) >> shift, (part[four] + _SALT[3][b[four + 3]]) * _U(0xD6E8FEB86659FD93) >> shift]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    whole = word_hashes(b, start + 1, end + 1)
    places.append(start)
    codes.append(whole >> shift)
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return np.concatenate(codes)[order].astype(np.int64), np.searchsorted(at[order], begin - 1)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float) -> None:
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probabilities of the languages; embeddings and softmax are one table by now."""
        codes, begin = subwords(texts)
        n = np.diff(begin)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.langs)):
                out[some, k] = np.add.reduceat(self.table[codes, k], begin[:-1][some])
        return softmax((out / np.maximum(n, 1)[:, None] + self.bias) / self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Plain stochastic gradient descent on small batches of (buckets, shares, language)."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w = rng.normal(0, 0.1, (DIMENSIONS, len(langs)))
    bias = np.zeros(len(langs))
    steps = EPOCHS * -(-len(rows) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH)):
            x = np.zeros((len(some), BUCKETS))
            for i, r in enumerate(some.tolist()):
                x[i, rows[r][0]] = rows[r][1]
            use = np.flatnonzero(x.any(axis=0))
            x = x[:, use]
            h = x @ e[use]
            p = softmax(h @ w + bias)
            p[np.arange(len(some)), [rows[r][2] for r in some.tolist()]] -= 1
            p /= len(some)
            rate = RATE * (1 - done / steps)
            back = p @ w.T
            w -= rate * 0.05 * (h.T @ p)
            e[use] -= rate * (x.T @ back)
            bias -= rate * 0.005 * p.sum(axis=0)
            done += 1
    return e @ w, bias


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> Model:
    """A model of a bounded sample of the documents that may be learned from.

    Those have crc32(id as text) mod 4 other than 2, an id, a language and a letter; of rows that
    share an id the one with the least language and text is taken, so there are sample_rows rows
    at most. Without any, the model knows no language and every text is unknown.
    """
    crc = fold_number(F.col(id_col))
    lettered = F.regexp_like(F.col(text_col), F.lit(r"\p{L}"))
    may = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (crc % 4 != 2))
    ids = may.where(lettered).select(F.col(id_col).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    # at most sample_rows ids: their size is bounded, so they may be broadcast
    sample = may.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), lettered.alias("lettered")).where("lettered").join(F.broadcast(ids), "i")
    sample = sample.groupBy("i").agg(F.min(F.struct("lang", "t")).alias("s")).select("i", "s.lang", "s.t")

    def make():
        def work(texts: list[bytes | None]) -> list[list]:
            codes, begin = subwords(texts)
            found, shares = [], []
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                c, n = np.unique(codes[lo:hi], return_counts=True)
                found.append(c.astype(np.uint16).tobytes())
                shares.append((n / max(hi - lo, 1)).astype(np.float32).tobytes())
            return [found, shares]

        return work

    parts = map_texts(sample, "t", [("codes", "binary", pa.binary()), ("shares", "binary", pa.binary())], make, ["i", "lang"])
    got = [(str(r["c0"]), r["c1"], bytes(r["codes"]), bytes(r["shares"])) for r in checkpoint(parts).toLocalIterator()]
    got.sort()  # an order that reruns agree on
    langs = sorted({r[1] for r in got})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    number = {x: k for k, x in enumerate(langs)}
    rows = [(np.frombuffer(c, np.uint16).astype(np.int64), np.frombuffer(s, np.float32), number[x]) for _, x, c, s in got]
    turn = np.array([hash_of(r[0]) % KEPT_BACK for r in got])
    back = [r for r, t in zip(rows, turn.tolist(), strict=True) if t == 0]
    learn = [r for r, t in zip(rows, turn.tolist(), strict=True) if t] or rows
    table, bias = train(learn, langs)
    if not back:
        return Model(langs, table, bias, 1.0, 0.0)
    logits = np.stack([s @ table[c] for c, s, _ in back]) + bias
    truth = np.array([k for _, _, k in back])
    heats = np.geomspace(0.05, 20, 60)
    heat = min(heats, key=lambda h: -np.log(softmax(logits / h)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = softmax(logits / heat)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    least = float(score[order[np.flatnonzero(good)[-1]]]) if good.any() else 1.0
    return Model(langs, table, bias, float(heat), least)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) // 4


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is a language of the sample, or "und" for a null text, one without a letter, or
    where nothing could be learned; those have score 0 and are rejected. rejected: the score is
    below the calibrated bound. held_out: crc32(id as text) mod 4 is 2 (a null id counts as
    empty); such rows teach nothing. Ids may be repeated. Empty tables give no rows.
    """
    model = fit(docs, id_col, text_col, lang_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list[bytes | None]) -> list[list]:
            m = shared.value
            if not m.langs:
                return [[None] * len(texts), [0.0] * len(texts)]
            p = m.scores(texts)
            return [[m.langs[k] for k in p.argmax(axis=1).tolist()], p.max(axis=1).tolist()]

        return work

    lettered = docs.select(
        F.col(id_col).alias("i"),
        F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)).alias("lettered"),
        F.col(text_col).alias("t"),
    )
    out = map_texts(lettered, "t", [("lang", "string", pa.string()), ("p", "double", pa.float64())], make, ["i", "lettered"])
    known = F.col("c1") & F.col("lang").isNotNull()
    score = F.when(known, F.col("p")).otherwise(F.lit(0.0))
    return out.select(
        F.col("c0").alias("doc_id"),
        (fold_number(F.col("c0")) % 4 == 2).alias("held_out"),
        F.when(known, F.col("lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        score.alias("score"),
        (~known | (score < model.least)).alias("rejected"),
    )
