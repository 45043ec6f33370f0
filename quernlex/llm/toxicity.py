"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The features are densities of lexicon words (a fixed list of insults, and terms learned from
labelled rows), how near second-person words stand to them, and rates of capitals, punctuation
and obfuscation. Terms are words and short beginnings of words, so that inflected forms of a
stem count together; each is learned with the share of toxic documents among those that have it.

Fitting uses a bounded sample of labelled rows. What a row's own label taught must not show in
its own features, so the sample has folds: a row's features come from the terms learned on the
other folds, and so does the score that the calibration is fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlex.llm.batches import map_texts
from quernlex.llm.trees import Boosted, Isotonic
from quernlex.llm.words import Words, column_bytes, eights, mix, slices
from quernlex.session import checkpoint, ship

#: The most labelled rows that fitting uses: those with the least hashes of their ids.
SAMPLE_ROWS = 12_000
FOLDS = 5
THRESHOLD = 0.3
#: A term needs so many toxic documents of the sample, copies aside.
LEAST_DOCS = 3
#: The lexicon's size: the most terms that are weighed, those in the most toxic documents of the sample first.
LEXICON_TERMS = 50_000
#: The least log-likelihood ratio of a term that is learned.
LEAST_RATIO = 12.0
#: Shares of toxic documents, estimated with care, that make a term weak, fair or strong evidence.
BANDS = (0.5, 0.75, 0.9)
NEAR_WORDS = 5
_PREFIXES = (3, 4, 5, 6)

# Common insults and second-person words of four languages.
INSULTS = (
    "ass awful bastard clown creep cretin damn disgusting dumb dumbass fool freak garbage gross hate hell idiot idiotic imbecile"
    " jerk liar lame loser moron moronic pathetic pig psycho rubbish scum scumbag shit stupid sucker trash ugly vermin worthless"
    " abschaum arschloch blöd dumm dreck depp ekelhaft hässlich idiotin mist nichtsnutz schwein trottel versager wertlos"
    " abruti connard crétin débile dégoûtant déchet idiote imbécile laid merde minable ordure pathétique stupide"
    " asqueroso basura estúpido escoria feo imbécil inútil mierda patético payaso perdedor tonto"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure"
    " tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros vuestro"
).split()

_U = np.uint64
_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0x80)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_ALPHA = _UPPER | _LETTER
_PUNCT = ((_BYTE >= 0x21) & (_BYTE <= 0x2F)) | ((_BYTE >= 0x3A) & (_BYTE <= 0x40)) | ((_BYTE >= 0x5B) & (_BYTE <= 0x60)) | ((_BYTE >= 0x7B) & (_BYTE <= 0x7E))
#: Signs that stand for letters.
_SIGNS = b"01345789@$"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _SIGNS, bytes(range(97, 123)) + b"oieastbgas")
_SIGN = np.isin(_BYTE, np.frombuffer(_SIGNS + b"*", np.uint8))
#: The kinds of terms are told apart by these.
_WHOLE = _U(0x5851F42D4C957F2D)


def fold_number(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def terms_of(w: Words) -> np.ndarray:
    """A row for each word: hashes of its beginnings (0 where it is shorter) and of itself."""
    first = eights(w.buf)[w.start]
    size = w.end - w.start
    out = np.zeros((len(w.start), len(_PREFIXES) + 1), _U)
    for k, n in enumerate(_PREFIXES):
        fits = size >= n
        out[fits, k] = mix(first[fits] & _U((1 << 8 * n) - 1) ^ _U(n << 56))
    out[:, -1] = mix(w.hashes() ^ _WHOLE)
    return out


def contexts(w: Words) -> np.ndarray:
    """A hash of the words before and after each word."""
    h = np.concatenate(([_U(0)], w.hashes(), [_U(0)]))
    return mix(h[:-2] * _U(0x9E3779B97F4A7C15) + h[2:])


def _own(words: list[str]) -> np.ndarray:
    w = Words([x.encode() for x in words], _LETTER)
    return np.unique(w.hashes())


def _held(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are keys, and where they would be."""
    if not len(sorted_keys):
        return np.zeros(x.shape, bool), np.zeros(x.shape, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


class Lexicon:
    """Learned terms (sorted hashes) with their evidence."""

    def __init__(self, keys: np.ndarray, evidence: np.ndarray) -> None:
        use = evidence >= BANDS[0]
        self.keys, self.evidence = keys[use], evidence[use]
        self.seen = np.zeros(1 << 18, bool)  # says at once of most words that they aren't terms
        self.seen[(self.keys & _U((1 << 18) - 1)).astype(np.int64)] = True

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        """The largest evidence of each word's terms."""
        flat = terms.ravel()
        out = np.zeros(len(flat))
        some = np.flatnonzero(self.seen[(flat & _U((1 << 18) - 1)).astype(np.int64)])
        held, at = _held(self.keys, flat[some])
        out[some[held]] = self.evidence[at[held]]
        return out.reshape(terms.shape).max(axis=1) if len(terms) else np.zeros(0)


class Features:
    """Dense features of texts, given a lexicon."""

    def __init__(self) -> None:
        self.insults, self.you = _own(INSULTS), _own(SECOND_PERSON)

    def words(self, texts: list[bytes | None]) -> Words:
        return Words([(t or b"").translate(_PLAIN) for t in texts], _LETTER)

    def of(self, texts: list[bytes | None], lexicons: list[Lexicon], which: np.ndarray) -> np.ndarray:
        """A row for each text; which: the number of the lexicon for each."""
        w = self.words(texts)
        doc = w.doc()
        terms = terms_of(w)
        weight = np.zeros(len(doc))
        for k in np.unique(which).tolist():
            own = which[doc] == k
            weight[own] = lexicons[k].weigh(terms[own])
        insult = _held(self.insults, w.hashes())[0]
        you = _held(self.you, w.hashes())[0]
        raw = np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        lo = w.begin[:-1]
        hi = lo + w.lengths

        def per_text(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            s = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
            return s[b] - s[a]

        def words(values: np.ndarray) -> np.ndarray:
            return per_text(values, w.first[:-1], w.first[1:])

        # within so many words, in the same text
        s = np.concatenate(([0], np.cumsum(you)))
        i = np.arange(len(doc))
        near = s[np.minimum(i + NEAR_WORDS + 1, w.first[1:][doc])] > s[np.maximum(i - NEAR_WORDS, w.first[:-1][doc])]
        bands = [weight >= b for b in BANDS]
        evil = bands[1] | insult
        n = np.maximum(w.counts, 1)
        size = np.maximum(w.lengths, 1)
        alpha, sign = _ALPHA[raw], _SIGN[raw]
        inside = np.zeros(len(raw), bool)  # a sign between letters
        inside[1:-1] = sign[1:-1] & alpha[:-2] & alpha[2:]
        letters = np.maximum(per_text(alpha, lo, hi), 1)
        count = [words(b) for b in (*bands, insult)]
        most = np.zeros(w.n)
        np.maximum.at(most, doc, weight)
        shout = (raw == 0x21) | (raw == 0x3F)
        return np.stack(
            [
                *count,
                *(c / n for c in count),
                words(weight) / n,
                most,
                words(evil & near) / n,
                words(evil & near) / np.maximum(words(evil), 1),
                words(you) / n,
                per_text(_UPPER[raw], lo, hi) / letters,
                per_text(_PUNCT[raw], lo, hi) / size,
                per_text(shout, lo, hi) / size,
                per_text(inside, lo, hi) / n,
                np.log1p(w.counts),
            ],
            axis=1,
        )


def evidence(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Of the documents with each term, n1 of all1 toxic and n0 of all0 other ones, the share that is toxic.

    Two more clean documents are assumed, so that few documents are weak evidence; terms whose
    log-likelihood ratio may be chance get 0.
    """
    if not all1 or not all0:
        return np.zeros(len(n1))
    share = all1 / (all1 + all0)
    n = np.maximum(n1 + n0, 1)

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / expected), 0)

    ratio = 2 * (part(n1, n * share) + part(n0, n * (1 - share)))
    return np.where((n1 > n * share) & (ratio >= LEAST_RATIO), n1 / (n1 + n0 + 2), 0)


class Model:
    """All that scoring needs."""

    def __init__(self, lexicon: Lexicon, boosted: Boosted, isotonic: Isotonic) -> None:
        self.lexicon, self.boosted, self.isotonic = lexicon, boosted, isotonic

    def score(self, features: Features, texts: list[bytes | None]) -> np.ndarray:
        x = features.of(texts, [self.lexicon], np.zeros(len(texts), np.int64))
        return self.isotonic.apply(self.boosted.predict(x))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, lexicon_terms: int = LEXICON_TERMS) -> Model:
    """A model of the labelled rows that may be learned from.

    Those have crc32(id as text) mod 4 other than 2. Of ids labelled twice the larger label
    holds, of documents that share an id the one with the least text; so there is a row for each
    id, sample_rows at most. Null labels, and labels without a document, teach nothing. Without labels of both
    kinds every score is the rate of label 1 (0 without any).
    """
    spark = docs.sparkSession
    ship(spark)
    crc = fold_number(F.col(id_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc % 4 != 2))
    known = known.groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    # at most sample_rows small rows: their size is bounded, so they may be broadcast
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    fold = F.floor(fold_number(F.col("i")) / 4) % FOLDS
    sample = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    sample = sample.groupBy("i", "y").agg(F.min("t").alias("t"))
    sample = checkpoint(sample.select("i", "y", fold.cast("int").alias("fold"), "t"))

    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            texts = column_bytes(batch.column(1))
            for lo, hi in slices(texts):
                w = features.words(texts[lo:hi])
                terms, place = terms_of(w), contexts(w)
                for k in range(w.n):
                    own = slice(w.first[k], w.first[k + 1])
                    flat, around = terms[own].ravel(), np.repeat(place[own], terms.shape[1])
                    order = np.lexsort((around, flat))
                    flat, around = flat[order], around[order]
                    new = np.ones(len(flat), bool)
                    new[1:] = flat[1:] != flat[:-1]
                    n = int(new.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat[new].view(np.int64)), pa.array(around[new].view(np.int64)), pa.array(np.full(n, fold[lo + k], np.int32))], ["term", "place", "fold"]
                    )

    # copies and near copies have a term in the same surroundings, and so count once
    found = sample.where("y = 1").select("fold", "t").mapInArrow(toxic_terms, "term long, place long, fold int")
    found = found.groupBy("term", "place").agg(F.min("fold").alias("fold")).groupBy("term")
    found = found.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("fold") == k, 1)).alias(f"f{k}") for k in range(FOLDS)])
    top = found.where((F.col("n") >= LEAST_DOCS) & (F.col("term") != 0)).orderBy(F.col("n").desc(), "term").limit(lexicon_terms).collect()
    keys = np.array([r["term"] for r in top], np.int64).view(_U)
    order = np.argsort(keys)
    keys = keys[order]
    toxic = np.array([[r[f"f{k}"] for k in range(FOLDS)] for r in top], np.int64).reshape(-1, FOLDS)[order].T
    shared_keys = spark.sparkContext.broadcast(keys)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row: how many documents of each fold and label have each term, and how many there are."""
        features, keys = Features(), shared_keys.value
        total = np.zeros((FOLDS, 2, len(keys) + 1), np.int32)
        for batch in batches:
            y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = column_bytes(batch.column(2))
            for lo, hi in slices(texts):
                w = features.words(texts[lo:hi])
                terms, doc = terms_of(w), w.doc()
                held, at = _held(keys, terms)
                for k in range(w.n):
                    own = doc == k if w.n > 1 else slice(None)
                    into = total[fold[lo + k], y[lo + k]]
                    into[np.unique(at[own][held[own]])] += 1
                    into[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    total = np.zeros((FOLDS, 2, len(keys) + 1), np.int64)
    for r in sample.coalesce(12).select("y", "fold", "t").mapInArrow(counts, "n binary").toLocalIterator():
        total += np.frombuffer(r["n"], np.int32).reshape(total.shape)
    lexicons = []
    for k in range(FOLDS + 1):  # without fold k; the last is of all
        others = [f for f in range(FOLDS) if f != k]
        n0, n1 = total[others].sum(axis=0)
        lexicons.append(Lexicon(keys, evidence(toxic[others].sum(axis=0), n0[:-1], int(n1[-1]), int(n0[-1]))))
    shared = spark.sparkContext.broadcast(lexicons)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, lexicons = Features(), shared.value
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            texts = column_bytes(batch.column(3))
            x = [features.of(texts[lo:hi], lexicons, fold[lo:hi]) for lo, hi in slices(texts)]
            if x:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in np.concatenate(x)], pa.binary())], ["i", "y", "fold", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.mapInArrow(dense, f"i {kind}, y int, fold int, x binary").collect()
    rows = sorted((str(r["i"]), r["y"], r["fold"], bytes(r["x"])) for r in rows)  # in an order that reruns agree on
    if not rows:
        return Model(lexicons[-1], Boosted(), Isotonic(np.zeros(0), np.zeros(0)))
    y, fold = (np.array([r[k] for r in rows]) for k in (1, 2))
    x = np.stack([np.frombuffer(r[3]) for r in rows])
    raw = np.zeros(len(rows))
    for k in np.unique(fold).tolist():
        raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k].astype(float)).predict(x[fold == k])
    return Model(lexicons[-1], Boosted().fit(x, y.astype(float)), Isotonic(raw, y))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, carry: list[str]) -> DataFrame:
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features = Features()
        return lambda texts: [shared.value.score(features, texts).tolist()]

    return map_texts(docs, text_col, [("score", "double", pa.float64())], make, carry)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    held_out: crc32(id as text) mod 4 is 2 (a null id counts as empty); such rows teach nothing.
    The score is of the whole text alone; null and empty texts get one too. Ids may be null or
    repeated, texts of any length. Empty tables give no rows, and without labels of both kinds the
    score is their rate. Other columns are not read, so their names may be any.
    """
    out = _scored(docs, labels, id_col, text_col, label_col, sample_rows, [id_col])
    return out.select(
        F.col("c0").alias("doc_id"),
        (fold_number(F.col("c0")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, columns as they are, with scores below the threshold."""
    out = _scored(docs, labels, id_col, text_col, label_col, sample_rows, docs.columns).where(F.col("score") < threshold)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
