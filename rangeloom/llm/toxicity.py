"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; a sample of the texts without a label row is the
unlabelled side, and the risk is corrected by the class prior, which is estimated from
these two sides alone (``estimate_prior``) unless it is given:

    risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

A linear numpy classifier over present-or-absent word features is trained on the driver
from a bounded sample; scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.llm.common import blob, cut, free_name, pieces, require
from rangeloom.llm.simhash import word_prints

PIECE_BYTES = 4_000_000
#: Bytes of words that a worker keeps the features of; the cache starts anew beyond it.
CACHE_BYTES = 24_000_000
#: A feature's share among positives must exceed that among the others by so many standard errors.
LEAST_Z = 5.0
#: Lengths of word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
#: Fixed bytes for splitting: ASCII other than letters separates; other bytes stay.
LETTER_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class ToxicityModel:
    """Weights of named features; a text scores sigmoid(bias + sum of its present features)."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, present: set[int]) -> float:
        z = self.bias + float(self.weights[sorted(present)].sum()) if present else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def words_of(data: bytes) -> set[bytes]:
    """Distinct lower-cased words of a text."""
    return set(data.decode("utf-8", errors="replace").lower().encode().translate(LETTER_BYTES).split())


def word_features(word: bytes) -> list[str]:
    """The whole word and its beginnings of four to six characters."""
    w = word.decode("utf-8", errors="replace")
    return [f"={w}"] + [f"^{w[:n]}" for n in STEMS if len(w) >= n]


def text_features(data: bytes) -> set[str]:
    return {f for w in words_of(data) for f in word_features(w)}


def train_nnpu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Minimise the non-negative PU risk with Adam; p and u are (texts, features) of 0 and 1.

    Full batches, so where the corrected negative risk falls below 0 its part of the gradient is
    left out: the exact subgradient of the estimator.  Deterministic.
    """
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        w32 = w.astype(np.float32)
        sp, su = (1 / (1 + np.exp(-np.clip(a @ w32[:-1] + w32[-1], -40, 40))) for a in (p, u))
        # logistic loss: d/dz of loss+ is s - 1, of loss- is s
        push = lambda a, g: np.append(g @ a, g.sum()) / max(1, len(a))
        negative_risk = -np.log(np.maximum(1 - su, 1e-12)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-12)).mean()
        corrected = push(u, su) - prior * push(p, sp)
        grad = prior * push(p, sp - 1) + (corrected if negative_risk >= 0 else 0.0)
        grad[:-1] += decay * prior * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, cover: float = 0.7) -> float:
    """Share of positives among the unlabelled rows, from rows of 0 and 1 alone.

    A set of features that marks a share a of the positives marks at least prior * a of the
    unlabelled, so the ratio of the two shares bounds the prior from above.  Features are
    joined in order of their ratio until they mark ``cover`` of the positives, which keeps
    the bound tight without resting on a few rare ones.
    """
    if not len(p) or not len(u) or not p.shape[1]:
        return 0.05
    ratio = (u.sum(axis=0) + 1) / len(u) / ((p.sum(axis=0) + 1) / len(p))
    marked_p, marked_u = np.zeros(len(p), bool), np.zeros(len(u), bool)
    for f in np.argsort(ratio, kind="stable"):
        marked_p |= p[:, f] > 0
        marked_u |= u[:, f] > 0
        if marked_p.mean() >= cover:
            break
    return float(np.clip(marked_u.mean() / max(marked_p.mean(), 1e-9), 0.005, 0.95))


def apart(prints: list[tuple[bool, int]], radius: int = 8) -> list[int]:
    """Fingerprints over distinct words, in order, without those within ``radius`` bits of one before."""
    rest = np.array([x for _, x in prints], np.int64).astype(np.uint64)
    kept = []
    while len(rest):
        kept.append(int(rest[:1].astype(np.int64)[0]))
        rest = rest[np.bitwise_count(rest ^ rest[0]) > radius]
    return kept


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    train: F.Column | None = None,
    max_positive: int = 2_000,
    max_unlabelled: int = 6_000,
    n_features: int = 600,
    min_texts: int = 3,
    min_share: float = 0.01,
    prior: float | None = None,
) -> ToxicityModel:
    """Fit on at most ``max_positive`` confirmed toxic texts and ``max_unlabelled`` texts without
    a label row (lowest key hashes; other labelled texts only where too few are without a row).

    ``train`` is a condition on keys whose labels may be read (default: all).  ``prior`` is
    estimated where it is not given.  Near copies count once (SimHash over
    their words), as words of one text are no pattern.  Features are word
    features that at least ``min_texts`` and ``min_share`` of the positives have, twice as often as the unlabelled sample and by ``LEAST_Z`` standard
    errors, the clearest ones first.  Null labels count as unlabelled, null keys are not
    learnt from; without positives or others every text
    scores the prior (next to 0 if there are no labels).
    """
    require(documents, key, text)
    require(labels, key, toxic)
    allowed = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    rows = labels.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.when(allowed, F.coalesce(F.col(toxic).cast("int"), F.lit(0))).otherwise(-1)).alias("_toxic"))
    rows = rows.select(F.col(key).alias("_key"), "_toxic")
    order = F.xxhash64(F.col("_key").cast("string"))
    some = rows.where("_toxic > 0").orderBy(order, "_key").limit(max_positive).select("_key", F.lit(True).alias("_p"), F.lit(False).alias("_u"))
    keys = documents.select(F.col(key).alias("_key")).where("_key is not null")
    bare = keys.join(rows.select("_key"), "_key", "left_anti").distinct().orderBy(order, "_key").limit(max_unlabelled)
    bare = cut(bare.select("_key", F.lit(False).alias("_p"), F.lit(True).alias("_u")))
    lacking = max_unlabelled - bare.count()
    if lacking > 0:  # a label that is not toxic is not read as a negative, the text is one of the mixed side
        mixed = rows.where("_toxic >= 0").orderBy(order, "_key").limit(lacking).select("_key", F.lit(False).alias("_p"), F.lit(True).alias("_u"))
        bare = bare.unionByName(mixed)
    sample = some.unionByName(bare).groupBy("_key").agg(F.bool_or("_p").alias("_p"), F.bool_or("_u").alias("_u"))
    sample = F.broadcast(cut(sample))  # at most max_positive + max_unlabelled keys
    guess = 1e-6 if prior is None else min(max(prior, 1e-6), 0.95)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_text", PIECE_BYTES):
            words = [b" ".join(sorted(words_of(t))) for t in part.column("_text").to_pylist()]
            prints = np.frombuffer(b"".join(word_prints(w, 1) for w in words), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_pydict({"words": pa.array(words, pa.binary()), "print": pa.array(prints), "p": part.column("_p"), "u": part.column("_u")})

    texts = documents.select(F.col(key).alias("_key"), blob(text).alias("_text")).join(sample, "_key").select("_text", "_p", "_u")
    bags = cut(texts.mapInArrow(read, "words binary, print long, p boolean, u boolean"))
    prints = bags.groupBy("print").agg(F.bool_or("p").alias("p")).collect()  # the sample's rows at most
    alone = apart(sorted((not r.p, r.print) for r in prints))
    some = F.broadcast(documents.sparkSession.createDataFrame([(x,) for x in alone], "_print long"))
    bags = bags.join(some, F.col("print") == F.col("_print")).groupBy("print").agg(F.min("words").alias("words"), F.bool_or("p").alias("p"), F.bool_or("u").alias("u"))
    bags = cut(bags)
    sizes = bags.agg(F.count(F.when(F.col("p"), 1)), F.count(F.when(F.col("u"), 1))).first()
    a, b = sizes
    if not a or not b:
        return ToxicityModel({}, np.zeros(0), float(np.log(guess / (1 - guess))), guess)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "words", PIECE_BYTES):
            seen: dict[str, list[int]] = {}
            for bag, p, u in zip(*(part.column(c).to_pylist() for c in ("words", "p", "u")), strict=True):
                for f in {f for w in bag.split() for f in word_features(w)}:
                    n = seen.setdefault(f, [0, 0])
                    n[0] += p
                    n[1] += u
            yield pa.RecordBatch.from_pydict({"f": pa.array(list(seen), pa.string()), "p": pa.array([n[0] for n in seen.values()], pa.int64()), "u": pa.array([n[1] for n in seen.values()], pa.int64())})

    counted = bags.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= max(min_texts, min_share * a))
    share, other, both = F.col("p") / a, F.col("u") / b, (F.col("p") + F.col("u")) / (a + b)
    z = (share - other) / F.sqrt(both * (1 - both) * (1 / a + 1 / b) + 1e-12)
    best = counted.where((share >= 2 * other) & (z >= LEAST_Z)).orderBy(F.round(z, 6).desc(), "f").limit(n_features)
    index = {r[0]: i for i, r in enumerate(best.select("f").collect())}  # n_features names at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "words", PIECE_BYTES):
            rows = [sorted({index[f] for w in bag.split() for f in word_features(w) if f in index}) for bag in part.column("words").to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": pa.array(rows, pa.list_(pa.int32())), "p": part.column("p"), "u": part.column("u")})

    found = bags.mapInArrow(place, "at array<int>, p boolean, u boolean").collect()  # the sample's rows at most
    x = np.zeros((len(found), len(index)), np.float32)
    for i, r in enumerate(found):
        x[i, r[0]] = 1
    positive, mixed_in = np.array([r[1] for r in found], bool), np.array([r[2] for r in found], bool)
    prior = estimate_prior(x[positive], x[mixed_in]) if prior is None else guess
    weights, bias = train_nnpu(x[positive], x[mixed_in], prior)
    return ToxicityModel(index, weights, bias, prior)


def score_texts(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "_toxicity", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``, the score (0 to 1) of each whole text; empty and null texts score too.

    Only the text enters the score.  Repeated rows and further columns are kept as they are;
    a column ``out`` must not exist yet.
    """
    require(df, text)
    names = [c for c in df.columns if keep_text or c != text]
    if out in df.columns:
        raise ValueError(f"column {out} exists; choose another name")
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType, True) for c in names], T.StructField(out, T.DoubleType())])
    width = len(names)
    at = names.index(text) if keep_text else width  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple[int, ...]] = {}
        held = 0
        features = model.features
        for part in pieces(batches, at, PIECE_BYTES):
            scores = []
            for data in part.column(at).cast(pa.binary()).to_pylist():
                words = words_of(data or b"")
                for w in [w for w in words if w not in cache]:
                    cache[w] = tuple(features[f] for f in word_features(w) if f in features)
                    held += len(w) + 120
                scores.append(model.score({i for got in map(cache.__getitem__, words) if got for i in got}))
                if held > CACHE_BYTES:
                    cache.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(scores, pa.float64())], names=[*names, out])

    columns = [F.col(f"`{c}`") for c in names]
    return (df.select(*columns) if keep_text else df.select(*columns, blob(text).alias(free_name(df, "_text")))).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` without the rows that score ``threshold`` or more; same columns.

    Null and empty texts are judged by the bias alone; repeated rows are judged alike.
    """
    out = free_name(df, "_toxicity")
    return score_texts(df, model, text, out).where(F.col(out) < threshold).select(*[F.col(f"`{c}`") for c in df.columns])
