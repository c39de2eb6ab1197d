"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting. A sample of at most ``max_train`` labelled rows (those of least hash; the only bound) gives
counts of words and word beginnings in toxic and clean texts. Their log-odds under an informative
Dirichlet prior (the pooled counts, scaled to ``prior`` tokens), less ``margin`` standard errors,
score a word: of the word itself and its beginnings the one with the clearest evidence counts.
Features within the margin of zero say nothing and have score zero; all others, which the sample
bounds, are sent to the tasks.

A word that only repeats the one before it counts once, here and below.

Scoring. A word's score less a drift makes clean text fall. A linear-time scan (Ruzzo and Tompa)
finds every maximal-scoring segment of a text. Segment scores are calibrated as extreme values:
lambda solves E exp(lambda s) = 1 over clean tokens, K follows from the clean texts' best segments,
and x = lambda S - log(K n) is the log of one over the expected number of such segments by chance.
The best x, the sum over significant segments and their number, on logarithmic scales, go through a
logistic link fitted on the sample's texts.

Null and empty texts are scored like any text without segments. Repeated rows keep their own
output rows. Labels that contradict each other count as toxic. Without both classes in the sample,
every score is the toxic share (0 for none). An empty table gives an empty result. A text of any
length is scanned whole, in time and memory linear in its words. Of features with equal evidence the
one of greater score counts; segments of equal score stay apart as the scan finds them. Columns
besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import stored, table
from gridloom.llm._units import Memo, encoded, slices

_SPLIT = r"[^\pL\pN]+"
BEGINNINGS = range(3, 9)
STEP = 0.05
#: Chosen by cross-validation inside the training rows (README).
MARGIN = 2.0


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.25
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = ()
    share: float = 0.0
    significant: float = 2.0

    def word(self, w: str) -> float:
        """The score of the word's clearest feature; features hold (|z|, score)."""
        found = [x for k in (*BEGINNINGS, None) if (x := self.scores.get(w if k is None else f"{w[:k]}\x1f"))]
        return max(found)[1] if found else 0.0


def features_of(w: str) -> list[str]:
    return [w, *(f"{w[:k]}\x1f" for k in BEGINNINGS if len(w) >= k)]


def segments(at: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments; at: places of the tokens whose net score
    is positive, every other token costs ``drift``."""
    out: list[list] = []  # first, last, total before, total at the end
    total, last = 0.0, -1
    for i, gain in zip(at, gains):
        total -= drift * (i - last - 1)
        seg = [i, i, total, total + gain]
        total, last = total + gain, i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(a, b, y - x) for a, b, x, y in out]


def _again(sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Tokens equal to the one before them in their text: no evidence of their own."""
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    starts = np.cumsum(sizes) - sizes
    again[starts[starts < len(index)]] = False
    return again


def _scan(texts: pa.Array, memo: Memo, drift: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text: tokens, the scores of all tokens' units by index, places and gains of positive tokens."""
    sizes, units, index = encoded(pc.split_pattern_regex(pc.utf8_lower(texts), _SPLIT))
    score = np.array(memo.all(units.to_pylist()), dtype=float)[index] if len(units) else np.zeros(0)
    score[_again(sizes, index)] = 0.0
    up = np.flatnonzero(score > drift)
    ends = np.cumsum(sizes)
    lo, hi = np.searchsorted(up, ends - sizes), np.searchsorted(up, ends)
    for k in range(len(sizes)):
        a = int(ends[k] - sizes[k])
        yield int(sizes[k]), up[lo[k] : hi[k]] - a, score[up[lo[k] : hi[k]]] - drift


def _evidence(model: Model, n: int, at: np.ndarray, gains: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The link's inputs, and the significant segments with their x."""
    if not len(at):
        return [math.asinh(-10.0), 0.0, 0.0], []
    base = model.log_k + math.log(max(n, 1))
    found = [(a, b, model.lam * s - base) for a, b, s in segments(at.tolist(), gains.tolist(), model.drift)]
    good = [f for f in found if f[2] >= model.significant]
    best = max(f[2] for f in found)
    return [math.asinh(best), math.asinh(sum(f[2] for f in good)), math.log1p(len(good))], good


def _link(model: Model, inputs: list[list[float]]) -> np.ndarray:
    if not model.weights:
        return np.full(len(inputs), model.share)
    z = np.array(inputs).reshape(-1, 3) @ np.array(model.weights[1:]) + model.weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _karlin(values: np.ndarray, p: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda v) = 1; the mean of v is negative."""
    lo, hi = 0.0, 1.0
    f = lambda t: float(np.log((p * np.exp(np.minimum(t * values, 500))).sum()))
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, prior: float = 2000.0, margin: float = MARGIN) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, training rows alone."""
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = stored(docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "train")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_all = sizes.get(1, 0), sum(sizes.values())
    model = Model(share=n_toxic / n_all if n_all else 0.0)
    if not 0 < n_toxic < n_all:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for piece in slices(batch, 0):
                toxic = piece.column(1).to_numpy()
                sizes, units, index = encoded(pc.split_pattern_regex(pc.utf8_lower(piece.column(0)), _SPLIT))
                fresh = ~_again(sizes, index)
                of, index = np.repeat(toxic, sizes)[fresh], index[fresh]
                names = units.to_pylist()
                for label in (0, 1):
                    n = np.bincount(index[of == label], minlength=len(names))
                    for i in np.flatnonzero(n):
                        for f in features_of(names[i]):
                            seen[label][f] += int(n[i])
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"f": pa.array(keys, pa.string()), "c": pa.array([seen[0][k] for k in keys], pa.int64()), "t": pa.array([seen[1][k] for k in keys], pa.int64())})

    counted = stored(texts.mapInArrow(count, "f string, c bigint, t bigint").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where("f <> ''"), "features")
    words = counted.where("f not like '%\x1f'").agg(F.sum("c"), F.sum("t")).first()
    n_c, n_t = float(words[0] or 1), float(words[1] or 1)
    a = prior * (F.col("c") + F.col("t")) / (n_c + n_t)
    yt, yc = F.col("t") + a, F.col("c") + a
    delta = F.log(yt / (n_t + prior - yt)) - F.log(yc / (n_c + prior - yc))
    error = F.sqrt(1 / yt + 1 / yc)
    some = counted.where(F.lit(n_t + prior) > yt).where(F.lit(n_c + prior) > yc).select("f", (F.abs(delta) / error).alias("z"), (F.signum(delta) * (F.abs(delta) - margin * error)).alias("s"))
    model.scores = {r["f"]: (r["z"], r["s"]) for r in some.where(F.col("z") > margin).collect()}

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, found = Memo(lambda units: [model.word(u) for u in units]), Counter()
        for batch in batches:
            for piece in slices(batch.filter(pc.equal(batch.column(1), 0)), 0):
                sizes, units, index = encoded(pc.split_pattern_regex(pc.utf8_lower(piece.column(0)), _SPLIT))
                s = np.maximum(np.array(memo.all(units.to_pylist()), dtype=float), 0.0)[index]
                s[_again(sizes, index)] = 0.0
                found.update(np.rint((s - model.drift) / STEP).astype(int).tolist())
        yield pa.RecordBatch.from_pydict({"v": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    # a few hundred score steps at most
    bins = texts.mapInArrow(histogram, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).collect()
    v, p = np.array([r["v"] for r in bins]) * STEP, np.array([r["n"] for r in bins], dtype=float)
    model.lam = _karlin(v, p / p.sum()) if len(v) and (v * p).sum() < 0 < v.max() else 1.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda units: [model.word(u) for u in units])
        for batch in batches:
            for piece in slices(batch, 0):
                rows = []
                for n, at, gains in _scan(piece.column(0), memo, model.drift):
                    rows.append((n, max((s for _, _, s in segments(at.tolist(), gains.tolist(), model.drift)), default=0.0)))
                yield pa.RecordBatch.from_pydict({"n": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([r[1] for r in rows], pa.float64()), "toxic": piece.column(1)})

    gumbel = texts.mapInArrow(best, "n bigint, s double, toxic int").where("toxic = 0 and s > 0").agg(F.expr(f"percentile_approx({model.lam} * s - ln(greatest(n, 1)), 0.5, 10000)")).first()[0]
    model.log_k = (gumbel if gumbel is not None else 0.0) + math.log(math.log(2))  # the median of a Gumbel law

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda units: [model.word(u) for u in units])
        for batch in batches:
            for piece in slices(batch, 0):
                rows = [_evidence(model, *x)[0] for x in _scan(piece.column(0), memo, model.drift)]
                yield pa.RecordBatch.from_pydict({f"x{k}": pa.array([r[k] for r in rows], pa.float64()) for k in range(3)} | {"toxic": piece.column(1)})

    rows = np.array([tuple(r) for r in texts.mapInArrow(inputs, "x0 double, x1 double, x2 double, toxic int").collect()], dtype=float)
    model.weights = _logistic(rows[:, :3], rows[:, 3])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): the significant segments as first and last word and their x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda units: [model.word(u) for u in units])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("x", pa.float64())]))
        for batch in batches:
            for piece in slices(batch, 1):
                found = [_evidence(model, *x) for x in _scan(piece.column(1), memo, model.drift)]
                spans = pa.array([[{"first": a, "last": b, "x": x} for a, b, x in f] for _, f in found], kind)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_link(model, [e for e, _ in found])), spans], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, passages array<struct<first:bigint,last:bigint,x:double>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"))
