"""Toxicity by maximum-scoring segments over token log-odds.

Labelled texts give every token the log-odds of standing in a toxic text, with a
Dirichlet prior whose mean comes from the token's stem (its first five, then
four letters) and in the end from all tokens, so an unseen form of a known stem
is not neutral.  A token counts as evidence by the lower end of its interval;
every other token costs ``drift``.  A linear-time scan finds all maximal-scoring
segments.  The extreme-value law of their scores tells which passages chance does
not explain and how much the strongest ones of a text of that length tell together;
a one-variable logistic fit maps that to a probability.  Constants are fitted on
labelled rows that aren't held out, one half against the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import filter_rows, hashed_share, materialize, ship, streamed, text_slices, training_row

TOKEN = re.compile(r"[^\W_]+")
#: Lengths of the stems that a token's prior goes through, shortest first.
STEMS = (4, 5)
#: A passage is significant if chance makes one as strong in fewer than one clean text in twenty.
LEVEL = 0.05


def tokens(data: bytes | None) -> list[str]:
    return TOKEN.findall(data.decode("utf-8", "replace").lower()) if data else []


def features(token: str) -> list[str]:
    """The stems of a token, marked as such, and the token itself."""
    return [*(f"{token[:n]}*" for n in STEMS if len(token) > n), token]


@dataclass
class ToxicModel:
    """``score`` of features that are evidence.  By the extreme-value law a clean text
    of ``n`` tokens has ``reach * n * exp(-decay * s)`` segments of score ``s`` or more
    at most; ``rate`` is how often a token is evidence there."""

    score: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()
    drift: float = 0.2
    rate: float = 0.05
    decay: float = 1.0
    reach: float = 0.5
    intercept: float = -2.0
    slope: float = 0.5

    def of_token(self, token: str) -> float:
        for f in reversed(features(token)):
            if f in self.score:
                return self.score[f]
            if f in self.known:
                break
        return -self.drift

    def segments(self, scored: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments ``(first, last, score)`` of a sequence in
        which only ``scored`` positions are above ``-drift``, in their order.

        One pass that keeps candidates with the running total before and after
        each; a candidate swallows earlier ones if that makes a better segment.
        """
        kept: list[tuple[int, int, float, float]] = []
        total, last = 0.0, -1
        for at, s in scored:
            total -= self.drift * (at - last - 1)
            low, total, last = total, total + s, at
            first, high = at, total
            while kept:
                j = len(kept) - 1
                while j >= 0 and kept[j][2] >= low:
                    j -= 1
                if j < 0 or kept[j][3] >= high:
                    break
                first, low = kept[j][0], kept[j][2]
                del kept[j:]
            kept.append((first, at, low, high))
        return [(a, b, high - low) for a, b, low, high in kept]

    def evidence(self, segments: list[tuple[int, int, float]], length: int) -> float:
        """How much the strongest segments tell in a text of ``length`` tokens: the r best
        scores as a Poisson tail, ``-log`` of it for the most telling r.  ``rate`` stands
        for ``reach`` here, so this is a statistic that the logistic curve calibrates."""
        best = 0.0
        for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
            mean = self.rate * max(length, 1) * math.exp(-self.decay * s)
            # P(Poisson(mean) >= r) <= mean^r / r!
            best = max(best, r * -math.log(max(mean, 1e-300)) + math.lgamma(r + 1) - math.log(r))
        return best

    def significant(self, score: float, length: int) -> bool:
        return self.reach * max(length, 1) * math.exp(-self.decay * score) < LEVEL

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.intercept + self.slope * evidence))))


def build(counts: dict[str, tuple[float, float]], texts: tuple[float, float], clean_tokens: float, strength: float = 10.0, z: float = 4.0, least_score: float = 0.5) -> ToxicModel:
    """Log-odds of features from (toxic, clean) document counts.

    ``texts`` are the numbers of toxic and clean texts and ``clean_tokens`` the
    distinct tokens of all clean texts.  The scores are lower ends of the interval
    at ``z``, kept from ``least_score`` up; the extreme-value decay is the positive root of
    ``sum p(s) exp(decay s) = 1`` under the clean rates."""
    model = ToxicModel()
    if not all(texts) or not clean_tokens:
        return model
    base = texts[0] / sum(texts)
    share, scores, rates = {}, {}, []
    for name in sorted(counts, key=lambda f: (not f.endswith("*"), len(f), f)):
        a, b = counts[name]
        shorter = [f"{name[:n]}*" for n in STEMS if n < len(name) - 1] if name.endswith("*") else features(name)[:-1]
        prior = next((share[f] for f in reversed(shorter) if f in share), base)
        alpha, beta = a + strength * prior, b + strength * (1 - prior)
        share[name] = alpha / (alpha + beta)
        low = math.log(alpha / beta) - math.log(base / (1 - base)) - z * math.sqrt(1 / (a + strength * base) + 1 / (b + strength * (1 - base)))
        if low > least_score:
            scores[name] = low
            if not name.endswith("*"):
                rates.append((low, (b + strength * (1 - prior) * base) / clean_tokens))
    model.score, model.known = scores, frozenset(k for k in share if k not in scores)
    if rates:
        s, p = np.array(rates).T
        law = lambda x: float((p * np.exp(x * s)).sum() + max(1e-9, 1.0 - p.sum()) * math.exp(-x * model.drift) - 1.0)
        low, high = 0.05, 0.05
        while law(high) < 0 and high < 20:
            low, high = high, high * 1.5
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if law(mid) < 0 else (low, mid)
        model.decay, model.rate = low, float(min(1.0, max(1e-5, p.sum())))
        # A segment starts with a token that scores s and then has s less to go.
        model.reach = float(min(1.0, max(1e-5, (p * np.exp(low * s)).sum())))
    return model


def _token_scores(found: list[list[str]], model: ToxicModel) -> list[list[tuple[int, float]]]:
    """Positions with evidence in each list of tokens."""
    flat = [w for x in found for w in x]
    out: list[list[tuple[int, float]]] = [[] for _ in found]
    if not flat:
        return out
    codes, unique = pd.factorize(np.array(flat, object))
    score = np.fromiter(map(model.of_token, unique), float, len(unique))
    each = score[codes]
    ends = np.cumsum([len(x) for x in found])
    for at in np.flatnonzero(each > 0):
        i = int(np.searchsorted(ends, at, "right"))
        out[i].append((int(at - (ends[i - 1] if i else 0)), float(each[at])))
    return out


def _point_batches(batches, models: list[ToxicModel]):
    """Evidence (in tenths) by each of the models, and labels, of rows of id, text, half and toxic."""
    for batch in batches:
        for part, texts in text_slices(batch, 1):
            found = [tokens(x) for x in texts]
            for i, model in enumerate(models):
                evidence = [round(model.evidence(model.segments(x), len(w)), 1) for x, w in zip(_token_scores(found, model), found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(texts), pa.int64()), pa.array(evidence, pa.float64()), part.column(3)], ["model", "x", "toxic"])


def _score_batches(batches, model: ToxicModel):
    for batch in batches:
        for part, texts in text_slices(batch, 1):
            found = [tokens(x) for x in texts]
            segments = [model.segments(x) if x else [] for x in _token_scores(found, model)]
            evidence = [model.evidence(x, len(w)) for x, w in zip(segments, found, strict=True)]
            passages = [[{"first": a, "last": b, "score": s} for a, b, s in x if model.significant(s, len(w))] for x, w in zip(segments, found, strict=True)]
            score = [model.probability(e) for e in evidence]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(passages, _PASSAGES)], ["id", "score", "passages"])


_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
_PASSAGES_SQL = "array<struct<first:long,last:long,score:double>>"


def score_texts(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` (probability of label 1) and ``passages`` (token positions
    and scores of every segment significant at the level of 0.05 for a text of that
    length) for every row and whole text of ``df``.

    A null or empty text has no evidence and gets the lowest score.  Repeated rows
    come out as often as they occur; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("passages", T._parse_datatype_string(_PASSAGES_SQL))])
    return picked.mapInArrow(streamed(lambda it: _score_batches(it, model)), schema)


def _count_batches(batches):
    """(token, half, toxic, clean) document counts of the rows of a task; the
    token "" counts texts and " " the distinct tokens of all texts."""
    tally: Counter = Counter()

    def flush():
        rows = [(f, h, n if y else 0, 0 if y else n) for (f, h, y), n in tally.items()]
        tally.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], ["token", "half", "toxic", "clean"]
        )

    for batch in batches:
        for part, texts in text_slices(batch, 1):
            for data, half, y in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                own = set(tokens(data))
                tally.update((f, half, y) for f in own)
                tally["", half, y] += 1
                tally[" ", half, y] += len(own)
            if len(tally) > 200_000:
                yield flush()
    yield flush()


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int, seed: int = 3) -> DataFrame:
    """``id``, ``text``, ``half`` and ``toxic`` of at most ``sample`` labelled
    training rows, by a hash of the id.  A text with several labels is toxic if one
    says so; labels that are null don't count.  Of a repeated id one text is taken,
    the first by its hash."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(training_row("doc_id", 4))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = hashed_share(marks, "doc_id", sample, seed).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(sample).select(F.col("doc_id").alias("id"), "toxic", (F.pmod("h", F.lit(2))).cast("long").alias("half"))
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    # At most ``sample`` rows of three numbers: a bound that holds at every input size.
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "half", "toxic")).alias("x"))
    return found.select("id", "x.text", "x.half", F.col("x.toxic").cast("long").alias("toxic"))


def train(documents: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 2, widths: tuple[float, ...] = (2.0, 3.0, 4.0, 5.0)) -> ToxicModel:
    """Fits a model on a sample of labelled rows that aren't held out.

    Features in fewer than ``least`` toxic texts are left to their stems.  Half of
    the sample makes a model for each of the ``widths`` of intervals, whose evidence on
    the other half fits a logistic curve; the width that tells the labels there best
    counts.  The scores of the model returned come from both halves.  Without
    labels of both kinds the model has no evidence; nulls and repeats are as in
    :func:`labelled_sample`."""
    ship(documents.sparkSession)
    rows = materialize(labelled_sample(documents, labels, sample), "toxic-sample")
    half = lambda c: F.sum(F.when(F.col("half") == 0, F.col(c)).otherwise(0))
    words = (
        rows.mapInArrow(streamed(_count_batches), "token string, half long, toxic long, clean long")
        .groupBy("token")
        .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"), half("toxic").alias("a0"), half("clean").alias("b0"))
    )
    words = materialize(words.select("token", *(F.col(c).cast("double") for c in ("a", "b", "a0", "b0"))), "toxic-words")
    # A form adds at most ``least`` toxic texts to its stems, and its clean ones in
    # proportion: a stem counts for having several toxic forms.
    cut = lambda a: F.least(F.lit(1.0), least / F.greatest(F.col(a), F.lit(1)))
    stem = F.explode(F.filter(F.array(*(F.when(F.length("token") > n, F.concat(F.substring("token", 1, n), F.lit("*"))) for n in STEMS)), lambda x: x.isNotNull()))
    stems = words.select(stem.alias("token"), *((F.col(c) * cut("a" + c[1:])).alias(c) for c in ("a", "b", "a0", "b0"))).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("a", "b", "a0", "b0")))
    found = words.unionByName(stems).filter((F.col("a") >= least) | F.col("token").isin("", " ")).collect()
    of = {r.token: (r.a, r.b, r.a0, r.b0) for r in found}
    texts, size = of.pop("", (0, 0, 0, 0)), of.pop(" ", (0, 0, 0, 0))
    half = [build({t: x[2:] for t, x in of.items() if x[2] >= least}, texts[2:], size[3], z=z) for z in widths]
    points = rows.filter("half = 1").mapInArrow(streamed(lambda it: _point_batches(it, half)), "model long, x double, toxic long")
    points = points.groupBy("model", "x").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect()
    curves = [_logistic([(p.x, p.y, p.n) for p in points if p.model == i]) for i in range(len(widths))]
    best = min(range(len(widths)), key=lambda i: curves[i][2])
    model = build({t: x[:2] for t, x in of.items()}, texts[:2], size[1], z=widths[best])
    model.intercept, model.slope = curves[best][:2]
    return model


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Intercept, slope and loss of Newton steps for ``y of n`` at ``min(x, 20)`` with a
    light penalty on the slope."""
    if not points or not 0 < sum(p[1] for p in points) < sum(p[2] for p in points):
        return ToxicModel.intercept, ToxicModel.slope, 0.0
    x, y, n = np.array(points, float).T
    x = np.minimum(x, 20.0)
    w, design = np.array([0.0, 0.1]), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - n * p) - np.array([0.0, 0.01]) * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[1] = max(w[1], 1e-3)
    odds = np.clip(design @ w, -30, 30)
    return float(w[0]), float(w[1]), float((n * np.log1p(np.exp(odds)) - y * odds).sum())


THRESHOLD = 0.3


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_texts(documents, train(documents, labels))
    return scored.select(
        F.col("id").alias("doc_id"),
        (~training_row("id", 4)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def drop_toxic(df: DataFrame, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``; the model comes from
    ``documents``.  A null or empty text has the lowest score, equal rows share their
    fate, an empty table stays empty and columns of any name are passed on."""
    model = train(documents, labels)
    return filter_rows(df, "text", lambda batch: (x.column(1).to_numpy() < threshold for x in _score_batches([batch], model)))
