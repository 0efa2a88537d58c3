"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language has its own
piece probabilities, fitted by expectation-maximisation in which every
segmentation of a word counts with its posterior weight.  A text's probability
is the product over its words of the sum over all segmentations, which the
forward algorithm gives; pieces don't cross words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import filter_rows, materialize, ship, streamed, text_slices, training_row

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: At most so many characters of all words are segmented at once; a word of more than
#: LONG characters is segmented by itself.
ROOM, LONG = 1 << 18, 256


def public_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces made of letters from a SentencePiece model file."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(x for x in pieces if x.removeprefix(START).isalpha() or x == START)


def _shares(words: list[str]) -> list[slice]:
    """Runs of words, each of at most ``ROOM`` characters or one longer word."""
    ends = np.cumsum([len(w) + 1 for w in words])
    out, at = [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROOM, "right")))
        out.append(slice(at, to))
        at = to
    return out


@dataclass
class PieceModel:
    """Sorted piece hashes, and ``probs[piece, language]`` with the row of an
    unknown character last."""

    languages: list[str]
    keys: np.ndarray
    sizes: np.ndarray
    probs: np.ndarray

    @classmethod
    def blank(cls, pieces: list[str], languages: list[str]) -> PieceModel:
        keys = np.array([_hash_piece(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        assert len(np.unique(keys)) == len(keys), "two pieces share a hash"
        probs = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
        return cls(languages, keys, np.array([len(p) for p in pieces], np.int64)[order], probs)

    def filter(self) -> np.ndarray:
        """A table that tells most strings that are no pieces at a glance."""
        table = np.zeros(1 << 18, bool)
        table[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        return table

    def _matches(self, codes, starts, t: int, m: int, table, least=None):
        """For words 0..m that reach position t: (length, word indices, piece ids).
        ``least``, if given, is how many characters each has before its end."""
        h = np.zeros(m, np.uint64)
        power = np.uint64(1)
        for size in range(1, int(self.sizes.max(initial=1)) + 1):
            if least is None and size > t:
                break
            with np.errstate(over="ignore"):
                h = h + (codes[np.maximum(starts[:m] + (t - size), 0)] + np.uint64(1)) * power
                power = power * _BASE
                mixed = h * np.uint64(0xD6E8FEB86659FD93)
            at = np.flatnonzero(table[(mixed >> np.uint64(46)).astype(np.int64)] & (True if least is None else least >= size))
            ids = np.searchsorted(self.keys, mixed[at])
            ids[ids == len(self.keys)] = 0
            hit = self.keys[ids] == mixed[at] if len(self.keys) else np.zeros(0, bool)
            at, ids = at[hit], ids[hit]
            if size == 1:  # a character that is no piece
                rest = np.ones(m, bool)
                rest[at] = False
                lone = np.flatnonzero(rest)
                at, ids = np.r_[at, lone], np.r_[ids, np.full(len(lone), len(self.keys))]
            if len(at):
                yield size, at, ids

    def forward(self, words: list[str], counts: np.ndarray | None = None):
        """Log probability of every word by language, over all segmentations; with
        ``counts`` (word by language) also the expected piece counts.

        Words go through all positions together.  Every few positions the sums of the
        words that go on are divided by the last one, whose log is kept, so that no
        word is too long; without counts only as many positions as the longest piece
        has are held."""
        words = [START + w for w in words]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = (np.cumsum(lens) - lens)[order]
        lens = lens[order]
        reach = len(lens) - np.searchsorted(lens[::-1], np.arange(1, int(lens.max(initial=0)) + 1))  # words of that length at least
        table, width, span = self.filter(), len(self.languages), int(self.sizes.max(initial=1))
        alpha, base = {0: np.ones((len(words), width))}, np.zeros((len(words), width))
        steps, logs_at = [], [base.copy()]
        out = np.zeros((len(words), width))
        for t, m in enumerate(reach.tolist(), 1):
            now = np.zeros((m, width))
            found = list(self._matches(codes, starts, t, m, table))
            for size, at, ids in found:
                now[at] += self.probs[ids] * alpha[t - size][at]
            after = int(reach[t]) if t < len(reach) else 0
            out[after:m] = base[after:m] + np.log(now[after:])
            if counts is not None:
                steps.append(found)
                logs_at.append(base[:m] + np.log(now))
            alpha[t] = now
            alpha.pop(t - span, None)
            if t % 8 == 0 and after:
                base[:after] += np.log(now[:after])
                alpha = {u: x[:after] / now[:after] for u, x in alpha.items()}
        logs = np.empty_like(out)
        logs[order] = out
        if counts is None:
            return logs
        expected = np.zeros_like(self.probs)
        # The part of a word's probability, times its count, that goes through a position.
        through = [np.zeros((len(x), width)) for x in logs_at]
        weight = counts[order]
        for t in range(len(steps), 0, -1):
            after = int(reach[t]) if t < len(reach) else 0
            through[t][after:] += weight[after : reach[t - 1]]
            for size, at, ids in steps[t - 1]:
                arc = self.probs[ids] * np.exp(logs_at[t - size][at] - logs_at[t][at]) * through[t][at]
                through[t - size][at] += arc
                for g in range(width):
                    expected[:, g] += np.bincount(ids, arc[:, g], len(self.probs))
        return logs, expected

    def alone(self, word: str) -> np.ndarray:
        """As :meth:`forward` for one long word: pieces are looked up at all its positions
        at once, and only the sums go from one position to the next."""
        codes = np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total, span, table = len(codes), int(self.sizes.max(initial=1)), self.filter()
        out, alpha = np.zeros(len(self.languages)), np.ones((span, len(self.languages)))
        for first in range(0, total, ROOM):
            ends = np.arange(first + 1, min(total, first + ROOM) + 1)
            arcs = [(size, ends[i], ids) for at in (ends,) for size, i, ids in self._matches(codes, at, 0, len(at), table, least=at)]
            sizes = np.concatenate([np.full(len(e), size) for size, e, _ in arcs])
            places, ids = np.concatenate([e for _, e, _ in arcs]), np.concatenate([x for _, _, x in arcs])
            order = np.argsort(places, kind="stable")
            sizes, ids, cuts = sizes[order], ids[order], np.searchsorted(places[order], np.r_[ends, total + 1])
            for t, a, b in zip(ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = (self.probs[ids[a:b]] * alpha[(t - sizes[a:b]) % span]).sum(0)
                alpha[t % span] = now
                if t % 8 == 0:
                    out += np.log(now)
                    alpha /= now
        return out + np.log(alpha[total % span])

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of every word by language, over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
        short = np.flatnonzero(~long)
        usual = [words[i] for i in short]
        for x in _shares(usual):
            out[short[x]] = self.forward(usual[x])
        for i in np.flatnonzero(long):
            out[i] = self.alone(words[i])
        return out


def _hash_piece(piece: str) -> int:
    h, power, mask = 0, 1, (1 << 64) - 1
    for c in reversed(piece):
        h = (h + (ord(c) + 1) * power) & mask
        power = (power * int(_BASE)) & mask
    return (h * 0xD6E8FEB86659FD93) & mask


def _training_words(texts: list[str], longest: int) -> list[str]:
    return [w[at : at + longest] for x in texts for w in LETTERS.findall(x.lower()) for at in range(0, len(w), longest)]


def fit(texts: dict[str, list[str]], pieces: list[str], rounds: int = 3, prior: float = 0.1, longest: int = 64) -> PieceModel:
    """Expectation-maximisation over the words of each language's texts.  Words of more
    than ``longest`` letters are learned in runs of so many; texts are scored without
    such cuts."""
    model = PieceModel.blank(pieces, sorted(texts))
    if not texts:
        return model
    tallies = [pd.Series(_training_words(texts[g], longest), dtype=object).value_counts() for g in model.languages]
    counts = pd.concat(tallies, axis=1).fillna(0.0)
    words = counts.index.tolist()
    if not words:
        return model
    counts = counts.to_numpy(float)
    for _ in range(rounds):
        expected = np.zeros_like(model.probs)
        for x in _shares(words):
            expected += model.forward(words[x], counts[x])[1]
        model.probs = (expected + prior) / (expected + prior).sum(0)
    return model


def sample_texts(df: DataFrame, text_col: str, lang_col: str, per_language: int, characters: int = 2_000_000, seed: int = 5) -> dict[str, list[str]]:
    """At most ``per_language`` different whole texts of each language, the first by a
    hash of the text, until they have ``characters``; the first one in any case.  It
    doesn't matter how often texts are repeated.

    Hashes are ranked apart from the texts, and only the texts that are picked reach
    the driver, one for each hash."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    distinct = materialize(rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("length")), "langid-hashes")
    # A share of the hashes with enough of them for every language; a row for each language,
    # broadcast if they are few, so that a language with most texts isn't gathered.
    share = F.when(F.col("n") <= 2 * per_language, F.lit(1 << 30)).otherwise(F.lit(1 << 30) * (2.0 * per_language + 100) / F.col("n"))
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("n")).withColumn("below", share)
    sizes = materialize(sizes, "langid-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    near = distinct.join(sizes, "lang").withColumn("place", F.pmod("h", F.lit(1 << 30))).filter(F.col("place") < F.col("below"))
    first = Window.partitionBy("lang").orderBy("place", "h")
    ranked = near.withColumn("rank", F.row_number().over(first)).withColumn("ahead", F.sum("length").over(first) - F.col("length"))
    picked = ranked.filter((F.col("rank") <= per_language) & ((F.col("rank") == 1) | (F.col("ahead") < characters))).select("lang", "h", "rank")
    picked = materialize(picked, "langid-picked")
    found = rows.join(picked, ["lang", "h"]).groupBy("lang", "h", "rank").agg(F.min("text").alias("text"))
    out: dict[str, list[tuple]] = {}
    for r in found.select("lang", "rank", "text").toLocalIterator():
        out.setdefault(r.lang, []).append((r.rank, r.text))
    return {g: [x[1] for x in sorted(v)] for g, v in sorted(out.items())}


def _predict_batches(batches, model: PieceModel):
    for batch in batches:
        for part, texts in text_slices(batch, 1):
            words, owner, letters = [], [], np.zeros(len(texts), bool)
            for i, data in enumerate(texts):
                text = data.decode("utf-8", "replace") if data else ""
                letters[i] = any(map(str.isalpha, text))
                if letters[i]:
                    found = LETTERS.findall(text.lower())
                    words += found
                    owner.append((i, len(found)))
            codes, unique = pd.factorize(np.array(words, object)) if words else (np.empty(0, np.int64), [])
            logs = model.words(list(unique))
            row = np.repeat([i for i, _ in owner], [n for _, n in owner]).astype(np.int64)
            total = np.zeros((len(texts), len(model.languages)))
            for g in range(len(model.languages)):
                total[:, g] = np.bincount(row, logs[codes, g], len(texts))
            known = letters & (len(model.languages) > 0)
            best = total.argmax(1) if len(model.languages) else np.zeros(len(texts), int)
            odds = np.exp(total - total.max(1, initial=-np.inf, keepdims=True)) if len(model.languages) else total
            score = np.where(known, 1.0 / np.maximum(odds.sum(1), 1.0), 0.0)
            lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])


def identify(df: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` (the posterior of that language, all
    being equally likely beforehand) for every row and whole text of ``df``.

    A null text and one without any letter give ``und`` with score 0.  Repeated
    rows come out as often as they occur; an equal score goes to the language
    first in code point order; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(streamed(lambda it: _predict_batches(it, model)), schema)


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, vocabulary: str | None = None
) -> PieceModel:
    """Fits a model on rows whose id isn't held out and whose language is known, on a
    sample of at most ``per_language`` different texts of each language.  Every
    language of such a row is learned; without any the model has none."""
    texts = sample_texts(df.filter(training_row(id_col, 4)), text_col, lang_col, per_language)
    return fit(texts, public_pieces(vocabulary))


def langid_query(documents: DataFrame) -> DataFrame:
    found = identify(documents, train(documents))
    return found.select(F.col("id").alias("doc_id"), (~training_row("id", 4)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is told with a posterior of ``least`` or more.
    A null text and one without letters go; equal rows share their fate, an empty table
    stays empty and columns of any name are passed on."""
    model = train(df)
    return filter_rows(df, "text", lambda batch: (x.column(2).to_numpy() >= least for x in _predict_batches([batch], model)))
