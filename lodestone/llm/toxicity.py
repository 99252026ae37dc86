"""Toxic spans by a linear-chain conditional random field.

Two states, plain and toxic. The features of a token are its word and the word's beginnings of
PREFIXES bytes; the one that tells toxic documents best, if any does, stands for the token. A
token is labelled toxic for training if it stands in a toxic document and has such a feature.
The field has a weight for each feature, one for being toxic at all, and one for each transition.

Forward-backward gives each token's marginal. Between two words that have a weight all tokens
are alike, so their part of the recursion is a power of one 2 x 2 matrix; the result is that of
the recursion over every token. A logistic function, fitted on the same labelled documents,
turns the marginals of a document into its score. Spans are the tokens whose marginal is 0.5 or more.

What is fitted on a sample: words, field and score, on MAX_TRAIN labelled documents at most
(in expectation; chosen by a hash of the id). All documents are scored, over their whole text.

Defined cases: a null or empty text has no tokens and gets the score of a document without
toxic words. Without labels of both kinds the model is empty and every score 0. Rows of
``labels`` with nulls are left out; of several labels of a document the highest counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.boosting import logistic
from lodestone.llm.common import arrow_rows, column, raw_texts

MAX_TRAIN = 20_000
MAX_WORDS = 400
MIN_DOCS = 4
MIN_SURPRISE = 25.0  # twice the log-likelihood ratio
MIN_LOG_ODDS = 1.5
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5
PREFIXES = (7, 6, 5, 4)
KEPT_WORDS = 150_000
LOOK = 24  # tokens of a training window at most
#: Everything in ASCII that isn't a letter separates words.
SEPARATORS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().translate(SEPARATORS).split() if raw else []


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a star, longest first."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


class Marks(dict):
    """word -> its best feature's value, or None; remembers a bounded number of words. ranked lists (feature, value), best first."""

    def __init__(self, ranked: list[tuple]) -> None:
        super().__init__()
        self.best = {f: (i, v) for i, (f, v) in enumerate(ranked)}

    def __missing__(self, word: bytes):
        found = min((self.best[f] for f in features_of(word) if f in self.best), default=(0, None))[1]
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


@dataclass
class Model:
    """Field and score. Exponentials are of natural weights; words maps a feature to its weight, best features first."""

    words: dict[bytes, float] = field(default_factory=dict)
    toxic: float = -6.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    score: tuple[float, ...] = ()

    def prepare(self) -> None:
        import numpy as np

        self.marks = Marks(list(self.words.items()))
        self.a = np.exp(np.array(self.trans).reshape(2, 2))
        self.m = self.a * np.array([1.0, math.exp(self.toxic)])
        values, vectors = np.linalg.eig(self.m)
        first = int(np.argmax(values.real))
        self.ratio = float(values.real[1 - first] / values.real[first])
        v, inverse = vectors.real, np.linalg.inv(vectors.real)
        self.main = np.outer(v[:, first], inverse[first])
        self.rest = np.outer(v[:, 1 - first], inverse[1 - first])

    def run(self, n: int):
        """The matrix of n plain tokens, up to a factor."""
        return self.main + self.rest * self.ratio**n

    def marginals(self, n: int, at: list[int], weights: list[float]) -> list[float]:
        """P(toxic) of the tokens at these places among n, all others having no weight."""
        import numpy as np

        e = [np.array([1.0, math.exp(self.toxic + w)]) for w in weights]
        alpha, alphas, before = None, [], -1
        for p, x in zip(at, e, strict=True):
            if alpha is None:
                alpha = x if p == 0 else np.array([1.0, math.exp(self.toxic)]) @ self.run(p - 1) @ self.a * x
            else:
                alpha = alpha @ self.run(p - before - 1) @ self.a * x
            alpha = alpha / alpha.sum()
            alphas.append(alpha)
            before = p
        beta, out = self.run(n - 1 - at[-1]) @ np.ones(2), [0.0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            both = alphas[i] * beta
            out[i] = float(both[1] / both.sum())
            if i:
                beta = self.run(at[i] - at[i - 1] - 1) @ (self.a @ (e[i] * beta))
                beta = beta / beta.sum()
        return out

    def document(self, raw: bytes | None) -> tuple[float, list[tuple[int, float]]]:
        """Score, and (token, marginal) of the tokens that have a weight."""
        if not self.score:
            return 0.0, []
        weights = list(map(self.marks.__getitem__, words_of(raw)))
        at = [i for i, w in enumerate(weights) if w is not None]
        p = self.marginals(len(weights), at, [weights[i] for i in at]) if at else []
        return sigmoid(sum(a * b for a, b in zip(self.score, summary(p), strict=True))), list(zip(at, p, strict=True))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def summary(p: list[float]) -> tuple[float, ...]:
    """What the score knows of a document: the greatest marginal, their sum, and whether any word had a weight."""
    return (1.0, max(p, default=0.0), math.log1p(sum(p)), float(bool(p)))


def for_training(doc_id: Column) -> Column:
    """False for the rows that are held out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic) of about ``most`` labelled documents that aren't held out; of equal texts one. The labels chosen are bounded, so they are broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & for_training(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, most / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(part * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("_text")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("_text")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, plain): labelled documents of each kind that have the feature; counted in each batch before they are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            toxic, plain = Counter(), Counter()
            for raw, y in zip(raw_texts(b), column(b, "toxic"), strict=True):
                (toxic if y else plain).update({f for w in set(words_of(raw)) for f in features_of(w)})
            words = sorted(toxic.keys() | plain.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([plain[w] for w in words], pa.int64())], names=["word", "toxic", "plain"])

    return rows.select("text", "toxic").mapInArrow(run, "word binary, toxic long, plain long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def surprise(toxic, plain, n_toxic, n_plain, log):
    """Twice the log-likelihood ratio of a word's share among toxic and plain documents, against one share. For numbers or Columns."""

    def likelihood(k, n, q):
        return k * log(q + 1e-12) + (n - k) * log(1 - q + 1e-12)

    q = (toxic + plain) / (n_toxic + n_plain)
    return 2 * (likelihood(toxic, n_toxic, toxic / n_toxic) + likelihood(plain, n_plain, plain / n_plain) - likelihood(toxic, n_toxic, q) - likelihood(plain, n_plain, q))


def log_odds(toxic, plain, n_toxic, n_plain, log):
    return log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - log((plain + 0.5) / (n_plain - plain + 0.5))


def marked_words(rows: DataFrame, n_toxic: int, n_plain: int) -> list[bytes]:
    """The features that tell toxic documents best, best first: MAX_WORDS at most. Of equal ones the longer beginning, then the word."""
    args = (F.col("toxic"), F.col("plain"), n_toxic, n_plain, F.log)
    counts = word_counts(rows).where(F.col("toxic") >= MIN_DOCS).withColumns({"surprise": surprise(*args), "odds": log_odds(*args)})
    found = counts.where((F.col("surprise") >= MIN_SURPRISE) & (F.col("odds") >= MIN_LOG_ODDS)).orderBy(F.desc("surprise"), F.desc(F.octet_length("word")), "word").limit(MAX_WORDS)
    return [bytes(r["word"]) for r in found.select("word").collect()]


def needed_words(found: list[tuple], n_words: int) -> list[int]:
    """Of the marked words those that tell toxic documents by their own surroundings.

    A word's support is the number of toxic documents in which at least half of its occurrences
    have neighbours (the words before and behind) that no document before had. A word that is
    frequent in toxic documents only because one of them has many near copies has the same
    neighbours in all of them.
    """
    around: dict[int, set] = {}
    support, plain = Counter(), Counter()
    for toxic, _, _, which, beside in found:
        here: dict[int, list] = {}
        for k, x in zip(which, beside, strict=True):
            here.setdefault(k, []).append(x)
        for k, xs in here.items():
            if not toxic:
                plain[k] += 1
                continue
            seen = around.setdefault(k, set())
            support[k] += 2 * sum(x not in seen for x in xs) >= len(xs)
            seen.update(xs)
    total = Counter(bool(f[0]) for f in found)
    out = []
    for k in range(n_words):
        t = support[k]
        args = (t, plain[k], total[True], total[False], math.log)
        if t >= MIN_DOCS and log_odds(*args) >= MIN_LOG_ODDS and surprise(*args) >= MIN_SURPRISE:
            out.append(k)
    return out


def only(found: list[tuple], words: list[int]) -> list[tuple]:
    """The same documents with these words only, numbered anew."""
    number = {k: i for i, k in enumerate(words)}
    out = []
    for toxic, n, at, which, _ in found:
        kept = [(p, number[k]) for p, k in zip(at, which, strict=True) if k in number]
        out.append((toxic, n, [p for p, _ in kept], [k for _, k in kept]))
    return out


def places(rows: DataFrame, words: list[bytes]) -> list[tuple]:
    """(toxic, tokens, places, words, neighbours) of each sampled document; words by number. Their number is bounded by the sample's."""
    ranked = [(w, i) for i, w in enumerate(words)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = Marks(ranked)
        for b in batches:
            out = []
            for d, raw, y in zip(column(b, "doc_id"), raw_texts(b), column(b, "toxic"), strict=True):
                tokens = words_of(raw)
                which = list(map(number.__getitem__, tokens))
                at = [i for i, k in enumerate(which) if k is not None]
                beside = [zlib.crc32(b" ".join(tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2])) for i in at]
                out.append((d, y, len(tokens), at, [which[i] for i in at], beside))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "toxic", "n", "at", "which", "beside"])

    made = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, n long, at array<long>, which array<long>, beside array<long>")
    return [tuple(r)[1:] for r in sorted(made.collect(), key=lambda r: (r["doc_id"], r["n"]))]


def windows(found: list[tuple], look: int = LOOK):
    """Training sequences: runs of marked words at most two tokens apart, with a plain token at each end. (features, labels, lengths); -1 has no weight."""
    import numpy as np

    seqs = []
    for toxic, n, at, which in found:
        i = 0
        if not at and n:
            seqs.append(([-1] * min(n, 4), [0] * min(n, 4)))
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= 3 and at[j + 1] - at[i] < look - 2:
                j += 1
            lo, hi = max(0, at[i] - 1), min(n, at[j] + 2)
            f, y = [-1] * (hi - lo), [0] * (hi - lo)
            for k in range(i, j + 1):
                f[at[k] - lo], y[at[k] - lo] = which[k], int(bool(toxic))
            seqs.append((f, y))
            i = j + 1
    f, y = np.full((len(seqs), look), -1), np.zeros((len(seqs), look), int)
    for k, (a, b) in enumerate(seqs):
        f[k, : len(a)], y[k, : len(b)] = a, b
    return f, y, np.array([len(a) for a, _ in seqs])


def fit_field(found: list[tuple], n_words: int, steps: int = 150, rate: float = 0.2, ridge: float = 0.5):
    """Weights that maximise the conditional likelihood of the labels, less a ridge. Returns (words, toxic, transitions)."""
    import numpy as np

    f, y, n = windows(found)
    length = int(n.max())
    f, y, real = f[:, :length], y[:, :length], np.arange(length) < n[:, None]
    w = np.zeros(n_words + 6)  # words, a word without weight (stays 0), toxic, transitions
    w[n_words + 1] = -3.0
    rows = np.arange(len(n))
    step, m, v = real[:, 1:], np.zeros_like(w), np.zeros_like(w)

    def counts(pt, pp):
        g = np.zeros_like(w)
        np.add.at(g, np.where(f >= 0, f, n_words).ravel(), (pt * real).ravel())
        g[n_words], g[n_words + 1] = 0, (pt * real).sum()
        g[n_words + 2 :] = (pp * step[..., None, None]).sum((0, 1)).ravel() if length > 1 else 0
        return g

    pairs = np.zeros((len(n), max(0, length - 1), 2, 2))
    for a in range(2):
        for b in range(2):
            pairs[..., a, b] = (y[:, :-1] == a) & (y[:, 1:] == b)
    seen = counts(y.astype(float), pairs)
    for t in range(1, steps + 1):
        e = np.stack([np.ones_like(f, float), np.exp(w[n_words + 1] + w[np.where(f >= 0, f, n_words)])], -1)
        a = np.exp(w[n_words + 2 :].reshape(2, 2))
        alpha, beta = np.zeros((len(n), length, 2)), np.ones((len(n), length, 2))
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, length):
            x = alpha[:, i - 1] @ a * e[:, i]
            alpha[:, i] = x / x.sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            x = (e[:, i + 1] * beta[:, i + 1]) @ a.T
            x = np.where(real[:, i + 1, None], x, 1.0)
            beta[:, i] = x / x.sum(1, keepdims=True)
        both = alpha * beta
        p = both[..., 1] / both.sum(-1)
        pp = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pp /= pp.sum((2, 3), keepdims=True)
        g = (seen - counts(p, pp) - ridge * w) / len(rows)
        g[n_words + 2] = 0  # plain to plain is the origin
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[n_words + 2] = 0
    return w[:n_words], float(w[n_words + 1]), tuple(float(x) for x in w[n_words + 2 :])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """The model of the labelled documents that aren't held out."""
    import numpy as np

    arrow_rows(docs.sparkSession)
    rows = labelled(docs, labels, most)
    kinds = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") != 0).count().collect()}
    if len(kinds) < 2:
        return Model()
    words = marked_words(rows, kinds[True], kinds[False])
    found = places(rows, words)
    needed = needed_words(found, len(words))
    found, words, model = only(found, needed), [words[k] for k in needed], Model()
    if words:
        weights, model.toxic, model.trans = fit_field(found, len(words))
        model.words = dict(zip(words, map(float, weights), strict=True))
    else:
        weights = []
    model.prepare()
    marks = [model.marginals(n, at, [float(weights[k]) for k in which]) if at else [] for _, n, at, which in found]
    model.score = tuple(map(float, logistic(np.array([summary(p) for p in marks]), np.array([bool(f[0]) for f in found], float))))
    return model


def span_text(raw: bytes, tokens: set[int]) -> str:
    """start:end of these tokens in code points, comma-joined."""
    out, at, chars = [], 0, 0
    for i, x in enumerate(WORD.finditer(raw.lower())):
        if i in tokens:
            chars += len(raw[at : x.start()].decode("utf-8"))
            end = chars + len(raw[x.start() : x.end()].decode("utf-8"))
            out.append(f"{chars}:{end}")
            at, chars = x.end(), end
    return ",".join(out)


def with_score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df plus (score, n_toxic_tokens, toxic_spans). No shuffle; the model is bounded by MAX_WORDS."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if model.score:
            model.prepare()
        for b in batches:
            scores, n, spans = [], [], []
            for raw in raw_texts(b, text):
                s, marks = model.document(raw)
                tokens = {i for i, p in marks if p >= SPAN_MARGINAL}
                scores.append(s)
                n.append(len(tokens))
                spans.append(span_text(raw, tokens) if tokens else "")
            made = [pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "score", "n_toxic_tokens", "toxic_spans"])

    arrow_rows(df.sparkSession)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, score double, n_toxic_tokens long, toxic_spans string")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_toxic_tokens, toxic_spans) of every document."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def op10_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    """Score and toxic spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", (~for_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_tokens", "toxic_spans")
