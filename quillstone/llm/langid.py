"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded and convolved by filters of several widths; each filter's largest response
over a window is kept, and a softmax layer turns these into language probabilities. Training
takes a bounded sample of labelled rows: about ``SAMPLE`` different texts of each language, drawn
by a hash of the text, and of each ``PIECES`` windows from anywhere in it. To predict, a text is
cut into windows of ``WINDOW`` bytes that cover all of it; its prediction comes from the mean of
its windows' log probabilities, weighted by their length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import cut_lineage

#: Labelled texts of each language that the network is fitted on, and windows taken of each.
SAMPLE = 1000
PIECES = 2
#: A label column with more values than this holds no languages; training refuses it.
MOST_LABELS = 10_000
WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
EPOCHS = 10
LEAST_STEPS = 800
UNDETERMINED = "und"


class ByteCnn:
    """Embedding, convolutions, max pooling and softmax over fixed-length byte windows."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32)
        self.embed[256] = 0
        self.kernels = [rng.normal(0, 1 / np.sqrt(w * DEPTH), (w * DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = np.zeros((len(WIDTHS) * FILTERS, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses, at least 0, of windows (n, WINDOW) of byte values; 256 fills up."""
        x = self.embed[windows]
        n, length, _ = x.shape
        pooled, places = [], []
        for w, kernel in zip(WIDTHS, self.kernels):
            seen = np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * DEPTH), x.strides)
            out = seen.reshape(-1, w * DEPTH) @ kernel
            out = out.reshape(n, length - w + 1, FILTERS)
            at = out.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(pooled, axis=1), places

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """As features, without the places; for prediction."""
        x = self.embed[windows]
        n, length, _ = x.shape
        out = []
        for w, kernel in zip(WIDTHS, self.kernels):
            seen = np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * DEPTH), x.strides)
            out.append((seen.reshape(-1, w * DEPTH) @ kernel).reshape(n, length - w + 1, FILTERS).max(axis=1))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = np.tanh(self.pooled(windows)) @ self.dense + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        """Adam on the cross entropy, in batches of 64."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.kernels, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weights = (len(labels) / (len(self.languages) * np.maximum(1, np.bincount(labels, minlength=len(self.languages))))).astype(np.float32)
        step = 0
        epochs = max(epochs, -(-LEAST_STEPS * 64 // len(labels)))  # small samples are seen more often
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 64):
                pick = order[at : at + 64]
                grads = self._gradients(windows[pick], labels[pick], weights)
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.embed[256] = 0

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        pooled, places = self.features(windows)
        hidden = np.tanh(pooled)
        scores = hidden @ self.dense + self.bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        delta = scores / scores.sum(axis=1, keepdims=True)
        delta[np.arange(len(labels)), labels] -= 1
        delta *= (weights[labels] / len(labels))[:, None]
        dense, bias = hidden.T @ delta, delta.sum(axis=0)
        back = (delta @ self.dense.T) * (1 - hidden**2)
        embed, kernels = np.zeros_like(self.embed), []
        rows = np.arange(len(labels))[:, None]
        for k, (w, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            part, at = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
            codes = np.stack([windows[rows, at + i] for i in range(w)], axis=2)  # n, filters, w
            seen = self.embed[codes].reshape(len(labels), FILTERS, w * DEPTH)
            kernels.append(np.einsum("nfd,nf->df", seen, part))
            spread = (part[:, :, None] * kernel.T[None]).reshape(-1, DEPTH)
            np.add.at(embed, codes.reshape(-1), spread)
        return [embed, *kernels, dense, bias]


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """Windows that cover the whole text; the last is filled up with 256."""
    count = max(1, -(-len(text) // size))
    out = np.full(count * size, 256, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(count, size)


def train(labelled: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE, pieces: int = PIECES) -> ByteCnn | None:
    """A network fitted on a bounded sample of ``labelled``; None where it has no usable row.

    All rows are counted by language. Texts are drawn by the hash of the text, in the share that
    gives about ``sample`` of each language, and equal draws are one; ``pieces`` windows of each,
    at places drawn by the same hash, are learned. Null texts, texts without letters and rows
    without a label are left out. Repeated rows change the shares only, ties of the hash and
    very long texts nothing. Every label that occurs is learned; over ``MOST_LABELS`` raise.
    """
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = cut_lineage(usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")))
    languages = counts.count()
    if not languages:
        return None
    if languages > MOST_LABELS:
        raise ValueError(f"{languages} labels; at most {MOST_LABELS} are taken for languages")
    draw = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 30))
    drawn = usable.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"))
    drawn = drawn.join(F.broadcast(counts), "lang").filter(F.col("draw") * F.col("n") < F.lit(sample * (1 << 30)))
    raw = F.encode("text", "utf-8")
    place = lambda k: F.pmod(F.xxhash64("draw", F.lit(k)), F.greatest(F.lit(1), F.length(raw) - WINDOW + 1)).cast("int")
    cuts = F.array(*[F.substring(raw, place(k) + 1, F.lit(WINDOW)) for k in range(pieces)])
    picked = drawn.select("lang", "draw", F.array_distinct(cuts).alias("cuts")).groupBy("lang", "draw").agg(F.min("cuts").alias("cuts"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["draw"], r["lang"], bytes(cut)) for b in batches for r in b.to_pylist() for cut in r["cuts"])
        known = sorted({lang for _, lang, _ in rows})
        windows = np.concatenate([windows_of(cut) for *_, cut in rows])
        model = ByteCnn(known)
        model.fit(windows, np.array([known.index(lang) for _, lang, _ in rows]))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    # the sample is bounded, so one task takes it; a task has one numpy thread, the driver many
    return pickle.loads(picked.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


#: Windows that are convolved at once, and texts that are cut into windows at once.
STEP = 64
STEP_TEXTS = 256


def _predict(model: ByteCnn | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for group in _groups(todo, texts):
        parts = [windows_of(texts[i].encode()) for i in group]
        windows = np.concatenate(parts)
        found = np.concatenate([model.log_probabilities(windows[a : a + STEP]) for a in range(0, len(windows), STEP)])
        found *= (windows < 256).sum(axis=1, keepdims=True)
        ends = np.cumsum([len(p) for p in parts])
        for i, a, b in zip(group, [0, *ends[:-1]], ends):
            total = found[a:b].sum(axis=0) / len(texts[i].encode())
            best = int(total.argmax())
            odds = np.exp(total - total[best])
            lang[i], score[i] = model.languages[best], float(odds[best] / odds.sum())
    return lang, score


def _groups(todo: list[int], texts: list[str | None], most: int = 1 << 20):
    part, size = [], 0
    for i in todo:
        part.append(i)
        size += len(texts[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def predict(text: Column, model: ByteCnn | None) -> Column:
    """struct<lang, score> of the whole text; ``und`` and 0 for null texts and those without letters.

    The network sees nothing but the text, so repeated rows have equal predictions; of languages
    of equal score the first by name is taken. An empty table gives none, and without a model
    all are ``und``. The network's size depends on the number of languages alone, so it travels
    with the function.
    """

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(texts: pa.Array) -> pa.Array:
        lang, score = [], []
        for at in range(0, len(texts), STEP_TEXTS):
            some = _predict(model, texts.slice(at, STEP_TEXTS).to_pylist())
            lang += some[0]
            score += some[1]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predicted(text)
