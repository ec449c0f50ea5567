"""Language identification by a byte-level convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes that cover them whole. A window goes through filters of several widths over
bytes (their first layer is a one-hot embedding, so a filter is a table of weights by byte and place), a rectifier, a
maximum over places and a softmax. A document's languages are scored by the sum of its windows' log-probabilities,
weighted by their length; the score is the softmax of the mean.

The network is fitted on the driver on a sample of labelled rows: about ``per_language`` distinct rows (in SHARES equal
parts) of each language, those with the smallest hashes of key and text, and ``windows_each`` windows of each. Every label is learned; where
there are so many that these were more than ``most`` rows, fewer of each are drawn, but one at least. Prediction is one narrow pass over whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null label are not learned
from; with no labelled row everything is ``und``; columns with the outputs' names give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, filled, lean, tidied

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
UNKNOWN = "und"
SHARES = 50


@dataclass
class Network:
    """tables[i][j]: weights of width i's filters at place j, by byte; then the biases and the last layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of windows (n x WINDOW bytes): the maxima of all filters, and where each has its own."""
        found, places = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            y = table[0][x[:, :n]]
            for j in range(1, w):
                y += table[j][x[:, j : j + n]]
            places.append(y.argmax(1))
            found.append(np.maximum(np.take_along_axis(y, places[-1][:, None], 1)[:, 0] + bias, 0))
        return np.concatenate(found, 1), places

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        found = []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = x.shape[1] - w + 1
            y = table[0][x[:, :n]]
            for j in range(1, w):
                y += table[j][x[:, j : j + n]]
            found.append(np.maximum(y.max(1) + bias, 0))
        z = np.concatenate(found, 1) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a block of documents, the document of each and its number of bytes; short ones end with zeros."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + nth * WINDOW
    held = np.minimum(offsets[1:][owner] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    x = np.concatenate([data, np.zeros(WINDOW, np.uint8)])[np.minimum(at, len(data))]
    x[np.arange(WINDOW) >= held[:, None]] = 0
    return x, owner, held


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on windows x and language numbers y."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, (f, k)).astype(np.float32), np.zeros(k, np.float32))
    parts = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            xb, yb = x[own], y[own]
            h, places = net.features(xb)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), yb] -= 1
            p /= len(own)
            back = (p @ net.out.T) * (h > 0)
            tables = []
            for i, (w, table) in enumerate(zip(WIDTHS, net.tables, strict=True)):
                g, own_back = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, places[i] + j, 1), np.arange(FILTERS)[None]), own_back)
                tables.append(g)
            step += 1
            grads = [*tables, *(back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))), h.T @ p, p.sum(0)]
            for part, g, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, most: int = 30_000, windows_each: int = 8) -> Network | None:
    """Fit on labelled rows (see above for the bounds). Only hashes and labels are ranked; only the sample's texts come to the driver."""
    from pyspark.sql import Window

    named = labelled.select(F.col(lang).alias("_l"), F.xxhash64(key, text).alias("_h"), F.col(text).alias("_t")).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = sorted(r[0] for r in named.select("_l").distinct().collect())
    if not known:
        return None
    each = max(1, min(per_language, most // len(known)))
    # a language is ranked in parts by hash, so that a common one does not meet in one task; copies of a row count once
    parts = min(SHARES, each)
    place = F.row_number().over(Window.partitionBy("_l", "_s").orderBy("_h"))
    ids = named.select("_l", "_h").distinct().withColumn("_s", F.pmod(F.xxhash64(F.lit(1), "_h"), F.lit(parts)))
    chosen = ids.withColumn("_n", place).where(F.col("_n") <= -(-each // parts)).select("_l", "_h")
    size = WINDOW * 4  # characters of a slice, so that each holds some windows
    spread = F.transform(F.sequence(F.lit(0), F.lit(windows_each - 1)), lambda i: F.substring("_t", (F.greatest(F.length("_t") - size, F.lit(0)) * i / windows_each).cast("int") + 1, F.lit(WINDOW)))
    rows = named.join(F.broadcast(chosen), ["_l", "_h"]).select("_l", "_h", F.array_distinct(spread).alias("slices")).dropDuplicates(["_l", "_h"]).collect()
    pairs = sorted((r["_h"], known.index(r["_l"]), s) for r in rows for s in r["slices"] if s)
    raw = [s.encode()[:WINDOW] for _, _, s in pairs]
    if not raw:
        return None
    x = np.zeros((len(raw), WINDOW), np.uint8)
    for i, b in enumerate(raw):
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    return train(x, np.array([n for _, n, _ in pairs]), known)


def predict(df: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to each row. The network (under 100 kB) travels with the function."""
    lean(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(text))
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            offsets, data = buffers(texts)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for a, b in blocks(texts, 1 << 19) if net else ():
                total = np.zeros((b - a, len(net.languages)))
                weight = np.zeros(b - a)
                x, owner, held = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for at in range(0, len(x), 256):
                    own = slice(at, at + 256)
                    np.add.at(total, owner[own], net.log_probabilities(x[own]) * held[own, None])
                    np.add.at(weight, owner[own], held[own])
                total /= np.maximum(weight, 1)[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[a:b], score[a:b] = p.argmax(1), p.max(1)
            known = (best >= 0) & lettered
            names = [net.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)] if net else [UNKNOWN] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
