"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hashed_to

#: Bytes in a window, filters of each width, and the widths.
WINDOW, FILTERS, WIDTHS = 512, 12, (2, 3, 4)
#: The classifier is fitted on so many documents of a language, about, and on two windows of each.
SAMPLE_PER_LANGUAGE = 1000
UNKNOWN = "und"
#: Windows that go through the network together.
BATCH = 128
#: A-Z to a-z; a window shorter than WINDOW ends in zero bytes.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters as sums over byte pairs: what a pair gives at a position, and two bytes further on."""
        n = FILTERS * len(WIDTHS)
        first, second = np.zeros((65536, n), np.float32), np.zeros((65536, n), np.float32)
        a, b = np.divmod(np.arange(65536), 256)
        for i, w in enumerate(self.filters):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            first[:, own] = w[0][a] + w[1][b]
            if len(w) > 2:
                second[:, own] = w[2][a] + (w[3][b] if len(w) > 3 else 0)
        return first, second


def windows_of(text: bytes) -> np.ndarray:
    """All of the text in rows of WINDOW bytes, folded, the last padded with zeros."""
    data = FOLD[np.frombuffer(text, np.uint8)]
    rows = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), np.uint8)
    rows.reshape(-1)[: len(data)] = data
    return rows


def pooled(rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), first.shape[1]), np.float32)
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH].astype(np.int32)
        pairs = part[:, :-1] * 256 + part[:, 1:]
        here = first[pairs[:, :-2]]
        here += second[pairs[:, 2:]]
        out[at : at + BATCH] = here.max(axis=1)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[bytes, str]], epochs: int = 8, rate: float = 0.05, seed: int = 1) -> Network:
    """Fit on (window, language) pairs by mini-batch gradient descent with per-weight rates (Adagrad)."""
    rng = np.random.default_rng(seed)
    languages = sorted({s[1] for s in samples})
    n = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(n), rng.normal(0, 0.3, (n, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return net
    rows = np.concatenate([windows_of(s[0])[:1] for s in samples]).astype(np.int64)
    labels = np.array([languages.index(s[1]) for s in samples])
    squares: dict[int, np.ndarray] = {}

    def step(weights: np.ndarray, gradient: np.ndarray, name: int) -> None:
        s = squares.setdefault(name, np.full(weights.shape, 1e-6))
        s += gradient * gradient
        weights -= rate * gradient / np.sqrt(s)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, y = rows[own], labels[own]
            tops, places = [], []
            for w in net.filters:
                k = len(w)
                h = sum(w[j][x[:, j : x.shape[1] - k + 1 + j]] for j in range(k))
                place = h.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(h, place[:, None, :], 1)[:, 0, :])
            z = np.concatenate(tops, axis=1) + net.bias
            active = np.maximum(z, 0)
            d = softmax(active @ net.out + net.out_bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ net.out.T) * (z > 0)
            step(net.out, active.T @ d, 0)
            step(net.out_bias, d.sum(0), 1)
            step(net.bias, back.sum(0), 2)
            lane = np.arange(FILTERS)[None, :]
            for i, w in enumerate(net.filters):
                gradient = np.zeros_like(w)
                own_back = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(w)):
                    byte = np.take_along_axis(x, places[i] + j, 1)
                    np.add.at(gradient[j], (byte, np.broadcast_to(lane, byte.shape)), own_back)
                step(w, gradient, 3 + i)
    return net


def fit(docs: DataFrame, learn_from, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """A network fitted on a bounded sample of the labelled documents that satisfy `learn_from`: those of each
    language whose hashed id falls below a share that leaves about `per_language`; two windows of each, taken at
    hashed places. Only text and lang are learned from."""
    labelled = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    scale = 1 << 20
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(scale * min(1.0, per_language / n)))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < share[F.col("lang")])
    room = F.greatest(F.char_length("text") - WINDOW // 2, F.lit(1))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1 for i in range(2)]
    taken = chosen.select("doc_id", "lang", *(F.substring("text", p, F.lit(WINDOW)).alias(f"w{i}") for i, p in enumerate(places))).collect()
    taken.sort(key=lambda r: (r["doc_id"], r["lang"], r["w0"]))
    return train([(r[w].encode(), r["lang"]) for r in taken for w in ("w0", "w1")])


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per row of `docs`: doc_id, lang_pred and score, the mean probability over all windows of the whole text.

    A text that is null or has no letter gets `und` and 0, as do all texts without a network (no labels). Only
    the text is looked at. Rows that repeat get equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if network is None else network.tables()
        for batch in chunks(batches):
            predicted, scores = [], []
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            known = [i for i, t in enumerate(texts) if network is not None and has_letter(t)]
            best: dict[int, tuple[str, float]] = {}
            if known:
                rows = [windows_of(texts[i]) for i in known]
                z = np.maximum(pooled(np.concatenate(rows), *tables) + network.bias, 0)
                p = softmax(z @ network.out + network.out_bias)
                ends = np.cumsum([len(r) for r in rows])
                for i, r, end in zip(known, rows, ends.tolist()):
                    weights = np.full(len(r), WINDOW)
                    weights[-1] = len(texts[i]) - WINDOW * (len(r) - 1)
                    mean = weights @ p[end - len(r) : end] / weights.sum()
                    top = int(mean.argmax())
                    best[i] = network.languages[top], min(1.0, float(mean[top]))
            for i in range(len(texts)):
                lang, score = best.get(i, (UNKNOWN, 0.0))
                predicted.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on the documents outside the held-out fold and identify all. A null doc_id is never learned from and
    counts as held out."""
    out = F.coalesce(hashed_to(F.col("doc_id"), folds) == held, F.lit(True))
    network = fit(docs, ~out)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(plain, network)
