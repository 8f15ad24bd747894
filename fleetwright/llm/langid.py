"""Language identification by a byte convolutional network.

Filters of several widths slide over embedded bytes, each filter's greatest response goes into a
softmax. The network is trained in numpy on a bounded sample of labelled rows and applied to all
fixed-length windows of every whole text, in batches; a text's scores are the means over its
windows, weighted by their bytes. Only text decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import free_names

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
BYTE_DIM = 8
BATCH = 128
# Labelled rows per language that are trained on, at most, and windows of each.
SAMPLE_ROWS = 500
SAMPLE_WINDOWS = 4
# Bounds of the network and of its training set: the most frequent labels are learned, and with
# many of them each has fewer rows.
MAX_LANGUAGES = 500
MAX_WINDOWS = 200_000
_WIDE = max(WIDTHS)
# A-Z count as a-z, all digits as one; 0 pads.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = FOLD[97:123]
FOLD[48:58] = 48


@dataclass(frozen=True)
class Network:
    """Weights; `filters` is (widest * BYTE_DIM, filters), zero beyond a filter's own width."""

    languages: tuple[str, ...]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _patches(net_bytes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW, widest * BYTE_DIM): the embedded bytes below the filters at each place."""
    padded = np.zeros((len(windows), WINDOW + _WIDE - 1), dtype=np.uint8)
    padded[:, :WINDOW] = windows
    x = np.ascontiguousarray(net_bytes[padded])
    step, row = x.strides[1], x.strides[0]
    return as_strided(x, (len(windows), WINDOW, _WIDE * BYTE_DIM), (row, step, x.itemsize))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows, languages) for windows of bytes, folded already."""
    out = np.empty((len(windows), len(net.languages)), dtype=np.float32)
    for at in range(0, len(windows), BATCH):
        patches = _patches(net.bytes_, windows[at : at + BATCH])
        rows = patches.reshape(-1, patches.shape[2]) @ net.filters
        top = rows.reshape(len(patches), WINDOW, -1).max(axis=1)
        out[at : at + BATCH] = _softmax(np.maximum(top + net.bias, 0) @ net.out + net.out_bias)
    return out


def train(
    windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], *, epochs: int = 5, seed: int = 7
) -> Network:
    """Adam on the cross-entropy of single windows. Repeatable for the same input."""
    rng = np.random.default_rng(seed)
    wide, n_filters = _WIDE * BYTE_DIM, FILTERS * len(WIDTHS)
    mask = np.zeros((wide, n_filters), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * BYTE_DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    w = {
        "bytes_": rng.normal(0, 0.5, (256, BYTE_DIM)),
        "filters": rng.normal(0, 0.3, (wide, n_filters)) * mask,
        "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.2, (n_filters, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["bytes_"][0] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = np.bincount(labels, minlength=len(languages)) / max(len(labels), 1)
    weight = (1 / np.maximum(share, 1e-9) / len(languages)).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, y = windows[pick], labels[pick]
            patches = _patches(w["bytes_"], x)
            rows = (patches.reshape(-1, wide) @ w["filters"]).reshape(len(x), WINDOW, -1)
            place = rows.argmax(axis=1)
            top = np.take_along_axis(rows, place[:, None, :], axis=1)[:, 0] + w["bias"]
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ w["out"] + w["out_bias"])
            p[np.arange(len(y)), y] -= 1
            dz = p * weight[y][:, None] / len(y)
            dh = (dz @ w["out"].T) * (top > 0)
            seen = patches[np.arange(len(x))[:, None], place]
            g = {
                "out": hidden.T @ dz,
                "out_bias": dz.sum(axis=0),
                "bias": dh.sum(axis=0),
                "filters": np.einsum("bf,bfi->if", dh, seen) * mask,
                "bytes_": np.zeros_like(w["bytes_"]),
            }
            back = (dh[:, :, None] * w["filters"].T[None]).reshape(len(x), n_filters, _WIDE, BYTE_DIM)
            padded = np.zeros((len(x), WINDOW + _WIDE), dtype=np.uint8)
            padded[:, :WINDOW] = x
            under = padded[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(_WIDE)]
            np.add.at(g["bytes_"], under, back)
            g["bytes_"][0] = 0
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k, v in w.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                v -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
    return Network(languages, **w)


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, folded; the text of each window and its number of bytes.

    Windows overlap by one byte less than the widest filter, so no run of bytes is missed.
    """
    step = WINDOW - _WIDE + 1
    data = [t.encode("utf-8", "replace") for t in texts]
    counts = [max(1, -(-(len(b) - _WIDE + 1) // step)) for b in data]
    windows = np.zeros((sum(counts), WINDOW), dtype=np.uint8)
    used = np.zeros(len(windows), dtype=np.int64)
    at = 0
    for b, n in zip(data, counts, strict=True):
        x = np.frombuffer(b, dtype=np.uint8)
        for i in range(n):
            part = x[i * step : i * step + WINDOW]
            windows[at, : len(part)] = part
            used[at] = len(part)
            at += 1
    return FOLD[windows], np.repeat(np.arange(len(texts)), counts), used


def _pieces(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in batches of about `most` characters; a longer text comes in several pieces."""
    batch, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), most):
            part = text[at : at + most]
            if size + len(part) > most and batch:
                yield batch, owners
                batch, owners, size = [], [], 0
            batch.append(part)
            owners.append(i)
            size += len(part)
    if batch:
        yield batch, owners


def classify(net: Network, texts: list[str]) -> np.ndarray:
    """(texts, languages): mean probabilities over all windows of each whole text."""
    total = np.zeros((len(texts), len(net.languages)))
    for batch, owners in _pieces(texts):
        windows, mine, used = cut(batch)
        np.add.at(total, np.asarray(owners)[mine], probabilities(net, windows) * np.maximum(used, 1)[:, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)


def fit(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Train on `sample_rows` rows of every language of `labelled` (doc_id, text, lang), or on all it has.

    Those with the smallest hashes of doc_id and text are taken; repeated rows count as one.
    Windows lie evenly over each text. Rows without label or text are not used; without any,
    there is no network (None). Of more than `MAX_LANGUAGES` labels the most frequent are learned,
    and `MAX_WINDOWS` bounds the training set as a whole.
    """
    usable = labelled.where("lang is not null and length(text) > 0")
    most = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)
    languages = tuple(sorted(r["lang"] for r in most.collect()))
    if not languages:
        return None
    rows = max(1, min(sample_rows, MAX_WINDOWS // (sample_windows * len(languages))))
    keyed = usable.where(F.col("lang").isin(*languages)).withColumn("key", F.xxhash64("doc_id", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    drawn = keyed.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= rows)
    place = (F.col("i") * F.greatest(F.length("text") - WINDOW, F.lit(0)) / max(sample_windows - 1, 1)).cast("int")
    found = (
        keyed.join(F.broadcast(drawn), ["lang", "key"])  # `rows` short rows for each language
        .select("lang", "key", "text", F.explode(F.sequence(F.lit(0), F.lit(sample_windows - 1))).alias("i"))
        .where("i = 0 or length(text) > 300")
        .select("lang", "key", "i", F.substring(F.col("text"), place + 1, F.lit(WINDOW)).alias("part"))
        .groupBy("lang", "key", "i")
        .agg(F.min("part").alias("part"))
        .orderBy("lang", "part")
        .collect()  # rows * sample_windows short strings for each language
    )
    known = {name: i for i, name in enumerate(languages)}
    parts = [r["part"] for r in found]
    labels = np.array([known[r["lang"]] for r in found], dtype=np.int64)
    rng = np.random.default_rng(11)  # a third of the windows are shortened, as short texts are
    parts = [p[: rng.integers(4, 80)] if rng.random() < 0.34 else p for p in parts]
    windows = np.zeros((len(parts), WINDOW), dtype=np.uint8)
    for i, part in enumerate(parts):
        b = np.frombuffer(part.encode("utf-8", "replace")[:WINDOW], dtype=np.uint8)
        windows[i, : len(b)] = b
    return train(FOLD[windows], labels, languages)


def least_score(net: Network | None) -> float:
    """Below this score a text is in none of the languages the network knows: no better than
    chance, give or take a quarter."""
    return 0.0 if net is None else min(0.5, 1.25 / len(net.languages))


def identify(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs` and lang_pred, score (0 to 1), or as `names` calls these two.

    Texts that are null or have no letter get `und` with score 0; so does everything if there
    was nothing to train on. Columns of `docs` with these names are replaced.
    """
    lang_pred, score = names
    rest = [c for c in docs.columns if c not in names]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, has_letters in texts:
            names = np.full(len(text), UNKNOWN, dtype=object)
            scores = np.zeros(len(text))
            live = np.flatnonzero(has_letters.to_numpy(dtype=bool))
            if net is not None and len(live):
                p = classify(net, text.iloc[live].tolist())
                best = p.argmax(axis=1)
                names[live] = np.array(net.languages, dtype=object)[best]
                scores[live] = p[np.arange(len(best)), best]
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    (both,) = free_names(docs, "_p")
    found = docs.select(*rest, predict("text", letters).alias(both))
    return found.select(*rest, F.col(both)["lang_pred"].alias(lang_pred), F.col(both)["score"].alias(score))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out())
