"""Quality of whole texts by a generalised additive model with pairwise interactions.

Features are counted on the bytes of a text. Cyclic boosting visits feature
after feature, each time adding a shallow tree (at most four leaves) over that
feature's bins to its lookup table; then the pairs that would lower the loss
most get tables of two features each, boosted likewise. A score is the logistic
of the sum of the tables' entries.

Null and empty texts have all features 0 and get a score like any other; rows
that repeat score alike. An empty table gives an empty one. Texts are read
whole; memory follows the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .words import Words, chunks, utf8

#: The bounded sample that the model learns from: at most so many labelled rows.
SAMPLE_ROWS = 16_000
THRESHOLD = 0.7
NAMES = ("log_words", "upper", "symbols", "exclaims", "bars", "digits", "word_length", "repeats_before", "distinct", "stops", "lines", "symbol_ends", "high", "repeated_shingles", "long_words")
_UPPER, _LOWER_ABC, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER_ABC[97:123] = _DIGIT[48:58] = True
_SYMBOL[[*b"#$%&*!|<>=@^~_\\/{}[]+`"]] = True
_STOP[[*b".!?"]] = True


def features(column: pa.Array) -> np.ndarray:
    """(texts, features) as float32."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(NAMES)), np.float32)
    for lo, hi in chunks(offsets):
        w = Words(data, offsets, lo, hi)
        b, n = w.bytes, hi - lo

        def total(mask: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(mask)
            return np.diff(np.searchsorted(at, w.offsets))

        words = np.maximum(np.diff(w.first), 1)
        size = np.maximum(np.diff(w.offsets), 1)
        text = w.text_of_word()
        h = w.hashes()
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        per = lambda mask: np.bincount(text, mask, minlength=n)
        both = np.unique((text.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
        distinct = np.bincount((both >> np.uint64(54)).astype(np.int64), minlength=n)
        s, st, _ = w.shingles(3, short=False)
        both = np.unique((st.astype(np.uint64) << np.uint64(54)) | (s >> np.uint64(10)))
        shingles = np.bincount(st, minlength=n)
        once = np.bincount((both >> np.uint64(54)).astype(np.int64), minlength=n)
        last = b[w.end - 1]
        before_last = b[np.maximum(w.end - 2, w.start)]
        upper, lower = total(_UPPER[b]), total(_LOWER_ABC[b])
        length = w.end - w.start
        out[lo:hi] = np.stack(
            [
                np.log1p(np.diff(w.first)), upper / np.maximum(upper + lower, 1), total(_SYMBOL[b]) / words, total(b == 33) / words, total(b == 124) / words, total(_DIGIT[b]) / size,
                (np.bincount(text, length, minlength=n)) / words, per(same) / words, distinct / words, per(_STOP[last]) / words, total(b == 10) / words,
                per(_SYMBOL[last] & (_SYMBOL[before_last])) / words, total(b >= 128) / size, 1 - once / np.maximum(shingles, 1), per(length > 20) / words,
            ],
            axis=1,
        )
    return out


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The steps of a tree of at most four leaves over bins with gradient sums g and curvature sums h."""

    def best(a: int, z: int) -> int:
        cg, ch = np.cumsum(g[a:z])[:-1], np.cumsum(h[a:z])[:-1]
        tg, th = g[a:z].sum(), h[a:z].sum()
        ok = (ch > 1) & (th - ch > 1)
        gain = np.where(ok, cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1), -1) if z - a > 1 else np.zeros(0)
        return a + 1 + int(gain.argmax()) if len(gain) and gain.max() > tg**2 / (th + 1) + 1e-9 else 0

    cuts = {0, len(g)}
    if c := best(0, len(g)):
        cuts |= {c, best(0, c), best(c, len(g))}
    edges = sorted(cuts)
    out = np.zeros(len(g))
    for a, z in zip(edges, edges[1:]):
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best cross of one cut on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    ag, ah, bg, bh = cg[:-1, :-1], ch[:-1, :-1], cg[:-1, -1:], ch[:-1, -1:]
    dg, dh = cg[-1:, :-1], ch[-1:, :-1]
    parts = [(ag, ah), (bg - ag, bh - ah), (dg - ag, dh - ah), (tg - bg - dg + ag, th - bh - dh + ah)]
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for (x, y), at in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[at] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j] - tg**2 / (th + 1)), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15) -> dict:
    """The model from features (rows, features) and labels 0/1. One class, or no row, gives a constant score."""
    n, f = x.shape
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    model = {"base": float(np.log(share / (1 - share))), "bad": int(n - y.sum()), "edges": [], "tables": [], "pairs": []}
    for i in range(f):
        model["edges"].append(np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0))
        model["tables"].append(np.zeros(len(model["edges"][i]) + 1))
    if n == 0 or y.min() == y.max():
        return model
    at = _bins(model, x)
    z = np.full(n, model["base"])

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(f):
            k = len(model["tables"][i])
            if k > 1:
                g, h = gradient()
                step = rate * _tree(np.bincount(at[i], g, k), np.bincount(at[i], h, k))
                model["tables"][i] += step
                z += step[at[i]]
    g, h = gradient()
    found = []
    for i in range(f):
        for j in range(i):
            a, b = len(model["tables"][i]), len(model["tables"][j])
            if min(a, b) > 1:
                cell = at[i] * b + at[j]
                found.append((_quadrants(np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b))[0], i, j))
    for _, i, j in sorted(found, reverse=True)[:pairs]:
        model["pairs"].append([i, j, np.zeros((len(model["tables"][i]), len(model["tables"][j])))])
    for _ in range(pair_rounds):
        for pair in model["pairs"]:
            i, j, table = pair
            a, b = table.shape
            cell = at[i] * b + at[j]
            g, h = gradient()
            step = rate * _quadrants(np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b))[1]
            table += step
            z += step[at[i], at[j]]
    return model


def _bins(model: dict, x: np.ndarray) -> list[np.ndarray]:
    return [np.searchsorted(e, x[:, i], "left") for i, e in enumerate(model["edges"])]


def score(model: dict, x: np.ndarray) -> np.ndarray:
    at = _bins(model, x)
    z = np.full(len(x), model["base"])
    for t, a in zip(model["tables"], at):
        z += t[a]
    for i, j, t in model["pairs"]:
        z += t[at[i], at[j]]
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Learn labels.quality from at most `rows` labelled rows whose id isn't held out.

    Of the distinct (doc_id, quality) those with the least hashes are taken,
    about `rows`; of the documents that have these ids, the `rows` with the least
    hashes of id, label and text. So the bound holds for repeated ids too; a
    null id has no label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    mark = F.xxhash64("doc_id", "quality", F.lit(11))
    many = known.agg(F.approx_count_distinct(mark, 0.02).alias("n")).first()["n"]
    if not many:
        return train(np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
    picked = known if many <= rows else known.where(F.pmod(mark, F.lit(1048576)) < rows / many * 1048576)
    picked = picked.distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("mark"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "mark", "x"])

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id", "quality", "text").alias("mark"), "text")
    got = met.mapInArrow(run, "doc_id long, quality int, mark long, x array<float>").orderBy("mark").limit(rows).toArrow()
    if not got.num_rows:
        return train(np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
    x = np.stack(got["x"].to_numpy(zero_copy_only=False)) if got.num_rows else np.zeros((0, len(NAMES)))
    y, ids = got["quality"].to_numpy(), got["doc_id"].to_numpy()
    order = np.lexsort((*x.T, y, ids))  # the same rows give the same sums
    return train(x[order].astype(np.float32), y[order].astype(float))


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(model, features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that the classifier predicts 1, all columns as they are; no shuffle.

    A model that learnt from no label, or from none that is bad, has nothing to
    reject by: all documents are kept, though its constant score may be below THRESHOLD.
    """
    if not model["bad"]:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(model, features(b.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
