"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and bytes above 127, A-Z lower-cased. Seeds
of SEED words that a document and an item share are joined, of each item only
the rarest that a pair must share; for each pair that could reach the threshold,
the longest match of unmarked words, at least SEED long, is marked again and
again (tiles) by running Karp-Rabin hashes of windows of decreasing length, in
whatever order the passages lie.
A pair whose tiles cover at least COVER of the item's words is contaminated.
An item of fewer than SEED words is one seed, and only a document that holds it
whole, word after word, is contaminated by it.

Documents pass a bitmap of the items' seeds first. It has a fixed size, so it
can be broadcast whatever the benchmark's; what it lets through by chance
finds no partner in the join. Only the stretches of words around seeds are
shuffled, never texts.

Null and empty texts, and those without a word, match nothing.
Rows that repeat throughout count once. Empty tables give an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, Scratch, drop_rows, row_hash, row_key
from .words import LOWER, Words, _powers, chunks, mix, utf8

SEED = 5
COVER = 0.6
#: Pairs that a task tiles.
PAIRS = 5000
#: Bits of the bitmap: 4 MB.
BITS = 25
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


class Windows:
    """Running Karp-Rabin hashes of the windows of a sequence of words that hold no marked word."""

    def __init__(self, code: np.ndarray):
        self.code, self.marked = code, code < 0
        power, self.inverse = _powers(len(code) + 1)
        self.run = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], out=self.run[1:])
        self.count()

    def count(self) -> None:
        self.ahead = np.concatenate([[0], np.cumsum(self.marked)])

    def at(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each window of n words."""
        start = np.flatnonzero(self.ahead[n:] == self.ahead[: len(self.ahead) - n]) if len(self.code) >= n else np.zeros(0, np.int64)
        return (self.run[start + n] - self.run[start]) * self.inverse[start], start


def tiles(item: list[str], parts: list[list[str]], seed: int = SEED) -> list[tuple[int, int, int]]:
    """(start in item, start in the parts laid end to end, length) of the greedy tiles, by running Karp-Rabin.

    The search length is the longest of which unmarked windows of both sides
    have a hash in common, found by bisection below the one before. Windows that
    meet there, from the left, are compared word by word and marked.
    """
    code: dict[str, int] = {}
    a = Windows(np.array([code.setdefault(w, len(code)) for w in item], np.int64))
    b = Windows(np.array([c for p in parts for c in [*(code.get(w, -1) for w in p), -1]], np.int64))
    out: list[tuple[int, int, int]] = []

    def meet(n: int) -> bool:
        return bool(np.isin(a.at(n)[0], b.at(n)[0]).any())

    most = len(item)
    while most >= seed and meet(seed):
        low = seed
        while low < most:
            middle = (low + most + 1) // 2
            if meet(middle):
                low = middle
            else:
                most = middle - 1
        (ha, ia), (hb, ib) = a.at(most), b.at(most)
        order = np.argsort(hb, kind="stable")
        hb, ib = hb[order], ib[order]
        first, last = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        at = {}  # where the search among the windows of one hash goes on: those ahead are marked
        for i, h, x, z in zip(ia.tolist(), ha.tolist(), first.tolist(), last.tolist()):
            if x == z or a.marked[i] or a.marked[i + most - 1]:  # tiles marked here are as long as a window: one that overlaps holds an end
                continue
            x = at.get(h, x)
            while x < z:
                j = int(ib[x])
                if not b.marked[j] and not b.marked[j + most - 1] and (a.code[i : i + most] == b.code[j : j + most]).all():
                    out.append((i, j, most))
                    a.marked[i : i + most] = b.marked[j : j + most] = True
                    break
                x += 1
            at[h] = x
        a.count()
        b.count()
        most -= 1  # all windows of this length that meet are marked
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: Column, scratch: Scratch, seed: int = SEED, cover: float = COVER) -> DataFrame:
    """k (the given key of the row), doc_id, item_id, covered, item_words, coverage of each contaminated pair."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for lo, hi in chunks(offsets):
                w = Words(data, offsets, lo, hi, APART)
                h, text, _ = w.shingles(seed)
                take = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([b.column("item").take(take), pa.array(np.diff(w.first)[text].astype(np.int64)), pa.array(h.view(np.int64))], ["item", "item_words", "seed"])

    item = items.select(F.col("item_id").cast("long").alias("item_id"), "text", row_hash("item_id", "text").alias("item")).dropDuplicates(["item"])
    item = scratch.save(item)
    seed_table = scratch.save(item.mapInArrow(seeds, "item long, item_words long, seed long"))

    # what of a document is looked up: runs of `seed` words, and of as many as a shorter item has
    lengths = [seed, *sorted(r["item_words"] for r in seed_table.where(F.col("item_words") < seed).select("item_words").distinct().collect())]

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            for p in _probes(b.column("seed").to_numpy().view(np.uint64)):
                bits[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(1 << (BITS - 3), np.uint8)
    for r in seed_table.select("seed").coalesce(16).mapInArrow(bitmap, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(total)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value

        def inside(p: np.ndarray) -> np.ndarray:
            return (packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0

        for b in batches:
            data, offsets = utf8(b.column("text"))
            row, parts, hits = [], [], []
            for lo, hi in chunks(offsets):
                w = Words(data, offsets, lo, hi, APART)
                met = []
                for n in lengths:
                    h, text, word = w.shingles(n, short=False)
                    first, second = _probes(h)
                    at = np.flatnonzero(inside(first))
                    at = at[inside(second[at])]
                    met.append((h[at], text[at], word[at], word[at] + n))
                h, text, word, end = (np.concatenate(x) for x in zip(*met))
                order = np.argsort(word, kind="stable")  # words of a chunk are in the order of its texts
                h, text, word, end = h[order], text[order], word[order], end[order]
                low = LOWER[w.bytes].tobytes() if len(h) else b""
                cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(h) else []
                for x, z in zip(cuts, [*cuts[1:], len(h)]):
                    own, reach = word[x:z], np.maximum.accumulate(end[x:z])
                    new = np.flatnonzero(np.concatenate([[True], own[1:] > reach[:-1]]))
                    row.append(lo + int(text[x]))
                    parts.append([" ".join(low[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in range(own[p], reach[q - 1])) for p, q in zip(new, [*new[1:], z - x])])
                    hits.append(np.unique(h[x:z]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row, pa.int64())), b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(parts, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64()))], ["k", "doc_id", "parts", "seeds"])

    near = docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stretches, f"k {KEY}, doc_id long, parts array<string>, seeds array<long>")
    near = scratch.save(near)
    # Tiles of at least `seed` words: c covered words of the item hold at least c / seed places whose seed is shared. So a pair shares one of
    # the item's rarest seeds, those left when its most frequent ones go as long as they hold fewer places than a pair needs.
    exploded = near.select("k", F.explode("seeds").alias("seed"))
    often = exploded.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    own = seed_table.groupBy("item", "item_words", "seed").agg(F.count(F.lit(1)).alias("places")).join(often, "seed")
    tail = Window.partitionBy("item").orderBy(F.desc("often"), "seed")
    rare = own.withColumn("behind", F.sum("places").over(tail)).where(F.col("behind") >= F.ceil(F.ceil(cover * F.col("item_words")) / seed)).select("item", "seed")
    pairs = scratch.save(exploded.join(rare, "seed").select("k", "item").distinct())
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    ready = pairs.join(near.dropDuplicates(["k"]), "k").join(item, "item").select("k", "doc_id", "item", "item_id", "text", "parts", "seeds")
    ready = ready.repartition(max(2 * parallel, math.ceil(pairs.count() / PAIRS)), "k", "item").drop("item")  # the work is tiling, which partitions by bytes would leave to one task

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered, size = [], []
            data, offsets = utf8(b.column("text"))
            for i, (parts, met) in enumerate(zip(b.column("parts").to_pylist(), b.column("seeds"))):
                w = Words(data, offsets, i, i + 1, APART)
                low = LOWER[w.bytes].tobytes()
                words = [low[s:e].decode("utf-8", "replace") for s, e in zip(w.start, w.end)]
                size.append(len(words))
                shared = np.isin(w.shingles(min(seed, len(words)))[0].view(np.int64), met.values.to_numpy()).sum()
                enough = shared * seed >= math.ceil(cover * len(words))
                covered.append(sum(t[2] for t in tiles(words, [p.split(" ") for p in parts], min(seed, len(words)))) if enough else 0)
            keep = pa.array([c >= (math.ceil(cover * n) if n >= seed else n) for c, n in zip(covered, size)], pa.bool_())
            rows = pa.RecordBatch.from_arrays([b.column("k"), b.column("doc_id"), b.column("item_id"), pa.array(covered, pa.int64()), pa.array(size, pa.int64()), pa.array([c / n for c, n in zip(covered, size)], pa.float64())], ["k", "doc_id", "item_id", "covered", "item_words", "coverage"])
            yield rows.filter(keep)

    return scratch.save(ready.mapInArrow(tile, f"k {KEY}, doc_id long, item_id long, covered long, item_words long, coverage double"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, covered, item_words, coverage of each contaminated pair."""
    return contaminated(docs, items, row_key("doc_id", "text"), Scratch(docs.sparkSession)).drop("k")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without the contaminated ones, all columns as they are."""
    key = row_key(*docs.columns)
    return drop_rows(docs, contaminated(docs, items, key, Scratch(docs.sparkSession)), key)
