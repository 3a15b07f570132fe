"""Language of whole texts and of their spans.

Each word is scored under each language by the hashed trigrams of its letter
bytes, with marks at its ends (sums of logarithms of smoothed shares);
the scripts of a word's letters narrow the languages to those that have used
the script in training; Viterbi with a penalty for each switch labels the
words, so spans of a mixed text get their own languages. The text's language
is the one with most letter bytes, its score the share of them.

A null text, or one without a letter, is `und` with score 0. Ties go to the
lesser language. Repeated and empty rows are rows like any other; texts are
read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .viterbi import decode
from .words import Words, chunks, mix, utf8

#: The bounded sample that the model learns from: about so many distinct rows a language.
SAMPLE_ROWS = 1500
#: Bytes times languages that are scored at once.
SCORED = 16_000_000
BITS = 16
NONE = 1 << BITS
SWITCH = 4.0
#: Words decoded at once.
GROUP = 3_000_000
#: Scripts by the first bytes of UTF-8; 0 is no letter, 1 Latin.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "hangul", "han", "other")
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_SCRIPT[0xC3:0xCA] = 1
_SCRIPT[0xCE:0xD0] = 2
_SCRIPT[0xD0:0xD5] = 3
_SCRIPT[0xD6:0xD8] = 4
_SCRIPT[0xD8:0xDC] = 5
_SCRIPT[0xE0] = 6
_SCRIPT[0xE1] = 10
_SCRIPT[0xE3] = 7
_SCRIPT[0xEA:0xEE] = 8
_SCRIPT[0xE4:0xEA] = 9
_SCRIPT[0xF0:0xF5] = 10
_LETTER = (_SCRIPT > 0) | (np.arange(256) >= 0x80)


def fold(b: np.ndarray) -> np.ndarray:
    """Bytes in lower case: ASCII and the letters after C3."""
    out = b.copy()
    out[(b >= 65) & (b <= 90)] += 32
    after = np.zeros(len(b), bool)
    after[1:] = b[:-1] == 0xC3
    out[after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] += 32
    return out


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of the byte trigram around each byte, NONE where that byte is no letter; whether it is; letters of each word; bits of the scripts of each word).

    What is no letter, a digit or sign within a word too, reads as a mark.
    """
    b = w.bytes
    letter = _LETTER[b]
    marked = np.full(len(b) + 2, 32, np.uint32)
    marked[1:-1] = np.where(letter, fold(b), 32)
    key = (marked[:-2] << np.uint32(16)) | (marked[1:-1] << np.uint32(8)) | marked[2:]
    key = (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    key[~letter] = NONE
    letters = np.add.reduceat(letter.astype(np.int32), w.start) if len(w.start) else np.zeros(0, np.int32)
    bits = np.zeros(len(w.start), np.uint16)
    script = _SCRIPT[b]
    for s in np.flatnonzero(np.bincount(script, minlength=len(SCRIPTS)))[0 if len(b) else 1 :]:
        if s:
            hit = np.searchsorted(w.start, np.flatnonzero(script == s), "right") - 1 if s != 1 else np.flatnonzero(np.add.reduceat((script == 1).astype(np.int32), w.start))
            bits[hit] |= np.uint16(1 << (s - 1))
    return key, letter, letters, bits


def learn(rows: Iterator[tuple[str, str]]) -> dict:
    """The model from (text, language) rows."""
    by: dict[str, list[str]] = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(text or "")
    langs = sorted(by)
    table = np.zeros((NONE + 1, len(langs)), np.float32)
    scripts = np.zeros(len(langs), np.uint16)
    for i, lang in enumerate(langs):
        data, offsets = utf8(pa.array(by[lang], pa.large_string()))
        used = np.zeros(16)
        for lo, hi in chunks(offsets):
            key, _, letters, bits = grams(Words(data, offsets, lo, hi))
            table[:, i] += np.bincount(key, minlength=NONE + 1)
            for s in range(16):
                used[s] += letters[(bits >> s) & 1 > 0].sum()
        scripts[i] = sum(1 << s for s in range(16) if used[s] > 0.01 * max(1, used.sum()))
    table[NONE] = 0
    table = np.log((table + 0.5) / (table.sum(0, keepdims=True) + 0.5 * 4096))
    table[NONE] = 0
    return {"langs": langs, "table": table.astype(np.float32), "scripts": scripts}


def word_scores(model: dict, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each word under each language, letter bytes of each word)."""
    key, _, letters, bits = grams(w)
    if not len(w.start):
        return np.zeros((0, len(model["langs"])), np.float32), letters
    k = len(model["langs"])
    scores = np.empty((len(w.start), k), np.float32)
    i = 0
    while i < len(w.start):  # some words at a time: what is looked up is bytes x languages
        j = max(i + 1, int(np.searchsorted(w.start, w.start[i] + SCORED // max(k, 1))))
        end = w.start[j] if j < len(w.start) else len(key)
        np.add.reduceat(model["table"][key[w.start[i] : end]], w.start[i:j] - w.start[i], axis=0, out=scores[i:j])
        i = j
    able = (bits[:, None] & model["scripts"][None]) > 0
    scores[~able & able.any(1)[:, None]] -= 1e4
    return scores, letters


def label_texts(model: dict, column: pa.Array, spans: bool = False) -> tuple[list[str], np.ndarray, list | None]:
    """Language and score of each text, and its spans (start, end in bytes, language) if asked for."""
    data, offsets = utf8(column)
    langs = model["langs"]
    k = len(langs)
    change = np.full((k, k), -SWITCH, np.float32)
    np.fill_diagonal(change, 0)
    pred, score, found = np.full(len(column), -1), np.zeros(len(column)), []
    group: list[tuple[int, int, Words, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not group:
            return
        scores = np.concatenate([g[3] for g in group])
        shift = np.cumsum([0] + [len(g[3]) for g in group])
        first = np.concatenate([g[2].first[:-1] + s for g, s in zip(group, shift)] + [[shift[-1]]]).astype(np.int64)
        labels = decode(scores, first, change)
        for (lo, hi, w, _, letters), s in zip(group, shift):
            own = labels[s : s + len(letters)]
            text = w.text_of_word()
            share = np.zeros((hi - lo, k))
            for i in range(k):
                share[:, i] = np.bincount(text, letters * (own == i), minlength=hi - lo)
            total = share.sum(1)
            pred[lo:hi] = np.where(total > 0, share.argmax(1), -1)
            score[lo:hi] = share.max(1) / np.maximum(total, 1)
            if spans:
                for t in range(hi - lo):
                    a, z = w.first[t], w.first[t + 1]
                    cuts = [a, *(a + 1 + np.flatnonzero(own[a + 1 : z] != own[a : z - 1])), z] if z > a else []
                    found.append([(int(w.start[x] - w.offsets[t]), int(w.end[y - 1] - w.offsets[t]), langs[own[x]]) for x, y in zip(cuts, cuts[1:])])
        group.clear()

    held = 0
    for lo, hi in chunks(offsets):
        w = Words(data, offsets, lo, hi)
        scores, letters = word_scores(model, w)
        w.bytes = None
        group.append((lo, hi, w, scores, letters))
        held += len(scores)
        if held > GROUP:
            flush()
            held = 0
    flush()
    names = [langs[i] if i >= 0 else "und" for i in pred]
    for i in np.flatnonzero(pred >= 0):  # high bytes may be signs: the letter test is exact where no ASCII letter is
        part = data[offsets[i] : offsets[i + 1]]
        if not ((part >= 65) & (part <= 90) | (part >= 97) & (part <= 122)).any() and not any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace")):
            names[i], score[i] = "und", 0.0
            pred[i] = -1
    if spans:
        found = [f if p >= 0 else [] for f, p in zip(found, pred)]
    return names, score, found if spans else None


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id isn't."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Learn from text and non-null lang of rows not held out.

    Of each language about `rows` distinct rows are taken: those whose hash of
    id and text is below rows / (distinct rows of the language); a language with
    fewer gives all. So the bound holds whatever the ids are; rows that repeat
    count once.
    """
    mark = F.xxhash64("doc_id", "text", F.lit(7))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", mark.alias("mark"))
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("mark", 0.02).alias("n")).collect()}
    if not many:
        return learn(iter([]))
    limit = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, 2.0 if n <= rows else rows / n)])
    share = F.expr("pmod(mark, 1048576L)").cast("double") / 1048576
    picked = known.where(share < limit[F.col("lang")]).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    return learn((r["text"], r["lang"]) for r in picked.select("text", "lang").toLocalIterator())


def _points(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """The spans with code points in place of bytes."""
    ahead = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])  # code points that begin before a byte
    return [{"start": int(ahead[s]), "end": int(ahead[e]), "lang": lang} for s, e, lang in spans]


def identify(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; with `spans`, its spans too (start and exclusive end in code points, lang), none for `und`."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model["langs"]:
                names, score, found = label_texts(model, b.column("text"), spans)
            else:
                names, score, found = ["und"] * len(b), np.zeros(len(b)), [[]] * len(b)
            columns = {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                columns["spans"] = pa.array([_points(t, f) if f else [] for t, f in zip(b.column("text").to_pylist(), found)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start: long, `end`: long, lang: string>>" * spans)
