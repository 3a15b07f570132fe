"""Personal data in whole texts: exact base patterns, and a linear-chain conditional random field that adds what they miss.

Base spans (email, ip, card, phone) are found by bytes at the positions where
one can begin (a run of digits, an at sign, a plus), by patterns that take one
pass. The field labels words by their shapes, character classes, marks like
[at] or [.], digit counts and cue words, and those of their neighbours; it is
trained from the small labelled table below and decoded by Viterbi in numpy
batches. It adds obfuscated and spaced addresses, bracketed IPs, cards of 13
digits or with other separators, and national phone numbers. Its spans are
kept where they overlap no base span and hold a valid value of their kind.

Null and empty texts have no spans. Repeated rows are rows like any other.
Positions count code points, ends are exclusive. An empty table gives an empty
one; texts are read whole, memory follows the longest.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .viterbi import decode
from .words import LOWER, Words, chunks, mix, utf8

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(256, bool)
_LOCAL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"._%+-"]] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(b: bytes) -> bytes:
    return bytes(x for x in b if 48 <= x <= 57)


def base_spans(data: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of one text's base spans; data: its UTF-8 bytes."""
    digit = (data >= 48) & (data <= 57)
    runs = np.flatnonzero(digit & ~np.concatenate([[False], digit[:-1]]))
    ats, pluses = np.flatnonzero(data == 64), np.flatnonzero(data == 43)
    if not len(runs) and not len(ats):
        return []
    b, out = data.tobytes(), []
    end = 0
    for at in ats.tolist():
        m = _DOMAIN.match(b, at + 1)
        if m and at > end:
            outside = np.flatnonzero(~_LOCAL[data[end:at]])
            start = end + int(outside[-1]) + 1 if len(outside) else end
            if start < at:
                out.append((start, m.end(), "email"))
                end = m.end()
    ip_end = card_end = 0
    for at in runs.tolist():
        if at >= ip_end and (m := _IP.match(b, at)):
            ip_end = m.end()
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m.group().split(b".")):
                out.append((at, ip_end, "ip"))
        if at >= card_end and (m := _CARD.match(b, at)):
            card_end = m.end()
            d = _digits(m.group()) if m.end() - at < 40 else b""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((at, card_end, "card"))
    end = 0
    for at in pluses.tolist():
        if at >= end and (m := _PHONE.match(b, at)):
            end = m.end()
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((at, end, "phone"))
    return out


#: The labelled table: forms of each kind, of none, and the words they stand between (N: a word of plain prose, X: a form, ?: one that only a cue word tells).
#: In a form u is a user, h a host, t an ending, 9 a digit, w a word, i a number up to 255, c the next digit of a number that passes Luhn's test.
FORMS = {
    "email": ("u@h.t", "u@h.t", "u@h.t", "u@h.h.t", "u[at]h[dot]t", "u[at]h.h[dot]t", "u[at]h.t", "u(at)h(dot)t", "u(at)h.t", "u(at)h.h.t", "u{at}h.t", "u [at] h.t", "u [at] h [dot] t", "u (at) h.t", "u (at) h (dot) t", "u @ h.t", "u@h[.]t", "u@h [dot] t", "u@h(dot)t", "<u[at]h.t>"),
    "ip": ("i.i.i.i", "i.i.i.i", "i[.]i[.]i[.]i", "i(.)i(.)i(.)i", "i[dot]i[dot]i[dot]i", "i.i.i[.]i", "i.i[.]i.i", "i[.]i.i.i", "(i[.]i[.]i[.]i)"),
    "card": ("cccccccccccccccc", "cccc cccc cccc cccc", "cccc-cccc-cccc-cccc", "cccc.cccc.cccc.cccc", "cccc_cccc_cccc_cccc", "cccc/cccc/cccc/cccc", "ccccccccccccc", "cccc cccccc ccccc", "cccc.cccccc.ccccc", "cccc-cccccc-ccccc", "cccc. cccc. cccc. cccc"),
    "phone": ("+9 (999) 999-9999", "+99 99 9999999", "+99-999-999-9999", "+99.99.999.9999", "(999) 999-9999", "(999)999-9999", "(999) 999 9999", "(999) 999.9999", "999-999-9999", "999.999.9999", "999/999-9999", "9-999-999-9999", "1-800-999-9999", "0099 99 9999999", "(099) 9999 9999"),
    "phone?": ("999 999 9999", "999 9999 9999", "0999 999 9999", "099 99 99 99 99", "999-9999999", "9999 999 999"),
    "": ('"999ww9999www99999w99"', "password=99w9w99", "9999", "99", "9", "99.9", "9.99", "v9.9", "9.9.9", "v9.99.9-w9", "9999-99-99", "99/99/9999", "99.99.9999", "99:99", "9,999.99", "$9,999", "99%", "#99999", "999-9-99-999999-9", "978-9-99-999999-9", "9999-9999",
         "99999999999999999999", "999999", "99999999", "99999999-wwww-9999-wwww-999999999999", "WW-99999-999", "99.9999, 9.9999", "[9]", "[99]", "(9999)", "(w)", "(w w)", "[w]", "@w", "@w_w", "w[9]", "w(9)", "w@w", "+9", "+9%", "9+9", "9x9", "9-9", "999-999", "99 999", "999 999 999", "99 9 9999 99", "9th",
         "w.w", "h.t", "w.h.t", "w.w(w)", "(w).", "w/w/9", "w_99.w", "w-w", "9999/9999", "9999-99", "9.9e-9", "0x99ww99", "(c)", "99-99-99"),
}
CONTEXTS = {
    "": ("N N X N N", "N X N", "X N N", "N N X", "X", "N X, N", "N X. N N", "N X; X N", "N, X N", "(N) X N", "N N N N N X N N N N"),
    "email": ("write to X N", "mail X N", "email X", "N e-mail: X N", "contact X or N", "address X N", "X and X N"),
    "ip": ("ping X N", "from X to N", "host X N", "server X N N", "address X N", "ip: X N", "X X N"),
    "card": ("card X N", "visa X, N", "credit card X N", "pay with X N", "number X N", "X N card"),
    "phone": ("call X N", "tel: X", "phone X N", "fax X N", "dial X now N", "mobile: X or X N", "N contact X N", "whatsapp X"),
    "phone?": ("call X N", "call X", "tel: X N", "tel X", "phone X N N", "telephone: X", "fax: X N", "dial X N", "mobile X N", "N N call X now N", "reach me at phone X N", "cell X N", "sms X"),
    "none": ("isbn X N", "order no X N", "version X N", "page X N", "invoice X N", "token = X N", "date X N", "id X N", "key X N", "N at N dot N", "look N at X N", "at X N", "from X to X N", "N number X N", "from X N", "call N X N", "nr X, X N"),
}
CUES = "call tel telephone phone fax mobile cell whatsapp sms dial contact reach card visa mastercard amex credit pay with number ip host server ping address from to mail email e-mail write at dot now or isbn order no invoice id version date page token key nr me (at) [at] {at} (dot) [dot] {dot}".split()


def _value(form: str, rng: np.random.Generator) -> str:
    def word(n: int) -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    def number(n: int) -> str:
        return "".join(str(x) for x in rng.integers(0, 10, n))

    user = lambda: str(rng.choice([word(5), f"{word(4)}.{word(6)}", f"{word(5)}{number(2)}", f"{word(1)}.{word(6)}", f"{word(5)}.{number(2)}", f"{word(4)}_{word(5)}", f"{word(4)}-{word(3)}", word(9)]))
    host = lambda: str(rng.choice([word(5), word(8), f"{word(5)}{number(1)}", f"{word(4)}-{word(4)}"]))
    n = form.count("c") if form.count("c") > 9 else 0
    card = number(n - 1) if n else ""
    card += next((str(x) for x in range(10) if n and luhn(f"{card}{x}".encode())), "")
    out, at = "", 0
    for part in re.findall(r"\[at\]|\(at\)|\{at\}|\[dot\]|\(dot\)|password|\(c\)|0x|9th|.", form):
        if n and part == "c":
            out, at = out + card[at], at + 1
        else:
            out += {"u": user, "h": host, "t": lambda: str(rng.choice(["com", "org", "net", "de", "co.uk", "info"])), "9": lambda: number(1), "w": lambda: word(int(rng.integers(1, 4))), "W": lambda: word(1).upper(), "i": lambda: str(rng.integers(0, 256))}.get(part, lambda p=part: p)()
    return out


def labelled(seed: int, times: int = 1) -> list[tuple[list[str], list[int]]]:
    """Words and the numbers of their kinds (0: none): each form with each of its contexts, `times` times with values in."""
    rng, rows = np.random.default_rng(seed), []
    letters = list("abcdefghijklmnopqrstuvwxyz")
    kinds = {k: 1 + KINDS.index(k.rstrip("?")) if k else 0 for k in FORMS}
    for kind, forms in FORMS.items():
        contexts = (() if kind.endswith("?") else CONTEXTS[""]) + CONTEXTS.get(kind or "none", ())
        for form in forms:
            for context in contexts:
                for _ in range(times if len(contexts) * len(forms) < 400 else 1):
                    words, labels = [], []
                    for part in context.split(" "):
                        if "X" in part:
                            own = part.replace("X", _value(form, rng)).split(" ")
                            words += own
                            labels += [kinds[kind]] * len(own)
                        else:
                            w = "".join(rng.choice(letters, int(rng.integers(1, 10))))
                            w = w.capitalize() if rng.random() < 0.2 else w
                            words.append(part.replace("N", w + str(rng.choice(["", "", "", ",", ".", "###"]))))
                            labels.append(0)
                    rows.append((words, labels))
    return rows


SHAPES = 1 << 12
_CLASS = np.full(256, 0, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
for _c, _v in ((b"@", 3), (b".", 4), (b"+", 5), (b"()", 6), (b"-", 7), (b"[]{}", 8), (b"=:/_", 9), (b"\"'", 10)):
    _CLASS[list(_c)] = _v
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), *b"@[({"]] = True
_CUE = np.sort(Words(*utf8(pa.array([" ".join(CUES + [c + ":" for c in CUES])])), 0, 1).hashes())
#: Numbers of the features of a word: shape, classes that occur, digits, cue word, length of a word of digits.
SIZES = {"shape": SHAPES, "classes": 2048, "marks": 16, "digits": 22, "cue": len(_CUE) + 1, "numeral": 22}


def features(w: Words) -> dict[str, np.ndarray]:
    """For each feature its number at each word; plain words have 0 throughout, but for the cues.

    A shape is the hash of the word's runs of character classes; other signs and a last full stop are skipped.
    """
    n = len(w.start)
    out = {k: np.zeros(n, np.int64) for k in SIZES}
    if not n:
        return out
    c = _CLASS[w.bytes]
    last = w.end - 1
    c[last[c[last] == 4]] = 0
    h = w.hashes()
    at = np.minimum(np.searchsorted(_CUE, h), len(_CUE) - 1)
    out["cue"] = np.where(_CUE[at] == h, at + 1, 0)
    special = np.flatnonzero(np.add.reduceat((c > 1).astype(np.int32), w.start))
    if not len(special):
        return out
    digits = np.minimum(np.add.reduceat((c == 2).astype(np.int32), w.start)[special], 21)
    out["digits"][special] = digits
    out["numeral"][special] = np.where(digits == (w.end - w.start)[special], digits, 0)
    many = (w.end - w.start)[special]
    word = np.repeat(np.arange(len(special)), many)
    k = c[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.start[special], many)]
    word, k = word[k > 0], k[k > 0]
    b = np.append(LOWER[w.bytes], np.zeros(5, np.uint8))
    marks, bits = np.zeros(len(special), np.int64), np.zeros(len(special), np.int64)
    opens = np.flatnonzero((c == 6) | (c == 8))
    for bit, inner in ((0, b"at"), (1, b"dot"), (1, b".")):  # marks like (at), [dot], [.]
        ok = np.isin(b[opens + len(inner) + 1], list(b")]}"))
        for i, x in enumerate(inner, 1):
            ok &= b[opens + i] == x
        marks |= np.isin(special, np.searchsorted(w.start, opens[ok], "right") - 1).astype(np.int64) << bit
    np.bitwise_or.at(bits, word, np.int64(1) << k.astype(np.int64))
    out["classes"][special] = bits
    out["marks"][special] = marks | (bits >> 3 & 1) << 2 | (bits >> 4 & 1) << 3
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (word[1:] != word[:-1])
    word, k = word[new], k[new]
    first = np.searchsorted(word, np.arange(len(special)))
    place = np.minimum(np.arange(len(word)) - first[word], 15)
    h = np.bincount(word, (mix((place * 16 + k).astype(np.uint64)) >> np.uint64(24)).astype(np.float64), minlength=len(special)).astype(np.uint64)
    out["shape"][special] = 1 + (mix(h) % np.uint64(SHAPES - 1)).astype(np.int64)
    return out


def _around(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feature of each word, of the one before and of the one after it in its text (0: none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begin = first[:-1][np.diff(first) > 0]
    before[begin] = after[first[1:][np.diff(first) > 0] - 1] = 0
    return x, before, after


def scores(model: dict, found: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found["shape"]), 1 + len(KINDS)), np.float32 if model["change"].dtype == np.float32 else float)
    for k, x in found.items():
        for j, own in enumerate(_around(x, first)):
            table = model[f"{k}{j}"]
            out += table[0]
            some = np.flatnonzero(own)
            out[some] += table[own[some]] - table[0]
    return out


@functools.lru_cache(1)
def train(rounds: int = 25, rate: float = 0.9, decay: float = 1e-4, seed: int = 5) -> dict:
    """Gradient steps (Adagrad) on the log likelihood of the labelled table, by forward and backward sums over padded rows."""
    rows = labelled(seed)
    data, offsets = utf8(pa.array([" ".join(w) for w, _ in rows], pa.large_string()))
    w = Words(data, offsets, 0, len(rows))
    found = features(w)
    first, k = w.first, 1 + len(KINDS)
    truth = np.concatenate([np.array(y) for _, y in rows])
    n, most = len(rows), int(np.diff(first).max())
    row, place = w.text_of_word(), np.arange(len(truth)) - first[:-1][w.text_of_word()]
    mask = np.zeros((n, most), bool)
    mask[row, place] = True
    gold = np.zeros((k, k))
    inner = place > 0
    np.add.at(gold, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
    at = {f"{f}{j}": own for f, x in found.items() for j, own in enumerate(_around(x, first))}
    model = {x: np.zeros((SIZES[x[:-1]], k)) for x in at} | {"change": np.zeros((k, k))}
    square = {x: np.full_like(v, 1e-3) for x, v in model.items()}
    for _ in range(rounds):
        e = np.zeros((n, most, k))
        e[row, place] = scores(model, found, first)
        t = model["change"]
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, most):
            x = alpha[:, i - 1, :, None] + t[None]
            top = x.max(1)
            alpha[:, i] = np.where(mask[:, i, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + e[:, i], alpha[:, i - 1])
        for i in range(most - 2, -1, -1):
            x = t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            top = x.max(2)
            beta[:, i] = np.where(mask[:, i + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        delta = -np.exp(alpha + beta - z[:, None, None])[row, place]
        delta[np.arange(len(truth)), truth] += 1
        expected = np.zeros((k, k))
        for i in range(1, most):
            pair = np.exp(alpha[:, i - 1, :, None] + t[None] + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
            expected += (pair * mask[:, i, None, None]).sum(0)
        gradient = {x: np.stack([np.bincount(own, delta[:, j], SIZES[x[:-1]]) for j in range(k)], axis=1) for x, own in at.items()}
        gradient["change"] = gold - expected
        for x in model:
            g = gradient[x] / n - decay * model[x]
            square[x] += g * g
            model[x] += rate * g / np.sqrt(square[x])
    return {x: v.astype(np.float32) for x, v in model.items()}


_TRIM = b".,;:!?\"'*#$%&|<>"
_AT, _DOT = rb"(?: ?@ ?| ?[\[({]at[\])}] ?)", rb"(?:\.| ?[\[({](?:dot|\.)[\])}] ?)"
_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+" + _AT + rb"[A-Za-z0-9-]+(?:" + _DOT + rb"[A-Za-z0-9-]+)+", re.I)
#: Words of the longest value.
LONGEST = 6


def valid(kind: str, b: bytes) -> bool:
    """Whether the field's span holds a value of its kind."""
    d = _digits(b)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(rb"[0-9]{3,}(?:[._/ -]{1,2}[0-9]{3,})*", b) is not None
    if kind == "phone":
        return 10 <= len(d) <= 15 and re.fullmatch(rb"[+(0-9][0-9 ()./-]*[0-9]", b) is not None and (b[:1] in b"+(" or re.search(rb"[-. /]", b) is not None)
    if kind == "ip":
        parts = re.split(rb"\.|[\[({](?:\.|dot)[\])}]", b.strip(b"()"))
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return _EMAIL.fullmatch(b) is not None


def _values(kind: str, w: Words, a: int, z: int) -> Iterator[tuple[int, int]]:
    """(start, end) in bytes of the valid values in words a..z-1, which are all of the kind: the longest from each word on."""
    while a < z:
        for end in range(min(z, a + LONGEST), a, -1):
            s, e = int(w.start[a]), int(w.end[end - 1])
            b = w.bytes[s:e].tobytes()
            left = len(b) - len(b.lstrip(_TRIM))
            b = re.sub(rb"[\x09-\x0d ]+", b" ", b.strip(_TRIM))
            if valid(kind, b):
                yield s + left, s + left + len(w.bytes[s:e].tobytes().strip(_TRIM))
                a = end
                break
        else:
            a += 1


def find(model: dict, column: pa.Array) -> list[list[tuple[int, int, str, bool]]]:
    """Of each text: (start, end, kind, base) in code points, by start and kind."""
    data, offsets = utf8(column)
    every: list[list[tuple[int, int, str, bool]]] = [[] for _ in range(len(column))]
    # every span, base or valid, holds a digit, an at sign or a bracket: texts without have none
    some = np.unique(np.searchsorted(offsets, np.flatnonzero(_MARK[data]), "right") - 1)
    for t, spans in zip(some.tolist(), _find(model, column.take(pa.array(some)))):
        every[t] = spans
    return every


def _find(model: dict, column: pa.Array) -> list[list[tuple[int, int, str, bool]]]:
    data, offsets = utf8(column)
    out: list[list[tuple[int, int, str, bool]]] = []
    for lo, hi in chunks(offsets):
        w = Words(data, offsets, lo, hi)
        found = features(w)
        added: dict[int, list[tuple[int, int, str]]] = {}
        if len(w.start) and found["shape"].any():
            labels = decode(scores(model, found, w.first), w.first, model["change"])
            hit = np.flatnonzero(labels)
            text = np.searchsorted(w.first, hit, "right") - 1
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (text[1:] != text[:-1])
            cuts = np.append(np.flatnonzero(new), len(hit))
            for a, z in zip(cuts, cuts[1:]):
                t, kind = int(text[a]), KINDS[labels[hit[a]] - 1]
                for s, e in _values(kind, w, int(hit[a]), int(hit[z - 1]) + 1):
                    added.setdefault(t, []).append((s - int(w.offsets[t]), e - int(w.offsets[t]), kind))
        mark = (w.bytes == 64) | (w.bytes == 43) | ((w.bytes >= 48) & (w.bytes <= 57))
        some = np.searchsorted(w.offsets, np.flatnonzero(mark), "right") - 1
        some = set(some.tolist())
        for t in range(hi - lo):
            spans: list[tuple[int, int, str, bool]] = []
            if t in some or t in added:
                part = w.bytes[w.offsets[t] : w.offsets[t + 1]]
                base = base_spans(part)
                more = [(*x, False) for x in added.get(t, []) if all(x[1] <= s or e <= x[0] for s, e, _ in base)]
                point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                spans = sorted(((int(point[s]), int(point[e]), k, f) for s, e, k, f in [(*x, True) for x in base] + more), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            out.append(spans)
    return out


def find_personal_data(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, n_spans and n_added (spans in all, and those of the field), base_email, base_ip, base_card and base_phone (of base spans) of each document."""

    def text(spans: list[tuple[int, int, str, bool]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(model, b.column("text"))
            n, base = ([pa.array([sum(x[2] == k and (x[3] or every) for x in f) for f in found], pa.int64()) for k in KINDS] for every in (True, False))
            sha = pa.array([hashlib.sha256(text([x for x in f if x[3]]).encode()).hexdigest() for f in found], pa.string())
            columns = [b.column("doc_id"), *n, sha, pa.array([text(f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(not x[3] for x in f) for f in found], pa.int64()), *base]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added", *(f"base_{k}" for k in KINDS)])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, base_email long, base_ip long, base_card long, base_phone long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)
