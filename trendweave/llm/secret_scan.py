"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its context.

Candidates are all maximal runs of token characters, of any length and case, and the findings of the patterns;
``=`` before another token character is no part of a run, so a name and its value are two.
A run is read as stretches of at most ``INSIDE`` bytes: itself, or overlapping pieces of it where it is longer,
and likewise its parts between ``/`` and ``.``; so every byte of it is read, and its score is the greatest of its
stretches.  The network (numpy, no framework) reads the bytes of a stretch and those around it, under separate
codes; convolutions of three widths, pooled by maximum and mean, feed one logistic unit, in which the context
counts for at most ``SWAY``.  The own part is computed once for each distinct stretch; the context is read only
where it can still lift a score to a threshold, which changes no finding.

The network is trained on labelled findings: a bounded sample of the corpus' own candidates, labelled by the
patterns, its long words among them as often as all others, as these are what is most easily taken for a key, and generated findings of many shapes in many contexts.  What looks like a key but no pattern covers,
and what a pattern covers but does not look like a key, has no label.  A quarter of the runs is held back to
calibrate the scores (Platt) and to set two thresholds, for assigned and for bare runs: the highest that keep
``recall`` of the held-back secrets.

Pattern findings always stay; the network adds runs that overlap none of them, and of the runs that overlap one
the stretches that do not, as kind ``model``.

Defined results: a null or empty text has no findings; offsets are code points, end exclusive; repeated rows
are scanned alike and all returned; an empty table gives an empty result (the network is then trained on
generated findings alone); other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import buffers, code_points, hash_spans, slices

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
LONG_WORD, SHOUTED_WORD = 11, 6  # letters of a word, and of one in capitals, that is long enough to be taken for a key
BEFORE, INSIDE, AFTER = 32, 40, 8
WINDOW = BEFORE + INSIDE + AFTER
SWAY = 4.0


def base_findings(data: bytes, long_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern findings; long_run: whether a run of 32 token characters occurs."""
    low = data.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    if long_run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(data) if m.end() - m.start() >= 32]
    return sorted(found)


def _runs(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def token_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the candidate runs of all documents, cut at equals signs within, and for each document its longest run of token characters."""
    inside = TOKEN[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = _runs(inside, edge)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, np.searchsorted(offsets, starts, side="right") - 1, ends - starts)
    equals = raw == ord("=")
    if equals.any():  # one before a token character ends a name, others are padding
        following = np.minimum.accumulate(np.where(equals, len(raw), np.arange(len(raw)))[::-1])[::-1]
        last = np.repeat(offsets[1:], np.diff(offsets))
        inside = inside & ~(equals & (following < last) & inside[np.minimum(following, len(raw) - 1)])
        starts, ends = _runs(inside, edge)
    while len(ends):  # a full stop ends a sentence, not a token
        dot = (raw[ends - 1] == ord(".")) & (ends - starts > 1)
        if not dot.any():
            break
        ends = ends - dot
    return starts, ends, longest


def stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the stretches of each run, which cover it; a run's own come first."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    part = (np.cumsum(edge[:-1], dtype=np.int8) > 0) & (raw != ord("/")) & (raw != ord("."))
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = True
    before = np.concatenate([[False], part[:-1]]) if len(raw) else part
    after = np.concatenate([part[1:], [False]]) if len(raw) else part
    low = np.flatnonzero(part & (~before | first[:-1]))
    high = np.flatnonzero(part & (~after | first[1:])) + 1
    run = np.searchsorted(starts, low, side="right") - 1
    inner = high - low < (ends - starts)[run]
    run, low, high = np.concatenate([np.arange(len(starts)), run[inner]]), np.concatenate([starts, low[inner]]), np.concatenate([ends, high[inner]])
    n = np.maximum(0, -(-(high - low - INSIDE) // (INSIDE // 2))) + 1
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    run, low, high = np.repeat(run, n), np.repeat(low, n), np.repeat(high, n)
    low = np.minimum(low + k * (INSIDE // 2), np.maximum(low, high - INSIDE))
    order = np.argsort(run, kind="stable")
    return run[order], low[order], np.minimum(low + INSIDE, high)[order]


def _codes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for code, group in enumerate([b"\n\r\t ", b"\"'`", b":", b"=", b".,;!?", b"()[]{}<>", b"-", b"_", b"/", b"+", b"@", b"0123456789"], 1):
        table[list(group)] = code
    for i in range(26):
        table[97 + i], table[65 + i] = 13 + i, 39 + i
    table[0xC2:] = 65
    table[0x80:0xC0] = 65
    return table


CODES = _codes()
PER_PLACE = 66


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Codes of the bytes before, inside (its first ones) and after each candidate; 0 beyond its document [low, high)."""
    at = starts[:, None] + np.arange(-BEFORE, INSIDE)[None, :]
    own = at >= starts[:, None]
    valid = (at >= low[:, None]) & (~own | (at < ends[:, None]))
    tail = ends[:, None] + np.arange(AFTER)[None, :]
    at, own, valid = np.hstack([at, tail]), np.hstack([own, np.zeros(tail.shape, bool)]), np.hstack([valid, tail < high[:, None]])
    codes = CODES[raw[np.clip(at, 0, max(0, len(raw) - 1))]] if len(raw) else np.zeros(at.shape, np.int64)
    return np.where(valid, codes + PER_PLACE * own + 1, 0)


def is_assigned(raw: np.ndarray, starts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether a colon or equals sign stands within the three places before the run, in its document."""
    out = np.zeros(len(starts), bool)
    for k in (1, 2, 3):
        at = np.maximum(starts - k, 0)
        out |= (starts - k >= low) & ((raw[at] == ord(":")) | (raw[at] == ord("="))) if len(raw) else out
    return out


def around(w: np.ndarray) -> np.ndarray:
    """The places before and after the candidate, with a mark in its stead."""
    return np.hstack([w[:, :BEFORE], np.full((len(w), 1), 2 * PER_PLACE + 1, w.dtype), w[:, BEFORE + INSIDE :]])


@dataclass
class Network:
    """Embedding, convolutions of several widths, maximum and mean pooling, one logistic unit; then calibration and thresholds."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float] = (0.5, 0.5)  # bare, assigned

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.bias]

    def pooled(self, w: np.ndarray, keep: list | None = None) -> np.ndarray:
        x = self.embed[w]
        pooled = []
        for f, b in zip(self.filters, self.biases, strict=True):
            width, dim, n = f.shape
            cols = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2).reshape(len(w), -1, width * dim)
            a = np.maximum(cols @ f.reshape(-1, n) + b, 0)
            pooled += [a.max(axis=1), a.mean(axis=1)]
            if keep is not None:
                keep.append((cols, a, a.argmax(axis=1)))
        return np.concatenate(pooled, axis=1)

    def own(self, w: np.ndarray) -> np.ndarray:
        """The part of the margin that the candidate's own bytes make; w holds the inner places."""
        parts = [self.pooled(w[k : k + 512]) @ self.out[0] for k in range(0, len(w), 512)]
        return (np.concatenate(parts) if parts else np.zeros(0)) + self.bias[0]

    def margin(self, w: np.ndarray) -> np.ndarray:
        """Own part plus that of the context, which is at most SWAY either way."""
        return self.pooled(w[:, BEFORE : BEFORE + INSIDE]) @ self.out[0] + self.bias[0] + SWAY * np.tanh(self.pooled(around(w)) @ self.out[1] / SWAY)

    def gradients(self, w: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        places, kept, pools = (w[:, BEFORE : BEFORE + INSIDE], around(w)), ([], []), []
        for part, keep in zip(places, kept, strict=True):
            pools.append(self.pooled(part, keep))
        turn = np.tanh(pools[1] @ self.out[1] / SWAY)
        m = pools[0] @ self.out[0] + self.bias[0] + SWAY * turn
        d = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / len(y)
        sides = (d, d * (1 - turn * turn))
        g_embed, g_filters, g_biases = np.zeros_like(self.embed), [np.zeros_like(f) for f in self.filters], [np.zeros_like(b) for b in self.biases]
        for part, keep, side, out in zip(places, kept, sides, self.out, strict=True):
            dh = side[:, None] * out[None, :]
            dx, at = np.zeros((*part.shape, self.embed.shape[1])), 0
            for i, ((cols, a, top), f) in enumerate(zip(keep, self.filters, strict=True)):
                width, dim, n = f.shape
                da = np.repeat(dh[:, None, at + n : at + 2 * n] / a.shape[1], a.shape[1], axis=1)
                np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dh[:, None, at : at + n], 1)
                da *= a > 0
                flat = da.reshape(-1, n)
                g_filters[i] += (cols.reshape(-1, width * dim).T @ flat).reshape(f.shape)
                g_biases[i] += flat.sum(axis=0)
                back = (flat @ f.reshape(-1, n).T).reshape(len(w), a.shape[1], width, dim)
                for k in range(width):
                    dx[:, k : k + a.shape[1]] += back[:, :, k]
                at += 2 * n
            np.add.at(g_embed, part.ravel(), dx.reshape(-1, dx.shape[2]))
        return [g_embed, *g_filters, *g_biases, np.stack([p.T @ s for p, s in zip(pools, sides, strict=True)]), np.array([d.sum()])]

    def score(self, w: np.ndarray) -> np.ndarray:
        parts = [self.margin(w[k : k + 512]) for k in range(0, len(w), 512)]
        return self.chance(np.concatenate(parts) if parts else np.zeros(0))

    def chance(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * m + self.platt[1], -30, 30)))


def train(w: np.ndarray, y: np.ndarray, run: np.ndarray, assigned: np.ndarray, recall: float = 0.98, epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the logistic loss over the stretches of three quarters of the runs; Platt scaling and thresholds on the rest.

    y is nan where a stretch has no label of its own; run numbers the runs from 0, assigned is by stretch.
    """
    rng = np.random.default_rng(seed)
    dim, n, widths = 6, 12, (3, 5, 7)
    net = Network(rng.normal(0, 0.3, (2 * PER_PLACE + 2, dim)), [rng.normal(0, (2 / (k * dim)) ** 0.5, (k, dim, n)) for k in widths], [np.zeros(n) for _ in widths], rng.normal(0, 0.1, (2, 2 * n * len(widths))), np.zeros(1))
    order = rng.permutation(int(run.max()) + 1)
    back = np.zeros(len(order), bool)
    back[order[: len(order) // 4]] = True
    labelled = ~np.isnan(y)
    held, own = np.flatnonzero(back[run]), np.flatnonzero(~back[run] & labelled)
    means = [np.zeros_like(p) for p in net.parameters()]
    squares = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        rng.shuffle(own)
        for k in range(0, len(own), batch):
            step += 1
            rows = own[k : k + batch]
            for p, g, m, s in zip(net.parameters(), net.gradients(w[rows], y[rows]), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    sure = held[labelled[held]]
    m, t = net.margin(w[sure]), y[sure]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt: two parameters, plain gradient steps on standardised margins
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        a -= 0.5 * float(((p - t) * m).mean()) / (1 + float((m * m).mean()))
        b -= 0.5 * float((p - t).mean())
    net.platt = (a, b)
    best, secret, after = np.zeros(len(order)), np.zeros(len(order), bool), np.zeros(len(order), bool)
    np.maximum.at(best, run[held], net.score(w[held]))
    secret[run[y == 1]] = True
    after[run[assigned]] = True
    limits = []
    for group in (~after, after):
        secrets = np.sort(best[back & group & secret])
        limits.append(float(secrets[int((1 - recall) * len(secrets))]) if len(secrets) else 0.5)
    net.thresholds = (limits[0], limits[1])
    return net


def read(raw: np.ndarray, offsets: np.ndarray):
    """Runs, stretches (run, start, end), the document of each run, whether it is assigned, and the longest run of each document."""
    starts, ends, longest = token_runs(raw, offsets)
    run, low, high = stretches(raw, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, run, low, high, doc, is_assigned(raw, starts, offsets[doc]), longest


SURE = 16  # bytes of a secret that make a stretch one


def generated(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels, runs and whether assigned, of n generated texts, read as the scan reads them.

    Random keys of many shapes, alone or at the end of a path, against words, numbers, names and addresses; a
    quarter of the other runs of a text is taken along.
    """
    rng = np.random.default_rng(seed)
    chars = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "low": "abcdefghijklmnopqrstuvwxyz0123456789", "digit": "0123456789"}
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    pick = lambda k, m: "".join(rng.choice(list(chars[k]), m))
    word = lambda lo=1, hi=5: "".join(rng.choice(syllables, rng.integers(lo, hi)))
    between = lambda a, b: int(rng.integers(a, b + 1))
    secret = [
        lambda: pick("hex", between(20, 64)), lambda: pick("HEX", between(24, 48)), lambda: pick("b64", between(20, 60)) + "=" * between(0, 2), lambda: pick("url", between(20, 48)), lambda: pick("up", between(16, 32)),
        lambda: pick("low", between(20, 40)), lambda: word(1, 2) + "_" + pick("b64", 36).replace("/", "x").replace("+", "y"), lambda: word(1, 2) + "-" + pick("digit", 10) + "-" + pick("url", 24), lambda: "eyJ" + pick("url", between(20, 40)) + "." + pick("url", 40), lambda: word(1, 2) + "_live_" + pick("url", 24),
        lambda: pick("b64", between(10, 16)).replace("/", "x") + pick("digit", 1), lambda: "".join(rng.choice(list(chars["low"][:26]), between(20, 32))),
    ]
    plain = [
        lambda: word(5, 9) + str(between(1, 99)), lambda: pick("digit", between(12, 19)), lambda: f"{between(1990, 2030)}-{between(1, 12):02d}-{between(1, 28):02d}T{between(0, 23):02d}", lambda: "+" + "-".join(pick("digit", between(2, 4)) for _ in range(4)), lambda: word() + "." + word() + str(between(1, 99)) + ".example",
        lambda: "/".join(word() for _ in range(between(3, 5))) + f".{word(1, 2)}{between(1, 9)}", lambda: "-".join(word() for _ in range(between(3, 5))) + f"-{between(1, 2030)}", lambda: "".join(word().capitalize() for _ in range(between(3, 5))), lambda: f"v{between(0, 9)}.{between(0, 20)}.{between(0, 99)}-{word()}.{between(0, 9)}", lambda: "_".join(word() for _ in range(3)) + f"_{between(1, 99)}",
        lambda: "=" * between(12, 30) + str(between(1, 9)), lambda: ".".join(str(between(0, 255)) for _ in range(4)), lambda: f"{between(1, 9999)}.{word()}.{word(3, 5)}", lambda: "-".join(pick("digit", 4) for _ in range(4)),
        lambda: word(2, 7).upper(), lambda: word(2, 9), lambda: word(2, 5).capitalize() + ["", ".", "-", "_"][between(0, 3)] + word(1, 5),
    ]
    names = ["key", "credential", "auth", "bearer", "access_key", "private", "client", "signature", "id", "ref", "order", "version", "file", "code", "see", "number"]
    path = lambda: ["//", "/", ""][between(0, 2)] + "/".join([word() + "." + word() + ".example", *(word(1, 3) for _ in range(between(1, 4))), "T" + pick("digit", 8)][: between(2, 6)]) + "/"
    texts, spans = [], []
    for i in range(n):
        label = i % 2
        makers = secret if label else plain
        body = makers[between(0, len(makers) - 1)]()
        lead = " ".join(word() for _ in range(between(0, 8)))
        join = ["", " ", f" {rng.choice(names)}=", f" {rng.choice(names)}: ", f' {rng.choice(names)} = "', f" {rng.choice(names)} ", "\n", " ("][between(0, 7)]
        if rng.random() < 0.25:
            join = (" " if lead else "") + ".".join([*(word(1, 3) for _ in range(between(0, 3))), str(rng.choice(names))]) + "="
        text = lead + (join if lead or join.strip() else "") + (path() if rng.random() < 0.25 else "")
        after = [" " + word() + " " + word(), '"', ".\n", ")", "", ", " + word()][between(0, 5)]
        texts.append((text + body + after).encode())
        spans.append((len(text), len(text) + len(body), label))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, run, low, high, doc, assigned, _ = read(raw, offsets)
    a, b, label = (np.array(x) for x in zip(*spans, strict=True))
    a, b = a + offsets[:-1], b + offsets[:-1]
    of = doc[run]
    n_in = np.minimum(high, b[of]) - np.maximum(low, a[of])
    y = np.where((n_in <= 0) | (label[of] == 0), 0.0, np.where(n_in >= np.minimum(SURE, (b - a)[of]), 1.0, np.nan))
    main = (starts < b[doc]) & (ends > a[doc])
    keep = (main | (rng.random(len(starts)) < 0.25))[run]
    w = windows(raw, low[keep], high[keep], offsets[of[keep]], offsets[of[keep] + 1])
    return w, y[keep], np.unique(run[keep], return_inverse=True)[1], assigned[run][keep]


@cache
def _generated(n: int):
    return generated(n)


def looks_like_key(data: bytes) -> bool:
    """Whether a part of twelve characters and more, without separators, has letters and digits, or both cases mixed."""
    for part in re.split(rb"[/._=-]", data):
        if len(part) >= 12:
            upper, lower, digits = (len(re.findall(c, part)) for c in (rb"[A-Z]", rb"[a-z]", rb"[0-9]"))
            if (digits and upper + lower) or (upper > 1 and lower > 1):
                return True
    return False


def _labels(data: bytes, low: np.ndarray, high: np.ndarray, long_run: bool) -> np.ndarray:
    """1 for the stretches of pattern findings' values, 0 beyond the findings, nan where neither is sure."""
    y = np.zeros(len(low))
    for s, kind, e in base_findings(data, long_run):
        a, b = ASSIGN.match(data, s).span(2) if kind == 0 else (s, e)
        y[(np.minimum(high, e) > np.maximum(low, s)) & (y == 0)] = np.nan
        y[np.minimum(high, b) - np.maximum(low, a) >= np.minimum(SURE, np.minimum(b - a, high - low))] = 1.0
    for k in np.flatnonzero((y == 1) | ((y == 0) & (high - low >= 12))):
        if looks_like_key(data[low[k] : high[k]]) != (y[k] == 1):
            y[k] = np.nan
    return y


def _sample(batches):
    """Runs of sampled documents with the windows and labels of their stretches: all with a finding, a 32nd of the others, and a quarter of long words."""
    for batch in batches:
        raw, offsets = buffers(batch.column("_text"))
        starts, ends, run, low, high, doc, assigned, longest = read(raw, offsets)
        cuts = np.searchsorted(doc[run], np.arange(len(offsets)))
        y = np.zeros(len(run))
        for i in range(len(batch)):
            own = slice(cuts[i], cuts[i + 1])
            y[own] = _labels(raw[offsets[i] : offsets[i + 1]].tobytes(), low[own] - offsets[i], high[own] - offsets[i], longest[i] >= 32)
        has = np.zeros(len(starts), bool)
        has[run[~(y == 0)]] = True
        luck = hash_spans(raw, np.maximum(starts - 8, offsets[doc]), ends)
        only = lambda kind: (total := np.concatenate([[0], np.cumsum(kind[raw])]))[ends] - total[starts] == ends - starts
        shouted = ~has & (ends - starts >= SHOUTED_WORD) & only(LETTER & (np.arange(256) < 91))
        word = shouted | (~has & (ends - starts >= LONG_WORD) & only(LETTER))
        picked = has | (luck % np.uint64(32) == 0) | shouted | (word & (luck % np.uint64(4) == 0))
        first = np.searchsorted(run, np.arange(len(starts) + 1))
        rows = []
        for r in np.flatnonzero(picked):
            own = slice(first[r], min(first[r + 1], first[r] + 64))
            at = np.repeat(doc[r], own.stop - own.start)
            rows.append({"w": windows(raw, low[own], high[own], offsets[at], offsets[at + 1]).astype(np.int32).ravel().tolist(), "y": y[own].tolist(), "assigned": bool(assigned[r]), "secret": bool((y[own] == 1).any()), "word": bool(word[r])})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("w", pa.list_(pa.int32())), ("y", pa.list_(pa.float64())), ("assigned", pa.bool_()), ("secret", pa.bool_()), ("word", pa.bool_())]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 5000, max_findings: int = 2000, n_generated: int = 3000, recall: float = 0.98) -> Network:
    """Trained on at most max_findings runs, at most half of them secrets, and as many long words, of about max_docs documents, and on generated ones."""
    step = max(1, docs.count() // max_docs)
    texts = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(step)) == 0).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.mapInArrow(_sample, "w array<int>, y array<double>, assigned boolean, secret boolean, word boolean").withColumn("_h", F.xxhash64("w")).persist()
    got = found.where("secret").orderBy("_h", "assigned").limit(max_findings // 2).collect()
    got += found.where("not secret and not word").orderBy("_h", "assigned").limit(max_findings - len(got)).collect()
    got += found.where("not secret and word").orderBy("_h", "assigned").limit(max_findings).collect()
    found.unpersist()
    w, y, run, assigned = _generated(n_generated)
    if got:
        w = np.concatenate([w, *[np.array(r.w).reshape(-1, WINDOW) for r in got]])
        y = np.concatenate([y, *[np.array(r.y) for r in got]])
        sizes = [len(r.y) for r in got]
        run = np.concatenate([run, np.repeat(run.max() + 1 + np.arange(len(got)), sizes)])
        assigned = np.concatenate([assigned, np.repeat([r.assigned for r in got], sizes)])
    return train(w, y, run, assigned, recall)


def _scores(net: Network, memory: dict, raw: np.ndarray, low: np.ndarray, high: np.ndarray, below: np.ndarray, above: np.ndarray, always: np.ndarray) -> np.ndarray:
    """Score of each stretch; 0 where the network's own part shows that no context lifts it to a threshold, unless always."""
    names, at, back = np.unique(hash_spans(raw, low, high), return_index=True, return_inverse=True)
    known, margins = memory.get("own", (names[:0], np.zeros(0)))
    place = np.searchsorted(known, names)
    old = known[np.minimum(place, len(known) - 1)] == names if len(known) else np.zeros(len(names), bool)
    own = np.zeros(len(names))
    own[old] = margins[place[old]]
    new = np.flatnonzero(~old)
    for k in range(0, len(new), 4096):
        part = at[new[k : k + 4096]]
        own[new[k : k + 4096]] = net.own(windows(raw, low[part], high[part], below[part], above[part])[:, BEFORE : BEFORE + INSIDE])
    if len(known) > 1 << 21:
        memory["own"] = names, own
    elif len(new):
        merged = np.concatenate([known, names[new]])
        order = np.argsort(merged)
        memory["own"] = merged[order], np.concatenate([margins, own[new]])[order]
    most = net.chance(own + SWAY) if net.platt[0] > 0 else np.ones(len(own))
    need = np.flatnonzero((most >= min(net.thresholds) - 1e-9)[back] | always)
    scores = np.zeros(len(low))
    for k in range(0, len(need), 4096):
        part = need[k : k + 4096]
        scores[part] = net.score(windows(raw, low[part], high[part], below[part], above[part]))
    return scores


def _findings(net: Network, memory: dict, raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
    """(start, kind, end, score) in bytes of each document's findings."""
    starts, ends, run, low, high, doc, assigned, longest = read(raw, offsets)
    n = len(offsets) - 1
    base = [[(s, k, e) for s, k, e in base_findings(raw[offsets[i] : offsets[i + 1]].tobytes(), longest[i] >= 32)] if longest[i] >= 8 else [] for i in range(n)]
    edge = np.zeros(len(raw) + 1, np.int64)
    for i in range(n):
        for s, _, e in base[i]:
            edge[offsets[i] + s] += 1
            edge[offsets[i] + e] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    over = covered[high] > covered[low]
    of = doc[run]
    scores = _scores(net, memory, raw, low, high, offsets[of], offsets[of + 1], over)
    hits = np.flatnonzero(over | (scores >= np.where(assigned, net.thresholds[1], net.thresholds[0])[run]))
    touched = covered[ends] > covered[starts]
    cuts = np.searchsorted(of[hits], np.arange(n + 1))
    out = []
    for i in range(n):
        found = [(*f, None) for f in base[i]]
        model: dict[int, list] = {}
        for h in hits[cuts[i] : cuts[i + 1]]:
            a, b, p, r = int(low[h] - offsets[i]), int(high[h] - offsets[i]), float(scores[h]), int(run[h])
            if over[h]:
                for x, f in enumerate(found):
                    if f[0] < b and a < f[2]:
                        found[x] = (*f[:3], max(f[3] or 0.0, p))
            elif touched[r]:
                model.setdefault(r, []).append((a, b, p))
            else:
                model[r] = [(int(starts[r] - offsets[i]), int(ends[r] - offsets[i]), max(p, *(m[2] for m in model.get(r, [(0, 0, 0.0)]))))]
        for parts in model.values():
            joined: list = []
            for a, b, p in sorted(parts):
                if joined and a < joined[-1][2]:
                    joined[-1] = (joined[-1][0], 3, max(b, joined[-1][2]), max(p, joined[-1][3]))
                else:
                    joined.append((a, 3, b, p))
            found += joined
        out.append(sorted(found, key=lambda f: f[:3]))
    return out


def _scan(net: Network):
    def scan(batches):
        memory: dict = {}
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            rows = []
            for a, b in slices(np.diff(offsets), 1 << 22):
                for i, found in enumerate(_findings(net, memory, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    point = np.concatenate([[0], np.cumsum(code_points(raw[offsets[i] : offsets[i + 1]]))]) if found else None
                    rows.append([{"kind": KINDS[k], "start": int(point[s]), "end": int(point[e]), "score": p} for s, k, e, p in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, kind)], ["_id", "findings"])

    return scan


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, findings (kind, start, end, score of the network, null where no candidate run lies in it)."""
    net = learn(docs, id_col, text_col, **options)
    finding = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("findings", T.ArrayType(finding))])
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(_scan(net), schema).withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the pattern findings and all spans as text."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"] != "model")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("findings", named), ",").alias("spans"))
