"""Personal data: exact patterns, and a character-level BiLSTM with CRF transitions.

The patterns give the base spans.  The network, trained here in numpy from
labelled spans, adds spans that the patterns miss, such as phone numbers
without a plus sign.  Some of its examples are cut from the documents
themselves, with the base matches as labels, so that it knows what else stands
there; the others `examples` writes: forms that the patterns miss, and
look-alikes, in made-up prose.

A text is covered by windows of `WINDOW` characters that overlap by half.  No
span may lack both a digit and an at sign, so only windows that have one, and
their neighbours, go through the network; everything else is outside of spans
by that rule.  Each character's scores are averaged over its windows, weighted
towards their middles, and each unbroken stretch of windows is decoded as one
sequence: that reconciles the windows.  A decoded span is kept if its
probability, over all tag sequences of the stretch, is `SURE` or more, if it
begins and ends where words do and touches no base span.  The network can't
compute how many digits a number has nor Luhn: a card must have 12 to 19 and
pass it, a phone number 7 to 15.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
HIDDEN, STEPS, BATCH, LENGTH, RATE = 16, 320, 128, 80, 0.04
#: Made-up examples.
EXAMPLES = 4_000
#: The least probability of an added span.
SURE = 0.5
#: At most so many examples are cut from the documents, one from each, chosen by hash.
CUTS = 1_500

# ---------------------------------------------------------------- patterns

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind and possessive repeats change no match, but keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address's local part reaches back from its at sign to the last match or a character that it can't hold."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 14 <= len(digits := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- network

_SPECIAL = "@.-+()_ \n,:/%="
CODES = 2 + 26 + 1 + len(_SPECIAL) + 1  # padding, other letters, a to z, digits, specials, the rest
TAGS = 1 + 2 * len(KINDS)


def _code_table() -> np.ndarray:
    table = np.full(256, CODES - 1, np.int64)
    for i in range(26):
        table[65 + i] = table[97 + i] = 2 + i
    table[48:58] = 28
    for i, c in enumerate(_SPECIAL):
        table[ord(c)] = 29 + i
    table[192:256] = 1
    return table


_CODE = _code_table()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 256, _CODE[np.minimum(points, 255)], 1)


def _added_up(m: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of what m holds the logarithms of."""
    top = m.max(axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(m - top).sum(axis))


@dataclass
class Network:
    """Two LSTMs over characters, one from each end, scores of tags, and CRF
    transitions.  Both LSTMs run side by side: axis 0 of x and u."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        noise, h = np.random.default_rng(seed), HIDDEN
        p = {"x": noise.normal(0, 0.3, (2, CODES, 4 * h)), "u": noise.normal(0, 0.3, (2, h, 4 * h)), "e": noise.normal(0, 0.3, (2 * h, TAGS)), "c": np.zeros(TAGS), "t": noise.normal(0, 0.1, (TAGS, TAGS))}
        p["x"][:, :, h : 2 * h] += 1  # remember at first
        return cls(p)

    def _run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of the steps of x (steps, rows): (steps, rows, 2 * HIDDEN)."""
        h_size, u = HIDDEN, self.p["u"]
        steps, rows = x.shape
        z = np.stack([self.p["x"][0][x], self.p["x"][1][x[::-1]]], 1)
        h, c = np.zeros((2, rows, h_size), u.dtype), np.zeros((2, rows, h_size), u.dtype)
        out = np.empty((steps, 2, rows, h_size), u.dtype)
        for t in range(steps):
            z[t] += h @ u
            s = 1 / (1 + np.exp(-z[t, :, :, : 3 * h_size]))
            i, f, o, g = s[:, :, :h_size], s[:, :, h_size : 2 * h_size], s[:, :, 2 * h_size :], np.tanh(z[t, :, :, 3 * h_size :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            if keep is not None:
                keep.append((before_h, before_c, i, f, o, g, tc))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def _back(self, x: np.ndarray, kept: list, dhidden: np.ndarray, grad: dict) -> None:
        h_size, u = HIDDEN, self.p["u"]
        dout = np.stack([dhidden[:, :, :h_size], dhidden[::-1, :, h_size:]], 1)
        back = u.transpose(0, 2, 1)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        every = np.empty((*dout.shape[:3], 4 * h_size), u.dtype)
        for t in range(len(x) - 1, -1, -1):
            _, c0, i, f, o, g, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc**2)
            dz = every[t]
            dz[:, :, :h_size] = dc * g * i * (1 - i)
            dz[:, :, h_size : 2 * h_size] = dc * c0 * f * (1 - f)
            dz[:, :, 2 * h_size : 3 * h_size] = dh * tc * o * (1 - o)
            dz[:, :, 3 * h_size :] = dc * i * (1 - g**2)
            dh, dc = dz @ back, dc * f
        before = np.stack([k[0] for k in kept])
        for d, own in ((0, x), (1, x[::-1])):
            flat = every[:, d].reshape(-1, 4 * h_size)
            grad["u"][d] = before[:, d].reshape(-1, h_size).T @ flat
            order = np.argsort(own.ravel(), kind="stable")
            used, heads = np.unique(own.ravel()[order], return_index=True)
            grad["x"][d][used] = np.add.reduceat(flat[order], heads)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tags' scores of windows x (rows, steps): (rows, steps, tags)."""
        x = x.T
        return (self._run(x) @ self.p["e"] + self.p["c"]).transpose(1, 0, 2)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for sequences x with tags y, both (rows, steps)."""
        x, y = x.T, y.T
        steps, rows = x.shape
        kept: list = []
        hidden = self._run(x, kept)
        e, trans = hidden @ self.p["e"] + self.p["c"], self.p["t"]
        a, b = self.sums(e)
        whole = _added_up(a[-1], 1)
        de = np.exp(a + b - whole[:, None])
        r = np.arange(rows)
        pairs = np.exp(a[:-1, :, :, None] + trans + (e + b)[1:, :, None, :] - whole[:, None, None]).sum((0, 1))
        gold = e[0, r, y[0]].copy()
        for t in range(steps):
            de[t, r, y[t]] -= 1
            if t:
                gold += trans[y[t - 1], y[t]] + e[t, r, y[t]]
        np.subtract.at(pairs, (y[:-1], y[1:]), 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["t"], grad["c"] = pairs, de.sum((0, 1))
        grad["e"] = hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        self._back(x, kept, de @ self.p["e"].T, grad)
        return float((whole - gold).mean()), {k: v / rows for k, v in grad.items()}

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the weights of all tag sequences up to each tag, and from it on, of scores e (steps, rows, tags)."""
        a, b, trans = np.empty_like(e), np.zeros_like(e), self.p["t"]
        a[0] = e[0]
        for t in range(1, len(e)):
            a[t] = _added_up(a[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = _added_up(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
        return a, b

    def probabilities(self, e: np.ndarray, tags: np.ndarray, spans: list[list[Span]]) -> list[list[float]]:
        """How likely each decoded span of each sequence is: it begins where it does, goes on with its tags and ends there."""
        trans, steps, out = self.p["t"], e.shape[1], []
        a, b = self.sums(e.transpose(1, 0, 2))
        for row, own in enumerate(spans):
            y, whole = tags[row], _added_up(a[-1, row], 0)
            along = np.r_[0.0, np.cumsum(trans[y[:-1], y[1:]] + e[row, np.arange(1, steps), y[1:]])]
            chances = []
            for start, kind, stop in own:
                last = 0.0
                if stop < steps:  # any tag follows but the span's own
                    after = trans[y[stop - 1]] + e[row, stop] + b[stop, row]
                    last = _added_up(np.delete(after, 2 + 2 * kind), 0)
                chances.append(float(np.exp(min(0.0, a[start, row, y[start]] + along[stop - 1] - along[start] + last - whole))))
            out.append(chances)
        return out

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of sequences with scores e (rows, steps, tags)."""
        rows, steps, _ = e.shape
        trans, back = self.p["t"], np.empty((steps, rows, TAGS), np.int8)
        best = e[:, 0]
        for t in range(1, steps):
            m = best[:, :, None] + trans
            back[t] = m.argmax(1)
            best = m.max(1) + e[:, t]
        out = np.empty((rows, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(rows), out[:, t]]
        return out


def examples(noise: np.random.Generator) -> tuple[str, list[Span]]:
    """A line of made-up prose with labelled spans and look-alikes."""
    pick = lambda xs: xs[int(noise.integers(len(xs)))]
    digits = lambda n: "".join(map(str, noise.integers(0, 10, n)))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la qui eau é ü ción ung sch ñ ä".split()

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(noise.integers(1, 5))))
        return pick([w, w, w, w.capitalize(), w + ",", w + "."])

    def name() -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(noise.integers(2, 9))))

    def card() -> str:
        body = pick("3456") + digits(int(noise.integers(12, 15)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area, a, b = digits(3), digits(3), digits(4)
        if noise.random() < 0.25:  # by pairs, or an area code that begins with 0
            return pick([" ".join(["0" + digits(1), *(digits(2) for _ in range(4))]), f"0{digits(2)} {digits(7)}", f"(0{digits(2)}) {a} {b}", f"0{digits(3)}-{digits(7)}", f"0{digits(3)}/{digits(6)}"])
        land = pick(["", "", "+1 ", "+" + digits(2) + " ", "1-", "001 "])
        return land + pick([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}", f"({area}) {a} {b}"])

    def email() -> str:
        host = pick(["mail", "example", name()]) + pick(["", digits(1)])
        return f"{name()}{pick(['.', '_', '', '-'])}{pick([digits(2), name()])}{pick(['@', '@', ' @ ', '@ '])}{host}.{pick(['com', 'org', 'net', 'example.com', 'de'])}"

    def ip() -> str:
        return pick([".".join(str(x) for x in noise.integers(0, 256, 4)), ":".join(f"{x:x}" for x in noise.integers(1, 65536, 8)), "::".join(":".join(f"{x:x}" for x in noise.integers(1, 65536, n)) for n in noise.integers(1, 4, 2))])

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(noise.integers(16, 41))))
        return pick([
            f'token = "{hexes}"', f"password={hexes}", "AKIA" + "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), f"version {digits(1)}.{digits(1)}.", f"{digits(4)}-{digits(2)}-{digits(2)}",
            f"CC BY-NC {digits(1)}.0.", digits(int(noise.integers(1, 13))), f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"http://{name()}.com/{digits(3)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"§ {digits(2)}", digits(20), f"{digits(3)} {digits(2)}",
            f"{digits(4)}-{digits(4)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(2)},{digits(3)},{digits(3)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"@{name()}", f"{name()}@{name()}", f"{name()} @ {name()}",
            f"{name()}{digits(3)}", f"({digits(4)})", f"{digits(3)} {digits(3)}", ":".join(hexes[i : i + 2] for i in range(0, 12, 2)),
        ])

    makers = (email, ip, card, phone)
    text, spans = "", []
    while len(text) < 2 * LENGTH:
        roll = noise.random()
        if roll < 0.2:
            kind = int(noise.integers(4))
            made = makers[kind]()
            spans.append((len(text), kind, len(text) + len(made)))
            text += made
        else:
            text += other() if roll < 0.3 else word()
        text += pick([" ", " ", " ", " ", "\n", ", "])
    return text, spans


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, kind, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def cut(text: str, chance: int) -> tuple[bytes, bytes] | None:
    """A piece of the text around one of its digits or at signs, as codes and
    tags: base spans, and numbers that lack only Luhn to be cards.  None if it
    has none, or if a longer run of digits makes the labels doubtful."""
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    if not triggers:
        return None
    at = max(0, triggers[chance % len(triggers)] - chance // 7 % LENGTH)
    labels = [*base_spans(text)]
    known = {(a, b) for a, _, b in labels}
    for m in _CARD.finditer(text):
        n = len(re.sub(r"[\x20-]", "", m.group()))
        if n > 19 and m.start() < at + LENGTH and m.end() > at:
            return None
        if 14 <= n <= 19 and m.span() not in known and m.end() - m.start() <= 37:
            labels.append((m.start(), 2, m.end()))
    x, y = np.zeros(LENGTH, np.uint8), np.zeros(LENGTH, np.uint8)
    piece = codes(text[at : at + LENGTH])
    x[: len(piece)] = piece
    near = [(a - at, k, b - at) for a, k, b in labels if a < at + LENGTH and b > at]
    for a, k, b in near:
        y[max(a, 0) : b] = 2 + 2 * k
        if a >= 0:
            y[a] = 1 + 2 * k
    return x.tobytes(), y.tobytes()


def cuts(docs: DataFrame, most: int = CUTS) -> tuple[tuple[bytes, bytes], ...]:
    """Labelled pieces of at most so many documents, those with the least
    hashes of doc_id and text among a share of about sixteen times as many."""
    share = min(1.0, 16 * most / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(h, *c) for h, t in zip(*(batch.column(k).to_pylist() for k in ("h", "text")), strict=True) if (c := cut(t, h >> 20))]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["h", "x", "y"])

    hashed = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), text_of(docs).alias("text"))
    rows = hashed.filter(F.col("h") % (1 << 20) < int(share * (1 << 20))).mapInArrow(run, "h long, x binary, y binary").orderBy("h", "x", "y").limit(most)
    return tuple((bytes(r["x"]), bytes(r["y"])) for r in rows.collect())


@functools.lru_cache(4)
def trained(pieces: tuple[tuple[bytes, bytes], ...] = (), steps: int = STEPS, seed: int = 7) -> Network:
    """The network, fitted by Adam to made-up examples and these pieces of documents; the same every time."""
    noise = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(EXAMPLES):
        text, spans = examples(noise)
        tags = _tags(len(text), spans)
        at = int(noise.integers(0, len(text) - LENGTH))
        x, y = codes(text)[at : at + LENGTH].copy(), tags[at : at + LENGTH].copy()
        if noise.random() < 0.2:  # a text's edge
            cut = int(noise.integers(1, LENGTH))
            x[cut:], y[cut:] = 0, 0
        xs.append(x)
        ys.append(y)
    for x, y in pieces:
        xs.append(np.frombuffer(x, np.uint8).astype(np.int64))
        ys.append(np.frombuffer(y, np.uint8).astype(np.int64))
    xs, ys = np.array(xs), np.array(ys)
    net = Network({k: v.astype(np.float32) for k, v in Network.fresh().p.items()})  # single precision while it learns
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for i in range(1, steps + 1):
        rows = noise.integers(0, len(xs), BATCH)
        _, grad = net.step(xs[rows], ys[rows])
        rate = RATE * min(1, 2 * (1 - i / (steps + 1)))
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return Network({k: v.astype(np.float64) for k, v in net.p.items()})


def stretches(text: str) -> list[tuple[int, int]]:
    """Where windows that have a digit or an at sign, and their neighbours, follow each other: start and end."""
    n, out = len(text), []
    for m in _TRIGGER.finditer(text):
        cell = m.start() // STRIDE  # the trigger is in windows cell - 1 and cell
        a, b = max(0, (cell - 2) * STRIDE), min(n, (cell + 1) * STRIDE + WINDOW)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


def found(net: Network, parts: list[str], least: float = 0.0) -> list[list[Span]]:
    """The spans that the network sees in each of these stretches of text, with at least such a probability."""
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    out: list[list[Span]] = [[] for _ in parts]
    at = 0
    while at < len(order):
        group, size = [], 0
        while at < len(order) and (not group or (size + len(parts[order[at]]) <= 200_000 and len(parts[order[at]]) <= 1.3 * len(parts[group[0]]) + WINDOW)):
            group.append(order[at])
            size += len(parts[order[at]])
            at += 1
        steps = max(WINDOW, -(-max(len(parts[i]) for i in group) // STRIDE) * STRIDE)
        x = np.zeros((len(group), steps), np.int64)
        for row, i in enumerate(group):
            x[row, : len(parts[i])] = codes(parts[i])
        heads = np.arange(0, steps - WINDOW + 1, STRIDE)
        windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW, 1)[:, heads]
        flat = windows.reshape(-1, WINDOW)
        e = np.concatenate([net.scores(flat[i : i + 1024]) for i in range(0, len(flat), 1024)]).reshape(*windows.shape, TAGS)
        total, weight = np.zeros((*x.shape, TAGS)), np.zeros(steps)
        for k, head in enumerate(heads):
            total[:, head : head + WINDOW] += e[:, k] * _WEIGHT[:, None]
            weight[head : head + WINDOW] += _WEIGHT
        e = total / weight[:, None]
        tags = net.decode(e)
        spans = [_spans(tags[row, : len(parts[i])]) for row, i in enumerate(group)]
        some = [row for row, own in enumerate(spans) if own] if least > 0 else []
        for row, own in zip(some, net.probabilities(e[some], tags[some], [spans[row] for row in some]) if some else [], strict=True):
            spans[row] = [s for s, p in zip(spans[row], own, strict=True) if p >= least]
        for row, i in enumerate(group):
            out[i] = spans[row]
    return out


def _spans(tags: np.ndarray) -> list[Span]:
    inside = tags > 0
    if not inside.any():
        return []
    kind = (tags - 1) // 2
    begin = inside & (np.r_[True, ~inside[:-1] | (kind[1:] != kind[:-1])] | (tags % 2 == 1))
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(np.r_[begin[1:] | ~inside[1:], True]) + 1  # where a span, if one is open, is over
    stops = ends[np.searchsorted(ends, starts, "right")]
    return list(zip(starts.tolist(), kind[starts].tolist(), stops.tolist(), strict=True))


def passes(text: str, span: Span) -> bool:
    """Whether the span cuts no word, number or code, has a digit or an at sign, and, if it is a card or a phone number, as many digits as one; a card passes Luhn."""
    a, kind, b = span
    got = text[a:b]
    if (a and (text[a - 1].isalnum() or text[a - 1] in "+=\"'@/_")) or (b < len(text) and (text[b].isalnum() or text[b] in "=\"'@/_")):
        return False
    digits = re.sub(r"[^0-9]", "", got)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 if kind == 3 else bool(_TRIGGER.search(got))


def added(net: Network, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the network adds to each text's base spans."""
    places = [(i, a, b) for i, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[Span]] = [[] for _ in texts]
    starts = [[a for a, _, _ in spans] for spans in base]
    reach = [[0, *itertools.accumulate((b for _, _, b in spans), max)] for spans in base]  # the furthest end of the first ones
    for (i, start, _), spans in zip(places, found(net, [texts[i][a:b] for i, a, b in places], SURE), strict=True):
        for a, kind, b in spans:
            piece = texts[i][start + a : start + b]
            a, b = a + len(piece) - len(piece.lstrip(" \n,.")), b - (len(piece) - len(piece.rstrip(" \n,.")))
            span = (start + a, kind, start + b)
            apart = reach[i][bisect.bisect_left(starts[i], span[2])] <= span[0] and (not out[i] or out[i][-1][2] <= span[0])
            if a < b and apart and passes(texts[i], span):
                out[i].append(span)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all), n_added, n_spans (all) of every document.

    A null text counts as empty: no spans, the hash of nothing.  A null doc_id
    stays null; repeated rows give repeated rows; no shuffle but of the `CUTS`
    training pieces.  Documents without a digit or an at sign cost one search.
    """
    net = trained(cuts(docs))
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                texts = batch.column("text").to_pylist()
                rows = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
                base: list[list[Span]] = [[] for _ in texts]
                more: list[list[Span]] = [[] for _ in texts]
                for i in rows:
                    base[i] = base_spans(texts[i])
                for i, spans in zip(rows, added(net, [texts[i] for i in rows], [base[i] for i in rows]), strict=True):
                    more[i] = spans
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
                hashes = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
                spans = pa.array([written(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string())
                columns = [batch.column("doc_id"), *counts, hashes, spans, pa.array(list(map(len, more)), pa.int64()), pa.array([len(b) + len(m) for b, m in zip(base, more, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kept}, {fields}")
