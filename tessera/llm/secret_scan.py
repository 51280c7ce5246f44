"""Secret scans: candidate rules, and a random forest that removes false positives.

The rules propose candidates widely.  The forest, trained here from labelled
findings that `findings` writes (keys and passwords of the usual forms against
checksums, commits, placeholders, names and paths), looks at a candidate's
length, the transitions between character classes, how much of it dictionary
words cover, its path and the words beside it.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

TREES, DEPTH, LEAST, SEED = 40, 8, 3, 29
THRESHOLD = 0.5
BESIDE = 48  # characters before and after a candidate that count as beside it

RULES = (
    ("aws", re.compile(r"(?<![A-Za-z0-9])(AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), 0),
    ("github", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 0),
    ("slack", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"), 0),
    # Looks once from a run's beginning whether two more runs follow, then for the first eyJ in it: linear in the run.
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})(?:[A-Za-z0-9_-]*?[_-])?(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"), 1),
    # The whole block; without its end, the header and the lines of its body.
    ("private_key", re.compile(r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*?PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)"), 0),
    ("assigned", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|(?:api|access|deploy|private|signing|encryption)[_-]?key|credentials?|bearer|auth)[\"']?\s*+[=:]\s*+[\"']?([^\s\"',;<>]{6,}+)"), 1),
    ("hex", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"), 0),
    ("random", re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+|(?=[a-z+/_-]*+[A-Z])(?=[A-Z+/_-]*+[a-z])[A-Za-z+/_-]{32,}+)={0,2}"), 0),
)
#: No rule matches a text without any of these: the last ones are the beginnings of keys that may be all letters.
TRIGGER = re.compile(r"[0-9=:]|-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ|[a-f]{32}|[A-Za-z+/_-]{32}")

#: Fixed words: what stands beside secrets, beside look-alikes, and inside names and placeholders.
HINTS = frozenset("password passwd pwd secret token key apikey api access auth credential private login bearer".split())
DOUBTS = frozenset("sha1 sha256 md5 commit checksum hash digest revision etag uuid example sample placeholder version integrity changeset".split())
DICTIONARY = tuple(sorted("password secret token example sample change your here test value config default production service user name account admin system file path home usr lib bin src main class function module package import return string number index page image icon button the and with from this that data table column key access change_me none null true false localhost server client public private version release build debug info error".split(), key=len, reverse=True))

FEATURES = (
    "length", "transitions", "lower", "upper", "digits", "signs", "hex_only", "distinct", "entropy", "dictionary", "slashes", "dots", "path", "hint_before", "doubt_before", "hint_after", "doubt_after", "assigned", "known_form", "repeats",
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(rule, start, end), by start; of overlapping ones the first rule's stays, and of the other what the rule finds before it."""
    if not TRIGGER.search(text):
        return []
    out: list[tuple[int, int, str]] = []  # by start, without overlaps
    for name, rule, group in RULES:
        starts, fresh = [a for a, _, _ in out], []
        for m in rule.finditer(text):
            a, b = m.span(group)
            at = bisect.bisect_right(starts, a)  # the first one that starts after a
            if at < len(starts) and starts[at] < b:
                m = rule.match(text, m.start(), starts[at])
                a, b = m.span(group) if m else (a, b)
            if (not at or out[at - 1][1] <= a) and (at == len(starts) or b <= starts[at]):
                fresh.append((a, b, name))
        out = list(heapq.merge(out, fresh)) if fresh else out
    return [(name, a, b) for a, b, name in out]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, found: tuple[str, int, int], path: str = "") -> list[float]:
    rule, a, b = found
    got = text[a:b]
    n = max(len(got), 1)
    kinds = [_kind(c) for c in got]
    counts = Counter(got)
    p = np.array(list(counts.values()), float) / n
    rest = got.lower()
    for w in DICTIONARY:
        rest = rest.replace(w, "\0" * len(w)) if w in rest else rest
    before = set(re.findall(r"[a-z0-9]+", text[max(0, a - BESIDE) : a].lower()))
    after = set(re.findall(r"[a-z0-9]+", text[b : b + BESIDE].lower()))
    return [
        np.log(n), sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / n, *(kinds.count(k) / n for k in range(4)), float(all(c in "0123456789abcdef" for c in got)),
        len(counts) / n, float(-(p * np.log2(p)).sum()), rest.count("\0") / n, got.count("/") / n, got.count(".") / n, float("test" in path or "example" in path or "doc" in path),
        float(bool(before & HINTS)), float(bool(before & DOUBTS)), float(bool(after & HINTS)), float(bool(after & DOUBTS)), float(rule == "assigned"), float(rule in ("aws", "github", "slack", "jwt", "private_key")),
        max(len(m.group()) for m in re.finditer(r"(.)\1*", got, re.S)) / n if got else 0.0,
    ]


@dataclass
class Forest:
    """All trees' nodes in one array; a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean probability of a real secret."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total / max(len(self.roots), 1)


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Forest:
    """Trees on bootstrap rows, each split by Gini over a random third of the features."""
    noise = np.random.default_rng(seed)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def grow(rows: np.ndarray, depth: int) -> int:
        at, mean = len(nodes), float(y[rows].mean())
        nodes.append([0, 0, at, at, mean])
        if not depth or len(rows) < 2 * LEAST or mean in (0.0, 1.0):
            return at
        best = (mean * (1 - mean) * len(rows) - 1e-9, -1, 0.0)
        for j in noise.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, ones = x[order, j], np.cumsum(y[order])
            size = np.arange(1, len(rows) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(size[cut] >= LEAST) & (len(rows) - size[cut] >= LEAST)]
            if len(cut):
                nl, pl = size[cut], ones[cut]
                nr, pr = len(rows) - nl, ones[-1] - pl
                cost = pl * (1 - pl / nl) + pr * (1 - pr / nr)
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (float(cost[k]), int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] >= 0:
            below = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = grow(rows[below], depth - 1)
            nodes[at][3] = grow(rows[~below], depth - 1)
        return at

    roots = [grow(noise.integers(0, len(y), len(y)), DEPTH) for _ in range(TREES)]
    table = np.array(nodes)
    return Forest(np.array(roots), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def findings(noise: np.random.Generator, n: int) -> Iterator[tuple[str, str, int]]:
    """(text, path, label): labelled findings in their surroundings."""
    pick = lambda xs: xs[int(noise.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexes, word = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = word + word.upper() + "0123456789"
    prose = lambda: " ".join(chars(word, int(noise.integers(2, 9))) for _ in range(int(noise.integers(2, 7))))
    hint = lambda: pick(["password", "secret", "token", "api_key", "access_key", "auth", "passwd"])
    name = lambda: pick(["deploy_key", "AWS_KEY", "DB_PASS", "credential", "private_key", "SIGNING", "bearer", "ENCRYPTION_KEY"])
    words = lambda: "".join(pick(DICTIONARY).title() + pick(["", "", "_", "-"]) for _ in range(int(noise.integers(5, 10))))
    body = lambda: "\n".join(chars(mixed + "+/", 64) for _ in range(int(noise.integers(2, 14))))
    pem = lambda whole: f"-----BEGIN {pick(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{body()}" + ("\n-----END RSA PRIVATE KEY-----" if whole else "")
    for _ in range(n):
        path = pick(["src/config.py", "deploy/env.sh", "", "", "tests/data.py", "docs/guide.md", "example/app.js"])
        if noise.random() < 0.5:
            secret = pick([
                f"{hint()}={chars(hexes, int(noise.integers(16, 41)))}", f'{hint()} = "{chars(hexes, 40)}"', f"{hint()}: {chars(mixed + '!#%', int(noise.integers(8, 33)))}", f"AKIA{chars('ABCDEFGHJKLMNPQRSTUVWXYZ234567', 16)}",
                f"ghp_{chars(mixed, 36)}", f"xoxb-{chars('0123456789', 11)}-{chars(mixed, 24)}", f"eyJ{chars(mixed, 20)}.{chars(mixed, 40)}.{chars(mixed + '-_', 43)}", "-----BEGIN RSA PRIVATE KEY-----",
                f"{name()}={chars(mixed, int(noise.integers(24, 65)))}", f"{name()}: {chars(mixed + '+/', 40)}", f"{name()}={chars(word + word.upper(), int(noise.integers(32, 65)))}", f"{hint()} {chars(word + word.upper(), 40)}", pem(True), pem(False),
                f"{hint()} {chars(mixed, 40)}", f'{hint()} "{chars(hexes, 64)}"', f"{hint()} = '{chars(mixed, 24)}'",
            ])
            yield f"{prose()} {secret} {prose()}", path, 1
        else:
            plain = pick([
                f"commit {chars(hexes, 40)}", f"sha256 {chars(hexes, 64)}", f"md5 checksum {chars(hexes, 32)}", f"{hint()} = your_{hint()}_here", f"{hint()}: <change_me>", f"{hint()}=example_value_1", f"{hint()} = None123",
                f"/usr/lib/{chars(word, 8)}/{chars(word, 12)}/{chars(word, 6)}2/index", f"{hint()}=config.get_default_value1", f"{hint()}: {'x' * int(noise.integers(8, 20))}", f"{chars(word, 9)}_{chars(word, 8)}_{chars(word, 9)}_2",
                f"{words()}", f"class={words()}", f"see /{words()}/{words()}2/{words()}", f"url=/{words()}/{words()}3?page={chars('0123456789', 5)}", f"{name()}={words()}", f"checksum={chars(hexes, 40)}", f"version={chars('0123456789', 24)}", "-----BEGIN PUBLIC KEY-----",
                f"uuid {chars(hexes, 32)}", f"etag {chars(hexes, 32)}", chars("0123456789", int(noise.integers(24, 40))), "-" * 30 + "1", f"{hint()} = 'example_{chars(word, 6)}'", f"revision {chars(hexes, 40)} example", f"{hint()}: {chars(word, 8)}",
            ])
            yield f"{prose()} {plain} {prose()}", path, 0


@functools.cache
def trained(n: int = 4_000, seed: int = SEED) -> Forest:
    """The forest; the same every time."""
    x, y = training_rows(n, seed)
    return fit(x, y)


def training_rows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, path, label in findings(np.random.default_rng(seed), n):
        for found in candidates(text):
            x.append(features(text, found, path))
            y.append(label)
    return np.array(x, float), np.array(y, float)


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (rule:start:end by start, code
    points, comma-joined), top_score of every document's whole text.

    path names a column of file paths, if there is one.  A null text counts as
    empty and has no candidates (top_score null); a null doc_id stays null;
    repeated rows give repeated rows; no shuffle.
    """
    forest = trained()
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column("text").to_pylist(), batch.column("path").to_pylist()
            found = [candidates(t) for t in texts]
            x = [features(t, f, p or "") for t, p, fs in zip(texts, paths, found, strict=True) for f in fs]
            scores = forest.score(np.array(x, float)).tolist() if x else []
            n, secrets, tops, at = [], [], [], 0
            for fs in found:
                own, at = scores[at : at + len(fs)], at + len(fs)
                real = [f for f, s in zip(fs, own, strict=True) if s >= THRESHOLD]
                n.append(len(real))
                secrets.append(",".join(f"{r}:{a}:{b}" for r, a, b in real))
                tops.append(max(own, default=None))
            columns = [batch.column("doc_id"), pa.array(list(map(len, found)), pa.int64()), pa.array(n, pa.int64()), pa.array(secrets, pa.string()), pa.array(tops, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_candidates", "n_secrets", "secrets", "top_score"])

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return docs.select("doc_id", text_of(docs).alias("text"), where.alias("path")).mapInArrow(run, f"doc_id {kept}, n_candidates long, n_secrets long, secrets string, top_score double")
