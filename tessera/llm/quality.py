"""A quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised traversal.

The statistics come from whole texts by table look-ups and segmented sums over
the batch's UTF-8 bytes.  The trees are fitted by the driver on at most
`SAMPLE` labelled documents, chosen by hash, of which only the statistics
leave the executors; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, text_of

#: Bytes of text whose statistics are taken at once, unless one text is longer.
CHUNK = 1 << 20
#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 8_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.2, 64, 10, 1.0

FEATURES = (
    "log_words", "word_length", "word_length_sd", "longest_word", "upper", "digits", "symbols", "bars", "exclamations", "stops", "non_ascii",
    "capitalised", "distinct_words", "repeated_neighbours", "distinct_lines", "log_lines", "symbol_words", "upper_words",
)


def _tables() -> dict[str, np.ndarray]:
    codes = np.arange(256)
    is_in = lambda chars: np.isin(codes, list(chars.encode())).astype(np.uint8)
    upper = ((codes >= 65) & (codes <= 90)).astype(np.uint8)
    return {
        "space": ((codes == 32) | ((codes >= 9) & (codes <= 13))).astype(np.uint8),
        "upper": upper,
        "lower": ((codes >= 97) & (codes <= 122)).astype(np.uint8),
        "digits": ((codes >= 48) & (codes <= 57)).astype(np.uint8),
        "symbols": is_in("#$%&*^~`@\\/<>{}[]=+_|!?"),
        "bars": is_in("|"),
        "exclamations": is_in("!"),
        "stops": is_in(".,;:"),
        "non_ascii": (codes >= 128).astype(np.uint8),
        "newline": (codes == 10).astype(np.uint8),
    }


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over [begin, end), empty ones 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[end] - total[begin]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    key = (owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of FEATURES for the texts raw[begin[i]:end[i]] of UTF-8 bytes, which adjoin."""
    tables, n = _tables(), len(begin)
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    noise = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
    size = np.maximum(end - begin, 1)
    col = {name: i for i, name in enumerate(FEATURES)}
    count = {k: _sums(tables[k][raw], begin, end) for k in ("upper", "digits", "symbols", "bars", "exclamations", "stops", "non_ascii", "newline")}
    for k in ("digits", "symbols", "bars", "exclamations", "stops", "non_ascii"):
        out[:, col[k]] = count[k] / size
    out[:, col["upper"]] = count["upper"] / np.maximum(count["upper"] + _sums(tables["lower"][raw], begin, end), 1)

    solid = tables["space"][raw] == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = begin[(begin < len(raw)) & (begin < end)]
    first[bounds] = solid[bounds]
    heads = np.flatnonzero(first)
    owner = np.searchsorted(end, heads, "right")
    words = np.bincount(owner, minlength=n)
    many = np.maximum(words, 1)
    if len(heads):
        inside = solid.astype(np.int64)
        length = np.add.reduceat(inside, heads)
        place = np.zeros(len(raw), np.int64)
        place[heads[0] :] = np.arange(heads[0], len(raw)) - np.repeat(heads, np.diff(np.append(heads, len(raw))))
        hashes = np.add.reduceat(np.where(solid, noise[raw] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.uint64(0)), heads)
        out[:, col["log_words"]] = np.log1p(words)
        mean = np.bincount(owner, length, n) / many
        out[:, col["word_length"]] = mean
        out[:, col["word_length_sd"]] = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / many - mean**2, 0))
        np.maximum.at(out[:, col["longest_word"]], owner, np.log1p(length))
        out[:, col["capitalised"]] = np.bincount(owner, tables["upper"][raw[heads]], n) / many
        out[:, col["distinct_words"]] = _distinct(owner, hashes, n) / many
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out[:, col["repeated_neighbours"]] = np.bincount(owner[1:], same, n) / many
        marked = np.add.reduceat(tables["symbols"][raw].astype(np.int64), heads)
        out[:, col["symbol_words"]] = np.bincount(owner, marked > 0, n) / many
        shouted = np.add.reduceat(tables["upper"][raw].astype(np.int64), heads)
        out[:, col["upper_words"]] = np.bincount(owner, 2 * shouted > length, n) / many

        breaks = np.flatnonzero(tables["newline"][raw])
        line = np.unique(np.concatenate([bounds, breaks + 1]))
        line = line[line < len(raw)]
        line_owner = np.searchsorted(end, line, "right")
        head_line = np.searchsorted(line, heads, "right") - 1
        turned = hashes * ((np.arange(len(heads)) - np.searchsorted(heads, line)[head_line]).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        edges = np.flatnonzero(np.diff(head_line, prepend=-1))
        line_hash = np.add.reduceat(turned, edges)
        holder = line_owner[head_line[edges]]
        filled = np.bincount(holder, minlength=n)
        out[:, col["distinct_lines"]] = _distinct(holder, line_hash, n) / np.maximum(filled, 1)
        out[:, col["log_lines"]] = np.log1p(filled)
    return out


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """statistics() of an Arrow array of strings."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    out, at = np.zeros((len(texts), len(FEATURES))), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        out[at:upto] = statistics(raw[ends[at] : ends[upto]], ends[at:upto] - ends[at], ends[at + 1 : upto + 1] - ends[at])
        at = upto
    return out


@dataclass
class Trees:
    """Flattened trees: of node i, feature, threshold (left if below or equal)
    and children; leaves point to themselves and hold a value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int = DEPTH

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, for all rows at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts logistic loss over histograms of quantile bins.  Without both
    labels there is nothing to split: every score is the labels' mean, or 0.5
    without labels."""
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        margin = np.full(len(y), base)

        def node(**k) -> int:
            at = len(feature)
            for held, name in ((feature, "feature"), (threshold, "threshold"), (left, "left"), (right, "right"), (value, "value")):
                held.append(k.get(name, at if name in ("left", "right") else 0))
            return at

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, -1)
            if depth and len(rows) >= 2 * LEAST:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + RIDGE) + (sum_g - gl) ** 2 / (sum_h - hl + RIDGE) - sum_g**2 / (sum_h + RIDGE)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                return node(value=-RATE * sum_g / (sum_h + RIDGE))
            _, j, k = best
            at = node(feature=j, threshold=edges[j][k])
            below = binned[rows, j] <= k
            left[at], right[at] = grow(rows[below], g, h, depth - 1), grow(rows[~below], g, h, depth - 1)
            return at

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            before = len(feature)
            grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH)
            roots.append(before)
            one = Trees(np.array([before]), *map(np.array, (feature, threshold, left, right, value)), 0.0)
            margin += -np.log(1 / one.score(x) - 1)
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), base)


def held_out(doc_id: Column) -> Column:
    """Whether the document's labels are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on labelled documents that aren't held out."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("__y"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(batch_statistics(batch.column("text")).ravel())
            x = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("__y").cast(pa.int64()), x], names=["id", "y", "x"])

    # Rows of one doc_id give one example, whichever order they come in; one row for each goes to the driver.
    got = rows.select("doc_id", "text", "__y").mapInArrow(run, "id long, y long, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas()
    got = got.sort_values("id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted of every document; keep: docs' columns and __score.

    Null and empty texts are scored alike, as texts without words; repeated
    rows are scored alike; no shuffle.
    """
    names = docs.columns if keep else ["doc_id"]
    out = docs.select(*(docs[c] for c in names), text_of(docs).alias("__text"))
    schema = out.schema
    result = out.drop("__text").schema.add("__score", "double")
    kept = [f.name for f in result.fields][:-1]
    at = schema.fieldNames().index("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                scores = trees.score(batch_statistics(batch.column(at)))
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*kept, "__score"])
        give_back()

    return out.mapInArrow(run, result)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier doesn't reject, with docs' columns."""
    return score(docs, train(docs, labels, sample), keep=True).filter(F.col("__score") >= THRESHOLD).drop("__score")
