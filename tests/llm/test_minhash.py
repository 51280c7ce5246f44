"""Against brute force over all pairs."""

import random

import numpy as np

from tests.llm.conftest import AWKWARD
from tessera.llm import minhash


def sets(rows):
    out = []
    for doc, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
        w = [x for part in w for x in part.replace("\n", "\t").replace("\r", "\t").replace("\x0b", "\t").replace("\x0c", "\t").split("\t") if x]
        out.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows, percent=85):
    all_ = sets(rows)
    top = {d: d for d, _ in all_ if d is not None}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, (a, x) in enumerate(all_):
        for b, y in all_[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in all_), key=repr)


def run(docs, percent=85):
    got = minhash.classes(docs, percent).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def near(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for base in range(6):
        words = [r.choice(vocabulary) for _ in range(r.choice([30, 120, 200]))]
        for _ in range(n):
            copy = list(words)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randrange(1000)
            rows.append((len(rows) + 100 * base, " ".join(copy)))
    r.shuffle(rows)
    return rows


def test_awkward(awkward, nothing):
    assert run(awkward) == brute([r[:2] for r in AWKWARD])
    assert minhash.classes(nothing).count() == 0
    kept = minhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, None, 7, 8, 9, 10}  # 1 and 2 are 9 / 11 alike


def test_near_copies(spark, monkeypatch):
    rows = near(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)
    assert run(docs, 80) == brute(rows, 80)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)  # many blocks
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1)
    assert run(docs) == brute(rows)


def test_a_doc_id_with_different_texts(spark):
    """Every row is linked by its own text, and the rows of one doc_id are one document."""
    r = random.Random(4)
    words = ["v%d" % i for i in range(900)]
    a, b, c = (" ".join(r.sample(words, 100)) for _ in range(3))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, c), (9, c + " more"), (9, ""), (8, None), (None, a), (10, ""), (10, "")]
    for some in (rows, rows[::-1], [(12 - d if d else d, t) for d, t in rows]):
        assert run(spark.createDataFrame(some, "doc_id long, text string")) == brute(some)


def test_signature_estimates_similarity():
    family, noise = minhash.Circulant(), np.random.default_rng(0)
    a = noise.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], noise.integers(0, 2**63, 200, dtype=np.uint64)])
    same = (family.signature(a) == family.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.1
