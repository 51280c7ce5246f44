"""Base spans against the plain patterns; the network on examples that it hasn't seen."""

import itertools
import random
import re
import time

import numpy as np

from tessera.llm import pii


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(1)
    pieces = ["a.b@c.d", "@", ".", "1.2.3.4", "300.1.1.1", "+1 (988) 555-2485", "4111 1111 1111 1111", "-", " ", "x", "9", "0", "a@b@c.com", "1.2.3.4.5.6.7.8", "é", "\n", "4111-1111-1111-1111", "+", "%"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000):
        pii.base_spans(text)


def test_network():
    net, noise = pii.trained(), np.random.default_rng(5)
    rows = [pii.examples(noise) for _ in range(200)]
    hits = wrong = missed = 0
    for (_, truth), got in zip(rows, pii.found(net, [t for t, _ in rows]), strict=True):
        hits, wrong, missed = hits + len({*truth} & {*got}), wrong + len({*got} - {*truth}), missed + len({*truth} - {*got})
    assert hits / (hits + wrong) > 0.85 and hits / (hits + missed) > 0.85


def test_adds_what_the_patterns_miss():
    text = "Call the thing on +1 (269) 555-3296 4524132264652876 and 555-201-4477 soon. " + "then word " * 60 + "phone 555-201-4478 end"
    base = [pii.base_spans(text)]
    got = {(pii.KINDS[k], text[a:b]) for a, k, b in pii.added(pii.trained(), [text], base)[0]}
    assert ("card", "4524132264652876") in got and ("phone", "555-201-4478") in got
    assert pii.added(pii.trained(), ["Card 4524132264652877 here"], [[]]) == [[]]  # fails Luhn
    clean = "Version 2.0. of 2024-01-02 costs $12.50, see section 4.2 and id 12345 or commit 4d2f0a9c8b7e6d5c."
    assert pii.added(pii.trained(), [clean], [pii.base_spans(clean)]) == [[]]


def test_skipped_windows_hold_nothing(monkeypatch):
    """Texts taken whole give the spans that the windows with digits and at signs give, with nearly the same probability."""
    noise, net = np.random.default_rng(11), pii.trained()
    prose = lambda: "".join(pii.examples(noise)[0] if noise.random() < 0.3 else "plain words without any of it, on and on. " * int(noise.integers(1, 9)) for _ in range(6))
    texts = [prose() for _ in range(60)]
    base = [pii.base_spans(t) for t in texts]
    some = pii.added(net, texts, base)
    monkeypatch.setattr(pii, "stretches", lambda text: [(0, len(text))])
    assert some == pii.added(net, texts, base) and sum(map(len, some)) > 30


def test_spans_of_tags():
    """The spans of a tag sequence, against a walk over it."""
    noise = np.random.default_rng(12)
    for _ in range(500):
        tags = noise.integers(0, pii.TAGS, int(noise.integers(0, 30))) * (noise.random() < 0.9)
        spans, last = [], 0
        for i, t in enumerate(tags.tolist()):
            if t and (t % 2 or not last or (last - 1) // 2 != (t - 1) // 2):
                spans.append([i, (t - 1) // 2, i + 1])
            elif t:
                spans[-1][2] = i + 1
            last = t
        assert pii._spans(tags) == [tuple(x) for x in spans]


def test_many_spans_take_linear_time():
    """A text of numbers from end to end."""
    net, took = pii.trained(), []
    for many in (2_000, 8_000):
        text = "call 555-201-4477 or +1 (988) 555-2485 " * (many // 2)
        start = time.process_time()
        base = [pii.base_spans(text)]
        more = pii.added(net, [text], base)[0]
        took.append(time.process_time() - start)
        assert len(base[0]) == many // 2 and len(more) >= 0.9 * many // 2
    assert took[1] < 8 * took[0] + 1


def test_documents(spark):
    """In the documents: all that the plain patterns find, and nothing added but numbers that run into the next one, which the patterns drop."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    for r in docs.collect():
        own, text = got[r["doc_id"]], r["text"] or ""
        spans = [x.split(":") for x in own["spans"].split(",") if x]
        assert {(int(a), pii.KINDS.index(k), int(b)) for k, a, b in spans} >= set(plain(text)) and own["n_spans"] == len(spans)
        assert own["n_spans"] - own["n_added"] == len(plain(text)) == own["n_email"] + own["n_ip"] + own["n_card"] + own["n_phone"]
        for k, a, b in spans:
            assert plain(text[int(a) : int(b)]) == [(0, pii.KINDS.index(k), int(b) - int(a))]


def test_an_address_of_any_length():
    text = "write to " + "a" * 300 + "@example.com now"
    assert pii.base_spans(text) == [(9, 0, text.index(" now"))]


def test_spans_cut_no_words():
    text = "call 555-201-4477x or 'a @ b.cd' now"
    assert not pii.passes(text, (5, 3, 17)) and not pii.passes(text, (23, 0, 31)) and not pii.passes("plain words", (0, 0, 5))
    assert pii.passes("at 555-201-4477.", (3, 3, 15)) and pii.passes("(4524132264652876)", (1, 2, 17)) and not pii.passes("(4524132264652877)", (1, 2, 17))


def test_probabilities_against_every_tag_sequence():
    """A span's probability is the share of the sequences that have it, by enumeration."""
    noise, steps = np.random.default_rng(3), 4
    net = pii.Network.fresh(seed=6)
    net.p["t"] = noise.normal(0, 1, net.p["t"].shape)
    e = noise.normal(0, 1, (5, steps, pii.TAGS)) + 2 * (np.arange(pii.TAGS) > 0)
    tags = net.decode(e)
    spans = [pii._spans(row) for row in tags]
    got = net.probabilities(e, tags, spans)
    every = np.array(list(itertools.product(range(pii.TAGS), repeat=steps)))
    assert sum(map(len, spans)) > 5
    for row in range(len(e)):
        weight = np.exp(e[row, np.arange(steps), every].sum(1) + net.p["t"][every[:, :-1], every[:, 1:]].sum(1))
        for (a, kind, b), p in zip(spans[row], got[row], strict=True):
            same = (every[:, a:b] == tags[row, a:b]).all(1) & (every[:, b] != 2 + 2 * kind if b < steps else True)
            assert abs(p - weight[same].sum() / weight.sum()) < 1e-9


def test_cuts():
    """Pieces hold the base spans' tags, and numbers that only lack Luhn."""
    text = "word " * 40 + "mail a.b@c.de or 4111 1111 1111 1112 now " + "word " * 40
    seen = set()
    for chance in range(2_000):
        x, y = (np.frombuffer(p, np.uint8) for p in pii.cut(text, chance))
        at = next(i for i in range(len(text)) if (pii.codes(text[i : i + pii.LENGTH]) == x).all())
        want = np.zeros(len(text), np.uint8)
        for kind, value in ((0, "a.b@c.de"), (2, "4111 1111 1111 1112")):
            start = text.index(value)
            want[start : start + len(value)] = 2 + 2 * kind
            want[start] -= 1
        assert (want[at : at + pii.LENGTH] == y).all() and y.any()
        seen.add(at)
    assert len(seen) > pii.LENGTH
    assert pii.cut("plain words", 5) is None and pii.cut("", 5) is None
    assert pii.cut("4111 1111 1111 1111 4111 1111 1111 1111", 3) is None  # doubtful
    x, y = pii.cut("1", 0)
    assert len(x) == len(y) == pii.LENGTH


def planted(texts, many):
    """Forms that the base patterns miss, and look-alikes, in the prose of documents."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    part = lambda: f"{r.randint(1, 65535):x}"

    def card(sep, n):
        body = "4" + digits(n - 2)
        body += next(c for c in "0123456789" if pii.luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, n, 4))

    makers = [
        lambda: (0, f"{name()}.{name()} @ {name()}.com"), lambda: (0, f"{name()}{digits(2)}@ {name()}.org"), lambda: (1, ":".join(part() for _ in range(8))), lambda: (1, f"2001:{part()}::{part()}"), lambda: (2, card(".", 16)), lambda: (2, card("", 13)),
        lambda: (3, f"{digits(3)}-{digits(3)}-{digits(4)}"), lambda: (3, f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: (3, f"{digits(3)}.{digits(3)}.{digits(4)}"), lambda: (3, "0" + digits(1) + "".join(" " + digits(2) for _ in range(4))), lambda: (3, f"0{digits(2)} {digits(7)}"),
        lambda: (None, f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}"), lambda: (None, f"978-3-{digits(2)}-{digits(6)}-{digits(1)}"), lambda: (None, f"{digits(3)},{digits(3)},{digits(3)}"), lambda: (None, f"v{digits(1)}.{digits(2)}.{digits(1)}"), lambda: (None, "".join(r.choice("0123456789abcdef") for _ in range(40))),
        lambda: (None, digits(16)), lambda: (None, "@" + name()), lambda: (None, ":".join(f"{r.randint(0, 255):02x}" for _ in range(6))), lambda: (None, f"#{digits(6)}-{digits(2)}"), lambda: (None, f"{digits(4)}-{digits(4)}"), lambda: (None, digits(9)),
    ]
    for i in range(many):
        kind, value = makers[i % len(makers)]()
        text = r.choice(texts) + " "
        at = text.find(" ", r.randrange(len(text)))
        at = len(text) - 1 if at < 0 else at
        left = text[max(0, at - 400) : at] + " "
        yield left + value + text[at : at + 400], (len(left), kind, len(left) + len(value))


def test_planted_forms(spark):
    """The network's own finds: right by kind and place, and nothing in look-alikes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = pii.trained(pii.cuts(docs))
    rows = list(planted([r["text"] for r in docs.orderBy("doc_id").limit(2_000).collect() if r["text"]], 2_200))
    base = [pii.base_spans(text) for text, _ in rows]
    hits = wrong = missed = 0
    for (_, span), known, more in zip(rows, base, pii.added(net, [text for text, _ in rows], base), strict=True):
        if any(a < span[2] and span[0] < b for a, _, b in known):
            continue  # a number that is a card by chance
        hits, missed, wrong = hits + (span in more), missed + (span[1] is not None and span not in more), wrong + sum(s != span for s in more)
    print("precision", hits / (hits + wrong), "recall", hits / (hits + missed))
    assert hits / (hits + wrong) > 0.97 and hits / (hits + missed) > 0.9


def test_the_sample_is_bounded_and_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = pii.cuts(docs)
    assert some and len(some) <= pii.CUTS and some == pii.cuts(docs.repartition(5)) and len(pii.cuts(docs, 10)) <= 10


def test_scan(awkward, nothing):
    got = {r["doc_id"]: r for r in pii.scan(awkward).collect()}
    assert (got[7]["n_email"], got[7]["n_ip"], got[7]["n_card"], got[7]["n_phone"]) == (1, 1, 0, 1)
    assert got[7]["spans"] == "email:5:14,phone:19:36,ip:40:53" and got[4]["spans"] == ""
    assert pii.scan(awkward).count() == 12 and pii.scan(nothing).count() == 0


def test_decoding_against_every_tag_sequence():
    """The decoded tags are the best of all sequences, by enumeration; gradients of the loss by differences."""
    noise = np.random.default_rng(12)
    net = pii.Network.fresh(seed=5)
    net.p["t"] = noise.normal(0, 1, net.p["t"].shape)
    e = noise.normal(0, 1, (6, 4, pii.TAGS))
    got = net.decode(e)
    for row in range(len(e)):
        worth = lambda y, row=row: sum(e[row, t, k] for t, k in enumerate(y)) + sum(net.p["t"][a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product(range(pii.TAGS), repeat=e.shape[1]), key=worth)
        assert tuple(got[row]) == best
    x, y = noise.integers(0, pii.CODES, (3, 5)), noise.integers(0, pii.TAGS, (3, 5))
    loss, grad = net.step(x, y)
    scores = net.scores(x)
    for row in range(3):  # the loss is the mean of -log P(tags), by enumeration
        every = [sum(scores[row, t, k] for t, k in enumerate(s)) + sum(net.p["t"][a, b] for a, b in itertools.pairwise(s)) for s in itertools.product(range(pii.TAGS), repeat=5)]
        gold = sum(scores[row, t, k] for t, k in enumerate(y[row])) + sum(net.p["t"][a, b] for a, b in itertools.pairwise(y[row]))
        loss -= (np.logaddexp.reduce(every) - gold) / 3
    assert abs(loss) < 1e-6
    for name, at in (("t", (1, 2)), ("e", (3, 1)), ("x", (0, int(x[0, 0]), 5)), ("u", (1, 2, 7)), ("c", (4,))):
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-5
        above = net.step(x, y)[0]
        net.p[name][at] = kept - 1e-5
        below = net.step(x, y)[0]
        net.p[name][at] = kept
        assert abs((above - below) / 2e-5 - grad[name][at]) < 1e-5
