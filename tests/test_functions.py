"""Golden values of the functions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import arrays as A
from tessera.functions import grading as M
from tessera.functions import scoring as P
from tessera.functions import text as X
from tessera.operators import batches as B
from tessera.operators import relational as R
from tessera.operators import statistics as G
from tessera.plans import scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("excess,penalty", [(0, 0), (1, 0.02), (2, 0.05), (3, 0.09), (4, 0.14), (5, 0.20), (6, 0.27), (7, 0.35), (10, 0.5), (40, 0.5)])
def test_count_penalty(spark, excess, penalty):
    assert one(spark, P.count_penalty(F.lit(6 + excess))) == pytest.approx(penalty)


@pytest.mark.parametrize("truth,n,penalty", [(3, 4, 0), (3, 5, 0.005), (3, 6, 0.01), (3, 7, 0.015), (3, 8, 0.065), (5, 6, 0), (5, 7, 0.005), (5, 8, 0.055), (6, 7, 0), (6, 8, 0.05)])
def test_count_penalty_relative(spark, truth, n, penalty):
    assert one(spark, P.count_penalty_relative(F.lit(n), F.lit(truth))) == pytest.approx(penalty)


def test_response_mask(spark):
    row = F.array(*map(F.lit, [20, 10, 34, 1, 0, 0, 0]))
    assert one(spark, A.response_mask(row, F.lit(1))) == [1, 1, 1, 1, 0, 0, 0]
    row = F.array(*map(F.lit, [78, 0, 76, 2, 1, 0, 0]))
    assert one(spark, A.response_mask(row, [1, 2])) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, A.response_mask(F.array(*map(F.lit, [5, 6])), F.lit(1))) == [1, 1]


def test_schedules(spark):
    steps = F.sequence(F.lit(0), F.lit(4))
    flat = one(spark, F.transform(steps, lambda s: A.warmup(s, 2) * 1e-3))
    assert flat == pytest.approx([0, 0.0005, 0.001, 0.001, 0.001])
    wave = one(spark, F.transform(steps, lambda s: A.warmup_cosine(s, 2, 5, 0.1) * 1e-3))
    assert wave == pytest.approx([0, 0.0005, 0.001, 0.000775, 0.000325])


def test_returns_and_advantages(spark):
    r = F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    assert one(spark, A.discounted_returns(r, F.array(*map(F.lit, [1, 1, 1])), 0.5)) == [2.75, 3.5, 3.0]
    assert one(spark, A.reverse_cumsum(r)) == [6.0, 5.0, 3.0]
    got = one(spark, A.gae(r, F.array(*map(F.lit, [0.5, 0.5, 0.5])), 0.9, 0.8))
    d = [1 + 0.9 * 0.5 - 0.5, 2 + 0.9 * 0.5 - 0.5, 2.5]
    assert got == pytest.approx([d[0] + 0.72 * (d[1] + 0.72 * d[2]), d[1] + 0.72 * d[2], d[2]])


def test_bullets(spark):
    text = "- **Target Module**: Encoder **\n - **Research Question**: Is it needed?\n* Target Module: no question\n- Target Module: Gate\n- Research Question: " + "w " * 300
    got = one(spark, X.parse_bullets(F.lit(text)))
    assert [b["target_module"] for b in got] == ["Encoder", "Gate"]
    assert got[0]["research_question"] == "Is it needed?" and len(got[1]["research_question"]) == 403
    assert one(spark, X.count_pairs(F.lit(text))) == 2
    assert one(spark, X.question_words(F.lit(text))) == [3, 300]
    assert one(spark, X.parse_bullets(F.lit(None).cast("string"))) == []
    assert len(one(spark, X.parse_bullets(F.lit("Target Module: a\nResearch Question: b"), loose=True))) == 1


@pytest.mark.parametrize("value,score", [("1.0", 1.0), ("[0.4]", 0.5), (" 0.25 ", 0.0), ("0.75", 0.5), ("-2", 0.0), ("none", None), ("", None)])
def test_parse_score(spark, value, score):
    assert one(spark, X.parse_score(F.lit(value))) == score


def test_doubling(spark):
    assert one(spark, X.is_doubling(F.lit("Graph Encoder Layer"), F.lit("the graph encoder layer (v2)")))
    assert not one(spark, X.is_doubling(F.lit("Short-term memory"), F.lit("Long-term memory")))
    modules = F.array(*map(F.lit, ["Graph Encoder Layer", "Loss", "Graph encoder layer again", "Loss"]))
    assert one(spark, P.doubles(modules)) == 1


def test_gsm8k(spark):
    assert one(spark, P.gsm8k_answer(F.lit("so #### 1,234.5 done"))) == "1234.5"
    assert one(spark, P.gsm8k_answer(F.lit("no mark 12"))) is None
    assert one(spark, P.gsm8k_answer(F.lit("first 3, last 42 ."), flexible=True)) == "42"


def test_math_forms():
    assert M.math_correct("so \\boxed{\\frac{1}{2}}", "0.5") == 1
    assert M.math_correct("so \\boxed{\\dfrac12}", "1/2") == 1
    assert M.math_correct("\\boxed{x} then \\boxed{\\sqrt3 }", "\\sqrt{3}") == 1
    assert M.math_correct("\\boxed{{a}", "a") == 0
    assert M.minerva_score("Answer: $ 1,000$", "1000") == 1 and M.minerva_score("nothing", "3") == -1
    assert M.lenient_score("The answer is 50%.", "0.5") == 1 and M.lenient_score("\\boxed{(1, 2)}", "(1,2.0)") == 1


def test_batches(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, x string")
    padded = B.pad_to_divisor(rows, "i", 3, 7).orderBy("i").collect()
    assert "".join(r["x"] for r in padded) == "abcabca"
    assert "".join(r["x"] for r in B.repeat_rows(rows, 2).orderBy("i", "rep").collect()) == "aabbcc"
    assert "".join(r["x"] for r in B.repeat_rows(rows, 2).orderBy("rep", "i").collect()) == "abcabc"
    with pytest.raises(ValueError):
        B.chunk(F.col("i"), 6, 5)
    assert B.pad_to_divisor(rows, "i", 3, 3).count() == 3


def test_permutation(spark):
    rows = spark.createDataFrame([(i, i + 1, "abcdef"[i]) for i in range(6)], "i long, obs long, label string")
    order = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "position long, source long")
    got = R.reorder(rows, "i", order).orderBy("position").collect()
    assert [r["obs"] for r in got] == [4, 5, 3, 1, 2, 6] and "".join(r["label"] for r in got) == "decabf"


def test_hstack_conflict(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "i long, x double")
    assert R.hstack(a, a.withColumn("y", F.lit(1)), "i").count() == 2
    with pytest.raises(Exception, match="x differs"):
        R.hstack(a, a.withColumn("x", F.lit(2.0)), "i").collect()


def test_balanced(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([9, 8, 7, 6, 5, 4, 3, 2])], "b long, k long, n long")
    parts = B.balanced(rows, ["b"], "k", "n", 2).join(rows, ["b", "k"]).groupBy("part").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()
    assert sorted(r["s"] for r in parts) == [22, 22]
    equal = B.balanced(rows, ["b"], "k", "n", 2, equal_size=True).groupBy("part").count().collect()
    assert [r["count"] for r in equal] == [4, 4]


def test_masked(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (4.0, 1), (9.0, 0)], "x double, m int")
    got = rows.agg(G.masked_mean(F.col("x"), F.col("m")).alias("mean"), G.masked_var(F.col("x"), F.col("m")).alias("var")).first()
    assert got["mean"] == pytest.approx(7 / 3) and got["var"] == pytest.approx(7 / 3)
    with pytest.raises(Exception, match="two ones"):
        rows.limit(1).agg(G.masked_var(F.col("x"), F.col("m"))).collect()


def test_expected_best(spark):
    a = F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    assert one(spark, G.expected_best(a, 2)) == pytest.approx(sum(max(x, y) for x in (1, 2, 3) for y in (1, 2, 3)) / 9)
    assert one(spark, G.expected_best(a, 2, worst=True)) == pytest.approx(sum(min(x, y) for x in (1, 2, 3) for y in (1, 2, 3)) / 9)


def test_entropy(spark):
    assert one(spark, A.entropy(F.array(*map(F.lit, [0.0, 0.0])))) == pytest.approx(math.log(2))


def test_judge(spark):
    text = '<candidate num="2"><score>0.5</score></candidate><CANDIDATE id=1 ><critique> c </critique><score>x</score><primary_match>bullet 3</primary_match></CANDIDATE>'
    got = one(spark, X.parse_judge(F.lit(text), F.lit(3)))
    assert [(r["critique"], r["score"], r["primary_match"]) for r in got] == [("c", None, 3), ("", 0.5, None), ("", None, None)]


def plain_bootstrap(scores, size, rounds=1000, seed=42):
    np.random.seed(seed)
    drawn = [[scores[i] for i in np.random.choice(len(scores), size=size, replace=True)] for _ in range(rounds)]
    return [f([g(d) for d in drawn]) for g in (max, min) for f in (np.mean, np.std)]


def test_bootstrap(spark):
    data = {7: [0.5], 8: [1.0, 0.0], 10: [3.0, 1.0, 2.0, 5.0, 4.0], None: [2.0, 9.0], 21: [float(i * 37 % 101) for i in range(100)], 22: [float(i) for i in range(100)]}
    rows = [(u, i, x) for u, xs in data.items() for i, x in reversed(list(enumerate(xs)))]
    got = {r[0]: r[1:] for r in G.bootstrap(spark.createDataFrame(rows, "uid long, idx long, score double").repartition(5), ["uid"], "score", "idx", 4).collect()}
    assert set(got) == set(data)
    for u, xs in data.items():
        assert got[u] == pytest.approx(plain_bootstrap(xs, 4))
    lost = spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], "uid long, idx long, score double")
    assert G.bootstrap(lost, ["uid"], "score", "idx", 4).first()["best_mean"] is None


def test_bootstrap_query_has_every_prompt(spark):
    where = "/root/testdata/sf0.001"
    scores = {}
    for r in plans.QUERIES["prj_select"](spark, where).orderBy("uid", "idx").collect():
        scores.setdefault(r["uid"], []).append(r["score"])
    got = {r[0]: r[1:] for r in plans.QUERIES["agg_bootstrap"](spark, where).collect()}
    assert set(got) == set(scores) and any(u % 10 for u in got)
    for u in sorted(scores)[::50]:
        assert got[u] == pytest.approx(plain_bootstrap([float(x) for x in scores[u]], 4))


def test_rl_prompts_hold_whole_content_and_goal(spark):
    long = "word {GOAL} " * 6_000
    papers = spark.createDataFrame([(1, long, "the goal", "v", "t"), (2, "short", None, None, None), (3, None, "g", "v", "t")], "id long, content string, goal string, venue string, title string")
    for name, limit in (("t1", 50_000), ("t2", 60_000)):
        got = {r["extra_info"]["index"]: r["prompt"][0]["content"] for r in scores.rl_rows(papers, name).collect()}
        pattern = scores.RL_PROMPTS[name][0]
        for i, content, goal in ((1, long, "the goal"), (2, "short", ""), (3, "", "g")):
            expected = pattern.replace("{CONTENT}", content[:limit])
            assert got[i] == (expected.replace("{GOAL}", goal) if name == "t2" else expected)
        assert "<Research_Context>" in got[2] and ("<Ablation_Goal>\ng\n" in got[3]) == (name == "t2")


def test_rl_queries_give_whole_prompts(spark):
    where = "/root/testdata/sf0.001"
    papers = {r["id"]: r["content"] or "" for r in plans.QUERIES["prj_rl_row"](spark, where).select("id", "content").collect()}
    for name in ("t1", "t2"):
        rows = plans.QUERIES[f"cnv_rl_{name}"](spark, where).collect()
        assert rows
        for r in rows:
            content = papers[r["index"]]
            assert (content.replace("{GOAL}", r["ground_truth"]) if name == "t2" else content) in r["content"]


@pytest.mark.parametrize(("said", "truth", "score"), [
    (r"\boxed{\frac12}", "1/2", 1), (r"\fbox{7}", "7", 0), (r"\boxed5 and {7}", "7", 0), (r"\boxed 7$ and", "7", 1), (r"\boxed{7", "7", 0), (r"\boxed{x/2 }", "x/2", 0), (r"\boxed{x/2}", "x/2", 1),
    (r"\boxed{2 /4}", "2/4", 1), (r"\boxed{02/4}", "2/4", 0), (r"\boxed{3\sqrt}", r"3\sqrt", 1), (r"\boxed{3 \sqrt}", r"3\sqrt", 0), (r"\boxed{\sqrt3}", r"\sqrt{3}", 1), (r"\boxed{\frac}", r"\frac", 1), (r"\boxed{ \frac}", r"\frac", 0),
    (r"\boxed{.5}", r"\frac12", 1), (r"\boxed{k=3}", "3", 1), (r"\boxed{90^\circ}", "90", 1), (r"\boxed{5\text{ cm}}", "5", 1), (r"\boxed{a\text{ b\text{ c}}}", "a", 0), ("", "", 0), (None, "1", 0),
])
def test_math_boxes(said, truth, score):
    assert M.math_correct(said, truth) == score


def test_minerva_box():
    assert M.minerva_score(r"\boxed{7}", "7", strict_box=True) == 1
    for said in (r"\boxed 7$", r"\fbox{7}", r"\boxed7 {7}", r"\boxed{7", r"\boxed{7}" + "x" * 100):
        assert M.minerva_score(said, "7", strict_box=True) == -1


def test_whole_reward(spark):
    """Two candidates claim one bullet: the better match stays; a claim without bullet counts for nothing; no candidates, no score."""
    text = "<Think>t</Think><Result>\n- Target Module: the gate\n- Research Question: why?\n- Target Module: a decoder\n- Research Question: how?\n</Result>"
    block = lambda i, focus: f"<Candidate><ID>{i}</ID><Investigation_Focus>{focus}</Investigation_Focus><Description_Text>d</Description_Text></Candidate>"
    truth = block(1, "core part") + block(2, "second") + block(3, "third")
    judge = "".join(f'<candidate num="{i}"><score>{s}</score><primary_match>{m}</primary_match></candidate>' for i, s, m in ((1, 0.5, 1), (2, 1, 1), (3, 1, 0)))
    judge += '<Bullet_Specificity><bullet num="1"><spec_score>0.5</spec_score></bullet></Bullet_Specificity>'
    rows = spark.createDataFrame([(1, text, truth, judge), (2, text, "", judge), (3, text, truth, None), (4, None, None, None)], "id long, response string, candidates string, judge string")
    got = {r["id"]: r["r"] for r in rows.select("id", P.objectives_reward(F.col("response"), F.col("candidates"), F.col("judge")).alias("r")).collect()}
    assert got[1]["recall"] == pytest.approx((3 * 0 + 2 * 1 * 0.5 + 2 * 1 * 0) / 7) and got[1]["plain_recall"] == pytest.approx((2 + 2) / 7)
    assert (got[1]["lost"], got[1]["missing"], got[1]["n_pairs"], got[1]["reason"]) == (1, 0, 2, "ok") and got[1]["score"] == pytest.approx(got[1]["recall"])
    assert got[2]["reason"] == "no_candidate_items" and got[2]["score"] == 0 == got[4]["score"] and got[3]["missing"] == 3 and got[3]["score"] == 0


def test_batches_balanced_as_by_hand(spark):
    """Greedy and largest differencing against plain loops."""
    lengths = [(7 * i * i + 3 * i) % 41 + 1 for i in range(60)]
    rows = spark.createDataFrame([(i // 20, i, n) for i, n in enumerate(lengths)], "b long, k long, n long")
    greedy = {r["k"]: r["part"] for r in B.greedy_balanced(rows, ["b"], "k", "n", 3).collect()}
    best = B.balanced(rows, ["b"], "k", "n", 3).join(rows, ["b", "k"]).groupBy("b", "part").agg(F.sum("n").alias("s")).collect()
    for b in range(3):
        sums = [0, 0, 0]
        for i in range(20 * b, 20 * b + 20):
            part = sums.index(min(sums))
            assert greedy[i] == part
            sums[part] += lengths[i]
        own = [r["s"] for r in best if r["b"] == b]
        assert sum(own) == sum(sums) and max(own) - min(own) <= max(sums) - min(sums)


def by_differencing(sizes, parts):
    """The places in each part: the two splits with the largest spreads are joined, again and again."""
    sets = lambda split: sorted(split, key=lambda s: (sum(n for _, n in s), len(s), s), reverse=True)
    total = lambda s: sum(n for _, n in s)
    splits = [sets([[(i, n)]] + [[]] * (parts - 1)) for n, i in sorted((n, i) for i, n in enumerate(sizes))]
    while len(splits) > 1:
        splits.sort(key=lambda s: (total(s[0]) - total(s[-1]), total(s[0]), len(s[0]), s[0]), reverse=True)
        a, b, *rest = splits
        splits = [*rest, sets([x + y for x, y in zip(a, reversed(b), strict=True)])]
    return [[i for i, _ in s] for s in splits[0]]


def test_differencing_with_ties():
    noise = np.random.default_rng(6)
    for n in (1, 2, 5, 12, 30):
        for parts in (1, 2, 3, 5):
            sizes = noise.integers(1, 6, n).tolist()
            assert B.differenced(sizes, parts) == by_differencing(sizes, parts)
    assert B.differenced([], 2) == [[], []]


def test_micro_batches(spark):
    """Ranks of a step agree on the larger number of parts; positions are the inverse of the order of work."""
    lengths = [(7 * i * i + 3 * i) % 41 + 1 for i in range(60)]
    rows = spark.createDataFrame([(i // 20, i % 2, i, n if i % 2 else max(1, n // 3)) for i, n in enumerate(lengths)], "b long, r int, k long, n long")
    got = B.micro_batches(rows, ["b"], "r", "k", "n", 100).collect()
    own = {r["k"]: r["n"] for r in rows.collect()}
    for b in range(3):
        needs = [sum(n for k, n in own.items() if k // 20 == b and k % 2 == r) for r in (0, 1)]
        parts = max(-(-n // 100) for n in needs)
        for r in (0, 1):
            keys = [k for k in own if k // 20 == b and k % 2 == r]
            split = by_differencing([own[k] for k in keys], parts)
            order = [keys[i] for part in split for i in part]
            mine = {x["k"]: x for x in got if x["b"] == b and x["r"] == r}
            assert {k: x["part"] for k, x in mine.items()} == {keys[i]: p for p, part in enumerate(split) for i in part}
            assert [k for k, _ in sorted(mine.items(), key=lambda x: x[1]["position"])] == order and {x["parts"] for x in mine.values()} == {parts}
    with pytest.raises(Exception, match="longer than a micro-batch"):
        B.micro_batches(rows, ["b"], "r", "k", "n", 20).collect()
    with pytest.raises(Exception, match="fewer rows than micro-batches"):
        B.micro_batches(spark.createDataFrame([(0, 0, 1, 9), (0, 1, 2, 9), (0, 1, 3, 9)], rows.schema), ["b"], "r", "k", "n", 10).collect()


def test_greedy_parts_of_equal_size(spark):
    lengths = [9, 1, 1, 1, 8, 2]
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "b long, k long, n long")
    got = {r["k"]: r["part"] for r in B.greedy_balanced(rows, ["b"], "k", "n", 3, equal_size=True).collect()}
    sums, expected = [0, 0, 0], []
    for n in lengths:
        part = sums.index(min(sums))
        expected.append(part)
        sums[part] += n + sum(lengths) + 1
    assert [got[i] for i in range(6)] == expected and sorted(expected) == [0, 0, 1, 1, 2, 2]
    with pytest.raises(Exception, match="don't divide"):
        B.greedy_balanced(rows, ["b"], "k", "n", 4, equal_size=True).collect()


def test_think_mask_by_runs(spark):
    """Per character as by definition; a text of a million characters takes no look at its tags for each of them."""
    for t in ["ab<Think>xy</Think>cd", "<Think></Think>", "x<Think>y</Think>", "no", "</Think>a<Think>", "a<Think>b", "a</Think><Think>b</Think>"]:
        start, end = t.find("<Think>"), t.find("</Think>")
        expected = [0 if 0 <= start < end and start - 1 <= i < end + 8 else 1 for i in range(len(t))]
        assert one(spark, X.think_mask(F.lit(t))) == expected
    assert one(spark, X.think_mask(F.lit(""))) is None
    long = F.concat(F.repeat(F.lit("a"), 500_000), F.lit("<Think>b</Think>"), F.repeat(F.lit("c"), 500_000))
    assert one(spark, F.array_size(F.array_remove(X.think_mask(long), 0))) == 999_999


def test_think_mask_of_tokens(spark):
    text, spans = "ab<Think>xy</Think>cd", [(0, 2), (2, 9), (9, 9), (9, 11), (11, 19), (19, 20), (20, 21)]
    offsets = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans))
    assert one(spark, X.think_token_mask(F.lit(text), offsets, prompt=1)) == [1, 0, 0, 0, 0, 0, 1, 1]
    assert one(spark, X.think_token_mask(F.lit(text), offsets, F.array(*map(F.lit, [1, 1, 1])), prompt=1)) == [1, 0, 0]  # cut off
    assert one(spark, X.think_token_mask(F.lit(text[2:]), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 7), (7, 17), (17, 19)])))) == [0, 0, 1]
    for other in ("<Think>ab", "ab</Think>", "", "</Think><Think>"):
        assert one(spark, X.think_token_mask(F.lit(other), offsets)) == [1] * 7
    assert one(spark, X.think_token_mask(F.lit(None).cast("string"), offsets)) == [1] * 7
    # A token that only partly lies in the block is none of it, but the one before the block is masked.
    wide = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 5), (5, 12), (12, 21)]))
    assert one(spark, X.think_token_mask(F.lit(text), wide)) == [0, 0, 1]


def test_flattened_lists(spark):
    rows = spark.createDataFrame([(1, {"x": [1, 2, 3]}), (2, {"x": []}), (3, {"x": None})], "i long, s struct<x: array<int>>")
    assert R.most_elements(rows) == 3
    flat = R.flatten_schema(rows, 2)
    assert flat.columns == ["i", "s/x/list_len", "s/x/0", "s/x/1"] and [tuple(r)[2:] for r in flat.orderBy("i").collect()] == [(1, 2), (None, None), (None, None)]
    assert R.most_elements(rows.select("i")) == 0 == R.most_elements(rows.limit(0))


def test_advantages_of_two_sources(spark):
    """Against loops over responses."""
    noise = np.random.default_rng(2)
    sizes = [3, 1, 4, 2, 5, 2]
    rows = [(r // 3, r, t, float(x), int(t < n - (r == 2)), 0, 0.0) for r, n in enumerate(sizes) for t, x in enumerate(np.round(noise.normal(size=n), 3))]
    rows = [(g, r, t, x, m, int(t == max(b[2] for b in rows if b[1] == r and b[4])), float(r % 2) if t == max(b[2] for b in rows if b[1] == r and b[4]) else 0.0) for g, r, t, x, m, _, _ in rows]
    df = spark.createDataFrame(rows, "g long, r long, t long, x double, m int, last int, y double")
    got = {(q["r"], q["t"]): (q["returns"], q["a"]) for q in G.prime_advantages(df, "r", "g", "t", "m", 3, [("x", "m", 5.0), ("y", "last", 2.0)], "a").collect()}
    values = {}
    for col, mask, c in ((3, 4, 5.0), (6, 5, 2.0)):
        for g in (0, 1):
            means = [np.mean([q[col] for q in rows if q[1] == r and q[mask]]) for r in range(3 * g, 3 * g + 3)]
            for q in rows:
                if q[0] == g:
                    values[q[1], q[2]] = values.get((q[1], q[2]), 0) + c * ((q[col] * 1.5 - sum(means) / 2) if q[mask] else 0)
    returns = {(q[1], q[2]): sum(values[p[1], p[2]] * p[4] for p in rows if p[1] == q[1] and p[2] >= q[2]) for q in rows}
    kept = np.array([returns[q[1], q[2]] for q in rows if q[4]])
    for k, v in returns.items():
        assert got[k] == pytest.approx((v, (v - kept.mean()) / np.sqrt(kept.var(ddof=1) + 1e-8)), abs=1e-5)
    with pytest.raises(ValueError):
        G.prime_advantages(df, "r", "g", "t", "m", 3, [("x", "m", 0.0)])


def test_best_of_n_weights(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (0, 3.0), (1, 5.0)], "g long, x double")
    got = sorted(r["w"] for r in rows.select(G.best_of_n_weight(F.col("x"), "g").alias("w")).collect())
    assert got == pytest.approx(sorted([4 * 0.25**3, 4 * 0.75**3, 4 * 0.75**3, 4.0, 1.0]))


def test_write_measures_once(spark, tmp_path):
    from tessera.sources import files

    rows = spark.range(1000).repartition(5)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "write")
    out, seen = files.write_observed(rows, str(tmp_path / "o"), F.col("id") % 3 == 0, {"before": F.count("*")}, {"after": F.count("*"), "total": F.sum("id")})
    jobs = len(tracker.getJobIdsForGroup("observed"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen == {"before": 1000, "after": 334, "total": sum(range(0, 1000, 3))} and out.count() == 334
    assert jobs <= 2  # the shuffle's map stage may run as a job of its own
