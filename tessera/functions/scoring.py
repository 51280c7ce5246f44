"""Penalties and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

SPECIFICITY_BASELINE = 0.70


def _over(c: Column, limit: int) -> Column:
    return F.greatest(F.lit(0), c - limit)


def count_penalty(n: Column, hard_cap: int = 6, base: float = 0.02, step: float = 0.01, cap: float = 0.5) -> Column:
    """Each item beyond the cap costs more than the one before it."""
    e = _over(n, hard_cap).cast("double")
    return F.least(F.lit(cap), e * base + e * (e - 1) * (step / 2))


def count_penalty_relative(n: Column, truth: Column, soft: float = 0.005, threshold: int = 7, hard: float = 0.05, cap: float = 0.5, free: int = 1) -> Column:
    """Cheap beyond the true count and some free ones, dear beyond the threshold."""
    lenient = F.greatest(F.lit(0), F.least(n, F.lit(threshold)) - (truth + free))
    return F.least(F.lit(cap), soft * lenient + hard * _over(n, threshold))


def overlong_penalty(tokens: Column, *tiers: tuple[int, float]) -> Column:
    """Sum over (threshold, rate per 100 tokens); all tiers but the first need both to be positive."""
    used = [t for i, t in enumerate(tiers) if i == 0 or (t[0] > 0 and t[1] > 0)]
    return sum((_over(tokens, t) / 100.0 * r for t, r in used), F.lit(0.0))


def format_gate(raw: Column, result: Column) -> Column:
    """Struct of factor, reason and number of bullet pairs."""
    low = F.lower(X.text(raw))
    no_open, no_close = ~F.contains(low, F.lit("<result>")), ~F.contains(low, F.lit("</result>"))

    def gate(pairs: Column) -> Column:
        reason = F.when(no_open, "no_result_open").when(no_close, "no_result_close").when(pairs == 0, "no_bullet_pair").when(pairs == 1, "single_pair").otherwise("ok")
        factor = F.when(no_open | no_close | (pairs == 0), 0.0).when(pairs == 1, 0.5).otherwise(1.0)
        return F.struct(factor.alias("factor"), reason.alias("reason"), pairs.alias("n_pairs"))

    return X.let(X.count_pairs(result), gate)


def rule_penalty_objectives(raw: Column, result: Column, tier: tuple[int, float] = (768, 0.05), total: tuple[tuple[int, float], ...] = ()) -> Column:
    """Length penalty of the result block, and of the whole response if tiers are given."""
    length = overlong_penalty(X.approx_tokens(result), tier)
    return length + overlong_penalty(X.approx_tokens(raw), *total) if total else length


def rule_penalty_plan(raw: Column, plan: Column, tier: tuple[int, float] = (2400, 0.03), disabled: bool = False) -> Column:
    """Struct of format_penalty and length_penalty of a plan."""
    low = F.lower(X.text(raw))
    closed = F.contains(low, F.lit("<proposed_plan>")) & F.contains(low, F.lit("</proposed_plan>"))
    form = F.when(closed, 0.0).otherwise(0.25) + F.when(X.required_sections(plan), 0.0).otherwise(0.25)
    length = overlong_penalty(X.approx_tokens(plan), tier)
    if disabled:
        form, length = F.lit(0.0), F.lit(0.0)
    return F.struct(form.alias("format_penalty"), length.alias("length_penalty"))


def verbosity_penalty(words: Column, threshold: int = 80, rate: float = 0.05, cap: float = 0.3) -> Column:
    """Struct over an array of word counts: capped and raw penalty, mean and greatest count."""

    def of(w: Column) -> Column:
        raw = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0), x - threshold) / 50.0 * rate)
        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        n = F.size(w)
        return F.struct(F.least(F.lit(cap), raw).alias("penalty"), raw.alias("raw"), F.when(n > 0, total / n).otherwise(0.0).alias("mean_words"), F.coalesce(F.array_max(w), F.lit(0)).alias("max_words"))

    return X.let(words, of)


def doubles(modules: Column, threshold: float = 0.7) -> Column:
    """How many of the modules, in order, repeat an earlier one that was kept."""
    start = F.array().cast("array<struct<name:string,words:array<string>>>")

    def of(m: Column) -> Column:
        kept = F.aggregate(F.transform(m, X.doubling_form), start, lambda k, m: F.when(F.exists(k, lambda x: X.same_module(m, x, threshold)), k).otherwise(F.concat(k, F.array(m))))
        return F.when(F.size(m) < 2, 0).otherwise(F.size(m) - F.size(kept))  # a single one has no earlier one

    return X.let(modules, of)


def doubling_penalty(n: Column, rate: float = 0.06, cap: float = 0.20) -> Column:
    return F.least(F.lit(cap), rate * n)


def paper_score(recall: Column, p_spec: Column, baseline: float = SPECIFICITY_BASELINE) -> Column:
    return 100.0 * (recall + 0.5 * (p_spec - baseline))


def objective_score(content: Column, factor: Column, *penalties: Column) -> Column:
    return F.greatest(F.lit(0.0), content * factor - sum(penalties, F.lit(0.0)))


def plan_score(rubric: Column, form: Column, length: Column) -> Column:
    return F.greatest(F.lit(0.0), rubric - form - length)


def one_to_one(items: Column, n: Column) -> Column:
    """items, an array of structs with score and primary_match, with lost = true and score 0 where another item that
    names the same bullet (1 to n) has a better score, or the same and comes first."""
    value = lambda x: F.coalesce(x["score"], F.lit(0.0))
    named = lambda x: x["primary_match"].between(1, n)

    def better(x: Column, i: Column):
        return lambda y, j: F.coalesce(named(x) & (y["primary_match"] == x["primary_match"]) & ((value(y) > value(x)) | ((value(y) == value(x)) & (j < i))), F.lit(False))

    def one(x: Column, i: Column) -> Column:
        lost = F.exists(F.transform(items, better(x, i)), lambda b: b)
        return F.struct(F.when(lost, 0.0).otherwise(x["score"]).alias("score"), x["primary_match"].alias("primary_match"), x["weight"].alias("weight"), lost.alias("lost"))

    return F.transform(items, one)


def _weighted(items: Column, value) -> Column:
    """Weighted mean of value(item) over the items that have a score; null without any."""
    scored = F.filter(items, lambda x: x["score"].isNotNull())
    total = lambda f: F.aggregate(scored, F.lit(0.0), lambda s, x: s + f(x))
    return total(lambda x: x["weight"] * value(x)) / F.nullif(total(lambda x: x["weight"].cast("double")), F.lit(0.0))


def judged_recall(candidates: Column, judge: Column, n_pairs: Column) -> Column:
    """Struct of recall (with the specificity of the matched bullets; an unnamed bullet counts as specific),
    plain recall, candidates, those without a score, and matches lost to a better one."""

    def of(found: Column) -> Column:
        marks = X.parse_judge(judge, F.size(found), critique=False)
        items = F.zip_with(found, marks, lambda c, m: F.struct(m["score"].alias("score"), m["primary_match"].alias("primary_match"), c["weight"].alias("weight")))
        return X.let(F.struct(F.coalesce(items, F.array().cast("array<struct<score:double,primary_match:int,weight:int>>")).alias("items"), X.parse_specificity(judge, n_pairs).alias("spec")), matched)

    def matched(p: Column) -> Column:
        missing = F.size(F.filter(p["items"], lambda x: x["score"].isNull()))
        return X.let(F.struct(one_to_one(p["items"], n_pairs).alias("items"), p["spec"].alias("spec"), missing.alias("missing")), means)

    def means(p: Column) -> Column:
        spec = lambda x: F.when(x["primary_match"] > 0, F.coalesce(F.try_element_at(p["spec"], x["primary_match"]), F.lit(1.0))).otherwise(0.0)
        return F.struct(
            F.coalesce(_weighted(p["items"], lambda x: x["score"] * spec(x)), F.lit(0.0)).alias("recall"), F.coalesce(_weighted(p["items"], lambda x: x["score"]), F.lit(0.0)).alias("plain"),
            F.size(p["items"]).alias("n"), p["missing"].alias("missing"), F.size(F.filter(p["items"], lambda x: x["lost"])).alias("lost"),
        )

    return X.let(X.parse_candidates(candidates), of)


def objectives_reward(response: Column, candidates: Column, judge: Column) -> Column:
    """Struct of the whole score of a list of objectives, from the response, the true candidates and the judge's
    answer, and all that it is made of: recall through one-to-one matches, times the format's factor, less the penalties."""

    def of(r: Column) -> Column:
        return X.let(F.struct(r.alias("result"), format_gate(response, r).alias("gate"), X.modules_and_words(r).alias("b")), parts)

    def parts(p: Column) -> Column:
        n = p["gate"]["n_pairs"]
        made = F.struct(
            p["gate"].alias("gate"), judged_recall(candidates, judge, n).alias("judged"), rule_penalty_objectives(response, p["result"]).alias("length"),
            verbosity_penalty(p["b"]["words"])["penalty"].alias("wordy"), doubling_penalty(doubles(p["b"]["modules"])).alias("double"),
        )
        return X.let(made, total)

    def total(p: Column) -> Column:
        none = p["judged"]["n"] == 0
        zero = lambda c: F.when(none, 0.0).otherwise(c)
        count = count_penalty_relative(p["gate"]["n_pairs"], p["judged"]["n"])
        return F.struct(
            zero(objective_score(p["judged"]["recall"], p["gate"]["factor"], p["length"], count, p["wordy"], p["double"])).alias("score"), zero(p["judged"]["recall"]).alias("recall"), zero(p["judged"]["plain"]).alias("plain_recall"),
            zero(p["gate"]["factor"]).alias("format_factor"), F.when(none, "no_candidate_items").otherwise(p["gate"]["reason"]).alias("reason"), F.when(none, 0).otherwise(p["gate"]["n_pairs"]).alias("n_pairs"),
            zero(count).alias("count_penalty"), zero(p["length"]).alias("length_penalty"), zero(p["wordy"]).alias("verbosity_penalty"), zero(p["double"]).alias("doubling_penalty"),
            F.when(none, 0).otherwise(p["judged"]["missing"]).alias("missing"), F.when(none, 0).otherwise(p["judged"]["lost"]).alias("lost"),
        )

    return X.let(X.extract_block(response, "Result"), of)


def rubric_scores(rubric: Column, judge: Column) -> Column:
    """Array of (level, weight, score) of the rubric's items, with the judge's scores in their order."""

    def of(items: Column) -> Column:
        marks = X.parse_items(judge, F.size(items), critique=False)
        return F.zip_with(items, F.coalesce(marks, F.array().cast("array<struct<num:int,score:double>>")), lambda r, m: F.struct(r["level"].alias("level"), r["weight"].alias("weight"), m["score"].alias("score")))

    return X.let(X.parse_rubric(rubric), of)


def plan_reward(response: Column, rubric: Column, judge: Column) -> Column:
    """Struct of the whole score of a plan: the rubric's weighted score less the penalties; 0 without rubric items."""

    def of(p: Column) -> Column:
        some = F.size(p["items"]) > 0
        zero = lambda c: F.when(some, c).otherwise(0.0)
        points = F.coalesce(_weighted(p["items"], lambda x: x["score"]), F.lit(0.0))
        form, length = p["penalty"]["format_penalty"], p["penalty"]["length_penalty"]
        missing = F.size(F.filter(p["items"], lambda x: x["score"].isNull()))
        return F.struct(zero(plan_score(points, form, length)).alias("score"), zero(points).alias("rubric_score"), zero(form).alias("format_penalty"), zero(length).alias("length_penalty"), F.when(some, missing).otherwise(0).alias("missing"))

    def made(r: Column) -> Column:
        return X.let(X.extract_block(r, "Proposed_Plan"), lambda plan: F.struct(rubric_scores(rubric, judge).alias("items"), rule_penalty_plan(r, plan).alias("penalty")))

    return X.let(X.let(response, made), of)


def design_evaluation(rubric: Column, judge: Column, expected: int) -> Column:
    """Struct of status, reason (of a failure), design_score, mean score by level, and items with and without a score."""

    def of(items: Column) -> Column:
        n, parsed = F.size(items), F.size(F.filter(items, lambda x: x["score"].isNotNull()))
        reason = F.when(n != expected, F.concat(F.lit("rubric has "), n.cast("string"), F.lit(f" items, expected {expected}"))).when(parsed == 0, "no score parsed")
        good = lambda c: F.when(reason.isNull(), c)

        def level(name: str) -> Column:
            own = F.filter(items, lambda x: (x["level"] == name) & x["score"].isNotNull())
            return good(F.aggregate(own, F.lit(0.0), lambda s, x: s + x["score"]) / F.nullif(F.size(own).cast("double"), F.lit(0.0))).alias(name)

        return F.struct(
            F.when(reason.isNull(), "SUCCESS").otherwise("FAIL").alias("status"), reason.alias("reason"), good(_weighted(items, lambda x: x["score"])).alias("design_score"),
            *(level(x) for x in ("critical", "major", "minor")), good(parsed).alias("parsed"), good(n - parsed).alias("missing"),
        )

    return X.let(rubric_scores(rubric, judge), of)


def route_source(source: Column, prefixes: dict[str, str]) -> Column:
    """The scorer that a row's source names by prefix, or null; prefixes: prefix to scorer."""
    clean = F.lower(X.strip(X.text(source)))
    out = F.when(F.lit(False), F.lit(""))
    for prefix, scorer in prefixes.items():
        out = out.when(clean.startswith(prefix), scorer)
    return out


#: Sources and the graders that answer for them.
GRADERS = {
    "openai/gsm8k": "gsm8k", "lighteval/MATH": "math", "DigitalLearningGmbH/MATH-lighteval": "math", "math_dapo": "minerva", "numina_aops_forum": "prime_math", "numina_synthetic_math": "prime_math", "numina_amc_aime": "prime_math",
    "numina_synthetic_amc": "prime_math", "numina_cn_k12": "prime_math", "numina_olympiads": "prime_math", "codecontests": "prime_code", "apps": "prime_code", "codeforces": "prime_code", "taco": "prime_code", "hiyouga/geometry3k": "geo3k",
}


def route_grader(source: Column) -> Column:
    out = F.when(source.startswith("aime"), "minerva")
    for name, grader in GRADERS.items():
        out = out.when(source == name, grader)
    return out


def overlong_buffer(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """Zero or less: grows once a response enters the buffer before the longest length."""
    return F.least(-(length - (longest - buffer)) / float(buffer) * factor, F.lit(0.0))


def at_last_token(length: Column, score: Column, size: Column) -> Column:
    """An array of `size` zeros with the score at the last valid position."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == length - 1, score).otherwise(0.0)))


def gsm8k_answer(solution: Column, flexible: bool = False) -> Column:
    """The answer after four hashes without commas and dollars, or the last number that isn't just a point."""
    if not flexible:
        found = F.regexp_extract(X.text(solution), r"#### (-?[0-9.,]+)", 1)
        return F.when(found != "", F.translate(found, ",$", ""))
    numbers = F.regexp_extract_all(X.text(solution), F.lit(r"(-?[0-9.,]+)"), 1)
    real = F.filter(numbers, lambda x: ~x.isin("", "."))
    return F.when(F.size(numbers) > 0, F.coalesce(F.try_element_at(real, F.lit(-1)), F.element_at(numbers, 1)))


def gsm8k_score(answer: Column, truth: Column, form: float = 0.0, right: float = 1.0) -> Column:
    return F.when(answer.isNull(), 0.0).when(answer == truth, right).otherwise(form)


def choice_score(solution: Column, truth: Column) -> Column:
    found = F.regexp_extract(X.text(solution), r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when((found != "") & (found == truth), 1.0).otherwise(0.0)


def geo_format(c: Column) -> Column:
    return F.when(F.regexp_like(X.text(c), F.lit(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")), 1.0).otherwise(0.0)


def geo_score(accuracy: Column, form: Column) -> Column:
    return 0.9 * accuracy + 0.1 * form


def same_output(a: Column, b: Column) -> Column:
    return X.strip(X.text(a)) == X.strip(X.text(b))
