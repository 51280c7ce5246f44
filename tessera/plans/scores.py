"""Queries of text functions, penalties, scores, graders and converters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import grading as M
from tessera.functions import scoring as P
from tessera.functions import text as X
from tessera.operators import batches as B
from tessera.operators import relational as R
from tessera.plans.data import W, strip_sql
from tessera.plans.registry import Tables, query, spread
from tessera.sources import files as S

NW = rf"[^{W[1:]}"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def words_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{NW}+'))"


def tokens_sql(c: str) -> str:
    return f"greatest({words_sql(c)}, CAST(ceil(length({c}) / 4) AS INTEGER))"


BLOCK = f"CASE WHEN regexp_matches(response, '(?is)<Result>(.*?)</Result>') THEN {strip_sql(chr(39).join(['regexp_extract(response, ', '(?is)<Result>(.*?)</Result>', ', 1)']))} ELSE {strip_sql('response')} END"
TM = X.TARGET.replace("(?i)", "")
RQ = X.QUESTION.replace("(?i)", "")
PAIRS = f"least(len(regexp_extract_all(chr(10) || result, '(?i){TM}')), len(regexp_extract_all(chr(10) || result, '(?i){RQ}')))"


def bullets_sql(source: str, target: str, question: str) -> str:
    """Common table expressions that end in b (id, i, tm, rq): untrimmed bullets of r (id, txt)."""
    marked = f"regexp_replace(chr(10) || txt, '(?i){target}', chr(1), 'g')"
    return f"""r AS ({source}), p AS (SELECT id, unnest(string_split({marked}, chr(1))[2:]) AS piece, generate_subscripts(string_split({marked}, chr(1))[2:], 1) AS i FROM r),
      q AS (SELECT id, i, regexp_replace(piece, '(?i)({question})', chr(2) || '\\1' || chr(3), 'g') AS piece FROM p),
      b AS (SELECT id, i, translate(regexp_extract(piece, '(?s)^(.+?)\x02[^\x03]*\x03(.*)$', 1), chr(2) || chr(3), '') AS tm, translate(regexp_extract(piece, '(?s)^(.+?)\x02[^\x03]*\x03(.*)$', 2), chr(2) || chr(3), '') AS rq FROM q
            WHERE regexp_matches(piece, '(?s)^(.+?)\x02[^\x03]*\x03(.*)$'))"""


def tidy_sql(c: str) -> str:
    inner = f"regexp_replace({strip_sql(c)}, '^:+', '')"
    outer = f"regexp_replace({strip_sql(inner)}, '\\*+$', '')"
    return strip_sql(outer)


RESULTS = f"SELECT id, {BLOCK} AS txt FROM {{responses}}"


def results(t: Tables) -> DataFrame:
    return t.spread("orders").responses.select("id", "response", X.extract_block(F.col("response"), "Result").alias("result"))


def question_words(t: Tables, name: str) -> DataFrame:
    """id and the word counts of the results that have a question; counted once, where a filter behind it would count them again."""
    return results(t).select("id", F.explode(X.let(X.question_words(F.col("result")), lambda w: F.when(F.size(w) > 0, F.array(w)))).alias(name))


# --------------------------------------------------------------------- text


@query("txt_approx_tokens", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM {{documents}}")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query("txt_norm_ws", f"SELECT doc_id, trim(regexp_replace(text, '{W}+', ' ', 'g')) AS text FROM {{documents}}")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@query("txt_extract_block", f"SELECT id, {BLOCK} AS result FROM {{responses}}")
def _(t: Tables) -> DataFrame:
    return results(t).select("id", "result")


@query("txt_extract_block_eof", r"SELECT id, CASE WHEN regexp_matches(response, '(?s)<Result>(.*?)(?:</Result>|\z)') THEN regexp_extract(response, '(?s)<Result>(.*?)(?:</Result>|\z)', 1) ELSE response END AS result FROM {responses}")
def _(t: Tables) -> DataFrame:
    return t.responses.select("id", X.extract_block(F.col("response"), "Result", insensitive=False, open_end=True).alias("result"))


@query("txt_extract_plan", f"SELECT id, {strip_sql('think')} AS plan FROM {{papers}}")
def _(t: Tables) -> DataFrame:
    return t.papers.select("id", X.extract_block(F.concat(F.lit("x <proposed_plan> "), "think", F.lit("</Proposed_Plan> y")), "Proposed_Plan").alias("plan"))


@query("txt_extract_field", f"SELECT id, {strip_sql(chr(39).join(['regexp_extract(candidates, ', '(?s)<Investigation_Focus>(.*?)</Investigation_Focus>', ', 1)']))} AS focus FROM {{judged}}")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", X.extract_field(F.col("candidates"), "Investigation_Focus").alias("focus"))


@query("txt_parse_candidates", """
    SELECT id, CAST(id % 5 AS INTEGER) AS candidate_id, concat('The ', CASE WHEN id % 2 = 0 THEN 'core' ELSE 'side' END, ' part') AS focus, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS weight FROM {judged}
    UNION ALL SELECT id, NULL, 'second', 2 FROM {judged} WHERE id % 3 <> 0""")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.inline(X.parse_candidates(F.col("candidates")))).drop("description")


@query("txt_heuristic_weight", "SELECT p_partkey, CASE WHEN lower(concat(p_name, ' ', p_type)) LIKE '%core%' OR lower(concat(p_name, ' ', p_type)) LIKE '%causal%' THEN 3 ELSE 2 END AS weight FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.heuristic_weight(F.col("p_name"), F.col("p_type")).alias("weight"))


@query("txt_parse_focuses", "SELECT id, 0 AS pos, concat('The ', CASE WHEN id % 2 = 0 THEN 'core' ELSE 'side' END, '  part') AS focus FROM {judged} UNION ALL SELECT id, 1, 'second' FROM {judged} WHERE id % 3 <> 0")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.posexplode(X.parse_focuses(F.col("candidates"))).alias("pos", "focus"))


_RUBRIC = "SELECT id, 1 AS item_num, 'critical' AS level, 3 AS weight, 'First rule' AS criterion FROM {judged} UNION ALL SELECT id, 2, 'minor', 1, 'second' FROM {judged} WHERE id % 4 <> 0"


@query("txt_parse_rubric_lenient", _RUBRIC)
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.inline(X.parse_rubric(F.col("rubric"))))


@query("txt_parse_rubric_strict", "SELECT id, CASE WHEN id % 4 <> 0 THEN 2 ELSE 1 END AS n, CASE WHEN id % 4 <> 0 THEN 'ok' ELSE 'rubric has 1 items, expected 2' END AS reason FROM {judged}")
def _(t: Tables) -> DataFrame:
    n = F.size(X.parse_rubric(F.col("rubric")))
    return t.judged.select("id", n.alias("n"), F.when(n == 2, "ok").otherwise(F.concat(F.lit("rubric has "), n.cast("string"), F.lit(" items, expected 2"))).alias("reason"))


@query("txt_parse_bullets", f"WITH {bullets_sql(RESULTS, TM, RQ)} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS idx, substr({tidy_sql('tm')}, 1, 300) AS target_module, CASE WHEN length({tidy_sql('rq')}) > 400 THEN concat(substr({tidy_sql('rq')}, 1, 400), '...') ELSE {tidy_sql('rq')} END AS research_question FROM b")
def _(t: Tables) -> DataFrame:
    rows = results(t).select("id", F.posexplode(X.parse_bullets(F.col("result"))).alias("pos", "b"))
    return rows.select("id", (F.col("pos") + 1).alias("idx"), "b.*")


@query("txt_count_pairs", f"SELECT id, {PAIRS} AS pairs FROM (SELECT id, {BLOCK} AS result FROM {{responses}}) x")
def _(t: Tables) -> DataFrame:
    return results(t).select("id", X.count_pairs(F.col("result")).alias("pairs"))


@query("txt_has_format", f"SELECT id, {PAIRS} > 0 AS ok FROM (SELECT id, {BLOCK} AS result FROM {{responses}}) x")
def _(t: Tables) -> DataFrame:
    return results(t).select("id", X.has_format(F.col("result")).alias("ok"))


@query("txt_rq_word_counts", f"WITH {bullets_sql(RESULTS, TM, RQ)} SELECT id, array_agg({words_sql('rq')} ORDER BY i) AS words FROM b GROUP BY id")
def _(t: Tables) -> DataFrame:
    return question_words(t, "words")


@query("txt_required_sections", "SELECT id, id % 3 = 0 AS ok FROM {judged}")
def _(t: Tables) -> DataFrame:
    plan = F.concat(F.lit("Objective: a Baseline setup: b VARIANTS: c "), F.when(F.col("id") % 3 == 0, "Fixed protocols & metrics: d").otherwise(""))
    return t.judged.select("id", X.required_sections(plan).alias("ok"))


@query("txt_format_bullets", """SELECT id, concat('<bullet num="1">', chr(10), '<target_module>', think, '</target_module>', chr(10), '<research_question>', result, '</research_question>', chr(10), '</bullet>') AS block FROM {papers}""")
def _(t: Tables) -> DataFrame:
    return t.papers.select("id", X.format_bullets(F.array(F.struct(F.col("think").alias("target_module"), F.col("result").alias("research_question")))).alias("block"))


_SCORE = "CASE id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN NULL WHEN 3 THEN 0.5 ELSE 0.0 END"


@query("txt_parse_judge_xml", f"SELECT id, 1 AS num, 'ok' AS critique, CAST({_SCORE} AS DOUBLE) AS score, CAST(id % 4 AS INTEGER) AS primary_match FROM {{judged}} UNION ALL SELECT id, 2, '', CASE WHEN id % 3 <> 0 THEN 0.5 END, NULL FROM {{judged}}")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.inline(X.parse_judge(F.col("answer"), F.lit(2))))


@query("txt_parse_items_xml", "SELECT id, 1 AS num, 'c' AS critique, CAST(CASE id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 1.0 END AS DOUBLE) AS score FROM {judged}")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.inline(X.parse_items(F.col("answer"), F.lit(1))))


@query("txt_parse_spec", "SELECT id, 1 AS bullet, CAST(1.0 AS DOUBLE) AS spec FROM {judged}")
def _(t: Tables) -> DataFrame:
    return t.judged.select("id", F.explode(X.parse_specificity(F.col("answer"), F.col("n_bullets").cast("int"))).alias("bullet", "spec"))


@query("txt_parse_score", "SELECT l_orderkey, l_linenumber, l_discount, CAST(CASE WHEN l_discount * 10 <= 0.25 THEN 0.0 WHEN l_discount * 10 <= 0.75 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score FROM {lineitem}")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", X.parse_score(F.concat(F.lit(" [ "), (F.col("l_discount") * 10).cast("string"), F.lit("]"))).alias("score"))


@query("txt_parse_score_clamp", "SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000)) AS score FROM {customer}")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.parse_score_clamped((F.col("c_acctbal") / 5000).cast("string")).alias("score"))


@query("txt_judge_json", "SELECT id, pos AS gt_id, score FROM {matches} WHERE score > 0 AND pos >= 1")
def _(t: Tables) -> DataFrame:
    entry = F.to_json(F.struct(F.col("pos").alias("gt_id"), F.lit(1).alias("primary_match"), "score"))
    raw = F.concat(F.lit('Sure: {"matches": ['), entry, F.lit("]} done"))
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "matches array<struct<gt_id:bigint,primary_match:bigint,pred_id:bigint,score:double>>, scores array<struct<gt_id:bigint,score:double>>")
    rows = t.matches.select("id", F.inline(parsed["matches"]))
    return rows.filter("score > 0 AND gt_id >= 1").select("id", "gt_id", "score")


_STOP = ", ".join(f"'{w}'" for w in X.DOUBLING_STOP)


@query("txt_core_words", rf"SELECT p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(concat(p_name, ' of the ', p_type, ' method')), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS words FROM {{part}}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.sort_array(X.core_words(F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" method")))).alias("words"))


@query("txt_doubling_norm", rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, ' (', p_type, ') - ', p_brand)), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '{W}+', ' ', 'g')) AS name FROM {{part}}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.doubling_norm(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") - "), "p_brand")).alias("name"))


@query("txt_is_doubling", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_partkey < 200 AND b.p_partkey < 200 WHERE a.p_name = b.p_name OR (length(a.p_name) >= 8 AND length(b.p_name) >= 8 AND (contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name)))")
def _(t: Tables) -> DataFrame:
    few = t.part.filter("p_partkey < 200")
    a, b = few.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_name").alias("na")), few.select("p_brand", F.col("p_partkey").alias("b"), F.col("p_name").alias("nb"))
    return a.join(b, "p_brand").filter((F.col("a") < F.col("b")) & X.is_doubling(F.col("na"), F.col("nb"))).select("a", "b")


@query("txt_wikihow_clean", "SELECT p_partkey, concat(p_name, '. ', p_type, ' end') AS text FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.wikihow_clean(F.concat(F.lit(" "), "p_name", F.lit(" [title]"), "p_type", F.lit("[sub] "), F.lit(" end"))).alias("text"))


@query("txt_capitalize", "SELECT p_partkey, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS type FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.capitalize(F.col("p_type")).alias("type"))


@query("txt_mask_think", r"""WITH r AS (SELECT id, response, instr(response, '<Think>') - 1 AS o FROM {responses}), p AS (SELECT *, CASE WHEN o >= 0 AND instr(substr(response, o + 8), '</Think>') > 0 THEN o + 7 + instr(substr(response, o + 8), '</Think>') - 1 + 8 END AS e FROM r),
    k AS (SELECT id, o, e, i // 5 AS t, i AS a, least(i + 5, length(response)) AS b FROM (SELECT *, unnest(range(0, length(response), 5)) AS i FROM p) x),
    m AS (SELECT id, min(t) FILTER (WHERE a >= o AND b <= e AND b > a) AS first, max(t) FILTER (WHERE a >= o AND b <= e AND b > a) AS last, max(t) + 1 AS n FROM k GROUP BY id),
    c AS (SELECT id, length(response) - CASE WHEN id % 10 = 0 THEN 0 ELSE length(regexp_extract(response, '(?s)<Think>.*</Think>')) END AS kept FROM {responses})
    SELECT c.id, kept, list_transform(range(coalesce(n, 0) + 2), lambda j: CAST(CASE WHEN j BETWEEN first + 1 AND last + 2 THEN 0 ELSE 1 END AS INTEGER)) AS mask FROM c LEFT JOIN m ON c.id = m.id""")
def _(t: Tables) -> DataFrame:
    """Of characters, how many are kept; of tokens of five code points after a prompt of two, the mask."""
    n = F.length("response")
    offsets = F.when(n > 0, X.let(n, lambda m: F.transform(F.sequence(F.lit(0), m - 1, F.lit(5)), lambda i: F.struct(i.alias("start"), F.least(i + 5, m).alias("end"))))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    rows = t.spread("orders").responses.select("id", "response", offsets.alias("offsets"))
    return rows.select("id", F.array_size(F.array_remove(X.think_mask(F.col("response")), 0)).cast("long").alias("kept"), X.think_token_mask(F.col("response"), F.col("offsets"), prompt=2).alias("mask"))


@query("txt_metric_line", "SELECT c_custkey, c_acctbal AS reward FROM {customer}")
def _(t: Tables) -> DataFrame:
    line = F.concat(F.lit("step:3 - reward:"), F.col("c_acctbal").cast("string"), F.lit(" - note"))
    return t.customer.select("c_custkey", X.metric_line(line)["reward"].alias("reward"))


@query("txt_strip_pad", "SELECT p_partkey, p_name AS text FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.strip_pad(F.concat("p_name", F.lit("<|endoftext|><|endoftext|>"))).alias("text"))


# ---------------------------------------------------------------- penalties


@query("pen_count_v1", "SELECT id, round(least(0.5, greatest(0, n_pred - 6) * 0.02 + 0.005 * greatest(0, n_pred - 6) * (greatest(0, n_pred - 6) - 1)), 6) AS penalty FROM {records}")
def _(t: Tables) -> DataFrame:
    return t.records.select("id", r6(P.count_penalty(F.col("n_pred"))).alias("penalty"))


@query("pen_count_v2", "SELECT id, round(least(0.5, 0.005 * greatest(0, least(n_pred, 7) - (n_gt + 1)) + 0.05 * greatest(0, n_pred - 7)), 6) AS penalty FROM {records}")
def _(t: Tables) -> DataFrame:
    return t.records.select("id", r6(P.count_penalty_relative(F.col("n_pred"), F.col("n_gt"))).alias("penalty"))


@query("pen_overlong", "SELECT doc_id, round(greatest(0, n_chars - 768) / 100.0 * 0.05 + greatest(0, n_chars - 2000) / 100.0 * 0.1, 6) AS penalty FROM {documents}")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", r6(P.overlong_penalty(F.col("n_chars"), (768, 0.05), (2000, 0.1), (0, 0.3))).alias("penalty"))


_GATE = f"SELECT id, CASE WHEN NOT contains(lower(response), '<result>') THEN 'no_result_open' WHEN NOT contains(lower(response), '</result>') THEN 'no_result_close' WHEN {PAIRS} = 0 THEN 'no_bullet_pair' WHEN {PAIRS} = 1 THEN 'single_pair' ELSE 'ok' END AS reason, {PAIRS} AS n_pairs, result, response FROM (SELECT id, response, {BLOCK} AS result FROM {{responses}}) x"


@query("pen_format_gate", f"SELECT id, CAST(CASE reason WHEN 'ok' THEN 1.0 WHEN 'single_pair' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS factor, reason, n_pairs FROM ({_GATE}) g")
def _(t: Tables) -> DataFrame:
    return results(t).select("id", P.format_gate(F.col("response"), F.col("result")).alias("g")).select("id", "g.*")


@query("pen_rule_t1", f"SELECT doc_id, round(greatest(0, {tokens_sql('text')} - 768) / 100.0 * 0.05, 6) AS penalty FROM {{documents}}")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", r6(P.rule_penalty_objectives(F.col("text"), F.col("text"))).alias("penalty"))


@query("pen_rule_t2", f"SELECT doc_id, 0.5 AS format_penalty, round(greatest(0, {tokens_sql('text')} - 2400) / 100.0 * 0.03, 6) AS length_penalty FROM {{documents}}")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", P.rule_penalty_plan(F.col("text"), F.col("text")).alias("p"))
    return rows.select("doc_id", F.col("p.format_penalty").alias("format_penalty"), r6(F.col("p.length_penalty")).alias("length_penalty"))


@query("pen_rq_verbosity", f"WITH {bullets_sql(RESULTS, TM, RQ)} SELECT id, round(least(0.3, sum(greatest(0, {words_sql('rq')} - 80) / 50.0 * 0.05)), 6) AS penalty, round(avg({words_sql('rq')}), 6) AS mean_words, max({words_sql('rq')}) AS max_words FROM b GROUP BY id")
def _(t: Tables) -> DataFrame:
    rows = question_words(t, "w").select("id", P.verbosity_penalty(F.col("w")).alias("p"))
    return rows.select("id", r6(F.col("p.penalty")).alias("penalty"), r6(F.col("p.mean_words")).alias("mean_words"), "p.max_words")


#: Modules of one response repeat each other here exactly if their normal forms are equal.
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(tm), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_DOUBLES = f"WITH {bullets_sql(RESULTS, TM, RQ)}, n AS (SELECT id, count(*) - count(DISTINCT {_NORM}) AS n_doubles FROM b GROUP BY id) SELECT r.id, coalesce(n_doubles, 0) AS n_doubles FROM {{responses}} r LEFT JOIN n ON r.id = n.id"


@query("win_doubling", _DOUBLES)
def _(t: Tables) -> DataFrame:
    return results(t).select("id", P.doubles(X.target_modules(F.col("result"))).alias("n_doubles"))


@query("pen_doubling", f"SELECT id, round(least(0.2, 0.06 * n_doubles), 6) AS penalty FROM ({_DOUBLES}) d")
def _(t: Tables) -> DataFrame:
    return results(t).select("id", r6(P.doubling_penalty(P.doubles(X.target_modules(F.col("result"))))).alias("penalty"))


@query("pen_dapo_overlong", "SELECT doc_id, round(least(-(n_chars - (4000 - 500)) / 500.0 * 1.0, 0), 6) AS penalty FROM {documents}")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", r6(P.overlong_buffer(F.col("n_chars"), 4000, 500, 1.0)).alias("penalty"))


@query("put_last_token", "SELECT id, i AS pos, CASE WHEN i = n_pred - 1 THEN p_spec ELSE 0 END AS score FROM (SELECT *, unnest(range(9)) AS i FROM {records} WHERE status = 'SUCCESS') x")
def _(t: Tables) -> DataFrame:
    ok = t.records.filter("status = 'SUCCESS'")
    return ok.select("id", F.posexplode(P.at_last_token(F.col("n_pred"), F.col("p_spec"), F.lit(9))).alias("pos", "score"))


# ------------------------------------------------------------------- scores


def _task1(t: Tables) -> DataFrame:
    """Responses with their true candidates and a judge's answer, in which the second candidate claims the first bullet and that is half specific."""
    said = F.replace(F.replace("answer", F.lit("<score>0.5</score></candidate >"), F.lit("<score>0.5</score><primary_match>1</primary_match></candidate >")), F.lit("<spec_score>0.9"), F.lit("<spec_score>0.4"))
    truth = t.judged.select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, "none").otherwise(F.col("candidates")).alias("candidates"), said.alias("judge"))
    return t.spread("orders").responses.join(truth, F.col("id") == F.col("k")).drop("k")


_TASK1 = f"""WITH {bullets_sql(RESULTS, TM, RQ)}, g AS ({_GATE}),
    w AS (SELECT id, least(0.3, sum(greatest(0, {words_sql('rq')} - 80) / 50.0 * 0.05)) AS wordy, least(0.2, 0.06 * (count(*) - count(DISTINCT {_NORM}))) AS dbl FROM b GROUP BY id),
    s AS (SELECT id, n_pairs, reason, result, CASE WHEN reason = 'ok' THEN 1.0 WHEN reason = 'single_pair' THEN 0.5 ELSE 0.0 END AS factor, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS w1, CASE WHEN id % 3 <> 0 THEN 2 ELSE 0 END AS w2,
        {_SCORE} AS s1, id % 4 AS m1, CASE WHEN n_pairs >= 1 THEN 0.5 ELSE 1.0 END AS p1, id % 3 <> 0 AND id % 4 = 1 AND n_pairs >= 1 AS clash FROM g),
    u AS (SELECT *, CASE WHEN clash AND coalesce(s1, 0) < 0.5 THEN 0.0 ELSE s1 END AS t1, CASE WHEN clash AND coalesce(s1, 0) >= 0.5 THEN 0.0 ELSE 0.5 END AS t2, 1 + CAST(id % 3 <> 0 AS INTEGER) AS n_truth FROM s),
    v AS (SELECT *, coalesce((w1 * coalesce(t1, 0) * CASE WHEN m1 = 0 THEN 0.0 WHEN m1 = 1 THEN p1 ELSE 1.0 END + w2 * t2 * p1) / nullif(CAST(CASE WHEN t1 IS NULL THEN 0 ELSE w1 END + w2 AS DOUBLE), 0), 0) AS recall,
        least(0.5, 0.005 * greatest(0, least(n_pairs, 7) - (n_truth + 1)) + 0.05 * greatest(0, n_pairs - 7)) AS cnt, greatest(0, {tokens_sql('result')} - 768) / 100.0 * 0.05 AS len FROM u)
    SELECT v.id, CASE WHEN v.id % 7 = 0 THEN 'no_candidate_items' ELSE reason END AS reason, CASE WHEN v.id % 7 = 0 THEN 0 ELSE round(recall, 6) END AS recall, CASE WHEN v.id % 7 = 0 THEN 0 ELSE CAST(clash AS INTEGER) END AS lost,
        CASE WHEN v.id % 7 = 0 THEN 0 ELSE round(greatest(0, recall * factor - len - cnt - coalesce(wordy, 0) - coalesce(dbl, 0)), 6) END AS score FROM v LEFT JOIN w ON v.id = w.id"""


@query("score_task1", _TASK1)
def _(t: Tables) -> DataFrame:
    rows = _task1(t).select("id", P.objectives_reward(F.col("response"), F.col("candidates"), F.col("judge")).alias("r"))
    return rows.select("id", "r.reason", r6(F.col("r.recall")).alias("recall"), "r.lost", r6(F.col("r.score")).alias("score"))


_PLAN = "concat('Objective: a Baseline Setup: b Variants: c ', CASE WHEN id % 3 = 0 THEN '' ELSE 'Fixed Protocols & Metrics: d ' END, repeat('word ', CASE WHEN id % 50 = 7 THEN 2500 ELSE 3 END))"


@query("score_task2", f"""WITH p AS (SELECT id, trim({_PLAN}) AS plan FROM {{judged}}), s AS (SELECT id, CASE id % 4 WHEN 0 THEN 0.5 WHEN 2 THEN NULL ELSE 1.0 END AS s1, CASE WHEN id % 4 <> 0 THEN 1 ELSE 0 END AS w2 FROM {{judged}})
    SELECT p.id, round(greatest(0, (3 * coalesce(s1, 0) + w2 * 0.5) / CAST(CASE WHEN s1 IS NULL THEN 0 ELSE 3 END + w2 AS DOUBLE) - CASE WHEN p.id % 5 = 0 THEN 0.25 ELSE 0 END - CASE WHEN p.id % 3 = 0 THEN 0.25 ELSE 0 END - greatest(0, {tokens_sql('plan')} - 2400) / 100.0 * 0.03), 6) AS score,
        CASE WHEN s1 IS NULL THEN 1 ELSE 0 END AS missing FROM p JOIN s ON p.id = s.id""")
def _(t: Tables) -> DataFrame:
    plan = F.expr(_PLAN)
    response = F.when(F.col("id") % 5 == 0, plan).otherwise(F.concat(F.lit("<Think>x</Think><Proposed_Plan>"), plan, F.lit("</Proposed_Plan>")))
    judge = F.concat("answer", F.lit('<item num="2"><score>0.5</score></item>'))
    return spread(t.judged).select("id", P.plan_reward(response, F.col("rubric"), judge).alias("r")).select("id", r6(F.col("r.score")).alias("score"), "r.missing")


@query("score_task1_eval", """SELECT id, status, round(recall, 6) AS recall, round(100.0 * (recall + 0.5 * (p_spec - 0.7)), 6) AS paper_score, round(greatest(0, recall - least(0.5, 0.005 * greatest(0, least(n_pred, 7) - (n_gt + 1)) + 0.05 * greatest(0, n_pred - 7))), 6) AS adjusted FROM {records} WHERE status = 'SUCCESS'""")
def _(t: Tables) -> DataFrame:
    adjusted = F.greatest(F.lit(0.0), F.col("recall") - P.count_penalty_relative(F.col("n_pred"), F.col("n_gt")))
    return t.records.filter("status = 'SUCCESS'").select("id", "status", r6(F.col("recall")).alias("recall"), r6(P.paper_score(F.col("recall"), F.col("p_spec"))).alias("paper_score"), r6(adjusted).alias("adjusted"))


@query("score_task2_eval", """SELECT id, CASE WHEN id % 2 = 0 THEN 'FAIL' ELSE 'SUCCESS' END AS status, CASE WHEN id % 4 = 0 THEN 'rubric has 1 items, expected 2' WHEN id % 4 = 2 THEN 'no score parsed' END AS reason,
    CASE id % 4 WHEN 1 THEN 0.875 WHEN 3 THEN 1.0 END AS design_score, CASE WHEN id % 2 = 1 THEN 1.0 END AS critical, CAST(NULL AS DOUBLE) AS major, CASE WHEN id % 4 = 1 THEN 0.5 END AS minor,
    CASE id % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 END AS parsed, CASE id % 4 WHEN 1 THEN 0 WHEN 3 THEN 1 END AS missing FROM {judged}""")
def _(t: Tables) -> DataFrame:
    judge = F.concat("answer", F.when(F.col("id") % 4 == 1, '<item num="2"><score>0.5</score></item>').otherwise(""))
    return t.judged.select("id", P.design_evaluation(F.col("rubric"), judge, 2).alias("r")).select("id", "r.*")


@query("route_source", "SELECT uid, idx, CASE WHEN data_source = 'src_A' THEN 'task1' WHEN data_source = 'src_N' THEN 'task2' END AS scorer FROM {rollouts}")
def _(t: Tables) -> DataFrame:
    return t.rollouts.select("uid", "idx", P.route_source(F.upper("data_source"), {"src_a": "task1", "src_n": "task2"}).alias("scorer"))


@query("route_grader", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'minerva' WHEN 2 THEN 'math' END AS grader FROM {customer}")
def _(t: Tables) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("openai/gsm8k", "aime2024", "lighteval/MATH", "unknown"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", P.route_grader(names).alias("grader"))


# ------------------------------------------------------------------ graders


@query("grd_gsm8k", "SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 0 END AS DOUBLE) AS strict, CAST(CASE WHEN c_custkey % 3 = 1 THEN 0.1 ELSE 1.0 END AS DOUBLE) AS flexible FROM {customer}")
def _(t: Tables) -> DataFrame:
    k, truth = F.col("c_custkey") % 3, (F.col("c_custkey") + 1000).cast("string")
    said = F.concat(F.lit("so 3 and "), F.when(k == 2, "").otherwise("#### "), F.when(k == 1, "1,5").otherwise(F.regexp_replace(truth, "^(.)", "$1,")), F.lit(" ."))
    strict, flexible = P.gsm8k_answer(said), F.translate(P.gsm8k_answer(said, flexible=True), ",", "")
    return t.customer.select("c_custkey", P.gsm8k_score(strict, truth, 0.1).alias("strict"), P.gsm8k_score(flexible, truth, 0.1).alias("flexible"))


@query("grd_gsm8k_extract", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS answer FROM {customer}")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", P.gsm8k_answer(F.concat(F.lit("a #### "), F.col("c_custkey").cast("string"))).alias("answer"))


def _answers(t: Tables) -> DataFrame:
    """Answers in many forms, right and wrong, by p_partkey % 8."""
    k = F.col("p_partkey")
    form, n = (k % 8).cast("int"), k.cast("string")
    frac = lambda x: F.concat(F.lit("\\frac{"), x.cast("string"), F.lit("}{7}"))
    boxed = lambda x: F.concat(F.lit("Thus Answer: $\\boxed{"), x, F.lit("}$"))
    said = F.element_at(F.array(
        boxed(frac(k)), boxed(F.lit("\\frac12")), boxed(frac(k + 1)), F.concat(F.lit("so \\fbox{"), n, F.lit("}")), F.concat(F.lit("\\boxed"), n, F.lit(" and {"), n, F.lit("}")),
        boxed(F.lit("x/2 ")), F.concat(F.lit("Answer: "), n, F.lit(" \\boxed "), n, F.lit("$ end")), F.concat(F.lit("no box, answer: "), n),
    ), form + 1)
    truth = F.element_at(F.array(frac(k), F.lit("1/2"), frac(k), n, n, F.lit("x/2"), n, n), form + 1)
    return spread(t.part.select("p_partkey", said.alias("said"), truth.alias("truth")))


@query("grd_math", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 IN (0, 1, 6) THEN 1 ELSE 0 END AS DOUBLE) AS score FROM {part}")
def _(t: Tables) -> DataFrame:
    return _answers(t).select("p_partkey", M.grader(M.math_correct)(F.col("said"), F.col("truth")).alias("score"))


@query("grd_minerva", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 IN (0, 5, 7) THEN 1 ELSE -1 END AS DOUBLE) AS score, CAST(CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS boxed FROM {part}")
def _(t: Tables) -> DataFrame:
    strict = M.grader(lambda s, t: M.minerva_score(s, t, strict_box=True))
    return _answers(t).select("p_partkey", M.grader(M.minerva_score)(F.col("said"), F.col("truth")).alias("score"), strict(F.col("said"), F.col("truth")).alias("boxed"))


@query("grd_choice", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 1.0 ELSE 0.0 END AS score FROM {part}")
def _(t: Tables) -> DataFrame:
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), 1)
    return t.part.select("p_partkey", P.choice_score(F.concat(F.lit("answer : $"), letter, F.lit("$")), F.lit("B")).alias("score"))


@query("grd_geo3k", "SELECT p_partkey, round(CASE WHEN p_partkey % 8 IN (0, 1, 5, 6, 7) THEN 0.9 ELSE 0 END + CASE WHEN p_partkey % 8 IN (0, 1, 2, 5) THEN 0.1 ELSE 0 END, 6) AS score FROM {part}")
def _(t: Tables) -> DataFrame:
    said = F.concat(F.lit("<think>x</think> "), "said")
    return _answers(t).select("p_partkey", r6(P.geo_score(M.grader(M.lenient_score)(said, F.col("truth")), P.geo_format(said))).alias("score"))


@query("grd_prime_math", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 6 IN (2, 5) THEN 0 ELSE 1 END AS DOUBLE) AS score FROM {part}")
def _(t: Tables) -> DataFrame:
    """Numbers, a hundredfold included; polynomials in other forms, right and wrong; matrices in other brackets."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    square = lambda last: text("x^2 + ", 2 * k, "x + ", last)
    form = (k % 6 + 1).cast("int")
    said = F.element_at(F.array((k * 100).cast("string"), k.cast("string"), (2 * k + 1).cast("string"), square(k * k), text("\\begin{bmatrix} ", k, " & 1 \\\\ 2 & 3 \\end{bmatrix}"), square(k * k + 1)), form)
    plain, factored = text(k, ".0"), text("(x + ", k, ")^2")
    truth = F.element_at(F.array(plain, plain, plain, factored, text("\\begin{pmatrix} \\frac{", 2 * k, "}{2} & 1 \\\\ 2 & 3.0 \\end{pmatrix}"), factored), form)
    return spread(t.part.select("p_partkey", said.alias("said"), truth.alias("truth"))).select("p_partkey", M.grader(M.lenient_score)(text("The answer is ", F.col("said"), "."), F.col("truth")).alias("score"))


@query("grd_prime_code", "SELECT uid, round(avg(acc) FILTER (WHERE idx < 10), 6) AS score FROM {rollouts} GROUP BY uid")
def _(t: Tables) -> DataFrame:
    return t.rollouts.filter("idx < 10").groupBy("uid").agg(r6(F.avg("acc")).alias("score"))


@query("grd_output_compare", "SELECT id, trim(title) = concat('Paper ', regexp_extract(pdf_url, '[0-9]+$')) AS same FROM {papers}")
def _(t: Tables) -> DataFrame:
    return t.papers.select("id", P.same_output(F.col("title"), F.concat(F.lit("Paper "), F.regexp_extract("pdf_url", "[0-9]+$", 0))).alias("same"))


@query("grd_batch", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 IN (0, 1, 5, 6, 7) THEN 1 ELSE 0 END AS DOUBLE) AS score FROM {part}")
def _(t: Tables) -> DataFrame:
    return _answers(t).select("p_partkey", M.grader(M.lenient_score)(F.col("said"), F.col("truth")).alias("score"))


@query("gen_digit_truth", "SELECT p_partkey, list_transform(range(1, 6), lambda i: (p_partkey + i * p_size) % 10) AS digits FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.digit_sequence(F.col("p_partkey"), F.col("p_size"), 5, 10).alias("digits"))


# --------------------------------------------------------------- converters


@query("cnv_gsm8k", "SELECT c_custkey, 'openai/gsm8k' AS data_source, concat(c_name, ' Think step by step and put the final answer after \"####\".') AS content, CAST(c_custkey AS VARCHAR) AS ground_truth, 'math' AS ability FROM {customer}")
def _(t: Tables) -> DataFrame:
    q = F.concat("c_name", F.lit(' Think step by step and put the final answer after "####".'))
    truth = P.gsm8k_answer(F.concat(F.lit("#### "), F.col("c_custkey").cast("string")))
    rows = t.customer.select("c_custkey", *R.rl_row(F.lit("openai/gsm8k"), q, "math", truth, F.struct(F.col("c_custkey").alias("index"))))
    return rows.select("c_custkey", "data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "ability")


@query("cnv_math", "SELECT p_partkey, p_name AS content, CASE WHEN p_partkey % 2 = 0 THEN concat('\\frac{', p_partkey, '}{7}') ELSE '\\frac12' END AS ground_truth FROM {part}")
def _(t: Tables) -> DataFrame:
    boxed, k = F.pandas_udf(lambda s: s.map(M.last_boxed), "string"), F.col("p_partkey")
    solution = F.concat(F.lit("Thus Answer: $\\boxed{\\frac"), F.when(k % 2 == 0, F.concat(F.lit("{"), k.cast("string"), F.lit("}{7}"))).otherwise("12"), F.lit("}$"))
    return t.part.select("p_partkey", F.col("p_name").alias("content"), boxed(solution).alias("ground_truth"))


@query("cnv_hellaswag", "SELECT p_partkey, concat(p_brand, ': ', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS query, [p_name, p_type] AS choices FROM {part} WHERE p_size > 0")
def _(t: Tables) -> DataFrame:
    ok = t.part.filter(F.length(F.col("p_size").cast("string")) > 0)
    return ok.select("p_partkey", X.wikihow_clean(F.concat("p_brand", F.lit(": "), X.capitalize(F.col("p_type")))).alias("query"), F.transform(F.array("p_name", "p_type"), X.wikihow_clean).alias("choices"))


def _preferences(t: Tables) -> DataFrame:
    return t.papers.select("id", X.text(F.col("goal")).alias("prompt"), F.col("think").alias("chosen"), F.col("result").alias("rejected"))


@query("cnv_hh_sft", "SELECT id, coalesce(goal, '') AS prompt, think AS response FROM {papers} UNION ALL SELECT id, coalesce(goal, ''), result FROM {papers}")
def _(t: Tables) -> DataFrame:
    return _preferences(t).select("id", "prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


@query("cnv_hh_rm", """WITH x AS (SELECT id, coalesce(goal, '') AS prompt, think AS chosen, result AS rejected, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {papers})
    SELECT id, prompt, chosen, rejected, 'train' AS split FROM x WHERE i < n * 75 // 100 UNION ALL SELECT id, prompt, chosen, rejected, 'test' FROM x WHERE i >= n * 75 // 100""")
def _(t: Tables) -> DataFrame:
    """Pairs, the first three quarters for training."""
    pairs, by_id = _preferences(t), [F.col("id")]
    return S.percent_slice(pairs, by_id, 0, 75).withColumn("split", F.lit("train")).unionByName(S.percent_slice(pairs, by_id, 75, 100).withColumn("split", F.lit("test")))


@query("cnv_hh_rl", "SELECT id, 'user' AS role, coalesce(goal, '') AS content, 'alignment' AS ability, 'model' AS style FROM {papers}")
def _(t: Tables) -> DataFrame:
    rows = t.papers.select("id", *R.rl_row(F.lit("pref"), X.text(F.col("goal")), "alignment", F.lit(""), F.struct("id"), "model"))
    return rows.select("id", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style")


@query("cnv_multiturn", """WITH c AS (SELECT conv_id, count(*) AS turns, array_agg(role ORDER BY turn) AS roles, array_agg(text ORDER BY turn) AS contents FROM {conversations} GROUP BY conv_id), p AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM c)
    SELECT conv_id, turns, roles, contents, CASE WHEN i < n * 2 // 3 THEN 'train' ELSE 'test' END AS split FROM p""")
def _(t: Tables) -> DataFrame:
    """Whole conversations, the first two thirds for training."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = t.conversations.groupBy("conv_id").agg(messages.alias("m"))
    placed = R.positions(rows.select("conv_id"), [F.col("conv_id")], "i")
    split = F.when(F.col("i") < placed.count() * 2 // 3, "train").otherwise("test")
    return rows.join(placed.select("conv_id", split.alias("split")), "conv_id").select("conv_id", F.size("m").cast("long").alias("turns"), F.col("m.role").alias("roles"), F.col("m.content").alias("contents"), "split")


@query("cnv_geo3k", "SELECT p_partkey, concat('<image>', p_name) AS content, length(p_type) AS bytes FROM {part}")
def _(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat(F.lit("<image>"), "p_name").alias("content"), F.array(F.struct(F.col("p_type").cast("binary").alias("bytes"))).alias("images"))
    return rows.select("p_partkey", "content", F.octet_length(F.col("images")[0]["bytes"]).alias("bytes"))


_EVAL = "SELECT 'aime' AS source, p_partkey AS id, p_name AS question, CAST(p_size AS VARCHAR) AS answer FROM {part} WHERE p_partkey % 2 = 0"


def _aime(t: Tables) -> DataFrame:
    return t.part.filter("p_partkey % 2 = 0").select(F.lit("aime").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_size").cast("string").alias("answer"))


@query("cnv_aime", _EVAL)
def _(t: Tables) -> DataFrame:
    return _aime(t)


@query("cnv_gpqa", "SELECT p_partkey AS id, list_transform(list_sort([concat(md5(concat(p_partkey, p_name)), p_name), concat(md5(concat(p_partkey, p_type)), p_type), concat(md5(concat(p_partkey, p_brand)), p_brand)]), lambda x: substr(x, 33)) AS choices FROM {part}")
def _(t: Tables) -> DataFrame:
    keyed = F.array(*(F.struct(F.md5(F.concat(F.col("p_partkey").cast("string"), F.col(c))).alias("k"), F.col(c).alias("v")) for c in ("p_name", "p_type", "p_brand")))
    return t.part.select(F.col("p_partkey").alias("id"), F.transform(F.array_sort(keyed), lambda x: x["v"]).alias("choices"))


@query("cnv_cnmo", _EVAL + " UNION ALL SELECT 'cnmo', p_partkey, p_type, p_brand FROM {part} WHERE p_partkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    other = t.part.filter("p_partkey % 2 = 1").select(F.lit("cnmo").alias("source"), F.col("p_partkey").alias("id"), F.col("p_type").alias("question"), F.col("p_brand").alias("answer"))
    return B.union_cast(_aime(t), other)


@query("cnv_lcb", "SELECT event_id, event_type FROM {events} WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-02' AND strftime(ts, '%Y-%m-%d') < '2024-01-04' AND CAST(json_extract(props, '$.k') AS BIGINT) > 20")
def _(t: Tables) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.filter((day >= "2024-01-02") & (day < "2024-01-04") & (F.from_json("props", "k long")["k"] > 20)).select("event_id", "event_type")


@query("cnv_sft", """SELECT id, replace(replace(replace('Read: {CONTENT} | for {GOAL}.', '{CONTENT}', coalesce(content, '')), '{GOAL}', coalesce(goal, '')), chr(0), '') AS prompt, concat('<Think>', chr(10), think, chr(10), '</Think>', chr(10), chr(10), '<Result>', chr(10), result, chr(10), '</Result>') AS response FROM {papers}
    WHERE in_sft AND n_focuses BETWEEN 1 AND 6 AND content IS NOT NULL AND trim(content) <> '' AND goal IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    rows = t.papers.filter(F.col("in_sft") & R.focus_range(F.col("n_focuses")) & R.not_blank(F.col("content")) & F.col("goal").isNotNull())
    prompt, response = R.template("Read: {CONTENT} | for {GOAL}.", F.col("content"), F.col("goal")), R.wrap_tags(F.col("think"), F.col("result"))
    return rows.select("id", prompt.alias("prompt"), response.alias("response"))


#: The tasks' prompts, and how many characters of content they take.  Other prompts can be given to rl_rows().
RL_PROMPTS = {
    "t1": (
        """You are an expert AI research scientist and a rigorous peer reviewer. Your task is to identify the key ablation research questions that should be investigated to rigorously validate a paper's central methodological claims.

<Research_Context>
(Paper context with ablation-related content removed)
{CONTENT}
</Research_Context>

**Task Instructions:**
1. Read the paper context carefully and infer the most important research questions that should be addressed by ablation or controlled analysis.
2. Identify which components, mechanisms, or assumptions are most scientifically vulnerable.
3. Consider what causal confounders or alternative explanations a skeptical reviewer would raise.
4. Focus on research questions that are necessary to verify whether the claimed gains truly come from the proposed method.
5. Stay at the level of research questions rather than detailed implementation.

**Important Constraints:**
- Do not propose full experimental plans, datasets, hyperparameters, or exact protocols.
- Prefer mechanistically meaningful and causally informative questions over superficial component toggles.
- Identify the 2-6 most critical ablation targets. Prioritize scientific necessity over completeness.

**Output Format:** Each bullet represents one atomic ablation target. Output the most scientifically necessary targets (typically 2-6).

<Think>
[A brief reasoning process explaining the most important scientific vulnerabilities and causal uncertainties.]
</Think>

<Result>
[A list of target modules and their corresponding high-level research questions.]

- Target Module: [Name of the component or design choice]
    - Research Question: [One precise sentence summarizing the exact hypothesis to test]
</Result>""",
        50_000,
    ),
    "t2": (
        """You are an expert AI research scientist specializing in scientific experimental design. Your task is to construct a rigorous and reproducible ablation plan for a given ablation goal, based on the paper's methodology context.

<Research_Context>
{CONTENT}
</Research_Context>

<Ablation_Goal>
{GOAL}
</Ablation_Goal>

**Task Instructions:**
1. Design a scientifically rigorous experimental plan that directly tests the given ablation goal.
2. Define a fair baseline.
3. Specify the most important ablation or control variants.
4. Isolate the intended causal factor as cleanly as possible.
5. Keep unrelated components fixed unless a change is explicitly required.
6. Include the critical protocols and evaluation metrics needed for a reproducible comparison.

**Important Constraints:**
- Focus on causal validity, fairness of comparison, and confounder isolation.
- Avoid introducing unnecessary complexity or speculative variants not grounded in the methodology context.
- If a stronger control is needed to rule out a plausible alternative explanation, include it.

**Output Format:**

<Think>
[A brief reasoning process explaining how the ablation goal maps to the key controls, baselines, and confounders.]
</Think>

<Proposed_Plan>
- Objective: [Brief statement of the design goal]
- Baseline Setup: [Clear definition of the control condition]
- Variants: [The main ablation or control conditions and what each one changes]
- Fixed Protocols & Metrics: [Key training constraints, datasets, evaluation settings, and primary metrics in a single paragraph]
</Proposed_Plan>""",
        60_000,
    ),
}


def rl_rows(papers: DataFrame, name: str, prompts: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """A task's reinforcement-learning rows; the first task has no goal, so a {GOAL} in its content stays."""
    pattern, limit = (prompts or RL_PROMPTS)[name]
    prompt = R.template(pattern, R.truncate_chars(X.text(F.col("content")), limit), F.col("goal") if name == "t2" else F.lit("{GOAL}"))
    return papers.select(*R.rl_row(F.lit(name), prompt, "reasoning", X.text(F.col("goal")), F.struct(F.col("id").alias("index"), F.col("venue").alias("venue") if name == "t1" else F.col("title").alias("title"))))


def _rl(t: Tables, name: str) -> DataFrame:
    return rl_rows(t.papers.filter(F.col("in_sft")), name)


def _rl_sql(name: str) -> str:
    """The whole prompt, by replacing in the pattern what it names."""
    pattern, limit = RL_PROMPTS[name]
    content = f"replace('{pattern.replace(chr(39), 2 * chr(39))}', '{{CONTENT}}', substr(coalesce(content, ''), 1, {limit}))"
    filled = f"replace({content}, '{{GOAL}}', coalesce(goal, ''))" if name == "t2" else content
    return f"SELECT '{name}' AS data_source, {filled} AS content, coalesce(goal, '') AS ground_truth, id AS index FROM {{papers}} WHERE in_sft"


@query("cnv_rl_t1", _rl_sql("t1"))
def _(t: Tables) -> DataFrame:
    return _rl(t, "t1").select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


@query("cnv_rl_t2", _rl_sql("t2"))
def _(t: Tables) -> DataFrame:
    return _rl(t, "t2").select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


@query("cnv_combined", "SELECT data_source, content, ground_truth, index, coalesce(venue, '') AS venue, '' AS title FROM (" + _rl_sql("t1").replace(" FROM {papers}", ", venue FROM {papers}") + ") a UNION ALL SELECT data_source, content, ground_truth, index, '', title FROM (" + _rl_sql("t2").replace(" FROM {papers}", ", title FROM {papers}") + ") b")
def _(t: Tables) -> DataFrame:
    both = B.union_filled(_rl(t, "t1"), _rl(t, "t2"))
    return both.select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index", "extra_info.venue", "extra_info.title")
