"""Text functions as column expressions: cleaning, tagged blocks, bullets, judge output.

White space is Unicode's, as Python's str.split() has it; Java's \\s alone is ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"

#: Headers of a target module and of a research question; a bullet sign is needed in the first pair only.
TARGET = rf"(?i)\n{WS}*[-*]{WS}*(?:\*\*)?Target Module(?:\*\*)?{WS}*:"
QUESTION = rf"(?i)\n{WS}*[-*]{WS}*(?:\*\*)?Research Question(?:\*\*)?{WS}*:"
TARGET_LOOSE = rf"(?i)\n{WS}*(?:[-*]{WS}*)?(?:\*\*)?Target Module(?:\*\*)?{WS}*:"
QUESTION_LOOSE = rf"(?i)\n{WS}*(?:[-*]{WS}*)?(?:\*\*)?Research Question(?:\*\*)?{WS}*:"
#: Phrases that make a candidate weigh 3 rather than 2.
CRITICAL = ("central claim", "core", "necessity", "causal", "main mechanism", "critical component")
#: Labels that a plan must have.
SECTIONS = ("objective:", "baseline setup:", "variants:", "fixed protocols & metrics:")
#: Words that don't count when two target modules are compared.
DOUBLING_STOP = tuple(
    """strategy design method approach framework mechanism protocol system
    pipeline algorithm technique procedure evaluation analysis assessment
    validation verification robustness generalization adaptability scalability
    efficiency optimization training inference composition architecture
    configuration setting choice selection tuning sensitivity effectiveness
    performance integrity suitability interaction integration combination
    components component module modules mechanisms process processes
    aspect aspects strategies designs techniques approaches methods
    function functions operation operations
    term terms level levels rate rates size sizes range ranges
    value values part parts number numbers version versions type types
    and with for the in of to on from by vs versus via
    using its their this that these those such
    each some any all one two three
    at as an is are be can will may does""".split()
)


def text(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The characters of WS.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), rf"{WS}+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit(rf"{NOT_WS}+"))


def approx_tokens(c: Column) -> Column:
    """The larger of the word count and a quarter of the characters, rounded up."""
    return F.greatest(word_count(c), F.ceil(F.length(text(c)) / 4)).cast("int")


def extract_block(c: Column, tag: str, insensitive: bool = True, open_end: bool = False) -> Column:
    """The first block of the tag, stripped; without one the whole text, stripped."""
    pattern = f"(?{'i' if insensitive else ''}s)<{tag}>(.*?)" + (rf"(?:</{tag}>|\z)" if open_end else f"</{tag}>")
    t = text(c)
    inner = F.when(F.regexp_like(t, F.lit(pattern)), F.regexp_extract(t, pattern, 1)).otherwise(t)
    return inner if open_end else strip(inner)


def extract_field(c: Column, field: str) -> Column:
    return strip(F.regexp_extract(text(c), f"(?s)<{field}>(.*?)</{field}>", 1))


def heuristic_weight(focus: Column, description: Column) -> Column:
    merged = F.lower(F.concat_ws(" ", text(focus), text(description)))
    return F.when(reduce(lambda a, b: a | b, (F.contains(merged, F.lit(m)) for m in CRITICAL)), 3).otherwise(2)


def parse_candidates(c: Column) -> Column:
    """Array of (candidate_id, focus, description, weight) of the blocks that have a focus."""
    blocks = F.regexp_extract_all(text(c), F.lit("(?s)<Candidate>(.*?)</Candidate>"), 1)

    def one(b: Column) -> Column:
        focus, description, number = (extract_field(b, f) for f in ("Investigation_Focus", "Description_Text", "ID"))
        return F.struct(
            F.when(F.regexp_like(number, F.lit("^[0-9]+$")), number.try_cast("int")).alias("candidate_id"),
            normalize_ws(focus).alias("focus"), normalize_ws(description).alias("description"), heuristic_weight(focus, description).alias("weight"),
        )

    return F.filter(F.transform(blocks, one), lambda x: x["focus"] != "")


def parse_focuses(c: Column) -> Column:
    found = F.regexp_extract_all(text(c), F.lit("(?s)<Investigation_Focus>(.*?)</Investigation_Focus>"), 1)
    return F.filter(F.transform(found, strip), lambda x: x != "")


def parse_rubric(c: Column) -> Column:
    """Array of (item_num, level, weight, criterion), any number of items."""
    t = text(c)
    block = "(?is)<Rubric>(.*?)</Rubric>"
    inner = F.when(F.regexp_like(t, F.lit(block)), F.regexp_extract(t, block, 1)).otherwise(t)
    item = rf'(?is)<item{WS}+num="([0-9]+)"{WS}+level="(critical|major|minor)"{WS}+weight="([0-9]+)"{WS}*>(.*?)</item>'
    whole = F.regexp_extract_all(inner, F.lit(item), 0)
    return F.transform(whole, lambda x: F.struct(
        F.regexp_extract(x, item, 1).cast("int").alias("item_num"), F.lower(F.regexp_extract(x, item, 2)).alias("level"),
        F.regexp_extract(x, item, 3).cast("int").alias("weight"), normalize_ws(F.regexp_extract(x, item, 4)).alias("criterion"),
    ))


def _bullet_parts(c: Column, loose: bool) -> Column:
    """Array of (tm, rq): the texts after a target header and after the first question header before the next one."""
    target, question = (TARGET_LOOSE, QUESTION_LOOSE) if loose else (TARGET, QUESTION)
    # One native search for each mark: a pattern that finds none hands the text on as it is, translate() copies it character by character.
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(text(c), "[\x01-\x03]+", "")), target, "\x01")
    pieces = F.slice(F.split(marked, "\x01"), 2, 10**9)
    plain = lambda x: F.regexp_replace(x, "[\x02\x03]+", "")

    def cut(p: Column) -> Column:
        """Where a question header begins (0: nowhere) and its piece; one right after the target header doesn't count."""
        return let(F.regexp_replace(p, question, "\x02$0\x03"), lambda q: F.struct(q.alias("q"), F.locate("\x02", q, 2).alias("at")))

    def pair(x: Column) -> Column:
        end = F.call_function("locate", F.lit("\x03"), x["q"], x["at"])
        return F.struct(plain(F.substring(x["q"], F.lit(1), x["at"] - 1)).alias("tm"), plain(F.substring(x["q"], end + 1, F.length(x["q"]))).alias("rq"))

    return F.transform(F.filter(F.transform(pieces, cut), lambda x: x["at"] > 0), pair)


def _tidy(c: Column) -> Column:
    return strip(F.rtrim(strip(F.ltrim(strip(c), F.lit(":"))), F.lit("*")))


def _bullet(p: Column) -> Column:
    cut = let(_tidy(p["rq"]), lambda rq: F.when(F.length(rq) > 400, F.concat(F.substring(rq, 1, 400), F.lit("..."))).otherwise(rq))
    return F.struct(_module(p).alias("target_module"), cut.alias("research_question"))


def parse_bullets(c: Column, loose: bool = False) -> Column:
    """Array of (target_module, research_question), in order, cut to 300 and 400 characters."""
    return F.transform(_bullet_parts(c, loose), _bullet)


def _module(p: Column) -> Column:
    return F.substring(_tidy(p["tm"]), 1, 300)


def target_modules(c: Column) -> Column:
    """The target modules of parse_bullets() alone."""
    return F.transform(_bullet_parts(c, False), _module)


def modules_and_words(c: Column) -> Column:
    """Struct of the target modules of parse_bullets() and of question_words(), from one look at the text."""
    return let(_bullet_parts(c, False), lambda p: F.struct(F.transform(p, _module).alias("modules"), F.transform(p, lambda x: word_count(x["rq"])).alias("words")))


def count_pairs(c: Column) -> Column:
    t = F.concat(F.lit("\n"), text(c))
    return F.least(F.regexp_count(t, F.lit(TARGET)), F.regexp_count(t, F.lit(QUESTION)))


def has_format(c: Column) -> Column:
    t = F.concat(F.lit("\n"), text(c))
    return F.regexp_like(t, F.lit(TARGET)) & F.regexp_like(t, F.lit(QUESTION))


def question_words(c: Column) -> Column:
    """Word counts of the whole questions."""
    return F.transform(_bullet_parts(c, False), lambda p: word_count(p["rq"]))


def required_sections(c: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(F.lower(text(c)), F.lit(s)) for s in SECTIONS))


def format_bullets(bullets: Column) -> Column:
    """A numbered block, or a note if there are none."""
    lines = F.transform(bullets, lambda b, i: F.concat(
        F.lit('<bullet num="'), (i + 1).cast("string"), F.lit('">\n<target_module>'), b["target_module"], F.lit("</target_module>\n<research_question>"), b["research_question"], F.lit("</research_question>\n</bullet>"),
    ))
    return F.when(F.size(bullets) == 0, "(no parseable bullets in the generated result)").otherwise(F.array_join(lines, "\n"))


def parse_score(c: Column, binary: bool = False) -> Column:
    """The first number, moved to the nearest of 0, 0.5 and 1 (or 0 and 1), the lower one on ties; null without one."""
    cleaned = strip(F.regexp_replace(strip(text(c)), r"^[\[\](){}]+|[\[\](){}]+$", ""))
    v = F.regexp_extract(cleaned, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    if binary:
        return F.when(v.isNull(), None).when(v <= 0.5, 0.0).otherwise(1.0)
    return F.when(v.isNull(), None).when(v <= 0.25, 0.0).when(v <= 0.75, 0.5).otherwise(1.0)


def parse_score_clamped(c: Column) -> Column:
    """The whole text as a number, clamped to 0 to 1; null if it isn't one."""
    v = strip(text(c)).try_cast("double")
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def judged_blocks(c: Column, tag: str) -> Column:
    """Array of (num, body) of the tag's numbered blocks, tolerant of spaces, case and quotes."""
    pattern = rf"(?is)<{WS}*{tag}\b[^>]*(?:num|number|id){WS}*={WS}*[\"']?{WS}*([0-9]+){WS}*[\"']?[^>]*>(.*?)</{WS}*{tag}{WS}*>"
    return let(text(c), lambda t: F.zip_with(F.regexp_extract_all(t, F.lit(pattern), 1), F.regexp_extract_all(t, F.lit(pattern), 2), lambda n, body: F.struct(n.try_cast("int").alias("num"), body.alias("body"))))


def inner(c: Column, tag: str) -> Column:
    """What the first such tag holds, stripped; null if there is none."""
    pattern = rf"(?is)<{WS}*{tag}{WS}*>(.*?)</{WS}*{tag}{WS}*>"
    return strip(F.get(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(0)))


def first_of(blocks: Column, num: Column) -> Column:
    """The body of the first block with this number, or null."""
    return F.get(F.filter(blocks, lambda b: b["num"] == num), F.lit(0))["body"]


def _numbered(c: Column, tag: str, n: Column, one) -> Column:
    """one(number, body of the tag's first block with that number or null) for 1 to n; null if n is 0."""
    return F.when(n > 0, let(judged_blocks(c, tag), lambda blocks: F.transform(F.sequence(F.lit(1), n), lambda i: let(first_of(blocks, i), lambda body: one(i, body)))))


def _score_of(body: Column) -> Column:
    return let(inner(body, "score"), lambda x: F.when(x.isNotNull(), parse_score(x)))


def parse_judge(c: Column, n: Column, critique: bool = True) -> Column:
    """Array of (num, critique, score, primary_match) for candidates 1 to n; without critique, if that isn't asked for."""

    def one(i: Column, body: Column) -> Column:
        said = [F.coalesce(inner(body, "critique"), F.lit("")).alias("critique")] if critique else []
        return F.struct(i.alias("num"), *said, _score_of(body).alias("score"), F.regexp_extract(inner(body, "primary_match"), "-?[0-9]+", 0).try_cast("int").alias("primary_match"))

    return _numbered(c, "candidate", n, one)


def parse_items(c: Column, n: Column, critique: bool = True) -> Column:
    """Array of (num, critique, score) for rubric items 1 to n; without critique, if that isn't asked for."""

    def one(i: Column, body: Column) -> Column:
        said = [F.coalesce(inner(body, "critique"), F.lit("")).alias("critique")] if critique else []
        return F.struct(i.alias("num"), *said, _score_of(body).alias("score"))

    return _numbered(c, "item", n, one)


def parse_specificity(c: Column, n: Column) -> Column:
    """Map of bullet number to score; the surrounding block is optional."""
    block = rf"(?is)<{WS}*Bullet_Specificity{WS}*>(.*?)</{WS}*Bullet_Specificity{WS}*>"
    where = let(text(c), lambda t: F.when(F.regexp_like(t, F.lit(block)), F.regexp_extract(t, block, 1)).otherwise(t))
    entries = _numbered(where, "bullet", F.greatest(n, F.lit(1)), lambda i, body: F.struct(i.alias("key"), parse_score(inner(body, "spec_score")).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["key"] <= n)))


def core_words(c: Column) -> Column:
    """The different words of more than two letters that aren't stop words."""
    words = F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*DOUBLING_STOP)))


def doubling_norm(c: Column) -> Column:
    lowered = F.regexp_replace(F.lower(text(c)), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, rf"[^a-z0-9\s\x0b\x1c-\x1f\x85\p{{Z}}]+", " "), rf"{WS}+", " "))


def doubling_form(c: Column) -> Column:
    """Struct of what two target modules are compared by."""
    return F.struct(doubling_norm(c).alias("name"), core_words(c).alias("words"))


def same_module(a: Column, b: Column, threshold: float = 0.7) -> Column:
    """Whether two doubling_form()s name the same thing: one contains the other, or they share most core words."""
    x, y = a["name"], b["name"]
    contained = (F.length(x) >= 8) & (F.length(y) >= 8) & (F.contains(x, y) | F.contains(y, x))
    least = F.least(F.size(a["words"]), F.size(b["words"]))
    return contained | let(F.size(F.array_intersect(a["words"], b["words"])), lambda n: (n >= 2) & (n / least > threshold))


def is_doubling(a: Column, b: Column, threshold: float = 0.7) -> Column:
    return let(F.struct(doubling_form(a).alias("a"), doubling_form(b).alias("b")), lambda p: same_module(p["a"], p["b"], threshold))


def wikihow_clean(c: Column) -> Column:
    t = F.replace(strip(text(c)), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(text(c), 1, 1)), F.lower(F.substring(text(c), 2, 2**31 - 1)))


def think_mask(c: Column, open_tag: str = "<Think>", close_tag: str = "</Think>") -> Column:
    """Per character 0 inside the think block, its tags and the one before it, else 1."""
    t = text(c)

    def runs(p: Column) -> Column:
        """Ones, zeros and ones, by their numbers: tags are looked for once a text, not once a character."""
        before, n = F.greatest(p["start"] - 2, F.lit(0)), F.length(t)
        after = n - (p["end"] + len(close_tag) - 1)
        whole = (p["start"] > 0) & (p["end"] > p["start"])
        return F.when(whole, F.concat(F.array_repeat(F.lit(1), before), F.array_repeat(F.lit(0), n - before - after), F.array_repeat(F.lit(1), after))).otherwise(F.array_repeat(F.lit(1), n))

    return F.when(F.length(t) > 0, let(F.struct(F.locate(open_tag, t).alias("start"), F.locate(close_tag, t).alias("end")), runs))


def metric_line(c: Column) -> Column:
    """A map of 'key:value - key:value' lines' numbers."""
    pairs = F.filter(F.transform(F.split(text(c), " - "), lambda x: F.split(x, ":")), lambda x: (F.size(x) == 2) & x[1].try_cast("double").isNotNull())
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(x[0]).alias("key"), x[1].try_cast("double").alias("value"))))


def strip_pad(c: Column, pad: str = "<|endoftext|>") -> Column:
    return F.replace(text(c), F.lit(pad), F.lit(""))


def think_token_mask(c: Column, offsets: Column, mask: Column | None = None, prompt: Column | int = 0, open_tag: str = "<Think>", close_tag: str = "</Think>") -> Column:
    """mask (all ones if none is given) with 0 for the tokens of the first think block and the one before them.

    offsets: per token of the response its start and end, in order; a token is in the block if it begins and ends
    in it, tags included, and isn't empty.  mask has `prompt` places before the response's
    tokens, and may end before the last of them.  Without a whole block the mask stays."""
    prompt = prompt if isinstance(prompt, Column) else F.lit(prompt)
    mask = F.array_repeat(F.lit(1), F.size(offsets) + prompt) if mask is None else mask
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  computed once, not for each token
    opens = F.locate(open_tag, text(c)) - 1
    closes = F.when(opens >= 0, F.call_function("locate", F.lit(close_tag), text(c), opens + 1 + len(open_tag)) - 1).otherwise(-1)

    def marked(tags: Column) -> Column:
        inside = F.transform(offsets, lambda o: (o["start"] >= tags["a"]) & (o["end"] <= tags["b"] + len(close_tag)) & (o["end"] > o["start"]))
        return F.when(tags["b"] >= 0, inside).otherwise(F.array().cast("array<boolean>"))

    def parts(p: Column) -> Column:
        """The mask with zeros from place a to before place b."""
        return F.concat(F.slice(p["m"], F.lit(1), p["a"]), F.array_repeat(F.lit(0), p["b"] - p["a"]), F.slice(p["m"], p["b"] + 1, F.size(p["m"]) - p["b"]))

    def hidden(inside: Column) -> Column:
        first = F.array_position(inside, True) - 1 + prompt
        last = F.size(inside) - F.array_position(F.reverse(inside), True) + prompt
        ends = F.struct((first - 1).cast("int").alias("a"), last.cast("int").alias("b"))
        zeros = bound(ends, lambda e: bound(F.struct(mask.alias("m"), F.least(F.greatest(e["a"], F.lit(0)), F.size(mask)).alias("a"), F.least(e["b"] + 1, F.size(mask)).alias("b")), parts))
        return F.when(F.array_contains(inside, True), zeros).otherwise(mask)

    return bound(bound(F.struct(opens.alias("a"), closes.alias("b")), marked), hidden)
