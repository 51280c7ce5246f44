"""Projections, filters and joins of row tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.ordering import positions, sum_before


def keep_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*(c for c in wanted if c in df.columns))


def alias_coalesce(*names: Column) -> Column:
    """First that isn't null, else empty."""
    return F.coalesce(*names, F.lit(""))


def meta_struct(df: DataFrame, fields: Sequence[str] = ("title", "venue", "year", "pdf_url")) -> Column:
    """The struct column meta where it is set, else one of the fields that are there."""
    built = F.struct(*(X.text(df[c].cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields))
    return F.coalesce(df["meta"], built) if "meta" in df.columns else built


def template(pattern: str, content: Column, goal: Column) -> Column:
    """Fills {CONTENT}, then {GOAL}; a {GOAL} inside the content is filled as well."""
    return F.replace(F.replace(F.lit(pattern), F.lit("{CONTENT}"), X.text(content)), F.lit("{GOAL}"), X.text(goal))


def truncate_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n) if n > 0 else c


def wrap_tags(think: Column, result: Column, tag: str = "Result") -> Column:
    return F.concat(F.lit("<Think>\n"), X.text(think), F.lit(f"\n</Think>\n\n<{tag}>\n"), X.text(result), F.lit(f"\n</{tag}>"))


def chat(*turns: tuple[str, Column]) -> Column:
    """Array of (content, role)."""
    return F.array(*(F.struct(c.alias("content"), F.lit(r).alias("role")) for r, c in turns))


def chat_template(messages: Column, generate: bool = True) -> Column:
    """A generic rendering of a message list as one prompt."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def rl_row(source: Column, prompt: Column, ability: str, truth: Column, extra: Column, style: str = "rule") -> list[Column]:
    """The five fields of a reinforcement-learning row."""
    return [source.alias("data_source"), chat(("user", prompt)).alias("prompt"), F.lit(ability).alias("ability"), F.struct(truth.alias("ground_truth"), F.lit(style).alias("style")).alias("reward_model"), extra.alias("extra_info")]


def shuffled_order(seed: int, *key: Column) -> list[Column]:
    """An order that depends on the seed and the key's values alone: the same on any cluster."""
    named = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))
    return [F.md5(named), *key]


def with_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "index") -> DataFrame:
    """0-based position in an order, in each partition of `by`.

    Without `by` the numbers come from counts per range of the order, not from
    one task that sorts everything."""
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    return positions(df, order, name)


def coerce_strings(df: DataFrame, fields: Sequence[str], index: str | None = None) -> DataFrame:
    """Fields as strings, null as empty; the index as a number, 0 if it isn't one."""
    out = df
    for c in fields:
        out = out.withColumn(c, X.text(F.col(c).cast("string")))
    return out.withColumn(index, F.coalesce(F.col(index).try_cast("long"), F.lit(0))) if index else out


def extra_info(c: Column, schema: str) -> Column:
    """Struct of the parsed JSON text (null if it is bad) and the raw text where it is."""
    clean = X.strip(X.text(c))
    parsed = F.from_json(clean, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = (clean != "") & (parsed["_bad"].isNotNull() | parsed.isNull())
    return F.struct(F.when(~bad, parsed).alias("info"), F.when(bad, clean).alias("raw_extra_info"))


def pop(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns with the row key, and the rest."""
    return df.select(*by, *keys), df.drop(*keys)


def hstack(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both by row key; columns of one name must agree, nulls and NaN included, else the query raises."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__b_{c}") if c in shared else F.col(c) for c in b.columns if c != key))
    out = a.join(right, a[key] == right["__key"], "full")
    missing = F.col(key).isNull() | F.col("__key").isNull()
    out = out.withColumn(key, F.when(missing, F.raise_error(F.lit("rows differ")).cast("long")).otherwise(F.col(key)))
    for c in shared:
        out = out.withColumn(c, F.when(~F.col(c).eqNullSafe(F.col(f"__b_{c}")), F.raise_error(F.lit(f"{c} differs")).cast(a.schema[c].dataType)).otherwise(F.col(c)))
    return out.select(*a.columns, *(c for c in b.columns if c not in a.columns))


def fold(df: DataFrame, index: str, size: int) -> DataFrame:
    """Blocks of `size` adjacent rows as one row with an array."""
    rows = F.sort_array(F.collect_list(F.struct(index, *(c for c in df.columns if c != index))))
    return df.groupBy(F.floor(F.col(index) / size).cast("long").alias("block")).agg(rows.alias("rows"))


def unfold(df: DataFrame) -> DataFrame:
    return df.select("block", F.explode("rows").alias("r")).select("block", "r.*")


def flatten_schema(df: DataFrame, elements: int = 0, sep: str = "/") -> DataFrame:
    """Nested fields as flat columns a/b; arrays as their length a/list_len and their first `elements` elements a/0, a/1, ...,
    null beyond the array's end.  Use most_elements() for all of them."""

    def walk(prefix: str, kind, path: Column) -> list[Column]:
        if kind.typeName() == "struct":
            return [x for f in kind.fields for x in walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, path[f.name])]
        if kind.typeName() == "array":
            return [F.size(path).alias(f"{prefix}{sep}list_len"), *(x for i in range(elements) for x in walk(f"{prefix}{sep}{i}", kind.elementType, F.get(path, F.lit(i))))]
        return [path.alias(prefix)]

    return df.select(*(x for f in df.schema.fields for x in walk(f.name, f.dataType, F.col(f"`{f.name}`"))))


def most_elements(df: DataFrame) -> int:
    """The length of the longest array that is a column, or a field of one."""

    def arrays(kind, path: Column) -> list[Column]:
        if kind.typeName() == "struct":
            return [x for f in kind.fields for x in arrays(f.dataType, path[f.name])]
        return [F.size(path)] if kind.typeName() == "array" else []

    sizes = [x for f in df.schema.fields for x in arrays(f.dataType, F.col(f"`{f.name}`"))]
    return max(0, df.agg(F.max(F.greatest(*sizes) if len(sizes) > 1 else sizes[0])).first()[0] or 0) if sizes else 0


# ------------------------------------------------------------------ filters


def not_blank(c: Column) -> Column:
    return X.strip(X.text(c)) != ""


def focus_range(n: Column, least: int = 1, most: int = 6) -> Column:
    return n.between(least, most)


def count_focuses(candidates: Column) -> Column:
    return F.regexp_count(X.text(candidates), F.lit("(?i)<Investigation_Focus>"))


def waterfall(*rules: tuple[str, Column]) -> Column:
    """The first rule's name that holds, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, rule in rules:
        out = out.when(rule, name)
    return out


def group_variance(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """Groups whose metric varies, or of one row."""
    w = Window.partitionBy(*group)
    keep = (F.stddev_pop(metric).over(w) > 0) | (F.count("*").over(w) == 1)
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


def fill_batch(groups: DataFrame, order: Sequence[Column], size: str, wanted: int) -> DataFrame:
    """The groups, in order, that fill a batch: all that begin before it is full."""
    return sum_before(groups, order, F.col(size), "__before").filter(F.col("__before") < wanted).drop("__before")


def accuracy_band(df: DataFrame, group: Sequence[str], metric: str, low: float, high: float) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn("__m", F.avg(metric).over(w)).filter(F.col("__m").between(low, high)).drop("__m")


def untruncated_groups(df: DataFrame, group: Sequence[str], length: str, longest: int) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn("__m", F.max(length).over(w)).filter(F.col("__m") < longest - 1).drop("__m")


# -------------------------------------------------------------------- joins


def last_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key that isn't blank, by max_by: one aggregation."""
    rest = [c for c in df.columns if c != key]
    picked = df.filter(not_blank(F.col(key))).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def join_generations(generations: DataFrame, bench: DataFrame, key: str, order: Sequence[Column], how: str = "inner") -> DataFrame:
    """Generations with their benchmark row, the last one of equal keys.  AQE broadcasts the benchmark if it is small."""
    return generations.join(last_wins(bench, key, order), key, how)


def pending(items: DataFrame, done: DataFrame, title: str = "title") -> DataFrame:
    """Items whose stripped title isn't done; a blank title never is."""
    finished = done.select(X.strip(X.text(F.col(title))).alias("__t")).filter("__t <> ''").distinct()
    return items.withColumn("__own", X.strip(X.text(F.col(title)))).join(finished, F.col("__own") == F.col("__t"), "left_anti").drop("__own")


def self_pairs(df: DataFrame, group: Sequence[str], index: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of rows of a group, the lower index first: columns c_a and c_b.  Groups are prompts' rollouts, of bounded size."""
    a = df.select(*group, F.col(index).alias("i_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = df.select(*group, F.col(index).alias("i_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, list(group)).filter("i_a < i_b")


def reorder(df: DataFrame, index: str, order: DataFrame) -> DataFrame:
    """Rows by a permutation table (position, source): row `source` goes to `position`."""
    return df.join(order, df[index] == order["source"]).drop("source")
