"""Queries by key, each with the SQL that says the same in DuckDB.

`FIXTURES` derives the shapes that the operators work on (rollouts, token rows,
tagged texts) from the test tables, in SQL that both engines read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FIXTURES: dict[str, str] = {
    # One row per response to a prompt (uid), with scores.
    "rollouts": """
        SELECT l_orderkey AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS BIGINT) AS idx,
               concat('src_', l_returnflag) AS data_source, CAST(l_orderkey % 97 AS BIGINT) AS prompt, l_discount * 10 AS score, l_tax * 10 AS baseline,
               CAST(l_quantity AS BIGINT) AS len, CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS acc, concat('v', CAST(l_linenumber % 3 AS STRING)) AS vote
        FROM {lineitem}""",
    # One row per token t of a response uid.
    "tokens": """
        SELECT uid, idx AS t, score / 10 - 0.05 AS reward, baseline / 2 AS value, -len / 50.0 AS old_logp, -score * 0.9 AS logp, -baseline AS ref_logp, score - 0.4 AS adv,
               CAST(CASE WHEN idx < 5 THEN 1 ELSE 0 END AS BIGINT) AS mask, len AS token
        FROM {rollouts}""",
    # One row per paper, the source table of the training sets.
    "papers": """
        SELECT o_orderkey AS id, concat('http://papers/', CAST(o_custkey AS STRING)) AS pdf_url, concat(' Paper ', CAST(o_custkey AS STRING), ' ') AS title,
               CASE WHEN o_orderkey % 11 = 0 THEN '   ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('Content of ', CAST(o_orderkey AS STRING), ' with {GOAL} and ', o_orderpriority) END AS content,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('goal ', o_orderstatus) END AS goal, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'fallback' END AS other_goal,
               CAST(o_orderkey % 9 AS BIGINT) AS n_focuses, o_orderkey % 3 <> 0 AS in_sft, repeat(concat('t', o_orderstatus, ' '), CAST(o_orderkey % 120 AS INT)) AS think,
               repeat('result ', CAST(o_orderkey % 37 AS INT)) AS result, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS venue
        FROM {orders}""",
    # Model responses with think and result blocks and bullets.
    "responses": """
        SELECT o_orderkey AS id, concat(
            CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('<Think>', chr(10), 'because ', o_orderpriority, chr(10), '</Think>', chr(10)) END,
            CASE WHEN o_orderkey % 8 = 1 THEN '' WHEN o_orderkey % 8 = 2 THEN '<result>' ELSE '<Result>' END, chr(10),
            CASE WHEN o_orderkey % 6 = 0 THEN 'plain words only' ELSE concat('- **Target Module**: ', o_orderpriority, ' encoder (', o_orderstatus, ')', chr(10), '  - **Research Question**: Does it help ', repeat('very ', CAST(o_orderkey % 95 AS INT)), 'much?') END, chr(10),
            CASE WHEN o_orderkey % 4 = 3 THEN concat('* Target Module : decoder gate ', o_orderstatus, chr(10), ' * Research Question: What if the gate is gone?', chr(10), '- Target Module: Decoder Gate ', o_orderstatus, ' (again)', chr(10), '- Research Question: Why?') ELSE concat('Target Module: loose', chr(10), 'Research Question: loose too?') END, chr(10),
            CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '</Result>' END, ' tail ') AS response
        FROM {orders}""",
    # Rubrics and candidates as tagged text, and judges' answers.
    "judged": """
        SELECT o_orderkey AS id,
            concat('<Candidate><ID>', CAST(o_orderkey % 5 AS STRING), '</ID><Investigation_Focus> The ', CASE WHEN o_orderkey % 2 = 0 THEN 'core' ELSE 'side' END, '  part </Investigation_Focus><Description_Text>', o_orderpriority, '</Description_Text></Candidate>',
                   '<Candidate><ID>x</ID><Investigation_Focus>', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'second' END, '</Investigation_Focus></Candidate>') AS candidates,
            concat('<Rubric><item num="1" level="critical" weight="3"> First  rule </item>', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '<item num="2" level="Minor" weight="1">second</item>' END, '</Rubric>') AS rubric,
            concat('<candidate num="1"><critique> ok </critique><score>', CASE o_orderkey % 5 WHEN 0 THEN '[1.0]' WHEN 1 THEN '0.4' WHEN 2 THEN 'n/a' WHEN 3 THEN '0.75' ELSE '-3' END, '</score><primary_match>', CAST(o_orderkey % 4 AS STRING), '</primary_match></candidate>',
                   CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '< candidate id = ''2'' ><score>0.5</score></candidate >' END,
                   '<Bullet_Specificity><bullet num="1"><spec_score>0.9</spec_score></bullet></Bullet_Specificity><item num="1"><critique>c</critique><score>', CASE o_orderkey % 4 WHEN 0 THEN '0.3' WHEN 1 THEN '7' WHEN 2 THEN 'bad' ELSE '1' END, '</score></item>') AS answer,
            CAST(1 + o_orderkey % 3 AS BIGINT) AS n_bullets
        FROM {orders}""",
    # Matches of foci to bullets with scores.
    "matches": """
        SELECT uid AS id, idx AS pos, CAST(len % 5 AS BIGINT) AS bullet, CASE WHEN len % 7 = 0 THEN NULL ELSE CAST(len % 3 AS DOUBLE) / 2 END AS score, CAST(2 + len % 2 AS BIGINT) AS weight,
               CASE WHEN len % 3 = 0 THEN 'critical' WHEN len % 3 = 1 THEN 'major' ELSE 'minor' END AS level
        FROM {rollouts}""",
    # Evaluation records, some of them failed.
    "records": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'FAIL' ELSE 'SUCCESS' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) / 10 END AS recall,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS DOUBLE) / 7 END AS p_spec, CAST(o_custkey % 9 AS BIGINT) AS n_pred, CAST(1 + o_orderkey % 5 AS BIGINT) AS n_gt
        FROM {orders}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


def _needs(sql: str) -> list[str]:
    """The fixtures that a text names in braces, those that they need first."""
    out: list[str] = []
    for name in FIXTURES:
        if "{" + name + "}" in sql:
            out += [*_needs(FIXTURES[name]), name]
    return list(dict.fromkeys(out))


def plain(sql: str) -> str:
    """For DuckDB: tables by name, fixtures as common table expressions."""
    parts = [f"{n} AS ({FIXTURES[n]})" for n in _needs(sql)]
    for name in [*TABLES, *FIXTURES]:
        parts = [p.replace("{" + name + "}", name) for p in parts]
        sql = sql.replace("{" + name + "}", name)
    if not parts:
        return sql
    head = sql.lstrip()
    if head.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + head[15:]
    if head.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + head[5:]
    return "WITH " + ", ".join(parts) + " " + sql


#: Rows of one task, about, where rows are dealt by a key before several sorts.
TASK_ROWS = 250_000


class Tables:
    """The test tables of a folder, and the fixtures over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            sql = FIXTURES[name]
            used = {n: getattr(self, n) for n in [*TABLES, *FIXTURES] if "{" + n + "}" in sql}
            found = self.spark.sql(sql.replace("{GOAL}", "{{GOAL}}"), **used)
        elif name in TABLES:
            found = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        self.__dict__[name] = found
        return found

    def grouped(self, name: str, key: str) -> Tables:
        """The same with the rows of a table dealt by a key to tasks of about TASK_ROWS rows, however large the table is:
        what windows and groups of that key sort in a task doesn't grow with it."""
        out = Tables(self.spark, self.dir)
        whole = getattr(self, name)
        out.__dict__[name] = whole.repartition(self.tasks(name), key)
        return out

    def tasks(self, name: str) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // TASK_ROWS))

    def spread(self, name: str) -> Tables:
        """The same with the rows of a table spread(), before fixtures make them wider."""
        out = Tables(self.spark, self.dir)
        out.__dict__[name] = spread(getattr(self, name))
        return out


def scratch(t: Tables) -> str:
    """A folder that all executors see: under spark.checkpoint.dir; only where that is unset and
    Spark runs on this machine alone, as in tests, a temporary one."""
    top = t.spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return f"{top.rstrip('/')}/tessera-io-{os.urandom(6).hex()}"
    if not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


#: Tasks for each core when rows are dealt out, so that a slow one holds up little.
DEALS = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read as fewer partitions than costly work on each row needs, dealt to all cores
    before that work.  A table of more partitions stays as it is: no shuffle."""
    tasks = DEALS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def query(key: str, sql: str | None = None):
    """Registers a function of Tables under a key."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(key)
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = plain(sql)
        return f

    return add
