"""Prompts made from the tables by one SQL text that both Spark and an oracle run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: (kind, incoming, stored); {n} and {m} are numbers of three digits, {p} and {r} places.
PAIRS = (
    ("numeric", "Convert {n} USD to EUR", "Convert {m} USD to EUR"),
    ("grouped", "How many seats are in a hall of 1,{n} people", "How many seats are in a hall of 1{n} people"),
    ("unit", "How much does {n} kg of rice cost in {p}", "How much does {n} lbs of rice cost in {p}"),
    ("temporal", "What is the weather in {p} today", "What is the weather in {p} tomorrow"),
    ("negation", "Which foods should tourists eat in {p}", "Which foods should tourists not eat in {p}"),
    ("antonym", "How do I enable logging on server {n}", "How do I disable logging on server {n}"),
    ("entity", "What is the tallest building in {p} nowadays", "What is the tallest building in {r} nowadays"),
    ("substitution", "Write code that paints a brown horse", "Write code that paints a brown camel"),
    ("typo", "Write code that paints a brown horse", "Write code that paints a bronw horses"),
    ("scope", "Give me a summary of report {n}", "Give me a tutorial of report {n}"),
    ("direction", "How do I convert dollars to euros in {p}", "How do I convert euros to dollars in {p}"),
    ("sub-span", "How do I sort an array", "How do I sort an array without extra memory"),
    ("divergent", "Plan a cheap family trip through {p} by train", "List seven famous painters born near lakes and mountains"),
    ("length", "Weather {p}", "Tell me in plain words everything about the weather that somebody would expect in {p} this whole month"),
    ("order", "Did {p} beat {r} in the final", "Did {r} beat {p} in the final"),
    ("same", "How do I rinse a brush in Sweden", "how do I rinse a brush in Sweden?"),
)
_PLACES = ("Lisbon", "Madrid", "Vienna", "Prague", "Warsaw")


def _place(number: str) -> str:
    return f"CASE {number} % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLACES)) + " END"


def _text(template: str, key: str, other: str) -> str:
    parts = {"n": f"CAST({key} % 9 * 50 + 500 AS STRING)", "m": f"CAST({other} % 7 * 50 + 500 AS STRING)", "p": _place(key), "r": _place(f"({other} + 1)")}
    pieces = [parts[x[1]] if x.startswith("{") else f"'{x}'" for x in re.split(r"(\{[nmpr]\})", template) if x]
    return f"concat({', '.join(pieces)})"


def pair_columns(number: str, key: str, other: str) -> str:
    """kind, a and b as SQL expressions of three whole numbers: which template, and two to fill it."""
    case = lambda i: f"CASE {number} % {len(PAIRS)} " + " ".join(f"WHEN {k} THEN {_text(p[i], key, other) if i else repr(p[0])}" for k, p in enumerate(PAIRS)) + " END"
    return f"{case(0)} AS kind, {case(1)} AS a, {case(2)} AS b"


ORDER_PAIRS = f"SELECT o_orderkey AS pair_id, {pair_columns('o_orderkey', 'o_custkey', 'o_orderkey')} FROM orders"
#: Requests are the odd ids, entries the even ones; the scope is the label.
_PROMPT = f"CASE WHEN vec_id % 3 = 0 THEN {_text('Convert {n} USD to EUR', 'vec_id', 'vec_id')} WHEN vec_id % 3 = 1 THEN {_text('Give me a summary of report {n}', '(vec_id * 9)', 'vec_id')} ELSE {_text('Give me a tutorial of report {n}', '(vec_id * 9)', 'vec_id')} END"
_EMBEDDER = "CASE WHEN vec_id % 11 = 0 THEN 'old' ELSE 'new' END"
REQUESTS = f"SELECT vec_id AS query_id, CAST(label AS STRING) AS scope, embedding, {_PROMPT} AS prompt, {_EMBEDDER} AS embedder FROM embeddings WHERE vec_id % 2 = 1"
ENTRIES = f"SELECT vec_id AS entry_id, CAST(label AS STRING) AS scope, embedding, {_PROMPT} AS prompt, concat('answer ', CAST(vec_id AS STRING)) AS response, {_EMBEDDER} AS embedder FROM embeddings WHERE vec_id % 2 = 0"


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: reading prompts costs CPU, not bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over the tables it names."""
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
