"""Reading labelled pairs, verdict vectors, articles and change logs; writing reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import store

PAIRS = "pairs array<struct<a: string, b: string, shouldMatch: boolean, category: string>>"
VECTORS = "vectors array<struct<guard: string, query: string, candidate: string, reject: boolean, reason: string>>"
ARTICLES = "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string>>>>>>>>"
LOG = "seq bigint, op string, scope string, entry_id string, tag string, prompt string, response string, embedding array<float>, created_at timestamp, metadata map<string,string>, tags array<string>, embedder string, chunk_lengths array<int>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """a, b, should_match, category of a JSON document {pairs: [...]}."""
    rows = spark.read.schema(PAIRS).option("multiLine", True).json(path).select(F.explode("pairs").alias("p"))
    return rows.select("p.a", "p.b", F.col("p.shouldMatch").alias("should_match"), "p.category")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """guard, query, candidate, reject, reason of a JSON document {vectors: [...]}."""
    return spark.read.schema(VECTORS).option("multiLine", True).json(path).select(F.explode("vectors").alias("v")).select("v.*")


def similar_questions(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs (a, b, ...) whose character 4-grams have a Jaccard similarity of `least` or more."""
    return rows.where(T.jaccard(T.n_grams(F.col("a")), T.n_grams(F.col("b"))) >= least)


# Fixed value: what stands above the passages of a retrieval prompt.
INSTRUCTION = "Use only the context below to answer the question. If the context does not contain the answer, say that you do not know."


def enveloped(pairs: DataFrame, target: int, order: str = "pair_id") -> DataFrame:
    """pairs(a, b, ...) inside retrieval prompts of `target` characters or more: above each question stand the texts of the
    pairs that follow it, the first ones again after the last, as many as it takes.

    A pair meets target / 3 others at most, one join on its place in the order.
    """
    n = pairs.count()
    most = max(0, min(n - 1, -(-max(0, target - len(INSTRUCTION)) // 3)))
    placed = store.running_total(pairs, [F.asc(order)], F.lit(1).cast("long"), "_at").withColumn("_at", F.col("_at") - 1)
    texts = placed.select((F.col("_at")).alias("_from"), F.col("a").alias("_text"))
    wanted = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(1, most)))).alias("_step")).withColumn("_from", F.pmod(F.col("_at") + F.col("_step"), F.lit(max(1, n))))
    near = wanted.join(texts, "_from").where(F.col("_step") <= most)
    before = Window.partitionBy("_at").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    long = F.length("a") + len(INSTRUCTION) + F.coalesce(F.sum(F.length("_text") + 3).over(before), F.lit(0))
    taken = near.withColumn("_long", long).where(F.col("_long") < target).groupBy("_at").agg(F.array_sort(F.collect_list(F.struct("_step", "_text"))).alias("_taken"))
    lines = F.array_join(F.transform(F.coalesce("_taken", F.array().cast("array<struct<_step:int,_text:string>>")), lambda t: F.concat(F.lit("- "), t["_text"], F.lit("\n"))), "")
    wrap = lambda c: F.concat(F.lit(f"{INSTRUCTION}\n\nContext:\n"), lines, F.lit("\nQuestion: "), F.col(c))
    return placed.join(taken, "_at", "left").withColumns({"a": wrap("a"), "b": wrap("b")}).drop("_at", "_taken")


def read_articles(spark: SparkSession, path: str, paragraphs: int = 400) -> tuple[DataFrame, DataFrame]:
    """documents(id, title, text) and questions(id, document_id, question, answer) of nested articles, up to so many paragraphs."""
    each = spark.read.schema(ARTICLES).option("multiLine", True).json(path).select(F.posexplode("data").alias("i", "d"))
    each = each.select("i", "d.title", F.posexplode("d.paragraphs").alias("j", "p")).orderBy("i", "j").limit(paragraphs)
    named = each.withColumn("document_id", F.format_string("%05d-%05d", "i", "j"))
    documents = named.select(F.col("document_id").alias("id"), "title", F.col("p.context").alias("text"))
    questions = named.select("document_id", F.explode("p.qas").alias("q")).select("q.id", "document_id", "q.question", F.get(F.col("q.answers"), F.lit(0))["text"].alias("answer"))
    return documents, questions


def append_log(changes: DataFrame, path: str) -> None:
    """Appends changes to a log; each append is a commit of its own files."""
    changes.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def open_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries that the log at path leaves."""
    return store.fold_log(read_log(spark, path))


def compact_log(spark: SparkSession, path: str, to: str, after: int = 100_000) -> bool:
    """Writes the log's entries as a new log at `to` if it has more than `after` changes; the old log stays until its owner swaps them."""
    log = read_log(spark, path)
    if log.count() <= after:
        return False
    store.compact(log).write.parquet(to)
    return True


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_jdbc(entries: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Appends entries to a JDBC table; vectors and maps as JSON, which a JDBC column can hold."""
    flat = entries.withColumns({c: F.to_json(F.col(c)) for c in ("embedding", "metadata", "tags", "chunk_lengths") if c in entries.columns})
    flat.write.jdbc(url, table, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    kinds = {"embedding": "array<float>", "metadata": "map<string,string>", "tags": "array<string>", "chunk_lengths": "array<int>"}
    rows = spark.read.jdbc(url, table, properties=properties)
    return rows.withColumns({c: F.from_json(F.col(c), k) for c, k in kinds.items() if c in rows.columns})


def point_id(entry_id: Column) -> Column:
    """A UUID for an id: 32 hexadecimal digits as they are, else of the id's md5."""
    digits = F.when(entry_id.rlike("^[0-9a-fA-F]{32}$"), F.lower(entry_id)).otherwise(F.md5(entry_id))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
