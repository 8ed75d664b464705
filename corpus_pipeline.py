"""Five stages that turn raw documents into a training mix; each is one operator of chatloom.llm and reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing, queries, store
from chatloom.llm.store import fold, read


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or unlike every learned language, measured by the learned rows of like length."""
    labelled = docs.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    profiles = language_id.learn(labelled)
    bound = language_id.least_scores(labelled, profiles)
    plain = docs.select([F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    out = language_id.judged(plain, profiles, text=text).where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= bound(F.col(text))))
    return out.select([F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def placed(docs: DataFrame, own: dict[str, str]) -> tuple[DataFrame, list]:
    """docs with the columns that a stage reads under the names it wants (own: by name) and all others by their place, and what gives each its name again."""
    names = [own.get(c, f"c{k}") for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    plain, back = placed(docs, {"doc_id": "id", "text": "text"})
    out = line_dedup.dedup_lines(plain).select(back)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram likeness links, the one with the smallest id stays. Those without an id all stay and stand for no others."""
    named = docs.where("doc_id is not null")
    found = jaccard_join.jaccard_components(named.select(F.col("doc_id").alias("id"), "text"))
    heads = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")).distinct()
    return named.join(heads, "doc_id", "left_semi").select(docs.columns).unionAll(docs.where("doc_id is null"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights take; copies says how many epochs a document is used in. Columns named n_tokens or copies are replaced."""
    plain, back = placed(docs, {c: c for c in ("text", "lang", "source")} | {"doc_id": "id"})
    back = [c for c, name in zip(back, docs.columns, strict=True) if name not in ("n_tokens", "copies")]
    return mixing.mix(queries.with_domain(plain), queries.LEVELS, queries.weight).select(*back, "n_tokens", "copies")


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing to target weights", mix_to_weights),
]

#: Language ID learns its profiles from data and mixing draws seeded epochs: tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage made on its way, and what the one before it left, goes when its rows are written."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(store.MADE)
    for name, stage in STAGES[:-1]:
        docs = store.kept(stage(spark, docs, sf_dir), f"stage_{name.replace(' ', '_')}")
        store.sweep(spark, store.MADE[begin:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
