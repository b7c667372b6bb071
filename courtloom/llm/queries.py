"""The text queries: each maps the driver's tables to an operator's interface and its rows back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtloom.llm import (bpe, decontamination, hard_negatives, html_extraction, jaccard_join, language_id, passages, pii, quality_classifier,
                           quality_rules, simhash, spelling, toxicity)
from courtloom.llm.common import fold
from courtloom.session import ship_package


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_session(spark: SparkSession, rows: int = 2_000) -> SparkSession:
    """The session with this package on its workers, and Arrow batches of at most `rows` texts (10,000 by default in Spark), so
    that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return ship_package(spark)


_TO = {"doc_id": "job_id", "text": "summary", "source": "narration_angle"}
#: Put before further columns of documents that are named like a field of narrations.
_OTHER = "__document_"


def as_narrations(documents: DataFrame) -> DataFrame:
    """documents as narrations: job_id, summary, narration_angle, lang; columns that are not there stay out."""
    return documents.select(*[F.col(f"`{c}`").alias(_TO.get(c, f"{_OTHER}{c}" if c in _TO.values() else c)) for c in documents.columns])


def as_documents(narrations: DataFrame) -> DataFrame:
    back = {to: c for c, to in _TO.items()}
    return narrations.select(*[F.col(f"`{c}`").alias(back.get(c, c.removeprefix(_OTHER))) for c in narrations.columns])


def _narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_narrations(ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def ratings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "job_id")


def references_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("window_id"), F.col("text").alias("summary"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrations, held = _narrations(spark, sf_dir), fold(F.col("job_id"), 5) == 0
    model = quality_classifier.fit_quality_ensemble(narrations, ratings_of(spark, sf_dir).filter(~held), "quality")
    scored = quality_classifier.score_quality(narrations.select("job_id", "summary"), model)
    return scored.select(F.col("job_id").alias("doc_id"), held.alias("held_out"), F.col("quality_score").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ship_package(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = html_extraction.extract_main_text(pages, html_extraction.fit_block_model(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = jaccard_join.link_narrations(_narrations(spark, sf_dir))
    return links.select(F.col("job_id").alias("doc_id"), "class_id", "n_links", "n_text_links")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_narrations(spark, sf_dir))
    counts = [pii.count_of(F.col("base"), name).alias(f"n_{name}") for name in pii.KINDS]
    return found.select(F.col("job_id").alias("doc_id"), *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_narrations(spark, sf_dir), references_of(spark, sf_dir))
    return found.withColumnsRenamed({"job_id": "doc_id", "window_id": "item_id"})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrations, held = _narrations(spark, sf_dir), fold(F.col("job_id"), 3) == 1
    model = language_id.fit_language_model(narrations, ~held)
    out = language_id.identify_language(narrations.select("job_id", "summary"), model)
    return out.select(F.col("job_id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_narrations(_narrations(spark, sf_dir), tokenizer_path()).select(F.col("job_id").alias("doc_id"), "codes.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrations = _narrations(spark, sf_dir).select("job_id", "summary")
    model = toxicity.fit_toxic_model(narrations, ratings_of(spark, sf_dir), "toxic", parts=5, learn_part=0)
    out = toxicity.score_toxicity(narrations, model)
    return out.select(F.col("job_id").alias("doc_id"), (fold(F.col("job_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(_narrations(spark, sf_dir))
    return found.withColumnsRenamed({"job_id": "doc_id", "other_id": "other_doc_id"})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrations = _narrations(spark, sf_dir)
    judged = quality_rules.judge_quality(narrations.select("job_id", "summary"), quality_rules.fit_quality_rules(narrations, ratings_of(spark, sf_dir)))
    return judged.select(F.col("job_id").alias("doc_id"), *[f"stats.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ship_package(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    usable = vectors.filter("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))")
    reid = usable.selectExpr("vec_id as track_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as player",
                             "transform(embedding, x -> floor(256 * double(x))) as emb")
    return hard_negatives.mine_hard_negatives(reid, F.col("track_id") % 100 == 0).withColumnRenamed("track_id", "anchor_id")


OP11_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select anchor_id, vec_id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
  n as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
    from p join s on p.anchor_id = s.anchor_id and s.label <> s.own and 80 * positive_score <= 100 * score and score <= positive_score)
  select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copy_classes(_narrations(spark, sf_dir))
    return found.select(F.col("job_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.word_runs(_narrations(spark, sf_dir))
    h, at = F.crc32(F.concat(F.coalesce(F.col("job_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")), F.length("word")
    at = F.pmod(h, at).cast("int")
    slipped = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    words = runs.withColumns({"h": h, "at": at}).select(F.when(F.col("h") % 31 == 0, slipped).otherwise(F.col("word")).alias("word"))
    return spelling.group_spellings(spelling.count_words(words))


#: DuckDB statements of the queries that SQL can express.
STATEMENTS: dict[str, str] = {"op11_hard_negatives": OP11_SQL}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_classifier, op2_html_extraction, op3_ngram_jaccard_join, op4_pii, op5_benchmark_decontamination, op6_language_id, op7_bpe,
    op8_toxicity, op9_substring_dedup, op10_quality_rules, op11_hard_negatives, op12_simhash_near_dedup, op13_spelling_variants)}
