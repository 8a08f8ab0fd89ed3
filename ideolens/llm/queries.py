"""One query per operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ideolens.llm import alignment, byte_bpe, kneser_ney, lines, mixing, oracles, periodic_runs, pii, pitman_yor, quality_bands, secret_scan, simhash, toxicity, winnowing
from ideolens.llm.rows import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Key of the surrogates in the registered query; give your own to replace_pii.
PII_KEY = "ideolens"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), winnowing.contaminated().alias("contaminated"))


def op4_drop_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = secret_scan.describe(F.filter("spans", lambda x: x["kind"] < 3))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.describe(F.col("spans")).alias("spans"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_bands.judge(table(spark, sf_dir, "documents"), trusted)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary file; give the operators any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; for h = crc32(decimal doc_id) divisible by 10 and g = h div 10, each
    word i >= a of the n words becomes word a + (i - a) mod p, with a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")).alias("words"))
    n = F.size("words").cast("long")
    a = F.expr("h div 10") % n
    numbered = listed.select("doc_id", "text", "words", n.alias("n"), a.alias("a"), F.expr("h div 10").alias("g"))
    numbered = numbered.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int")))
    return numbered.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # the first of the runs with the greatest length / period, compared without rounding
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, x: F.when(better(x, top), x).otherwise(top))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    out = byte_bpe.decode(encoded.select("doc_id", "ids"), ranks)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_mix_sources, op2_pii_surrogates, op3_decontaminate, op4_drop_common_lines, op5_secret_scan, op6_pitman_yor,
           op7_kneser_ney, op8_toxicity, op9_quality_bands, op10_simhash, op11_align_tokenizers, op12_periodic_runs,
           op13_byte_bpe, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
