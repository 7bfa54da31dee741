"""The registered queries of the training-data operators: opN_<name> over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import bpe, decontaminate, divergence, extract, licenses, packing, quality, rollups, sharding, simhash, toxicity, urls, vector_codes
from rangeloom.llm.common import shared_folder, table

#: Host rules of the production URL filter.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
#: The production block list is a table of hosts: each site under each domain, bare and with each prefix.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED_PREFIXES = ("", "www.", "m.", "blog.")
SHARDS = 40
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A vocabulary file: by the public_tokenizers package, else in TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def listed_hosts() -> list[str]:
    """The hosts of the production block list."""
    return [f"{prefix}{site}.{domain}" for site in LISTED_SITES for domain in LISTED_DOMAINS for prefix in LISTED_PREFIXES]


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: host, path, the rule that fits, and the verdict of the rule or of the block list.

    Null urls and those without ``://`` have empty host and path and are allowed.
    """
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, listed_hosts()))).alias("key"))
    out = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, listed)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, base test and verdict; null texts have no words and fail."""
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(quality.PREFIX + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents for two tokenizer versions, from four signed batches.

    Documents arrive with an estimate (a token for each four bytes), which a second batch
    revises to the exact counts.  A third batch withdraws what has no word and a fourth
    reinserts it, as empty texts are documents too.  The first batches are delivered twice,
    and the state is compacted between them; null texts count as empty.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("n_words", rollups.word_count()).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    vocabulary = bpe.Vocabulary.load(tokenizer_path())
    folder = f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
    bpe.count_tokens(docs, vocabulary, out="n_bpe").write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    exact = F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("n_words").alias("n_tokens")), F.struct(F.lit("byte_bpe_50k").alias("tokenizer"), F.col("n_bpe").alias("n_tokens")))
    rows = counted.select("doc_id", "source", "lang", "n_words", F.ceil(F.col("n_bytes") / 4).alias("estimate"), F.inline(exact))
    old = [F.col(c).alias(f"old_{c}") for c in ("source", "lang")]
    image = ("doc_id", "source", "lang", "tokenizer")
    rollup = rollups.TokenRollup(spark, f"{folder}/state")
    blank = rows.where("n_words = 0")
    arrive = rows.select(F.lit("insert").alias("action"), *image, F.col("estimate").alias("n_tokens"))
    revise = rows.select(F.lit("revise").alias("action"), *image, "n_tokens", *old, F.col("estimate").alias("old_n_tokens"))
    withdraw = blank.select(F.lit("delete").alias("action"), *image, F.lit(None).cast("long").alias("n_tokens"), *old, F.col("n_tokens").alias("old_n_tokens"))
    rollup.commit("arrive-1", arrive)
    rollup.commit("revise-1", revise)
    rollup.commit("arrive-1", arrive)  # a repeated delivery is not applied again
    rollup.compact()
    rollup.commit("revise-1", revise)
    rollup.commit("withdraw-1", withdraw)
    rollup.commit("return-1", blank.select(F.lit("insert").alias("action"), *image, "n_tokens"))
    return rollup.totals()


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, base places, labels and score; null texts have none."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; null, empty and text-free pages have an empty one."""
    return extract.extract_text(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of their decoding; null texts count as empty."""
    vocabulary = bpe.Vocabulary.load(tokenizer_path())
    out = bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary, ids=False, decoded_text=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words in benchmark windows, items found, and longest match; null texts have no words."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    x = F.col("_found")
    return found.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        x["n_hit"].alias("n_hit"),
        F.size(x["items"]).cast("long").alias("n_items"),
        x["items_sha256"].alias("items_sha256"),
        (x["n_hit"] > 0).alias("contaminated"),
        x["longest"]["n_words"].alias("longest_match"),
        x["longest"]["item_id"].alias("longest_item"),
        x["longest"]["word"].alias("longest_at"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the ``rows`` law, by a uniform permutation; copies are placed like any row."""
    rows = sharding.describe(table(spark, sf_dir, "documents"))
    out = sharding.shard(rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null and blank texts have fingerprint 0."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(key: Column) -> Column:
    """The fifth of the keys whose labels are never learnt from; a null key is one of them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict, learnt from the labels of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~held_out(F.col("doc_id")))
    out = toxicity.score_texts(docs, model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they are packed; null texts count as empty and are their end id alone."""
    out = packing.pack(table(spark, sf_dir, "documents"), bpe.Vocabulary.load(tokenizer_path()), ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's code and error, its label's error, and the digest of the codebooks."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from each other source of its language, and its 200 most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_urls": op1_urls,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_licenses": op4_licenses,
    "op5_extract": op5_extract,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_divergence": op13_divergence,
}
