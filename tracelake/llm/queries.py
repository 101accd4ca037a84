"""The registered queries: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, conversations, decontaminate, divergence, embedding_dedup, line_dedup, quality, simhash, substrings, token_files, toxicity, url_lists, warc
from tracelake.llm.labelled import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its cross-site boilerplate lines."""
    out = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    out = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.95."""
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


#: Dates of the captures and of the list entries, which ``pages`` lacks: days after this one.
_FIRST_DAY = "2023-01-01"


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time made from the page id: a day within two years."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.date_add(F.lit(_FIRST_DAY).cast("date"), day).cast("timestamp").alias("fetched_at"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Dated entries for hosts and for host/language prefixes, made from the URLs themselves: each seventh
    host (by length and first letters) is added to 'hosts' and later removed and added again, each prefix
    whose second-level name has an even length is on 'sections' for some months."""
    parts = captures.select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("top")).where("host <> ''").distinct()
    name = F.regexp_extract("host", r"([^.]+)\.example", 1)
    mark = F.ascii(F.substring(name, -1, 1)) + F.length("host")
    day = lambda n: F.date_add(F.lit(_FIRST_DAY).cast("date"), n.cast("int")).cast("timestamp")
    entry = lambda kind, pattern, action, n: F.struct(F.lit(kind).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("effective_at"))
    start = F.pmod(mark * 31, F.lit(300))
    hosts = parts.select("host").distinct().where(F.pmod(mark, F.lit(7)) < 2).select(
        F.explode(F.array(entry("hosts", F.col("host"), "add", start), entry("hosts", F.col("host"), "remove", start + 90), entry("hosts", F.col("host"), "add", start + 240))).alias("e")
    )
    section = F.concat("host", F.lit("/"), "top")
    sections = parts.where((F.col("top") != "") & (F.pmod(F.length(name), F.lit(2)) == 0)).select(
        F.explode(F.array(entry("sections", section, "add", start + 60), entry("sections", section, "remove", start + 400))).alias("e")
    )
    return hosts.unionByName(sections).select("e.*")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that were active when it was fetched."""
    captures = _captures(spark, sf_dir)
    return url_lists.listed_captures(captures, _list_entries(captures)).withColumnRenamed("id", "page_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is benchmark text, and of how many items."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("th")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's token ids and read start, length and checksum of each back from the files."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    docs, folder = _table(spark, sf_dir, "documents"), token_files.new_folder(spark)
    token_files.write_token_files(docs, folder, lambda: token_files.file_tokenizer(path, pattern, added_tokens=True), end_id=0)
    return token_files.read_documents(spark, folder, docs.schema["doc_id"].dataType.simpleString())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a fifth of the ids is held out."""
    docs, held_out = _table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an ARC record, converted to WARC and read back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"), spark)


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the ids is held out."""
    docs, held_out = _table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of what they decode to, for every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words or more that the corpus has had before."""
    out = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash of its turns, with its faults and its cheapest repair."""
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations")).drop("repaired")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and by which terms from the language itself."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))
