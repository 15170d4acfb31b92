"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import crf, sql
from .bpe import bpe_encode
from .common import staged, table
from .exact_dedup import exact_groups
from .html_text import main_text
from .mix import mix_taken
from .ngram_join import ngram_join
from .tiff import tiff_read, tiff_store
from .toxicity import Chain, toxicity, train
from .training import crc
from .warc_fixity import FILE, FILE_RECORDS, differing, hashed_records, matched, numbered, roots, tree
from .wordpiece import sentencepiece_vocabulary, token_counts

Query = Callable[[SparkSession, str], DataFrame]


#: The rank file that op10 encodes by; read on the driver and broadcast.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rank_file(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("key"), "text")
    read = tiff_read(tiff_store(docs, "key"), "doc_id")
    payload = F.aggregate("pages", F.lit(b""), lambda done, page: F.concat(done, page["samples"]))
    read = read.select("doc_id.*", "media", "pages", payload.alias("payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.expr("crc32(substring(payload, -16, 16))").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join("pages.feature", ";").alias("feature"),
        F.size("pages").alias("n_pages"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_taken(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def decayed(html: Column, key: Column) -> Column:
    """A replica's body: in one of 50, by key, a character is overwritten by as many bytes."""
    turn = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    at = (turn % F.greatest(F.length(html), F.lit(1))).cast("int")
    found = F.substring(html, at + 1, F.lit(1))
    faulty = F.when(found == "~", "^").otherwise(F.repeat(F.lit("~"), F.octet_length(found)))
    flipped = F.concat(F.substring(html, F.lit(1), at), faulty, F.substring(html, at + 2, F.length(html)))
    return F.when(turn % 50 == 0, flipped).otherwise(html)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages laid out as WARC files, and what the audit of a decayed replica says of it."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    key, file = F.col("page_id"), F.shiftright(F.col("page_id"), FILE_RECORDS.bit_length() - 1)
    laid = staged(hashed_records(pages, key, file, F.col("url"), F.col("html"), decayed(F.col("html"), key)), "warc")
    place = [*FILE, "place"]
    replica = laid.select("key", *place, *(F.col(f"copy_{c}").alias(c) for c in ("start", "end", "hash")))
    levels = tree(laid)
    faults = differing(levels, tree(replica))[-1].select(*place, F.col("b.hash").alias("replica_sha256"))
    out = matched(laid, faults, place, "left")
    out = matched(out, numbered(roots(levels)), FILE, "inner")
    return out.select(F.col("key").alias("page_id"), F.col("number").alias("file"), "place", "start", "end", F.col("hash").alias("sha256"), F.col("replica_sha256").isNull().alias("intact"), "replica_sha256", "root")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc(F.col("doc_id")) % 3 == 1
    field = crf.train(docs, labels, keep=~held_out)
    scored = crf.quality(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("lines").alias("n_lines"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: The SentencePiece model whose pieces op8 takes as a word-piece vocabulary.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *sentencepiece_vocabulary(PIECES))


#: The chain of op9 ends in the one toxicity column of the labels, after so many sub-categories that are derived from it.
CATEGORIES, DERIVED = ["toxic"], 2


def toxicity_chain(spark: SparkSession, sf_dir: str) -> Chain:
    """A chain trained on the labelled documents."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES, derived=DERIVED)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_tiff_pages": op1_tiff_pages,
        "op2_mix_sources": op2_mix_sources,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_warc_fixity": op4_warc_fixity,
        "op5_main_text": op5_main_text,
        "op6_quality_crf": op6_quality_crf,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity_chain": op9_toxicity_chain,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": sql.MIX, "op3_exact_dedup": sql.EXACT, "op4_warc_fixity": sql.FIXITY}
