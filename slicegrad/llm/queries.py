"""The registered queries of this folder; each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.llm import chat_windows, divergence_rules, line_runs, merkle, mixing, phrase_graph, pu_quality, revisits, secret_scan, simhash_rings, spaced_seeds, token_counts, token_files
from slicegrad.session import scratch_path

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in Huffman-coded files, described as read back from them."""
    docs = table(spark, sf_dir, "documents")
    read = token_files.token_file_digest(docs, tokenizer("word_bpe_49k.json"))
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: spans of the base rules and of high-entropy windows."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.written_out(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written_out(F.concat("base", "added")).alias("spans"),
    )


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to tempered source weights, in shuffled order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, mixing.source_rates(docs))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores learnt from trusted positives and unlabelled texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pu_quality.score(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= pu_quality.THRESHOLD).cast("int")
    return scored.select("doc_id", pu_quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of the divergence rules."""
    judged = divergence_rules.judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("key").alias("doc_id"), *counts, "base_failed", "kept")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share a passage, exchanged words tolerated."""
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over 3-word shingles, fingerprints linked at two bits."""
    groups = simhash_rings.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return groups.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document under the sentence-piece model, and which documents exceed the limit."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_runs.drop_frequent(docs, min_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the capture log derived from the pages, each with its response and merged headers."""
    found = revisits.resolve(revisits.page_captures(table(spark, sf_dir, "pages")))
    written = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.select("record_id", "url_key", "response_id", "outcome", F.array_join(written, "\n").alias("headers"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of the documents, and what the proofs give for rows of which every seventh was tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    forged = merkle.leaf_digest(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields])
    rows, levels = merkle.manifest(docs, fields, key="doc_id", group="lang", carried={"forged": F.when(chosen, forged)})
    places = [(F.col("i"), F.col("n")), (F.col("g"), F.col("groups"))]
    folded = merkle.fold(F.coalesce("forged", "leaf"), F.col("proof"), places, levels)
    found = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and one that holds marks of the template, in budgeted windows, described as read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    marks = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chat-windows")
    chat_windows.write_windows(turns.unionByName(marks), path, tokenizer("byte_bpe_50k.tiktoken"))
    return chat_windows.digests(spark, path)


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return phrase_graph.phrases_of(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_files, op2_secret_scan, op3_poisson_mixing, op4_pu_quality, op5_divergence_rules, op6_spaced_seeds,
        op7_simhash_rings, op8_token_counts, op9_line_runs, op10_revisits, op11_merkle_manifest,
        op12_chat_windows, op13_phrase_graph,
    )
    return {query.__name__: query for query in named}
