"""The operators applied to whole tables: one query for each, and SQL where it can express the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, line_dedup, negatives, quality, repair


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every text."""
    from . import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/thousands/hundreds/id.txt; each hundredth is a licence file, that of its hundreds, or
    of its thousands if it is a thousandth, or of all if it is a hundred thousandth."""
    number = F.col("doc_id")
    part = lambda letter, n: F.concat(F.lit(letter), F.floor(number / n))
    path = F.concat_ws("/", F.lit("source"), F.when(number % 100_000 != 0, part("t", 1000)), F.when(number % 1000 != 0, part("h", 100)), F.concat(number, F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = licenses.scan(files, F.col("doc_id") % 100 == 0)
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "path", "own_license", "own_score", "license", "from_dir")


OP3_FILES = """SELECT 'source/' || CASE WHEN doc_id % 100000 <> 0 THEN 't' || (doc_id // 1000) || '/' ELSE '' END || CASE WHEN doc_id % 1000 <> 0 THEN 'h' || (doc_id // 100) || '/' ELSE '' END || doc_id || '.txt' AS path,
  text, doc_id % 100 = 0 AS is_file FROM documents"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def packing_under_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's packing where all three capacities bind: 1024 tokens, 4 documents, and an attention cost that leaves a piece of 600 tokens no more than one of 300."""
    from . import packing

    limits = packing.Limits(tokens=1024, documents=4, attention=450_000, weights=(1.0, 0.5, 0.5), rule="dot")
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokens=600)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length"), limits)


def op8_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files
    from .shared import Scratch

    path = Scratch(spark).path("huffman")
    token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2, path)
    return token_files.read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the marks of the format."""
    from . import chat

    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    done = chat.format_branches(chat.tree_of_turns(rows.unionByName(extra)))
    turns = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = done.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned"), "formatted")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 13 + length(role) + length(text) + length(regexp_replace(role, '[^#<\n\\]', '', 'g')) + length(regexp_replace(text, '[^#<\\]', '', 'g')) AS n FROM rows
), learned AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS t FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(length(any_value(t)) AS BIGINT) AS loss_chars, sha256(any_value(t)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized JOIN learned USING (conv_id) GROUP BY conv_id"""


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("version")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_codec

    done = piece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "n_runs")


def op11_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the text and language of two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.fit(docs.where("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of all conversations after a fixed damage."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth row, with each seventh label off by one."""
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_projection_forest": op1_projection_forest,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "packing_under_capacities": packing_under_capacities,
    "op5_reply_trees": op5_reply_trees,
    "op6_distribution_divergence": op6_distribution_divergence,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_huffman_token_files": op8_huffman_token_files,
    "op9_piece_codec": op9_piece_codec,
    "op10_line_dedup": op10_line_dedup,
    "op11_byte_network": op11_byte_network,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

#: By query, SQL for the same rows.
ORACLES: dict[str, str] = {
    "op3_license_scan": f"SELECT CAST(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS BIGINT) AS doc_id, * FROM ({licenses.sql(OP3_FILES)})",
    "op5_reply_trees": OP5_SQL,
    "op6_distribution_divergence": quality.sql(),
    "op10_line_dedup": line_dedup.SQL.format(docs="documents")
    + """SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE f.kept_text END AS text, CAST(coalesce(f.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(f.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(f.n_runs, 0) AS BIGINT) AS n_runs
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id""",
    "op12_conversation_repair": repair.SQL,
    "op13_hard_negatives": negatives.SQL,
}
