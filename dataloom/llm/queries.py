"""The operators applied to whole tables, and their results in SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dataloom.llm import (
    block_naming, brown_lm, byte_bpe, fuzzy_lines, hilbert, mixing, quality, resampling, simhash, spotsigs,
    token_files, tool_calls, turn_repair,
)
from dataloom.plans.shared import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def simhash_vptree(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, folder, "documents"), words=3, reach=2)
    return rows.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"), "group_size",
    )


def naming(spark: SparkSession, folder: str) -> DataFrame:
    rows = block_naming.exact_copies(_table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


NAMING_SQL = """
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS size,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM documents),
ranked AS (SELECT doc_id, bare,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY bare) AS group_size,
    row_number() OVER (PARTITION BY bare ORDER BY size DESC, doc_id) = 1 AS kept FROM texts)
SELECT doc_id, keep_id, group_size, kept, sha256(bare) AS text_sha256 FROM ranked
"""


def raked_mix(spark: SparkSession, folder: str) -> DataFrame:
    # The SQL of this query fixes unfilled goals and the number of rounds.
    rows = mixing.mixture(_table(spark, folder, "documents"), rounds=mixing.ROUNDS)
    return rows.withColumnRenamed("id", "doc_id").withColumn("probability", F.round("probability", 6))


def bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_decode(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, ids=False,
    ).withColumnRenamed("id", "doc_id")


def co_training(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.train(docs, _table(spark, folder, "labels"))
    rows = quality.scores(docs, model)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("content").alias("content_score"),
        F.col("metadata").alias("metadata_score"), "score", model.kept(F.col("score")).alias("kept"),
    )


def hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = hilbert.shards(
        _table(spark, folder, "documents"), {"source": "source", "lang": "lang", "length": F.char_length}, n_shards=16
    )
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    rows = fuzzy_lines.kept_lines(_table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_lines", F.size("kept").alias("n_kept"), F.array_join(
            F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "kept").cast("array<string>"), " "
        ).alias("dropped_lines"),
    )


def class_model(spark: SparkSession, folder: str) -> DataFrame:
    return brown_lm.scores(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def spots(spark: SparkSession, folder: str) -> DataFrame:
    rows = spotsigs.edited_pairs(_table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.digest(F.col("signs")).alias("fingerprint"), spotsigs.digest(F.col("edited_signs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        spotsigs.likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


# Tools that the turns of a conversation are read as calls of.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}},
    },
    "measure": {
        "type": "object", "required": ["text"],
        "properties": {"text": {"type": "string"}, "unit": {"enum": ["words", "characters"]}},
    },
    "note": {
        "type": "object", "required": ["body", "tags"],
        "properties": {"body": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}},
    },
}


def messages_of(conversations: DataFrame) -> DataFrame:
    """Tool messages derived from turns: a user's turn calls a tool with its text, the
    assistant's turn behind it is the result. A call needs the one before it; in every
    fifth conversation the one after it, in every 35th both, which is a cycle."""
    turn = F.col("turn")
    name_of = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    tool = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "note").otherwise("measure")
    text = F.coalesce("text", F.lit(""))
    arguments = F.when(tool == "search", F.to_json(F.struct(text.alias("query"), (F.col("conv_id") % 7).alias("limit")))).when(
        tool == "note", F.to_json(F.struct(F.array(F.lit("turn"), F.col("role")).alias("tags"), text.alias("body")))
    ).otherwise(F.to_json(F.struct(F.when(F.col("conv_id") % 3 == 0, "lines").otherwise("words").alias("unit"), text.alias("text"))))
    before = F.when(turn >= 2, F.array(name_of(turn - 2))).otherwise(F.array().cast("array<string>"))
    needs = F.when(F.col("conv_id") % 35 == 0, F.concat(before, F.array(name_of(turn + 2)))).when(
        F.col("conv_id") % 5 == 0, F.array(name_of(turn + 2))
    ).otherwise(before)
    nothing = F.lit(None).cast("string")
    calls = conversations.where("role = 'user'").select(
        F.col("conv_id").alias("conversation"), turn.alias("position"), F.lit("call").alias("kind"),
        name_of(turn).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), needs.alias("needs"), nothing.alias("content"),
    )
    results = conversations.where("role = 'assistant'").select(
        F.col("conv_id").alias("conversation"), turn.alias("position"), F.lit("result").alias("kind"),
        name_of(turn - 1).alias("call_id"), nothing.alias("name"), nothing.alias("arguments"),
        F.lit(None).cast("array<string>").alias("needs"), F.col("text").alias("content"),
    )
    return calls.unionByName(results)


def calls_linked(spark: SparkSession, folder: str) -> DataFrame:
    rows = tool_calls.linked_calls(messages_of(_table(spark, folder, "conversations")), SCHEMAS)
    return rows.withColumn("faults", F.array_join("faults", "; ")).withColumnRenamed("conversation", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the CRC-32 of ``conv_id:turn`` deals; NULLs are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.withColumn("dealt", dealt).where("dealt <> 0").select(
        "conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def turns_repaired(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    report, turns = turn_repair.repair(damaged(conversations))
    texts = turn_repair.joined_turns(turns).select(
        F.col("conversation").alias("told"), F.sha2("joined", 256).alias("sha")
    )
    every = conversations.groupBy("conv_id").agg(F.count("*").alias("rows")).select("conv_id")
    found = every.join(report, every["conv_id"].eqNullSafe(report["conversation"]), "left").join(
        texts, F.col("conv_id").eqNullSafe(F.col("told")), "left"
    )
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def resampled(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return resampling.resample(docs, target, percent=10).withColumnRenamed("id", "doc_id")


RESAMPLED_SQL = """
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
    FROM range(256) AS t(i)),
words_of AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word, 0 AS target FROM documents
    UNION ALL SELECT NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), 1 FROM benchmark),
vocabulary AS (SELECT word, hex(word) AS digits FROM (SELECT DISTINCT word FROM words_of)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(digits), 2),
        lambda i: (instr('0123456789ABCDEF', digits[i]) - 1) * 16 + instr('0123456789ABCDEF', digits[i + 1]) - 1)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, steps),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t
    FROM words_of JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
        / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight
    FROM words_of JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE)
        / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n_features >= 20
    THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked
"""


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_tokens(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files"), end=2,
    )
    return token_files.read_documents(files, ids=False)


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_simhash_vptree": (simhash_vptree, None),
    "op2_hilbert_shards": (hilbert_shards, None),
    "op3_block_naming": (naming, NAMING_SQL),
    "op4_raked_mix": (raked_mix, mixing.mixture_sql()),
    "op5_fuzzy_lines": (fuzzy, None),
    "op6_brown_lm": (class_model, None),
    "op7_tool_calls": (calls_linked, None),
    "op8_byte_bpe": (bpe, None),
    "op9_co_training": (co_training, None),
    "op10_spotsigs": (spots, None),
    "op11_turn_repair": (turns_repaired, None),
    "op12_resampling": (resampled, RESAMPLED_SQL),
    "op13_token_files": (token_stream, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
