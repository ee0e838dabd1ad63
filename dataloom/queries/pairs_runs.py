"""Text pairs and training runs."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dataloom.operators import catalog, pairs, runs
from dataloom.plans.shared import scratch_path
from dataloom.queries.tables import JOB_EVENTS, PAIRS, Tables, duck, rounded, text_list

_EVENTS = duck(JOB_EVENTS)
VOCABULARY = 2_000

# Expected and generated texts to score.
ANSWERS = """
(SELECT p_partkey, p_brand AS input, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END AS expected,
  CASE WHEN p_size % 3 = 0 THEN p_name ELSE lower(p_type) || substr(p_name, 4) END AS generated
FROM {part})
"""

CONFIGS = """
(SELECT o_orderkey AS job_id, o_orderpriority AS model_type, CAST(o_custkey AS INT) AS epochs,
  o_totalprice AS learning_rate FROM {orders})
"""

CHECKS = """
(SELECT event_id AS id, 'file' || user_id || '.py' AS filename, event_type AS tool, value AS score,
  CAST(length(props) AS INT) AS issues_count FROM {events})
"""


def pairs_of(t: Tables) -> DataFrame:
    return pairs.to_pairs(t.sql(PAIRS), "question", "answer", keep=["conv_id", "turn"])


def _split_sizes(t: Tables) -> DataFrame:
    split = pairs.train_test_split(t.documents, "doc_id", 0.1, seed=7)
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"))


def _encoded(t: Tables) -> DataFrame:
    text = pairs_of(t)
    vocab = pairs.build_vocab(text, ["input", "target"], VOCABULARY)
    ready = pairs.add_prefix(text, "Comment to Code")
    rows = pairs.encode_pairs(ready, vocab, ["conv_id", "turn"], max_in=64, max_tgt=32)
    return rows.withColumns({c: text_list(c) for c in ("input_ids", "attention_mask", "labels")})


def _encoded_filtered(t: Tables) -> DataFrame:
    """Ids under a vocabulary from which every other word was taken: ids stay as given."""
    text = pairs_of(t)
    vocab = pairs.build_vocab(text, ["input", "target"], VOCABULARY).where("token_id % 2 = 0")
    rows = pairs.encode_pairs(text, vocab, ["conv_id", "turn"])
    used = F.filter("input_ids", lambda i: i != 0)
    return rows.select("conv_id", "turn", F.concat_ws(" ", used.cast("array<string>")).alias("input_ids"))


def _vocabulary_sql(texts: str, size: int) -> str:
    return f"""SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INT) AS token_id
    FROM (SELECT token, count(*) AS n FROM (
      SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM {texts}) WHERE token <> ''
      GROUP BY token ORDER BY n DESC, token LIMIT {size})"""


def encoded_sql() -> str:
    def ids(column: str, width: int) -> str:
        return f"""(SELECT conv_id, turn, list(coalesce(token_id, 1) ORDER BY place) AS ids FROM (
          SELECT conv_id, turn, unnest(ws) AS token, unnest(range(len(ws))) AS place FROM (
            SELECT conv_id, turn, list_filter(regexp_split_to_array({column}, '\\s+'),
              lambda w: w <> '')[1:{width}] AS ws FROM p)) LEFT JOIN vocab USING (token)
          GROUP BY conv_id, turn)"""

    def padded(ids_of: str, width: int) -> str:
        return f"array_to_string(list_resize({ids_of}, {width}, 0), ' ')"

    return f"""
    WITH q AS (SELECT * FROM {duck(PAIRS)}),
    p AS (SELECT conv_id, turn, 'translate comment to code: ' || question AS input,
      answer AS target FROM q),
    vocab AS ({_vocabulary_sql("(SELECT question AS text FROM q UNION ALL SELECT answer FROM q)",
                               VOCABULARY)}),
    i AS {ids("input", 64)}, o AS {ids("target", 32)}
    SELECT p.conv_id, p.turn, {padded("i.ids", 64)} AS input_ids,
      {padded("list_transform(i.ids, lambda x: 1)", 64)} AS attention_mask,
      {padded("o.ids", 32)} AS labels
    FROM p JOIN i USING (conv_id, turn) JOIN o USING (conv_id, turn)"""


# Jobs that go through their states: every order is one.
JOBS_OF = """
(SELECT CAST(o_orderkey AS INT) AS id, 'job ' || o_orderkey AS name, CAST(o_custkey AS INT) AS dataset_id,
  o_orderpriority AS model_type, o_orderstatus AS kind, o_totalprice AS price, o_orderdate AS moment FROM {orders})
"""
_JOBS = duck(JOBS_OF)


def _runs(t: Tables) -> runs.Runs:
    """Jobs created, started (not of kind P), completed (F) or failed (O), every fiftieth
    removed; each with a log line and those of kind F with a configuration."""
    book, jobs = runs.Runs(t.spark, scratch_path(t.spark, "runs")), t.sql(JOBS_OF)
    book.add_jobs(jobs.withColumn("created_at", F.col("moment")))
    book.change(jobs.where("kind <> 'P'").select("id", F.lit(runs.RUNNING).alias("status"), F.col("moment").alias("started_at")))
    book.change(jobs.where("kind = 'F'").select(
        "id", F.lit(runs.COMPLETED).alias("status"), F.col("moment").alias("completed_at"),
        F.to_json(F.struct("dataset_id")).alias("metrics"), F.to_json(F.struct("model_type", "price")).alias("config"),
    ))
    book.change(jobs.where("kind = 'O'").select("id", F.lit(runs.FAILED).alias("status"), F.col("moment").alias("completed_at")))
    book.add_logs(jobs.select(
        F.col("id").cast("long").alias("id"), F.col("id").alias("training_job_id"), F.col("moment").alias("timestamp"),
        F.concat(F.lit("at "), "kind").alias("message"),
    ))
    book.remove(jobs.where("id % 50 = 0"))
    return book


def _cascade(t: Tables) -> DataFrame:
    """What is left of each table after one of two datasets was removed."""
    book = catalog.Catalog(t.spark, scratch_path(t.spark, "catalog"))
    kept, gone = book.store_profile(t.customer, "customers"), book.store_profile(t.orders, "orders")
    for dataset, table in ((kept, t.customer), (gone, t.orders)):
        book.create_version(dataset, table)
    book.runs.add_jobs(t.sql(JOBS_OF).withColumn("dataset_id", F.when(F.col("id") % 3 == 0, kept).otherwise(gone)))
    book.runs.add_logs(t.sql(JOBS_OF).select(F.col("id").alias("training_job_id"), F.lit("x").alias("message")))
    book.delete(gone)
    left = {"datasets": book.datasets(), "columns": book.columns(), "versions": book.versions(), "jobs": book.jobs(), "logs": book.logs()}
    counts = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, rows in left.items()]
    return reduce(DataFrame.unionAll, counts)


def _current(t: Tables) -> DataFrame:
    """The current version after three were created and the last was removed."""
    book = catalog.Catalog(t.spark, scratch_path(t.spark, "catalog"))
    dataset = book.store_profile(t.orders, "orders")
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    book.create_version(dataset, t.orders, "first", now=at[0])
    book.create_version(dataset, t.orders.where("o_orderstatus = 'F'"), "second", now=at[1])
    last = book.create_version(dataset, t.orders.where("o_orderstatus = 'O'"), "third", now=at[2])
    book.delete_version(dataset, last)
    rows = book.datasets().join(book.versions().withColumnRenamed("dataset_id", "id").drop("description"), "id")
    current = rows.where("version_id = current_version_id")
    return current.select("name", F.get_json_object("metadata", "$.rows").cast("long").alias("rows"))


_SCORED = f"""(SELECT p_partkey, input, coalesce(expected, '') AS expected, generated,
  1 - levenshtein(coalesce(expected, ''), generated)
    / greatest(length(coalesce(expected, '')), length(generated)) AS match_score
FROM {duck(ANSWERS)})"""

QUERIES = {
    "train_test_split": (
        lambda t: pairs.train_test_split(t.orders, "o_orderkey", 0.1, seed=1), None,
    ),
    "train_test_sizes": (
        _split_sizes,
        """SELECT split, "rows", "rows" AS ids FROM (
          SELECT 'test' AS split, CAST(ceil(count(*) * 0.1) AS BIGINT) AS "rows" FROM documents
          UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.1) AS BIGINT) FROM documents)""",
    ),
    "pairs_prefixed": (
        lambda t: pairs.add_prefix(pairs_of(t), "Code to Comment"),
        f"""SELECT conv_id, turn, 'translate code to comment: ' || question AS input,
          answer AS target FROM {duck(PAIRS)}""",
    ),
    "build_vocab": (
        lambda t: pairs.build_vocab(t.documents, ["text"], VOCABULARY),
        _vocabulary_sql("documents", VOCABULARY),
    ),
    "encode_pairs": (_encoded, encoded_sql()),
    "score_predictions": (
        lambda t: rounded(pairs.score_predictions(t.sql(ANSWERS))),
        f"""SELECT p_partkey, input, expected, generated, round(match_score, 6) + 0.0 AS match_score
        FROM {_SCORED}""",
    ),
    "score_summary": (
        lambda t: pairs.score_summary(pairs.score_predictions(t.sql(ANSWERS))),
        f"""SELECT count(*) AS tests, CAST(round_even(avg(match_score), 2) AS DOUBLE) AS mean_score,
          count(*) FILTER (match_score > 0.8) AS passed FROM {_SCORED}""",
    ),
    "job_latest_state": (
        lambda t: rounded(runs.job_state(t.sql(JOB_EVENTS).filter("status <> 'log'"))),
        f"""WITH e AS (SELECT * FROM {_EVENTS} WHERE status <> 'log'),
        a AS (SELECT job_id, min(ts) FILTER (status = 'created') AS created_at,
          min(ts) FILTER (status = 'running') AS started_at,
          max(ts) FILTER (status IN ('completed', 'failed')) AS ended_at FROM e GROUP BY 1),
        l AS (SELECT * FROM e QUALIFY row_number() OVER (
          PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT job_id, status, ts AS updated_at, metrics, created_at, started_at, ended_at,
          round(CASE WHEN ended_at >= started_at THEN
            (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 END, 6) + 0.0 AS duration_seconds
        FROM l JOIN a USING (job_id)""",
    ),
    "jobs_by_dataset": (
        lambda t: runs.jobs_of_datasets(
            t.orders.selectExpr("o_orderkey AS job_id", "o_custkey AS dataset_id",
                                "o_orderstatus AS status"),
            t.customer.selectExpr("c_custkey AS id", "c_name AS name")),
        """SELECT o_custkey AS dataset_id, o_orderkey AS job_id, o_orderstatus AS status,
          c_name AS dataset_name FROM orders JOIN customer ON c_custkey = o_custkey""",
    ),
    "job_by_id": (
        lambda t: runs.job_by_id(t.sql(JOB_EVENTS), 7),
        f"SELECT * FROM {_EVENTS} WHERE job_id = 7",
    ),
    "logs_by_job": (
        lambda t: runs.logs(t.sql(JOB_EVENTS)), f"SELECT * FROM {_EVENTS} ORDER BY job_id, ts, event_id",
    ),
    "log_tail": (
        lambda t: runs.log_tail(t.sql(JOB_EVENTS), 10),
        f"""SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC)
          AS INT) AS rank FROM {_EVENTS} QUALIFY rank <= 10""",
    ),
    "metric_series": (
        lambda t: runs.metric_series(t.sql(JOB_EVENTS), ["k"]),
        f"""SELECT job_id, ts, event_id, CAST(json_extract_string(metrics, '$.k') AS DOUBLE) AS k
        FROM {_EVENTS}""",
    ),
    "run_config": (
        lambda t: rounded(runs.load_config(
            runs.save_config(t.sql(CONFIGS), ["model_type", "epochs", "learning_rate"])
            .select("job_id", "config"),
            "model_type string, epochs int, learning_rate double")),
        f"""SELECT job_id, model_type, epochs, round(learning_rate, 6) + 0.0 AS learning_rate
        FROM {duck(CONFIGS)}""",
    ),
    "run_lifecycle": (
        lambda t: _runs(t).jobs().drop("description", "task_type", "hyperparameters", "model_path", "config"),
        f"""SELECT id, name, dataset_id, model_type, moment AS created_at,
          CASE WHEN kind <> 'P' THEN moment END AS started_at,
          CASE WHEN kind <> 'P' THEN moment END AS completed_at,
          CASE kind WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'created' END AS status,
          CASE WHEN kind = 'F' THEN '{{"dataset_id":' || dataset_id || '}}' END AS metrics
        FROM {_JOBS} WHERE id % 50 <> 0""",
    ),
    "log_append": (
        lambda t: _runs(t).logs().drop("metrics"),
        f"""SELECT CAST(id AS BIGINT) AS id, id AS training_job_id, moment AS timestamp, 'INFO' AS level,
          'at ' || kind AS message FROM {_JOBS} WHERE id % 50 <> 0""",
    ),
    "config_saved": (
        lambda t: rounded(runs.load_config(_runs(t).jobs().select("id", "config"), "model_type string, price double")),
        f"""SELECT id, CASE WHEN kind = 'F' THEN model_type END AS model_type,
          CASE WHEN kind = 'F' THEN round(price, 6) + 0.0 END AS price FROM {_JOBS} WHERE id % 50 <> 0""",
    ),
    "current_version": (
        _current, "SELECT 'orders' AS name, count(*) AS \"rows\" FROM orders WHERE o_orderstatus = 'F'",
    ),
    "cascade_all": (
        _cascade,
        """SELECT 'datasets' AS "table", 1::BIGINT AS n UNION ALL SELECT 'columns', 5 UNION ALL SELECT 'versions', 1
        UNION ALL SELECT 'jobs', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0)
        UNION ALL SELECT 'logs', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0)""",
    ),
    "encode_filtered_vocab": (
        _encoded_filtered,
        f"""WITH q AS (SELECT * FROM {duck(PAIRS)}), vocab AS (SELECT * FROM ({_vocabulary_sql(
            "(SELECT question AS text FROM q UNION ALL SELECT answer FROM q)", VOCABULARY)}) WHERE token_id % 2 = 0),
        w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')[1:256] AS ws FROM q),
        e AS (SELECT conv_id, turn, unnest(ws) AS token, unnest(range(len(ws))) AS place FROM w)
        SELECT conv_id, turn, array_to_string(list(coalesce(token_id, 1) ORDER BY place), ' ') AS input_ids
        FROM e LEFT JOIN vocab USING (token) GROUP BY conv_id, turn""",
    ),
    "checks_by_tool": (
        lambda t: rounded(runs.checks_by_tool(t.sql(CHECKS))),
        f"""SELECT tool, count(*) AS checks, CAST(sum(issues_count) AS BIGINT) AS issues,
          round(avg(score), 6) + 0.0 AS mean_score FROM {duck(CHECKS)} GROUP BY 1""",
    ),
    "checks_by_file": (
        lambda t: runs.checks_of(t.sql(CHECKS), filename="file7.py", tool="error"),
        f"SELECT * FROM {duck(CHECKS)} WHERE filename = 'file7.py' AND tool = 'error'",
    ),
}
