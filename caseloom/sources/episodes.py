"""Episode documents: explicit schema, JSON-lines reader, validation, flattening, and the two-way sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.functions.entities import redact_documents
from caseloom.session import materialize, scratch_path

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint,cost_usd:double,latency_s:double>"
ERROR = "struct<type:string,message:string>"
COUNTERFACTUAL = f"struct<error:{ERROR},passes_before:int,passes_after:int,failures_after:int,done:boolean,result_head:string>"
CANDIDATE = f"struct<action_raw:string,action:struct<type:string,code:string>,score:double,usage:{USAGE},parse_error:string,counterfactual:{COUNTERFACTUAL}>"
STEP = (f"struct<step_index:int,timestamp:timestamp,observation:string,action_schema_ref:string,candidates:array<{CANDIDATE}>,chosen_index:int,tool_result:string,"
        f"error:{ERROR},retry_index:int,reward:double,success_state:boolean,evaluator_output:struct<passes:int,failures:int,success:boolean>,usage:{USAGE},policy_meta:string>")
# Free-form objects (task_meta, policy_meta, raw) stay JSON text.
EPISODE = (f"schema_version string, env_id string, benchmark string, task_id string, scenario_id string, episode_id string, run_id string, split string, "
           f"versions struct<env_version:string,benchmark_version:string,model_id:string,prompt_hash:string,harness_git_sha:string,policy_id:string,policy_version:string,seed:int>, "
           f"started_at timestamp, ended_at timestamp, task_instruction string, task_meta string, steps array<{STEP}>, termination_reason string, "
           f"final_eval struct<success:boolean,num_tests:int,passes:array<string>,failures:array<string>,raw:string>, "
           f"totals struct<steps:int,invalid_actions:int,input_tokens:bigint,output_tokens:bigint,cost_usd:double,wall_s:double>, "
           f"redaction struct<rules_version:string,n_redactions:int>")
# Accepted versions, endings, and fields that must be present.
SCHEMA_VERSIONS = ["1.0.0", "1.1.0"]
TERMINATIONS = ["completed", "max_steps", "error", "timeout", "budget"]
REQUIRED = ["env_id", "benchmark", "task_id", "episode_id", "run_id", "split", "versions", "started_at", "task_instruction"]


def read_episodes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON-lines episodes from any number of folders; blank lines are skipped, unparsable ones kept in ``_corrupt``."""
    return spark.read.schema(EPISODE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn(
        "trace_file", F.col("_metadata.file_path"))


def validation_errors(required: list[str] | None = None, corrupt: str | None = None) -> Column:
    """Rule names an episode document breaks; an empty array means it is valid.

    ``corrupt`` names the column with the raw text of unparsable lines, where the reader kept one.
    """
    steps = F.coalesce("steps", F.array())
    gap = F.exists(F.transform(steps, lambda s, i: s["step_index"] != i), lambda b: b)
    pick = F.exists(steps, lambda s: s["chosen_index"].isNull() | (s["chosen_index"] < 0) | (s["chosen_index"] >= F.size(F.coalesce(s["candidates"], F.array()))))
    rules = [
        *([F.when(F.col(corrupt).isNotNull(), "unparsable")] if corrupt else []),
        F.when(gap, "step_index"), F.when(pick, "chosen_index"),
        F.when(~F.coalesce("schema_version", F.lit("1.1.0")).isin(SCHEMA_VERSIONS), "schema_version"),
        F.when(F.col("termination_reason").isNotNull() & ~F.col("termination_reason").isin(TERMINATIONS), "termination_reason"),
        *[F.when(F.col(c).isNull(), f"missing:{c}") for c in (REQUIRED if required is None else required)],
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def flatten_steps(episodes: DataFrame) -> DataFrame:
    """Episode documents -> step table with the executed candidate's action."""
    s = episodes.select("episode_id", "run_id", "scenario_id", "task_id", F.explode("steps").alias("s"))
    chosen = F.try_element_at(F.col("s.candidates"), F.col("s.chosen_index") + 1)
    return s.select("episode_id", "run_id", "scenario_id", "task_id", "s.step_index", "s.chosen_index", F.size("s.candidates").alias("n_candidates"),
                    chosen["action"]["code"].alias("code"), F.col("s.error.type").alias("error_type"), F.col("s.error.message").alias("error_message"),
                    "s.tool_result", "s.observation", "s.reward", F.col("s.success_state").alias("done"), F.col("s.evaluator_output.passes").alias("passes"),
                    F.col("s.evaluator_output.failures").alias("failures"))


def flatten_candidates(episodes: DataFrame) -> DataFrame:
    s = episodes.select("episode_id", F.explode("steps").alias("s")).select("episode_id", "s.step_index", "s.chosen_index", F.posexplode("s.candidates").alias("cand", "c"))
    cf = F.col("c.counterfactual")
    return s.select("episode_id", "step_index", "chosen_index", "cand", "c.action_raw", F.col("c.action.code").alias("code"), "c.score", "c.usage.*", cf.isNotNull().alias("has_cf"),
                    cf["error"]["type"].alias("cf_error"), cf["passes_before"].alias("passes_before"), cf["passes_after"].alias("passes_after"),
                    cf["failures_after"].alias("failures_after"), cf["done"].alias("cf_done"))


def nest(steps: DataFrame, candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Flat tables -> episode documents (an episode is bounded by the collector's step limit)."""
    null = F.lit(None)
    usage = F.struct("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    cf = F.when(F.col("has_cf"), F.struct(F.when(F.col("cf_error").isNotNull(), F.struct(F.col("cf_error").alias("type"), F.lit("").alias("message"))).alias("error"),
                                          "passes_before", "passes_after", "failures_after", F.col("cf_done").alias("done")))
    cand = F.struct("cand", "action_raw", F.struct(F.lit("execute_code").alias("type"), "code").alias("action"), null.cast("double").alias("score"), usage.alias("usage"), cf.alias("counterfactual"))
    cs = candidates.groupBy("episode_id", F.col("step_index").alias("_si")).agg(F.sort_array(F.collect_list(cand)).alias("candidates"))
    s = steps.withColumn("_si", F.col("step_index") if "order_index" not in steps.columns else F.col("order_index")).join(cs, ["episode_id", "_si"])
    err = F.when(F.col("error_type").isNotNull(), F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message")))
    step = F.struct("_si", "step_index", F.timestamp_micros("step_us").alias("timestamp"), "observation", F.lit("h").alias("action_schema_ref"),
                    F.transform("candidates", lambda c: c.dropFields("cand")).alias("candidates"), "chosen_index", "tool_result", err.alias("error"),
                    null.cast("double").alias("reward"), F.col("done").alias("success_state"), F.struct("passes", "failures").alias("evaluator_output"))
    docs = s.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: x.dropFields("_si")).alias("steps"))
    e = episodes.join(docs, "episode_id")
    lit = F.lit
    return e.select(
        "schema_version", lit("table").alias("env_id"), lit("dialogs").alias("benchmark"), "task_id", "scenario_id", "episode_id", "run_id", lit("train").alias("split"),
        F.struct("model_id").alias("versions"), F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"),
        F.col("instruction").alias("task_instruction"), "steps", "termination_reason", F.struct("success").alias("final_eval"),
        F.struct(F.col("stored_steps").cast("int").alias("steps"), "wall_s").alias("totals"), null.cast("string").alias("task_meta"))


def masked_and_checked(episodes: DataFrame, salt: str = "") -> DataFrame:
    """Masked documents with ``redaction`` and ``errors``, stored once, so both sinks read the same rows."""
    d = redact_documents(episodes, salt)
    return materialize(d.withColumn("errors", validation_errors(corrupt="_corrupt" if "_corrupt" in d.columns else None)), "checked-documents")


def write_validated(episodes: DataFrame, path: str, salt: str = "") -> tuple[str, str]:
    """Valid documents and dead letters (with their errors) as two JSON folders; every text masked first, nothing dropped."""
    checked = masked_and_checked(episodes, salt)
    ok, bad = f"{path}/episodes", f"{path}/invalid"
    checked.where(F.size("errors") == 0).drop("errors", "_corrupt").write.mode("append").json(ok)
    checked.where(F.size("errors") > 0).write.mode("append").json(bad)
    return ok, bad


def content_store(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(hash, doc): each distinct canonical text once, keyed by its sha256; already stored ones are left out."""
    d = docs.select(F.sha2("doc", 256).alias("hash"), "doc").dropDuplicates(["hash"])
    return d.join(existing.select("hash"), "hash", "left_anti") if existing is not None else d


def write_examples(examples: DataFrame, path: str | None = None) -> str:
    """Training examples partitioned by ``part`` (train / heldout)."""
    path = path or scratch_path(examples.sparkSession, "examples")
    examples.write.partitionBy("part").parquet(path)
    return path


def manifest(episodes: DataFrame) -> DataFrame:
    """Per run: valid / invalid counts, validation rate, cost and redaction count.  Needs n_errors, cost_usd, n_redactions."""
    return episodes.groupBy("run_id").agg(
        F.count_if(F.col("n_errors") == 0).alias("n_valid"), F.count_if(F.col("n_errors") > 0).alias("n_invalid"),
        F.round(F.avg((F.col("n_errors") == 0).cast("double")), 6).alias("validation_rate"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("n_redactions").alias("n_redactions"))
