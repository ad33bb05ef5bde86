"""Trees of task configurations, branches, results and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.functions.text import filled
from stepweave.operators import steps as S
from stepweave.sources import jsonl

TASK = "id string, snapshot string, instruction string, source string, trajectory string, related_apps array<string>, config string, evaluator string"
ANALYSIS = "task_id string, app_type string, model string, steps int, category string, analysis struct<branch_points:array<struct<after_step:int,reason:string,new_task_examples:array<string>,num_tasks:int>>>"
SEED_STEP = "step_num int, action_timestamp string, action string, response string, reward double, done boolean, info string, screenshot_file string, Error string"
METADATA = (
    "original_task_id string, domain string, branch_after_step int, original_instruction string, new_task_description string, refined_task_descriptions_by_step map<string,string>, progress_summary string, generation_timestamp string, "
    "num_replay_steps int, num_new_steps int, total_steps int, generated_task_description_from_vllm string, verification struct<success:boolean,explanation:string>, state_verification struct<match:boolean,explanation:string>, "
    "replay_reasoning_backfill struct<updated_steps:map<string,struct<method:string,action_text:string>>>"
)
BRANCH_STEP = "step int, action string, action_dict string, reasoning string, action_proposal string, reward double, done boolean, terminal boolean, skip boolean"


def _file() -> Column:
    return F.col("_metadata.file_path")


def part(path: Column, n: int) -> Column:
    """Part n of a path, counted from the end, from 1."""
    return F.element_at(F.split(path, "/"), -n)


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """Task configurations of examples/<domain>/<id>.json; the evaluator stays text, as its fields have several shapes."""
    rows = spark.read.schema(TASK).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    return rows.withColumn("domain", part(_file(), 2))


def task_config(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    """Point lookups; null where there is no configuration."""
    return wanted.join(configs.withColumnRenamed("id", "task_id"), ["domain", "task_id"], "left")


def analyses(spark: SparkSession, root: str) -> DataFrame:
    """A row a branch point, with its place in the file. Files whose names begin with _ are not seen."""
    rows = spark.read.schema(ANALYSIS).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    points = rows.select("task_id", "app_type", "model", F.posexplode("analysis.branch_points").alias("at", "p"))
    return points.select("task_id", "app_type", "model", "at", "p.*").where("after_step is not null and num_tasks is not null")


def trajectory_file(wanted: DataFrame, files: DataFrame, folders: dict[str, str]) -> DataFrame:
    """The first path of the model's folder that has the task's id in it. files(path); wanted(task_id, model)."""
    folder = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    named = wanted.withColumn("folder", F.try_element_at(folder, F.col("model")))
    tagged = files.withColumn("folder", part(F.col("path"), 4))
    found = named.join(tagged, "folder", "left").where(F.col("path").isNull() | F.contains("path", F.col("task_id")))
    return found.groupBy("task_id", "model").agg(F.min("path").alias("path"))


def branches(spark: SparkSession, root: str, source: str = "main") -> DataFrame:
    """Metadata of branch folders that have both files, with the folder's name as branch_id. Unreadable metadata is left out."""
    rows = spark.read.schema(METADATA).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/metadata.json").withColumn("branch_id", part(_file(), 2))
    listed = spark.read.format("binaryFile").load(f"{root}/*/trajectory.jsonl").select(part(F.col("path"), 2).alias("branch_id")).distinct()
    return rows.join(listed, "branch_id", "left_semi").withColumn("source", F.lit(source))


def branch_steps(spark: SparkSession, root: str) -> DataFrame:
    """(branch_id, line_no, step fields): good lines alone, numbered from 1."""
    rows = jsonl.numbered(spark, f"{root}/*/trajectory.jsonl", BRANCH_STEP)
    return rows.select(part(F.col("file"), 2).alias("branch_id"), "line_no", "row.*")


def training_examples(meta: DataFrame, steps: DataFrame, include_replay: bool = True, terminal: str = "Finish the task.", max_branch_domains: tuple[str, ...] = ()) -> DataFrame:
    """Per-step examples of branches: description, running history, replay and skip flags, both training types.

    Skipped steps stay in the histories and give no example. Arrays of all steps are not copied to each row: join by branch_id."""
    meta = S.max_branch_only(meta, "original_task_id", "branch_after_step", "domain", list(max_branch_domains))
    half = F.col("source") == "half_verified"
    described = F.when(half, F.coalesce("new_task_description", "generated_task_description_from_vllm", F.lit(""))).otherwise(F.coalesce(filled("generated_task_description_from_vllm"), "new_task_description", F.lit("")))
    own = meta.select("branch_id", "source", described.alias("task_description"), F.coalesce("num_replay_steps", F.lit(0)).alias("n_replay"), F.col("replay_reasoning_backfill.updated_steps").alias("updated"))
    joined = steps.join(own, "branch_id")
    replay = F.col("line_no") <= F.col("n_replay")
    joined = joined.withColumn("is_replay", replay)
    if not include_replay:
        joined = joined.where("not is_replay")
    method = F.try_element_at(F.col("updated"), F.col("line_no").cast("string"))["method"]
    keys, order = ["branch_id"], ["line_no"]
    built = joined.select(
        "branch_id", "source", "line_no", "task_description", "is_replay",
        F.coalesce("step", F.col("line_no").cast("int")).alias("step"), F.coalesce("action", F.lit("")).alias("action"),
        F.coalesce("action_dict", F.when(F.coalesce("terminal", F.upper(F.trim("action")) == "DONE"), F.lit('{"terminal":true,"status":"done"}')), F.lit("{}")).alias("action_dict"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"), S.terminal_text("action_proposal", terminal, keys, order).alias("action_proposal"),
        F.coalesce("reward", F.lit(0.0)).alias("reward"), F.coalesce("done", F.lit(False)).alias("done"),
        (F.coalesce("skip", F.lit(False)) | S.skipped(F.col("is_replay"), method)).alias("skip"), S.history("reasoning", keys, order).alias("history"),
    )
    return S.fan_out(built.where("not skip"))


def results(spark: SparkSession, root: str) -> DataFrame:
    """Scores of action_space/obs_type/model/domain/example_id/result.txt; words for true and false count as 1 and 0, other text as null."""
    path = F.col("_metadata.file_path")
    rows = spark.read.text(f"{root}/*/*/*/*/*/result.txt", wholetext=True)
    said = F.lower(F.trim("value"))
    score = F.coalesce(said.try_cast("double"), F.when(said == "true", 1.0).when(said == "false", 0.0))
    return rows.select(*[part(path, 7 - i).alias(n) for i, n in enumerate(("action_space", "obs_type", "model", "domain", "example_id"), 1)], score.alias("score"))


def existing_outputs(meta: DataFrame) -> DataFrame:
    """How many branches each (task, branch point) has; rows of the wrong types are left out."""
    good = meta.where("original_task_id is not null and branch_after_step is not null")
    return good.groupBy(F.col("original_task_id").alias("task_id"), F.col("branch_after_step").alias("after_step")).agg(F.count(F.lit(1)).alias("existing"))


def seen_store(spark: SparkSession, path: str) -> DataFrame:
    """(at, description) of {tasks: [{description}]}."""
    rows = spark.read.schema("tasks array<struct<description:string>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("tasks").alias("at", "t")).select("at", "t.description").where("description is not null")


def save_seen(store: DataFrame, path: str) -> None:
    """Distinct descriptions, each at its first place."""
    first = store.groupBy("description").agg(F.min("at").alias("at"))
    first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "description"))), lambda s: F.struct(s["description"].alias("description"))).alias("tasks")).write.mode("overwrite").json(path)


def save_branches(meta: DataFrame, steps: DataFrame, root: str, mismatch: Column | None = None) -> None:
    """Two tables by branch; screenshots are left out of the steps. Branches with a state mismatch go to quarantine."""
    wrong = F.coalesce(mismatch, F.lit(False)) if mismatch is not None else F.lit(False)
    meta.where(~wrong).write.mode("append").json(f"{root}/metadata")
    meta.where(wrong).write.mode("append").json(f"{root}/quarantine")
    kept = steps.drop("screenshot").join(meta.where(~wrong).select("branch_id"), "branch_id", "left_semi")
    kept.write.mode("append").partitionBy("branch_id").json(f"{root}/steps")


def display_logs(spark: SparkSession, root: str) -> DataFrame:
    kind = "operations map<string,array<struct<operation:string,timestamp:double,tokens:array<int>,cost:string,duration:double,step_count:int>>>"
    return spark.read.schema(kind).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "display.json").json(root).withColumn("file", _file())


def latest_steps(seed: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each running task: last step, number of steps, error and done flags."""
    last = F.max_by(F.struct("done", "Error", "action_timestamp"), "step_num")
    return seed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps"), last.alias("last")).select(*keys, "n_steps", "last.*")


def human_steps(trajectories: DataFrame, limit: int | None = None) -> DataFrame:
    """Steps of human demonstrations: nested (traj or trajectory) arrays, description by the first filled of three keys."""
    task = F.coalesce(filled("natural_language_task"), filled("instruction"), filled("actual_task"), F.lit(""))
    steps = F.coalesce("traj", "trajectory")
    rows = trajectories.select("trajectory_id", task.alias("task_description"), "task_completed", F.size(steps).alias("n"), F.posexplode(steps).alias("at", "s"))
    last = F.col("at") == F.col("n") - 1
    rows = rows.where(F.col("at") < limit) if limit else rows
    done = last & F.coalesce("task_completed", F.lit(False))
    return rows.select("trajectory_id", "task_description", "at", F.col("s.value.thought").alias("reasoning"), F.col("s.value.code").alias("code"), F.col("s.image").alias("image"), done.alias("done"), F.when(done, 1.0).otherwise(0.0).alias("reward"))


def hub_steps(rows: DataFrame, os_type: str | None = None) -> DataFrame:
    """Rows of a shared dataset: filtered before any image is read, indexed in their trajectory, actions parsed."""
    rows = rows.where(F.col("os_type") == os_type) if os_type else rows
    w = Window.partitionBy("trajectory_id").orderBy("step_number")
    return rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("action", F.coalesce(F.expr("try_parse_json(action_dict)"), F.expr("parse_json('{}')")))
