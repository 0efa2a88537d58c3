"""Records built from samples, images and results: prepared, gold, skipped, traces, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import keys
from gristmill.operators.consensus import votes
from gristmill.sources.records import SCHEMA_VERSION, merged

#: Arguments of a run in the order in which they are recorded.
COMMAND = "dataset split samples all_samples batch_size shuffle_seed shuffle_buffer_size contrastive_rate provider_mode provider_poll_interval resume".split()
#: Columns of a skipped record.
SKIPPED = "schema_version example_type record_key dataset split sample_id answer answer_type task_type image_ref skip_reason error agreed_output teacher_errors".split()


def entries(**values: Column | str | None) -> Column:
    """``map<string,string>`` of the given entries."""
    as_text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v.cast("string")
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(as_text, values.values())))


def prompt_for(task_type: Column | str, answer_type: Column | str, by_task: dict[str, str], by_answer: dict[str, str], default: str) -> Column:
    """The prompt of the task, else of the answer type, else the default."""
    look = lambda table, c: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c) if table else F.lit(None).cast("string")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(look(by_task, col(task_type)), look(by_answer, col(answer_type)), F.lit(default))


def prepared(samples: DataFrame, prompt: Column) -> DataFrame:
    """The row that annotators get, from core rows with ``image_path``, ``image_ref``
    and ``image_sha256``; the four fixed metadata keys win over the sample's own."""
    fixed = entries(dataset=F.col("dataset"), sample_id=F.col("id"), image_ref=F.col("image_ref"), image_sha256=F.col("image_sha256"))
    return samples.select(
        F.col("image_path").alias("imgname"),
        "question",
        "answer",
        "answer_type",
        "task_type",
        "chart_type",
        "dataset",
        F.col("id").alias("sample_id"),
        merged(F.coalesce("metadata", F.create_map().cast("map<string,string>")), fixed).alias("metadata"),
        prompt.alias("system_prompt"),
    )


def requests(samples: DataFrame, prompt: Column) -> DataFrame:
    """Inference requests of core rows."""
    metadata = entries(**{c: F.col(c) for c in ("dataset", "answer_type", "chart_type", "task_type")})
    return samples.select(F.col("id").alias("sample_id"), "image", prompt.alias("system_prompt"), F.col("question").alias("prompt"), metadata.alias("metadata"))


def trained_input(stage: int, question: Column | str = "question", claim: Column | str = "claim") -> Column:
    """The input of a record: the question, or the claim that stage 2 evaluates."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(question) if stage == 1 else F.concat(F.lit("Evaluate this claim: "), col(claim))


def _key(split: str) -> Column:
    return keys.record_key(
        dataset="dataset", split=F.lit(split), image_sha256="image_sha256", input_text="question", answer="answer", answer_type="answer_type", task_type="task_type", sample_id="id"
    )


def gold_records(samples: DataFrame, *, split: str, output: str = "output", trace: str = "trace", stage: int = 1) -> DataFrame:
    """``image``, ``input``, ``output``, ``metadata`` and ``record_key`` of core rows with an
    output and the metadata of its trace; the record's own keys win over the trace's."""
    own = entries(
        schema_version=SCHEMA_VERSION,
        example_type="gold",
        dataset=F.col("dataset"),
        split=split,
        sample_id=F.col("id"),
        answer=F.col("answer"),
        answer_type=F.col("answer_type"),
        chart_type=F.col("chart_type"),
        task_type=F.col("task_type"),
        image_ref=F.col("image_ref"),
        image_sha256=F.col("image_sha256"),
        source_metadata=F.to_json("metadata"),
        record_key=F.col("record_key"),
        record_key_version=keys.KEY_VERSION,
    )
    keyed = samples.withColumn("record_key", _key(split))
    return keyed.select(F.col("image_ref").alias("image"), trained_input(stage).alias("input"), F.col(output).alias("output"), merged(F.col(trace), own).alias("metadata"), "record_key")


def skipped_records(samples: DataFrame, *, split: str, reason: str = "skip_reason", error: str = "error", result_error: str = "synthesis_error") -> DataFrame:
    """The fourteen columns of skipped core rows; the error is the explicit one, else
    that of the result.  ``teacher_errors`` is a map, empty where there is none."""
    values = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "example_type": F.lit("skipped"),
        "record_key": _key(split),
        "split": F.lit(split),
        "sample_id": F.col("id"),
        "skip_reason": F.coalesce(F.col(reason), F.lit("unknown")),
        "error": F.coalesce(F.nullif(F.col(error), F.lit("")), F.col(result_error)),
        "teacher_errors": F.coalesce("teacher_errors", F.create_map().cast("map<string,string>")),
    }
    return samples.select(*(values.get(c, F.col(c)).alias(c) for c in SKIPPED))


def traces(responses: DataFrame, *, stage: int = 1, requires_compute: Column | None = None, key: str = "sample_id") -> DataFrame:
    """For each sample maps by provider: ``votes`` (valid ones), ``valid``, ``errors`` and
    ``attempts``; and ``reasoning_schema``.  From responses with ``attempts``."""
    voted = votes(responses, stage, requires_compute)
    pairs = lambda c, kept=None: F.map_from_entries(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "provider", F.col(c).alias("v")) if kept is None else F.when(kept, F.struct("ord", "provider", F.col(c).alias("v"))))), lambda x: F.struct(x["provider"], x["v"]))
    )
    label = F.lit(f"stage{stage}") if requires_compute is None else F.when(F.first(requires_compute), "stage1_compute").otherwise(f"stage{stage}")
    return voted.groupBy(key).agg(
        pairs("vote", F.col("vote").isNotNull()).alias("votes"), pairs("valid").alias("valid"), pairs("error").alias("errors"), pairs("attempts").alias("attempts"), label.alias("reasoning_schema")
    )


def command(*values) -> dict:
    """The arguments of a run by name; as many values as there are names."""
    return dict(zip(COMMAND, values, strict=True))
