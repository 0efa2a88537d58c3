"""Source rows to the core schema, one adapter for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.keys import short_id
from gristmill.functions.text import answer_mode, first_present, first_truthy, infer_answer_type, infer_task_type, plot_task_type, strip

#: Columns of the core schema in their order.
CORE = ("id", "dataset", "image", "question", "answer", "answer_type", "supervision", "chart_type", "task_type", "tag", "metadata")
# Fixed value: the question of every structure row.
STRUCTURE_QUESTION = (
    "Extract the chart data as PlotQA XML-like tags. Return one series block per chart series using only these tags: <s>, <s_y>, <s_x>, <s_name>, and <sep/>. "
    "Use actual values read from the chart only. Separate repeated values with <sep/>. "
    "For vertical bar and line charts, put numeric values in <s_y> and x labels or zero-based x positions in <s_x>. "
    "For horizontal bar charts, put category labels in <s_y> and numeric values in <s_x>. Use the visible legend or series label in <s_name>. "
    "Do not output placeholders such as y1, y2, x1, x2, or series name. Do not output explanations, markdown, or any other tags."
)


def _core(df: DataFrame, **columns) -> DataFrame:
    fixed = {"chart_type": None, "task_type": None, "tag": "real", "metadata": None} | columns
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return df.select(*(as_column(fixed[c]).alias(c) for c in CORE))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _optional(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")]


def chartqa(df: DataFrame) -> DataFrame:
    """One row each; the answer is the first label.  Equal questions and answers on
    different images share an id."""
    answer = F.get("label", 0)
    return _core(
        df,
        id=F.concat(F.lit("chartqa:"), short_id(F.col("query"), answer)),
        dataset="chartqa",
        image=F.col("image"),
        question=F.col("query"),
        answer=answer,
        answer_type=infer_answer_type(answer),
        supervision="benchmark",
        task_type=infer_task_type("query"),
        metadata=_json(source_type=F.col("human_or_machine")),
    )


def figureqa(df: DataFrame, index: str = "source_index") -> DataFrame:
    """A row for each question of an image."""
    flat = df.select(index, "image", F.posexplode("qa").alias("pos", "qa"))
    return _core(
        flat,
        id=F.concat_ws(":", F.lit("figureqa"), F.col(index), F.col("pos")),
        dataset="figureqa",
        image=F.col("image"),
        question=F.col("qa.question"),
        answer=F.col("qa.answer"),
        answer_type=infer_answer_type("qa.answer"),
        supervision="qa",
        task_type=infer_task_type("qa.question"),
    )


def plot_structure(df: DataFrame, index: str = "source_index", question: str = STRUCTURE_QUESTION) -> DataFrame:
    return _core(
        df,
        id=F.concat_ws(":", F.lit("plotqa_structure"), F.col(index)),
        dataset="plotqa_structure",
        image=F.col("image"),
        question=question,
        answer=F.col("text"),
        answer_type="structure",
        supervision="structure",
        task_type="structure_extraction",
    )


def plot_qa(df: DataFrame, index: str = "source_index") -> DataFrame:
    """Fields may have any of four names; a row without question or answer is an error."""
    question = first_present(*_optional(df, "question", "query", "user", "prompt"))
    answer = first_present(*_optional(df, "answer", "label", "assistant", "response"))
    missing = F.raise_error(F.lit("rows must have a question and an answer"))
    rows = df.withColumns(
        {
            "__q": F.when(question.isNull() | answer.isNull(), missing.cast("string")).otherwise(strip(question)),
            "__a": strip(answer),
            "__kind": F.coalesce(*_optional(df, "question_type")),
        }
    ).withColumns({"__type": infer_answer_type("__a"), "__task": plot_task_type("__q", F.col("__kind"))})
    source = F.coalesce(*_optional(df, "id"), *([F.col(index).cast("string")] if index in df.columns else []), short_id(F.col("__q"), F.col("__a")))
    return _core(
        rows,
        id=F.concat(F.lit("plotqa_qa:"), source),
        dataset="plotqa_qa",
        image=first_truthy(*_optional(df, "image", "img", "image_path")),
        question=F.col("__q"),
        answer=F.col("__a"),
        answer_type=F.col("__type"),
        supervision="benchmark",
        chart_type=F.coalesce(*_optional(df, "chart_type")),
        task_type=F.col("__task"),
        metadata=_json(
            question_type=F.col("__kind"), constructed_caption=F.coalesce(*_optional(df, "constructed_caption")), plotqa_answer_mode=answer_mode("__q", "__type", "__task")
        ),
    )


def chartbench(df: DataFrame) -> DataFrame:
    """A row for each turn of the conversation."""
    archive = F.when(F.col("image").contains("/train/"), "data/train.zip").otherwise("data/test.zip")
    flat = df.select("id", "image", "type", archive.alias("archive"), F.posexplode("conversation").alias("pos", "turn"))
    return _core(
        flat,
        id=F.concat_ws(":", F.lit("chartbench"), F.coalesce(F.col("id").cast("string"), short_id(F.col("image"))), F.col("pos")),
        dataset="chartbench",
        image=F.col("image"),
        question=F.col("turn.query"),
        answer=F.col("turn.label"),
        answer_type=infer_answer_type("turn.label"),
        supervision="benchmark",
        chart_type=F.col("type.chart"),
        task_type=F.col("type.task"),
        metadata=_json(type=F.col("type"), image_ref=F.col("image"), image_archive=F.col("archive")),
    )


def mmc(df: DataFrame) -> DataFrame:
    """Empty fields count as missing here; options make a row multiple choice."""
    question = F.coalesce(first_truthy(*_optional(df, "instruction", "question", "query")), F.lit(""))
    answer = F.coalesce(first_truthy(*_optional(df, "label", "answer")), F.lit(""))
    options = first_truthy(*_optional(df, "options", "choices"))
    image_id, task = F.coalesce(*_optional(df, "image_id")), F.coalesce(*_optional(df, "task"))
    source = F.coalesce(first_truthy(*_optional(df, "image_id", "id")), short_id(question, answer))
    return _core(
        df,
        id=F.concat_ws(":", F.lit("mmc_benchmark"), source, short_id(question)),
        dataset="mmc_benchmark",
        image=first_truthy(*_optional(df, "image", "image_id")),
        question=question,
        answer=answer,
        answer_type=infer_answer_type(answer, options.isNotNull() & ~options.isin("[]", "{}")),
        supervision="benchmark",
        task_type=F.coalesce(F.nullif(task, F.lit("")), infer_task_type(question)),
        metadata=_json(options=options, task=task, image_ref=image_id, image_archive=F.lit("MMC-Benchmark/mmc_benchmark_images.tar.gz")),
    )


ADAPTERS = {"chartqa": chartqa, "figureqa": figureqa, "plotqa_structure": plot_structure, "plotqa_qa": plot_qa, "chartbench": chartbench, "mmc_benchmark": mmc}


def adapt(dataset: str, df: DataFrame) -> DataFrame:
    """Rows of a known source in the core schema."""
    if dataset not in ADAPTERS:
        raise KeyError(f"Unknown dataset: {dataset}")
    return ADAPTERS[dataset](df)
