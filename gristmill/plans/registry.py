"""Queries by name and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import keys, perturb
from gristmill.functions import text as X
from gristmill.functions import validation as V
from gristmill.operators import builders, consensus, mixture, reports, rows, scoring
from gristmill.plans import sql, views
from gristmill.plans.views import table
from gristmill.sources import images, records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scoring and reports over the question-answering view

_SCORED = f"SELECT *, {sql.same('answer_type', 'gold', 'prediction')} AS correct FROM ({views.QA}) q"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_typed(views.qa(spark, d))


_PLOT = f"""SELECT *, {sql.plot_task_type("question")} AS task_type, {sql.same_decimal("answer_type", "gold", "prediction")} AS correct,
  CASE WHEN answer_type = 'numeric' THEN {sql.decimal("gold")} END AS g, CASE WHEN answer_type = 'numeric' THEN {sql.decimal("prediction")} END AS p
FROM ({views.QA}) q WHERE dataset = 'plotqa_qa'"""


def _plot(spark: SparkSession, d: str) -> DataFrame:
    plot = views.qa(spark, d).filter(F.col("dataset") == "plotqa_qa").withColumn("task_type", X.plot_task_type("question"))
    return scoring.score_decimal(plot, F.col("task_type"))


@query(
    "bench_summary",
    f"""SELECT dataset, answer_type, count(*) AS total, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) AS average_score, avg(latency_ms) AS average_latency_ms,
  sum(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS accuracy FROM ({_SCORED}) s GROUP BY 1, 2""",
)
def bench_summary(spark, d):
    return scoring.summarize(_scored(spark, d), "dataset", "answer_type")


@query(
    "score_predictions",
    f"""SELECT sample_id, dataset, correct, CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END AS score FROM (
  SELECT sample_id, dataset, correct FROM ({_SCORED}) a WHERE dataset <> 'plotqa_qa' UNION ALL SELECT sample_id, dataset, correct FROM ({_PLOT}) b) u""",
)
def score_predictions(spark, d):
    return scoring.score_predictions(views.qa(spark, d)).select("sample_id", "dataset", "correct", "score")


@query("infer_answer_type", f"SELECT sample_id, {sql.answer_type('gold')} AS gold_type, {sql.answer_type('prediction')} AS prediction_type FROM ({views.QA}) q")
def infer_answer_type(spark, d):
    return views.qa(spark, d).select("sample_id", X.infer_answer_type("gold").alias("gold_type"), X.infer_answer_type("prediction").alias("prediction_type"))


@query(
    "infer_task_type",
    f"SELECT conv_id, turn, {sql.task_type('question')} AS task_type, {sql.task_type('answer')} AS answer_task FROM ({views.PAIRS}) p",
)
def infer_task_type(spark, d):
    return views.pairs(spark, d).select("conv_id", "turn", X.infer_task_type("question").alias("task_type"), X.infer_task_type("answer").alias("answer_task"))


@query(
    "plotqa_task_type",
    f"""SELECT sample_id, task_type, {sql.answer_mode("question", "answer_type", "task_type")} AS answer_mode,
  {sql.scorer_mode("answer_type", "task_type")} AS scorer_mode FROM (SELECT *, {sql.plot_task_type("question")} AS task_type FROM ({views.QA}) q) t""",
)
def plotqa_task_type(spark, d):
    typed = views.qa(spark, d).withColumn("task_type", X.plot_task_type("question"))
    return typed.select(
        "sample_id", "task_type", X.answer_mode("question", "answer_type", "task_type").alias("answer_mode"), X.scorer_mode("answer_type", "task_type").alias("scorer_mode")
    )


@query(
    "normalize_text",
    f"""SELECT sample_id, {sql.normalize("prediction")} AS normal, {sql.yes_no("prediction")} AS yes_no FROM ({views.QA}) q
UNION ALL SELECT 'nation:' || n_nationkey, {sql.normalize("'  ' || n_name || ' !?. '")}, {sql.yes_no("'  ' || n_name || ' !?. '")} FROM nation""",
)
def normalize_text(spark, d):
    qa = views.qa(spark, d).select("sample_id", "prediction")
    nation = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("  "), "n_name", F.lit(" !?. ")))
    return qa.union(nation).select("sample_id", X.normalize_text("prediction").alias("normal"), X.normalize_yes_no("prediction").alias("yes_no"))



def _lines(kind: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber % 3 WHEN 0 THEN concat(' ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {kind}), '% ')
    WHEN 1 THEN concat('-', CAST(CAST(l_quantity AS DECIMAL(18,2)) AS {kind}), '.') ELSE concat(' ', l_returnflag, '. ') END AS gold,
  CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {kind}), '0')
    WHEN 1 THEN concat('-', CAST(CAST(l_quantity + 1 AS DECIMAL(18,2)) AS {kind})) ELSE lower(l_returnflag) END AS prediction"""


@query("normalize_numeric", f"SELECT l_orderkey, l_linenumber, l_partkey, {sql.float_of('gold')} AS value, {sql.same("'numeric'", 'gold', 'prediction')} AS same FROM ({_lines('VARCHAR')} FROM lineitem) x")
def normalize_numeric(spark, d):
    lines = spark.sql(_lines("STRING") + " FROM {lineitem}", lineitem=table(spark, d, "lineitem"))
    same = X.normalize_numeric("gold") == X.normalize_numeric("prediction")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", X.float_of("gold").alias("value"), same.alias("same"))


@query(
    "decimal_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql.same_decimal("'numeric'", "gold", "prediction")} AS correct, g IS NOT NULL AS gold_parse_ok, p IS NOT NULL AS prediction_parse_ok,
  CAST(abs(p - g) AS DOUBLE) AS absolute_error,
  CASE WHEN abs(p - g) = 0 THEN 0.0::DOUBLE WHEN g <> 0 THEN CAST(abs(p - g) AS DOUBLE) / CAST(abs(g) AS DOUBLE) END AS relative_error
FROM (SELECT *, CAST({sql.decimal("gold")} AS DECIMAL(37,12)) AS g, CAST({sql.decimal("prediction")} AS DECIMAL(37,12)) AS p FROM ({_lines("VARCHAR")} FROM lineitem) y) x""",
)
def decimal_score(spark, d):
    lines = spark.sql(_lines("STRING") + ", 'numeric' AS answer_type FROM {lineitem}", lineitem=table(spark, d, "lineitem"))
    names = ("l_orderkey", "l_linenumber", "l_partkey", "correct", "gold_parse_ok", "prediction_parse_ok", "absolute_error", "relative_error")
    return scoring.score_decimal(lines).select(*names)


@query(
    "qa_report",
    f"""SELECT count(*) AS total, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) AS exact_match, count(CASE WHEN answer_type = 'numeric' THEN 1 END) AS numeric_rows,
  avg(CASE WHEN answer_type = 'numeric' THEN CASE WHEN p IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END END) AS numeric_parse,
  avg(CAST(abs(CAST(p AS DECIMAL(37,12)) - CAST(g AS DECIMAL(37,12))) AS DOUBLE)) AS mean_absolute_error FROM ({_PLOT}) s""",
)
def qa_report(spark, d):
    return reports.qa_report(_plot(spark, d))


@query(
    "answer_modes",
    f"""SELECT answer_mode, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM (SELECT {sql.scorer_mode("answer_type", "task_type")} AS answer_mode FROM ({_PLOT}) s) m GROUP BY 1""",
)
def answer_modes(spark, d):
    return reports.shares(_plot(spark, d), "answer_mode")


_DISPLAY = "CASE dataset " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.DISPLAY.items()) + " ELSE dataset END"


@query(
    "accuracy_by_dataset",
    f"""SELECT {_DISPLAY} AS name, count(*) AS total, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  sum(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS accuracy FROM ({_SCORED}) s GROUP BY 1""",
)
def accuracy_by_dataset(spark, d):
    return reports.accuracy_by(_scored(spark, d).withColumn("name", reports.display_name("dataset")), "name")


_LABELLED = f"SELECT *, CASE WHEN latency_ms < 10 THEN 'fast' WHEN latency_ms IS NULL THEN 'none' ELSE 'slow' END AS label FROM ({_SCORED}) s"


@query(
    "accuracy_grid",
    f"""SELECT l.label, x.dataset, coalesce(a.accuracy, 0) AS accuracy FROM (SELECT DISTINCT label FROM ({_LABELLED}) a) l CROSS JOIN (SELECT DISTINCT dataset FROM ({_LABELLED}) b) x
LEFT JOIN (SELECT label, dataset, sum(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS accuracy FROM ({_LABELLED}) c GROUP BY 1, 2) a
  ON a.label = l.label AND a.dataset = x.dataset""",
)
def accuracy_grid(spark, d):
    label = F.when(F.col("latency_ms") < 10, "fast").when(F.col("latency_ms").isNull(), "none").otherwise("slow")
    return reports.accuracy_grid(_scored(spark, d).withColumn("label", label), "label", "dataset")


@query(
    "running_accuracy",
    f"""SELECT dataset, sample_id, running_correct, running_total, CAST(running_correct AS DOUBLE) / running_total AS running_accuracy FROM (
  SELECT dataset, sample_id, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w AS BIGINT) AS running_correct, count(*) OVER w AS running_total
  FROM ({_SCORED}) s WINDOW w AS (PARTITION BY dataset ORDER BY sample_id ROWS UNBOUNDED PRECEDING)) r""",
)
def running_accuracy(spark, d):
    out = scoring.running_accuracy(_scored(spark, d), "sample_id", "dataset")
    return out.select("dataset", "sample_id", "running_correct", "running_total", "running_accuracy")


# --- rows: pairs, slices, limits, batches, keys, anti-joins


@query("turn_pairs", f"SELECT conv_id, turn, question, answer, {sql.answer_type('answer')} AS answer_type FROM ({views.PAIRS}) p")
def turn_pairs(spark, d):
    return views.pairs(spark, d).select("conv_id", "turn", "question", "answer", X.infer_answer_type("answer").alias("answer_type"))


@query(
    "offset_limit_before_flatmap",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 10 AND conv_id < 60",
)
def offset_limit_before_flatmap(spark, d):
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return rows.source_slice(talks, "conv_id", 10, 50).select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role")


@query("limit_after_flatmap", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role LIMIT 100")
def limit_after_flatmap(spark, d):
    return rows.first_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), 100, "conv_id", "turn", "role")


@query("batch_ids", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 32 AS BIGINT) AS batch_id FROM events")
def batch_ids(spark, d):
    return rows.batch_ids(table(spark, d, "events").select("event_id"), "event_id", 32)


@query(
    "record_key",
    f"""SELECT conv_id, turn, sha256('{{"answer":' || CAST(to_json(answer) AS VARCHAR) || ',"answer_type":"' || answer_type || '","dataset":"pairs","image_sha256":"","input":' ||
  CAST(to_json(question) AS VARCHAR) || ',"sample_id_fallback":"' || conv_id || ':' || turn || '","split":"train","task_type":"","version":"{keys.KEY_VERSION}"}}') AS record_key
FROM (SELECT *, {sql.answer_type("answer")} AS answer_type FROM ({views.PAIRS}) p) t""",
)
def record_key(spark, d):
    pairs = views.pairs(spark, d).withColumn("answer_type", X.infer_answer_type("answer"))
    key = keys.record_key(
        dataset=F.lit("pairs"), split=F.lit("train"), input_text="question", answer="answer", answer_type="answer_type", sample_id=F.concat_ws(":", "conv_id", "turn")
    )
    return pairs.select("conv_id", "turn", key.alias("record_key"))


@query(
    "resume_antijoin",
    "SELECT doc_id, sha256(text) AS record_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src1', 'src3'))",
)
def resume_antijoin(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("record_key"))
    return rows.not_seen(docs, docs.filter(F.col("source").isin("src1", "src3"))).select("doc_id", "record_key")


# --- annotators


_VALID = f"SELECT *, {sql.validation_error('text')} AS problem FROM ({views.TAGGED}) t"
_VOTES = f"""SELECT *, problem IS NULL AS valid, CASE WHEN problem IS NULL THEN {sql.tag_value("text", "answer")} END AS vote FROM ({_VALID}) v"""
_NORM = f"SELECT *, {sql.normalize_vote('vote')} AS norm FROM ({_VOTES}) n"
_TALLY = f"SELECT sample_id, norm, count(*) AS n, min(ord) AS first_ord, arg_min(vote, ord) AS vote FROM ({_NORM}) x WHERE norm IS NOT NULL GROUP BY 1, 2"
_AGREED = f"""SELECT sample_id, vote AS agreed_output, norm AS agreed_norm FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first_ord) AS rn FROM ({_TALLY}) y) z WHERE rn = 1 AND n >= 2"""


@query(
    "response_fill",
    "SELECT event_id AS custom_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS text, CASE WHEN event_id % 13 = 0 THEN 'missing provider batch result' END AS error FROM events",
)
def response_fill(spark, d):
    events = table(spark, d, "events")
    given = events.filter("event_id % 13 <> 0").select(F.col("event_id").alias("custom_id"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("error"))
    return consensus.fill_missing(events.select(F.col("event_id").alias("custom_id")), given)


@query("tag_validation", f"SELECT sample_id, provider, problem FROM ({_VALID}) v")
def tag_validation(spark, d):
    return views.tagged(spark, d).select("sample_id", "provider", V.validation_error("text").alias("problem"))


@query(
    "tag_extract",
    f"SELECT sample_id, provider, {sql.tag_value('text', 'perceive')} AS perceive, {sql.tag_value('text', 'extract')} AS extract, {sql.tag_value('text', 'answer')} AS answer FROM ({views.TAGGED}) t",
)
def tag_extract(spark, d):
    return views.tagged(spark, d).select("sample_id", "provider", *(V.tag_value("text", t).alias(t) for t in V.STAGE1_TAGS))


@query("consensus_vote", _AGREED)
def consensus_vote(spark, d):
    return consensus.agreed(consensus.votes(views.tagged(spark, d)))


@query(
    "dissenters",
    f"""SELECT x.sample_id, array_to_string(list(x.provider ORDER BY x.ord) FILTER (WHERE x.norm IS NULL OR x.norm <> a.agreed_norm), ',') AS dissenters, CAST(count(*) AS BIGINT) AS providers
FROM ({_NORM}) x JOIN ({_AGREED}) a ON a.sample_id = x.sample_id GROUP BY 1""",
)
def dissenters(spark, d):
    voted = consensus.votes(views.tagged(spark, d))
    found = consensus.dissenters(voted, consensus.agreed(voted))
    counts = voted.groupBy("sample_id").agg(F.count("*").alias("providers"))
    listed = F.when(F.size("dissenters") > 0, F.array_join("dissenters", ","))
    return found.join(counts, "sample_id").select("sample_id", listed.alias("dissenters"), "providers")


_OUTCOME = f"""SELECT s.*, a.agreed_output, CASE WHEN a.agreed_output IS NULL AND NOT (dataset = 'plotqa_qa' AND answer_type = 'numeric' AND valid_all) THEN 'no_teacher_majority'
    WHEN a.agreed_output IS NULL AND NOT adjudicated THEN 'plotqa_numeric_adjudication_failed' WHEN NOT synthesised THEN 'synthesis_failed' END AS skip_reason
FROM (SELECT sample_id, bool_and(valid) AS valid_all, CASE WHEN sample_id % 2 = 0 THEN 'plotqa_qa' ELSE 'chartqa' END AS dataset,
    CASE WHEN sample_id % 3 = 0 THEN 'text' ELSE 'numeric' END AS answer_type, sample_id % 5 <> 0 AS adjudicated, sample_id % 9 <> 0 AS synthesised FROM ({_NORM}) x GROUP BY 1) s
LEFT JOIN ({_AGREED}) a ON a.sample_id = s.sample_id"""


def _outcomes(spark, d):
    voted = consensus.votes(views.tagged(spark, d))
    samples = voted.groupBy("sample_id").agg(F.bool_and("valid").alias("valid_all"))
    samples = samples.withColumns(
        {
            "dataset": F.when(F.col("sample_id") % 2 == 0, "plotqa_qa").otherwise("chartqa"),
            "answer_type": F.when(F.col("sample_id") % 3 == 0, "text").otherwise("numeric"),
            "adjudicated": F.col("sample_id") % 5 != 0,
            "synthesised": F.col("sample_id") % 9 != 0,
        }
    )
    return consensus.outcomes(samples, consensus.agreed(voted), valid_all="valid_all", adjudicated="adjudicated", synthesised="synthesised")


@query("skip_reason", f"SELECT sample_id, agreed_output, skip_reason FROM ({_OUTCOME}) o")
def skip_reason(spark, d):
    return _outcomes(spark, d).select("sample_id", "agreed_output", "skip_reason")


_DRAW = "CAST(('0x' || substr(sha256({}), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE"


@query(
    "generation_stats",
    f"""SELECT *, agreement / CAST(total AS DOUBLE) AS agreement_rate, written / CAST(total AS DOUBLE) AS write_rate, skipped / CAST(total AS DOUBLE) AS skip_rate FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE NOT deduped AND skip_reason IS NULL) AS written, count(*) FILTER (WHERE NOT deduped AND skip_reason IS NOT NULL) AS skipped,
    count(*) FILTER (WHERE NOT deduped AND agreed_output IS NOT NULL) AS agreement, count(*) FILTER (WHERE NOT deduped AND skip_reason IS NULL AND drawn) AS contrastive, count(*) FILTER (WHERE deduped) AS deduped
  FROM (SELECT *, sample_id % 17 = 0 AS deduped, {_DRAW.format("'0:' || sample_id")} < 0.25::DOUBLE AS drawn FROM ({_OUTCOME}) o) p) q""",
)
def generation_stats(spark, d):
    results = _outcomes(spark, d).withColumn("deduped", F.col("sample_id") % 17 == 0)
    results = results.withColumn("written", ~F.col("deduped") & F.col("skip_reason").isNull())
    results = results.withColumn("agreement", ~F.col("deduped") & F.col("agreed_output").isNotNull())
    return consensus.generation_stats(results.withColumn("contrastive", F.col("written") & keys.hash_draw(F.col("sample_id").cast("string"), 0.25, 0)))


_ASKED = "CASE sample_id % 3 WHEN 0 THEN 'How many in 2014?' WHEN 1 THEN 'Is the change large?' ELSE 'Which is it?' END"


@query("lint_extract", f"SELECT sample_id, provider, {sql.lint('text', _ASKED, 'CAST(user_id AS VARCHAR)')} AS message FROM ({views.TAGGED}) t")
def lint_extract(spark, d):
    tagged = views.tagged(spark, d).withColumn("question", F.expr(_ASKED))
    return tagged.select("sample_id", "provider", V.lint_message(V.lint_errors("text", "question", F.col("user_id").cast("string"))).alias("message"))


# --- structures


_FACTS = """
SELECT o_custkey AS sample_id, 'cust ' || o_custkey AS series, CAST(year(o_orderdate) AS VARCHAR) AS x, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) AS DOUBLE) AS y
FROM orders GROUP BY o_custkey, year(o_orderdate)"""


@query("structure_facts", _FACTS)
def structure_facts(spark, d):
    parsed = scoring.parse_structures(views.structure(spark, d))
    return parsed.select("sample_id", F.explode("gold_points").alias("f")).select("sample_id", "f.*")


# A prediction has the gold facts (0), doubled values under another name (1), or none (2 to 4).
# Doubled values are matched greedily in the order of years.
_SCORES = f"""WITH RECURSIVE facts AS ({_FACTS}), gold AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY x) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM facts),
fold AS (
  SELECT sample_id, 0 AS i, max(n) AS n, list(y ORDER BY i) AS g, list(y * 2 ORDER BY i) AS free, 0 AS hits FROM gold WHERE sample_id % 5 = 1 GROUP BY sample_id
  UNION ALL
  SELECT sample_id, i + 1, n, g, CASE WHEN pos IS NULL THEN free ELSE list_concat(free[1:pos - 1], free[pos + 1:]) END, hits + CASE WHEN pos IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_position(list_transform(free, lambda p: abs(g[i + 1] - p) <= greatest(abs(g[i + 1]) * 0.05::DOUBLE, 0.001::DOUBLE)), true) AS pos FROM fold WHERE i < n) s
), doubled AS (SELECT sample_id, n, hits FROM fold WHERE i = n),
scores AS (
  SELECT DISTINCT sample_id, n, CASE sample_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END::DOUBLE AS series_f1,
    CASE WHEN sample_id % 5 <= 1 THEN 1 ELSE 0 END::DOUBLE AS x_f1, CASE WHEN sample_id % 5 = 0 THEN 1 ELSE 0 END::DOUBLE AS point_f1,
    CASE sample_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN (SELECT hits / CAST(d.n AS DOUBLE) FROM doubled d WHERE d.sample_id = gold.sample_id) ELSE 0 END AS value_f1,
    CASE WHEN sample_id % 5 <= 1 THEN 1 ELSE 0 END::DOUBLE AS fact_coverage FROM gold
)
SELECT sample_id, n AS gold_facts, series_f1, x_f1, point_f1, value_f1, fact_coverage, ((series_f1 + x_f1 + value_f1) / 3 + fact_coverage) / 2 AS score FROM scores"""


def _structures(spark, d):
    return scoring.bucketed(scoring.score_structures(views.structure(spark, d)))


@query("structure_score", _SCORES)
def structure_score(spark, d):
    names = ("gold_facts", "series_f1", "x_f1", "point_f1", "value_f1", "fact_coverage")
    scored = scoring.score_structures(views.structure(spark, d))
    return scored.select("sample_id", *(F.col(f"plotqa_{n}").cast("long" if n == "gold_facts" else "double").alias(n) for n in names), "score")


_BUCKETS = """CASE sample_id % 5 WHEN 0 THEN 'semantic_match' WHEN 1 THEN 'partial_semantic_match' WHEN 2 THEN 'placeholder_output' WHEN 3 THEN 'no_structural_tags' ELSE 'empty_output' END"""


@query("failure_buckets", f"SELECT bucket, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (SELECT {_BUCKETS} AS bucket FROM (SELECT DISTINCT o_custkey AS sample_id FROM orders) o) b GROUP BY 1")
def failure_buckets(spark, d):
    return reports.shares(_structures(spark, d), "bucket")


@query(
    "structure_report",
    f"""SELECT count(*) AS total, 1.0::DOUBLE AS gold_parse, avg(x_f1) AS prediction_parse, 0.0::DOUBLE AS exact_match, avg(CASE WHEN score = 1 THEN 1.0::DOUBLE ELSE 0 END) AS semantic_match,
  avg(score) AS semantic_mean, avg(score) AS model_quality_score, avg((series_f1 + x_f1 + value_f1) / 3) AS component_f1, avg(value_f1) AS value_f1, avg(fact_coverage) AS fact_coverage,
  avg(series_f1) AS series_precision, avg(series_f1) AS series_recall, avg(series_f1) AS series_f1, avg(x_f1) AS x_label_precision, avg(x_f1) AS x_label_recall, avg(x_f1) AS x_label_f1,
  avg(x_f1) AS count_match, CAST(avg(gold_facts) AS DOUBLE) AS gold_facts, avg(gold_facts * x_f1) AS predicted_facts, 0.0::DOUBLE AS over_extract, avg(1 - x_f1) AS under_extract,
  avg(CASE WHEN sample_id % 5 = 4 THEN 1.0::DOUBLE ELSE 0 END) AS empty_output, avg(CASE WHEN sample_id % 5 = 2 THEN 1.0::DOUBLE ELSE 0 END) AS placeholder_output, 0.0::DOUBLE AS unparsed_schema_variant
FROM ({_SCORES}) s""",
)
def structure_report(spark, d):
    return reports.structure_report(_structures(spark, d))


@query(
    "structure_variants",
    f"""SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN (count(*) - 1) / CAST(count(*) AS DOUBLE) ELSE 1.0::DOUBLE END AS point_f1, count(*) AS predicted_facts, 1.0::DOUBLE AS x_f1
FROM ({_FACTS}) f GROUP BY sample_id""",
)
def structure_variants(spark, d):
    """The series form of the gold structures, as attributes and as child tags; the last
    value of every third is another."""
    orders = views.structure(spark, d).select("sample_id", "gold")
    x, y = (F.regexp_extract("gold", f"<s_{t}>(.*?)</s_{t}>", 1) for t in "xy")
    y = F.when(F.col("sample_id") % 3 == 0, F.regexp_replace(y, "[^>]+$", "7")).otherwise(y)
    name = F.concat(F.lit("Cust "), "sample_id")
    inline = F.concat(F.lit('<series name="'), name, F.lit('" x="'), F.regexp_replace(x, "<sep/>", ";"), F.lit('" y="'), F.regexp_replace(y, "<sep/>", ";"), F.lit('"/>'))
    nested = F.concat(F.lit("<series label='"), name, F.lit("'><x>"), x, F.lit("</x><y>"), y, F.lit("</y></series>"))
    both = orders.withColumn("prediction", F.when(F.col("sample_id") % 2 == 0, inline).otherwise(nested))
    scored = scoring.score_structures(both)
    return scored.select("sample_id", F.col("plotqa_point_f1").cast("double").alias("point_f1"), F.col("plotqa_predicted_facts").cast("long").alias("predicted_facts"), F.col("plotqa_x_f1").cast("double").alias("x_f1"))


# --- counterexamples


@query("contrastive_sample", f"SELECT doc_id, {_DRAW.format("'13:' || sha256(text)")} AS fraction FROM documents WHERE {_DRAW.format("'13:' || sha256(text)")} < 0.25::DOUBLE")
def contrastive_sample(spark, d):
    docs = table(spark, d, "documents").withColumn("record_key", F.sha2("text", 256))
    return docs.filter(keys.hash_draw(F.col("record_key"), 0.25, 13)).select("doc_id", keys.hash_fraction(F.col("record_key"), 13).alias("fraction"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_OTHERS = f"list_filter({list(_PRIORITIES)}, lambda c: lower(c) <> lower({sql.strip('gold')}))"
_INDEX = f"CAST(('0x' || substr(sha256('13:' || {sql.strip('gold')}), 1, 8))::UBIGINT % len({_OTHERS}) AS INTEGER) + 1"
_FLOAT = sql.float_of("gold")
_PERTURBED = f"""SELECT sample_id, gold, answer_type, CASE answer_type WHEN 'yes_no' THEN CASE lower({sql.strip("gold")}) WHEN 'yes' THEN 'no' WHEN 'true' THEN 'no' WHEN 'no' THEN 'yes' WHEN 'false' THEN 'yes' END
  WHEN 'multiple_choice' THEN {_OTHERS}[{_INDEX}]
  WHEN 'numeric' THEN CASE WHEN ({_FLOAT}) = floor({_FLOAT}) THEN CAST(CAST(round_even(({_FLOAT}) + greatest(abs({_FLOAT}) * 0.05::DOUBLE, 1.0::DOUBLE), 0) AS BIGINT) AS VARCHAR)
    ELSE printf('%.4g', ({_FLOAT}) + greatest(abs({_FLOAT}) * 0.05::DOUBLE, 0.1::DOUBLE)) END END AS perturbed FROM ({views.QA}) q"""


def _perturbed(spark, d):
    options = F.when(F.col("answer_type") == "multiple_choice", F.array(*map(F.lit, _PRIORITIES)))
    return views.qa(spark, d).withColumn("p", perturb.perturbation("gold", "answer_type", options, 13))


@query("perturb_answer", f"SELECT sample_id, perturbed FROM ({_PERTURBED}) p")
def perturb_answer(spark, d):
    return _perturbed(spark, d).select("sample_id", F.col("p.answer").alias("perturbed"))


@query(
    "contrastive_record",
    f"""SELECT sample_id, '<verdict>FAIL</verdict>' || chr(10) || '<correct_answer>' || gold || '</correct_answer>' || chr(10) || '<correction>' || chr(10) || '<answer>' || gold || '</answer>' || chr(10) || '</correction>' AS output,
  '<answer>' || perturbed || '</answer>' AS wrong FROM ({_PERTURBED}) p WHERE perturbed IS NOT NULL""",
)
def contrastive_record(spark, d):
    return _contrastive(_perturbed(spark, d))


def _contrastive(perturbed):
    gold = F.concat(F.lit("<answer>"), "gold", F.lit("</answer>"))
    records_ = perturbed.filter(F.col("p").isNotNull()).select(
        "sample_id",
        F.col("question").alias("input"),
        gold.alias("output"),
        F.col("p.answer").alias("perturbed_answer"),
        F.col("gold").alias("gold_answer"),
        F.col("gold").alias("answer"),
        gold.alias("gold_output"),
        perturb.replace_answer(gold, F.col("p.answer")).alias("wrong"),
    )
    return mixture.critique(records_).select("sample_id", "output", "wrong")


# --- mixtures, with sources of the documents as datasets

_DATASETS = tuple(f"src{i}" for i in range(20))
_INDEX_OF = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_DATASETS)) + " END"
_SPLIT = f"""SELECT doc_id, source, CASE WHEN rn <= floor(n * (1.0::DOUBLE - 0.05::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256((13 + {_INDEX_OF}) || ':' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) r"""


def _mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return mixture.split(docs, key="doc_id", dataset="source", seed=13, val_split=0.05, datasets=_DATASETS)


@query("mixture_split", _SPLIT)
def mixture_split(spark, d):
    return _mix(spark, d)


@query(
    "mixture_with_contrastive",
    f"""SELECT doc_id, source, split, false AS contrastive FROM ({_SPLIT}) s UNION ALL SELECT doc_id, source, split, true FROM ({_SPLIT}) s""",
)
def mixture_with_contrastive(spark, d):
    mix = _mix(spark, d).withColumn("contrastive", F.lit(False))
    wrong = table(spark, d, "documents").select("doc_id", "source", F.lit(True).alias("contrastive"))
    return mixture.attach_contrastive(mix, wrong, key="doc_id").select("doc_id", "source", "split", "contrastive")


@query(
    "mixture_order",
    f"SELECT doc_id, split, sha256(CASE split WHEN 'val' THEN '10013:' ELSE '13:' END || doc_id) AS shuffle FROM ({_SPLIT}) s",
)
def mixture_order(spark, d):
    return mixture.final_order(_mix(spark, d), "doc_id", 13).select("doc_id", "split", "shuffle")


@query(
    "row_metrics",
    "\nUNION ALL\n".join(
        f"SELECT '{f}' AS field, coalesce({f}, 'unknown') AS value, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio FROM documents GROUP BY 2" for f in ("source", "lang")
    ),
)
def row_metrics(spark, d):
    return reports.row_metrics(table(spark, d, "documents"), ("source", "lang"))


@query("row_mix", f"SELECT split, source, count(*) AS n FROM ({_SPLIT}) s GROUP BY 1, 2")
def row_mix(spark, d):
    return reports.row_mix(_mix(spark, d), "split", "source")


# --- records, failures, images


@query("jsonl_line", """SELECT sample_id, '{"answer_type":"' || answer_type || '","dataset":"' || dataset || '","gold":' || CAST(to_json(gold) AS VARCHAR) || ',"sample_id":"' || sample_id || '"}' AS line FROM (""" + views.QA + ") q")
def jsonl_line(spark, d):
    qa = views.qa(spark, d).select("sample_id", "dataset", "gold", "answer_type")
    return qa.select("sample_id", records.json_line(qa).alias("line"))


@query(
    "failure_replay",
    f"""SELECT sample_id AS id, dataset, gold AS answer, prediction, 'wrong' AS error_type, sample_id || '.png' AS image, 'real' AS tag FROM ({_SCORED}) s WHERE NOT correct""",
)
def failure_replay(spark, d):
    wrong = _scored(spark, d).filter(~F.col("correct"))
    none = F.lit(None).cast("string")
    samples = wrong.select(
        F.col("sample_id").alias("id"),
        "dataset",
        F.concat("sample_id", F.lit(".png")).alias("image"),
        "question",
        F.col("gold").alias("answer"),
        "answer_type",
        F.lit("qa").alias("supervision"),
        none.alias("chart_type"),
        none.alias("task_type"),
        F.lit("real").alias("tag"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "prediction",
    ).withColumn("metadata", F.map_from_arrays(F.array(F.lit("origin")), F.array("dataset")))
    back = records.replay(records.failures(samples, F.lit("wrong")))
    m = lambda k: F.element_at("metadata", k).alias(k)
    return back.select("id", "dataset", "answer", m("prediction"), m("error_type"), "image", "tag")


@query(
    "image_store",
    "SELECT page_id, sha256, ref FROM (SELECT page_id, sha256(html) AS sha256, 'images/' || sha256(html) || '.png' AS ref, row_number() OVER (PARTITION BY sha256(html) ORDER BY page_id) AS rn FROM pages) p WHERE rn = 1",
)
def image_store(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return images.first_of_each(images.stored(pages), "page_id").select("page_id", "sha256", "ref")


# Pages behind the first bytes of an image of four kinds by page_id.
_HEADS = ("\\x89PNG\\x0D\\x0A\\x1A\\x0A", "\\xFF\\xD8\\xFF", "RIFF1234WEBP", "")
_IMAGE = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{h}'::BLOB" for i, h in enumerate(_HEADS)) + " END || encode(html)"


@query(
    "media_type",
    f"""SELECT page_id, kind AS media_type, 'data:' || kind || ';base64,' || to_base64({_IMAGE}) AS url FROM (
  SELECT *, CASE page_id % 4 WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'image/png' END AS kind FROM pages) p""",
)
def media_type(spark, d):
    heads = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"RIFF1234WEBP", b"")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 4 + 1).cast("int"))
    image = F.concat(head, F.col("html").cast("binary"))
    return table(spark, d, "pages").select("page_id", X.media_type(image).alias("media_type"), X.data_url(image).alias("url"))


# --- record builders


def _built(spark, d):
    """Core rows of the turn pairs, with an image that every other row lacks."""
    none = F.lit(None).cast("string")
    return views.pairs(spark, d).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.lit("pairs").alias("dataset"),
        F.lit("p.png").alias("image"),
        "question",
        "answer",
        X.infer_answer_type("answer").alias("answer_type"),
        none.alias("chart_type"),
        none.alias("task_type"),
        F.when(F.col("turn") % 4 == 0, "images/p.png").alias("image_ref"),
        F.when(F.col("turn") % 4 == 0, "abc").alias("image_sha256"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("metadata"),
        "turn",
    )


_KEYED = f"""SELECT conv_id || ':' || turn AS sample_id, turn, question, answer, CASE WHEN turn % 4 = 0 THEN 'images/p.png' END AS image_ref, sha256('{{"answer":' || CAST(to_json(answer) AS VARCHAR) || ',"answer_type":"' || {sql.answer_type("answer")} ||
  '","dataset":"pairs","image_sha256":"' || CASE WHEN turn % 4 = 0 THEN 'abc' ELSE '' END || '","input":' || CAST(to_json(question) AS VARCHAR) || ',"sample_id_fallback":"' || CASE WHEN turn % 4 = 0 THEN '' ELSE conv_id || ':' || turn END ||
  '","split":"train","task_type":"","version":"{keys.KEY_VERSION}"}}') AS record_key FROM ({views.PAIRS}) p"""


@query(
    "gold_record",
    f"""SELECT record_key, image_ref AS image, question AS input, '<answer>' || answer || '</answer>' AS output, 'gold' AS example_type, sample_id, '{{"turn":"' || turn || '"}}' AS source_metadata, 'yes' AS traced FROM ({_KEYED}) k""",
)
def gold_record(spark, d):
    rows_ = _built(spark, d).withColumn("output", F.concat(F.lit("<answer>"), "answer", F.lit("</answer>")))
    rows_ = rows_.withColumn("trace", builders.entries(traced="yes", example_type="overlaid"))
    made = builders.gold_records(rows_, split="train")
    m = lambda k: F.element_at("metadata", k).alias(k)
    return made.select("record_key", "image", "input", "output", m("example_type"), m("sample_id"), m("source_metadata"), m("traced"))


@query(
    "skipped_record",
    f"""SELECT record_key, sample_id, image_ref, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE 'synthesis_failed' END AS skip_reason, CASE WHEN turn % 2 = 0 THEN 'late' ELSE 'early' END AS error, 'skipped' AS example_type, answer FROM ({_KEYED}) k""",
)
def skipped_record(spark, d):
    none = F.lit(None).cast("string")
    rows_ = _built(spark, d).withColumns(
        {
            "skip_reason": F.when(F.col("turn") % 3 != 0, "synthesis_failed"),
            "error": F.when(F.col("turn") % 2 != 0, "early").otherwise(""),
            "synthesis_error": F.lit("late"),
            "agreed_output": none,
            "teacher_errors": F.lit(None).cast("map<string,string>"),
        }
    )
    made = builders.skipped_records(rows_, split="train")
    return made.select("record_key", "sample_id", "image_ref", "skip_reason", "error", "example_type", "answer")


@query(
    "trace_metadata",
    f"""SELECT sample_id, max(CASE WHEN ord = 0 THEN vote END) AS vote_a, max(CASE WHEN ord = 1 THEN vote END) AS vote_b, bool_or(ord = 0 AND valid) AS valid_a, bool_or(ord = 1 AND valid) AS valid_b,
  max(CASE WHEN ord = 0 THEN error END) AS error_a, max(CASE WHEN ord = 1 THEN error END) AS error_b, 'stage1' AS reasoning_schema, CAST(count(vote) AS BIGINT) AS n_votes FROM ({_NORM}) x GROUP BY 1""",
)
def trace_metadata(spark, d):
    made = builders.traces(views.tagged(spark, d).withColumn("attempts", F.lit(1)))
    at = lambda m, p: F.element_at(m, p).alias(f"{m.rstrip('s') if m != 'valid' else m}_{p}")
    return made.select("sample_id", *(at(m, p) for m in ("votes", "valid", "errors") for p in "ab"), "reasoning_schema", F.size("votes").cast("long").alias("n_votes"))
