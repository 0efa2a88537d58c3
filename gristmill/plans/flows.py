"""Queries that go through sources, sinks and streams: scans of written datasets, adapters,
records that are written and read again, archives, and keyed deduplication."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from gristmill.functions import perturb
from gristmill.functions import text as X
from gristmill.functions import validation as V
from gristmill.operators import adapters, builders, reports, rows, scoring
from gristmill.plans import sql, views
from gristmill.plans.registry import _built, _scored, _SCORED, query
from gristmill.plans.views import table
from gristmill.sources import catalog, images, records
from gristmill.sources.scratch import folder
from gristmill.streaming import dedup

# --- scans: four files of rows with two questions each

_PARTS = f"""SELECT 'figureqa:' || i || ':' || pos AS id, image, question, answer, {sql.answer_type("answer")} AS answer_type, {sql.task_type("question")} AS task_type FROM (
  SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, 'p' || p_partkey || '.png' AS image, 0 AS pos, 'Is the part large?' AS question, CASE WHEN p_size > 25 THEN 'yes' ELSE 'No.' END AS answer FROM part
  UNION ALL SELECT row_number() OVER (ORDER BY p_partkey) - 1, 'p' || p_partkey || '.png', 1, 'How many units does it have?', CAST(p_size AS VARCHAR) FROM part) q"""


def _scan(spark, d, fmt, **slice_):
    root = folder(spark, "catalog")
    parts = table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("p"), "p_partkey", F.lit(".png")).alias("image"),
        F.array(
            F.struct(F.lit("Is the part large?").alias("question"), F.when(F.col("p_size") > 25, "yes").otherwise("No.").alias("answer")),
            F.struct(F.lit("How many units does it have?").alias("question"), F.col("p_size").cast("string").alias("answer")),
        ).alias("qa"),
    )
    parts.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.format(fmt).save(f"{root}/figureqa/train")
    schema = "image string, qa array<struct<question:string,answer:string>>" if fmt == "json" else None
    found = catalog.samples(spark, root, "figureqa", "train", fmt=fmt, schema=schema, **slice_)
    return found.select("id", "image", "question", "answer", "answer_type", "task_type")


@query("catalog_scan", _PARTS)
def catalog_scan(spark, d):
    return _scan(spark, d, "parquet")


@query("catalog_scan_json", _PARTS)
def catalog_scan_json(spark, d):
    return _scan(spark, d, "json")


@query("catalog_slice", f"SELECT * FROM ({_PARTS}) s WHERE CAST(split_part(id, ':', 2) AS BIGINT) BETWEEN 45 AND 164")
def catalog_slice(spark, d):
    """The feature is the slice: source rows 45 to 164, over several files."""
    return _scan(spark, d, "parquet", offset=45, limit=120)


# --- adapters


@query(
    "adapt_chartqa",
    f"""SELECT 'chartqa:' || substr(sha1('["' || question || '", ''' || answer || ''']'), 1, 12) AS id, image, question, answer, {sql.answer_type("answer")} AS answer_type, {sql.task_type("question")} AS task_type,
  '{{"source_type":"' || event_type || '"}}' AS metadata, 'benchmark' AS supervision FROM (
  SELECT event_type, event_id || '.png' AS image, 'What is the user''s value in event ' || event_id || '?' AS question, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS answer FROM events) e""",
)
def adapt_chartqa(spark, d):
    source = table(spark, d, "events").select(
        F.concat(F.lit("What is the user's value in event "), "event_id", F.lit("?")).alias("query"),
        F.array(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("other")).alias("label"),
        F.concat("event_id", F.lit(".png")).alias("image"),
        F.col("event_type").alias("human_or_machine"),
    )
    return adapters.adapt("chartqa", source).select("id", "image", "question", "answer", "answer_type", "task_type", "metadata", "supervision")


@query("adapt_structure", f"SELECT 'plotqa_structure:' || sample_id AS id, '{adapters.STRUCTURE_QUESTION}' AS question, gold AS answer, 'structure' AS answer_type, 'structure_extraction' AS task_type FROM ({views.STRUCTURE}) s")
def adapt_structure(spark, d):
    source = views.structure(spark, d).select(F.col("sample_id").alias("source_index"), F.lit("i").alias("image"), F.col("gold").alias("text"))
    return adapters.adapt("plotqa_structure", source).select("id", "question", "answer", "answer_type", "task_type")


_PRICES = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'What is the difference in price?' WHEN 1 THEN 'What is the maximum price?' ELSE 'How many units are shown?' END AS question,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS answer FROM part"""


@query(
    "adapt_plotqa",
    f"""SELECT 'plotqa_qa:' || CASE WHEN p_partkey % 2 = 0 THEN 'own' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id, question, answer, answer_type, task_type, 'p' AS image,
  {sql.answer_mode("question", "answer_type", "task_type")} AS answer_mode FROM (SELECT *, {sql.answer_type("answer")} AS answer_type, {sql.plot_task_type("question")} AS task_type FROM ({_PRICES}) p) q""",
)
def adapt_plotqa(spark, d):
    """Fields under several names, the id missing in every other row, an empty image before a named one."""
    asked = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'What is the difference in price?' WHEN 1 THEN 'What is the maximum price?' ELSE 'How many units are shown?' END")
    source = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("own"), "p_partkey")).alias("id"),
        F.col("p_partkey").alias("source_index"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("  "), asked)).alias("question"),
        F.when(F.col("p_partkey") % 3 == 0, asked).alias("prompt"),
        F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("label"),
        F.lit("").alias("image"),
        F.lit("p").alias("image_path"),
    )
    found = adapters.adapt("plotqa_qa", source)
    return found.select("id", "question", "answer", "answer_type", "task_type", "image", F.get_json_object("metadata", "$.plotqa_answer_mode").alias("answer_mode"))


@query(
    "adapt_chartbench",
    f"""SELECT 'chartbench:' || conv_id || ':' || pos AS id, question, answer, {sql.answer_type("answer")} AS answer_type, 'bar' AS chart_type, 'talk' AS task_type,
  CASE WHEN conv_id % 2 = 0 THEN 'data/train.zip' ELSE 'data/test.zip' END AS image_archive FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, question NULLS FIRST, answer NULLS FIRST) - 1 AS pos FROM ({views.PAIRS}) p) q""",
)
def adapt_chartbench(spark, d):
    talk = F.sort_array(F.collect_list(F.struct("turn", F.col("question").alias("query"), F.col("answer").alias("label"))))
    source = views.pairs(spark, d).groupBy("conv_id").agg(talk.alias("conversation"))
    source = source.select(
        F.col("conv_id").alias("id"),
        F.when(F.col("conv_id") % 2 == 0, "./train/a.png").otherwise("./test/a.png").alias("image"),
        F.struct(F.lit("bar").alias("chart"), F.lit("talk").alias("task")).alias("type"),
        "conversation",
    )
    found = adapters.adapt("chartbench", source)
    return found.select("id", "question", "answer", "answer_type", "chart_type", "task_type", F.get_json_object("metadata", "$.image_archive").alias("image_archive"))


@query(
    "adapt_mmc",
    """SELECT 'mmc_benchmark:order' || o_orderkey || ':' || substr(sha1(question), 1, 12) AS id, 'order' || o_orderkey AS image, question, o_orderpriority AS answer,
  CASE WHEN o_orderkey % 3 = 0 THEN 'multiple_choice' ELSE 'text' END AS answer_type, 'task ' || o_orderstatus AS task_type
FROM (SELECT *, 'Which priority applies to order ' || o_orderkey || '?' AS question FROM orders) o""",
)
def adapt_mmc(spark, d):
    asked = F.concat(F.lit("Which priority applies to order "), "o_orderkey", F.lit("?"))
    source = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, asked).otherwise("").alias("instruction"),
        F.when(F.col("o_orderkey") % 2 != 0, asked).alias("question"),
        F.lit("").alias("label"),
        F.col("o_orderpriority").alias("answer"),
        F.when(F.col("o_orderkey") % 3 == 0, '["1-URGENT","2-HIGH"]').when(F.col("o_orderkey") % 3 == 1, "").alias("options"),
        F.concat(F.lit("order"), "o_orderkey").alias("image_id"),
        F.concat(F.lit("task "), "o_orderstatus").alias("task"),
    )
    return adapters.adapt("mmc_benchmark", source).select("id", "image", "question", "answer", "answer_type", "task_type")


# --- prepared rows and requests

_BUILT = f"""SELECT conv_id || ':' || turn AS sample_id, turn, question, answer, CASE WHEN turn % 4 = 0 THEN 'images/p.png' END AS image_ref, CASE WHEN turn % 4 = 0 THEN 'abc' END AS image_sha256,
  {sql.answer_type("answer")} AS answer_type FROM ({views.PAIRS}) p"""
_PROMPT = "CASE answer_type WHEN 'numeric' THEN 'Give a number.' ELSE 'Give an answer.' END"


def _prompt():
    return builders.prompt_for("task_type", "answer_type", {"arithmetic": "Compute."}, {"numeric": "Give a number."}, "Give an answer.")


@query(
    "prepared_sample",
    f"SELECT sample_id, question, answer, '/img/' || sample_id AS imgname, {_PROMPT} AS system_prompt, image_ref, image_sha256, 'pairs' AS meta_dataset, CAST(turn AS VARCHAR) AS meta_turn, sample_id AS meta_id FROM ({_BUILT}) b",
)
def prepared_sample(spark, d):
    """The samples' own metadata has a ``dataset`` that the fixed one wins over."""
    rows_ = _built(spark, d).withColumn("image_path", F.concat(F.lit("/img/"), "id"))
    rows_ = rows_.withColumn("metadata", builders.entries(turn=F.col("turn"), dataset="overlaid"))
    made = builders.prepared(rows_, _prompt())
    m = lambda k, name: F.element_at("metadata", k).alias(name)
    return made.select("sample_id", "question", "answer", "imgname", "system_prompt", *(m(k, k) for k in ("image_ref", "image_sha256")), m("dataset", "meta_dataset"), m("turn", "meta_turn"), m("sample_id", "meta_id"))


@query("inference_request", f"SELECT sample_id, question AS prompt, 'p.png' AS image, {_PROMPT} AS system_prompt, 'pairs' AS dataset, answer_type FROM ({_BUILT}) b")
def inference_request(spark, d):
    made = builders.requests(_built(spark, d), _prompt())
    return made.select("sample_id", "prompt", "image", "system_prompt", F.element_at("metadata", "dataset").alias("dataset"), F.element_at("metadata", "answer_type").alias("answer_type"))


@query("stage_two_input", f"SELECT sample_id, 'Evaluate this claim: ' || question AS input FROM ({_BUILT}) b")
def stage_two_input(spark, d):
    return _built(spark, d).select(F.col("id").alias("sample_id"), builders.trained_input(2, "question", "question").alias("input"))


# --- predicates and small functions

@query(
    "numeric_predicates",
    f"SELECT sample_id, ({sql.parse_float("rtrim(rtrim(replace(" + sql.strip('prediction') + ", ',', ''), '%'), '.')")}) IS NOT NULL AS numeric FROM ({views.QA}) q",
)
def numeric_predicates(spark, d):
    return views.qa(spark, d).select("sample_id", V.looks_numeric("prediction").alias("numeric"))


@query(
    "safe_names",
    """SELECT o_orderkey, CASE WHEN safe = '' THEN 'batch' ELSE safe END AS safe_name FROM (
  SELECT o_orderkey, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '..//' ELSE ' order: ' || o_orderkey || ' / ' || o_orderpriority || '.' END AS name FROM orders) o) s""",
)
def safe_names(spark, d):
    name = F.when(F.col("o_orderkey") % 5 == 0, "..//").otherwise(F.concat(F.lit(" order: "), "o_orderkey", F.lit(" / "), "o_orderpriority", F.lit(".")))
    return table(spark, d, "orders").select("o_orderkey", X.safe_name(name).alias("safe_name"))


@query(
    "latency_from_metadata",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN event_id + 0.5::DOUBLE END AS latency_ms, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS kind FROM events""",
)
def latency_from_metadata(spark, d):
    """Metadata as JSON text: a whole number, a fraction, a quoted text, or none at all."""
    given = F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 1, F.concat("event_id", F.lit(".5"))).otherwise(F.lit('"fast"'))
    text = F.concat(F.lit('{"latency_ms": '), given, F.lit(', "kind": "'), "event_type", F.lit('"}'))
    rows_ = table(spark, d, "events").withColumn("metadata", F.when(F.col("event_id") % 4 != 3, text))
    return rows_.select("event_id", X.latency_ms(X.metadata_value("metadata", "latency_ms")).alias("latency_ms"), X.metadata_value("metadata", "kind").alias("kind"))


@query("split_aliases", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'train' ELSE 'other' END AS plotqa, CASE n_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'other' END AS chartqa FROM nation")
def split_aliases(spark, d):
    asked = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'other' END")
    return table(spark, d, "nation").select("n_nationkey", rows.split_column("plotqa_qa", asked).alias("plotqa"), rows.split_column("chartqa", asked).alias("chartqa"))


# --- reports by run


@query(
    "bucket_order",
    f"""SELECT value, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM (SELECT answer_type AS value, count(*) AS n, min(sample_id) AS first FROM ({_SCORED}) s GROUP BY 1) c""",
)
def bucket_order(spark, d):
    return reports.most_common(_scored(spark, d).withColumnRenamed("answer_type", "value"), "value", "sample_id").withColumn("place", F.col("place").cast("long"))


_RUN = "CASE sample_id % 2 WHEN 0 THEN 'base' ELSE 'tuned' END"


@query(
    "run_breakdown",
    f"""SELECT {_RUN} AS run, count(*) AS total, avg(CASE WHEN sample_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS prediction_parse, avg(CASE WHEN sample_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS series_f1,
  avg(CASE WHEN sample_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS model_quality_score FROM (SELECT DISTINCT o_custkey AS sample_id FROM orders) s GROUP BY 1""",
)
def run_breakdown(spark, d):
    """Predictions are the gold text, a text without tags, or missing."""
    answer = F.when(F.col("sample_id") % 3 == 0, F.col("gold")).when(F.col("sample_id") % 3 == 1, "no tags").otherwise("")
    scored = scoring.score_structures(views.structure(spark, d).withColumn("prediction", answer))
    return reports.breakdown(scored.withColumn("run", F.expr(_RUN)), "run").select("run", "total", "prediction_parse", "series_f1", "model_quality_score")


@query("model_order", "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'BRAZIL' THEN 2 ELSE 3 END, n_name) AS BIGINT) AS place FROM nation")
def model_order(spark, d):
    from pyspark.sql import Window

    keys_ = reports.model_order("n_name", ("FRANCE", "BRAZIL"))  # a report's rows, few
    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(*keys_)).cast("long").alias("place"))


@query("metric_log", "SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, unnest(['eval_loss', 'step_time']) AS metric, unnest([l_discount, l_tax]) AS value FROM lineitem) m")
def metric_log(spark, d):
    log = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_discount").cast("double").alias("eval_loss"), F.col("l_tax").cast("double").alias("step_time"))
    return reports.metric_rows(log, "at").select("at.*", "metric", "value")


# --- records that are written and read again

_RECORD = "schema_version string, record_key string, input string, output string, perturbed_answer string, gold_answer string, answer string, gold_output string"
_ROUTES = f"""SELECT sample_id AS record_key, question, answer, CASE turn % 3 WHEN 0 THEN 'contrastive' ELSE 'gold' END AS route, CASE WHEN turn % 2 = 0 THEN 'chartqa' ELSE 'figureqa' END AS dataset
FROM ({_BUILT}) b WHERE answer IS NOT NULL AND question IS NOT NULL"""


@query(
    "mixture_files",
    f"""SELECT record_key, dataset, CASE dataset WHEN 'chartqa' THEN 0 ELSE 1 END AS dataset_order, route,
  CASE route WHEN 'gold' THEN question ELSE question || chr(10) || 'Proposed answer: ' || answer || '!' || chr(10) || 'Is the proposed answer faithful to the chart?' END AS input,
  CASE route WHEN 'gold' THEN answer ELSE '<verdict>FAIL</verdict>' || chr(10) || '<correct_answer>' || answer || '</correct_answer>' || chr(10) || '<correction>' || chr(10) || answer || chr(10) || '</correction>' END AS output FROM ({_ROUTES}) r""",
)
def mixture_files(spark, d):
    """Three kinds of records of two datasets go to their files; gold and contrastive ones
    come back in the fixed order of datasets, the latter as critiques."""
    root, names = folder(spark, "records"), ("chartqa", "figureqa")
    rows_ = _built(spark, d).filter("answer is not null and question is not null").select(
        F.lit(records.SCHEMA_VERSION).alias("schema_version"),
        F.col("id").alias("record_key"),
        F.col("question").alias("input"),
        F.col("answer").alias("output"),
        F.concat("answer", F.lit("!")).alias("perturbed_answer"),
        F.col("answer").alias("gold_answer"),
        "answer",
        F.col("answer").alias("gold_output"),
        F.when(F.col("turn") % 3 == 0, "contrastive").otherwise("gold").alias("route"),
        F.when(F.col("turn") % 2 == 0, "chartqa").otherwise("figureqa").alias("dataset"),
    )
    for name in names:
        records.write_routed(rows_.filter(F.col("dataset") == name).drop("dataset"), records.record_paths(root, name, "train"))
    gold = records.load_gold(spark, root, names, "train", _RECORD).withColumn("route", F.lit("gold"))
    both = gold.unionByName(records.load_contrastive(spark, root, names, "train", _RECORD).withColumn("route", F.lit("contrastive")))
    return both.select("record_key", "dataset", "dataset_order", "route", "input", "output")


@query("backfilled_keys", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' || doc_id ELSE sha256(CAST(doc_id AS VARCHAR)) END AS record_key FROM documents")
def backfilled_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own"), "doc_id")).when(F.col("doc_id") % 3 == 1, "").alias("record_key"))
    return records.backfill(docs, F.sha2(F.col("doc_id").cast("string"), 256))


@query("failure_files", f"SELECT sample_id, dataset, gold, prediction, 'wrong' AS error_type, 'real' AS tag FROM ({_SCORED}) s WHERE NOT correct")
def failure_files(spark, d):
    """Wrong answers go out as a batch of failures and are read again."""
    none = F.lit(None).cast("string")
    wrong = _scored(spark, d).filter(~F.col("correct")).select(
        F.col("sample_id").alias("id"),
        "dataset",
        none.alias("image"),
        "question",
        F.col("gold").alias("answer"),
        "answer_type",
        F.lit("qa").alias("supervision"),
        none.alias("chart_type"),
        none.alias("task_type"),
        F.lit("real").alias("tag"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        "prediction",
    )
    at = records.write_failures(records.failures(wrong, F.lit("wrong")), folder(spark, "failures"), "batch")
    return records.read_failures(spark, at).select("sample_id", "dataset", "gold", "prediction", "error_type", F.element_at("metadata", "tag").alias("tag"))


@query(
    "bench_lines",
    f"""SELECT sample_id, '{{"correct": ' || CASE WHEN correct THEN 'true' WHEN NOT correct THEN 'false' ELSE 'null' END || ', "gold": ' || CAST(to_json(gold) AS VARCHAR) || ', "sample_id": "' || sample_id || '"}}' AS line FROM ({_SCORED}) s""",
)
def bench_lines(spark, d):
    made = _scored(spark, d).select("sample_id", "gold", "correct")
    return made.select("sample_id", records.bench_line(made).alias("line"))


# --- archives: members of a zip and a tar, looked up by name, without their first folder, or by their end

_MEMBERS = """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'zip' ELSE 'tar' END AS kind, 'charts/' || lower(replace(n_name, ' ', '_')) || '.png' AS member, sha256(n_name) AS sha256 FROM nation"""


@query("archive_members", _MEMBERS)
def archive_members(spark, d):
    """Archives are made of the names of nations, a fixed small table; each member's
    reference is whole, lacks its folder, or is looked up behind ``./``."""
    nations = [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    root, zipped, tarred = folder(spark, "archives"), io.BytesIO(), io.BytesIO()
    member = lambda name: f"charts/{name.lower().replace(' ', '_')}.png"
    with zipfile.ZipFile(zipped, "w") as z, tarfile.open(fileobj=tarred, mode="w:gz") as t:
        for key, name in nations:
            if key % 2 == 0:
                z.writestr(member(name), name)
            else:
                info = tarfile.TarInfo(member(name))
                info.size = len(name.encode())
                t.addfile(info, io.BytesIO(name.encode()))
    paths = {"zip": f"{root}/a.zip", "tar": f"{root}/b.tar.gz"}
    records.write_text(spark, paths["zip"], zipped.getvalue())
    records.write_text(spark, paths["tar"], tarred.getvalue())
    found = images.read_archives(spark, list(paths.values())).withColumn("kind", F.when(F.col("archive").endswith(".zip"), "zip").otherwise("tar"))
    whole = F.concat(F.lit("charts/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".png"))
    ref = F.when(F.col("n_nationkey") % 3 == 0, whole).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("./"), whole)).otherwise(F.concat(F.lit("data/"), whole))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "zip").otherwise("tar").alias("archive"), ref.alias("image_ref"))
    members = found.select(F.col("kind").alias("archive"), "member", F.sha2("content", 256).alias("sha256"))
    named = images.find_members(asked, members)
    return named.join(members, ["archive", "member"]).select("id", F.col("archive").alias("kind"), "member", "sha256")


# --- streams


@query("stream_dedup", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND event_id % 7 <> 0")
def stream_dedup(spark, d):
    """The events come twice, in files of their own: what was written the first time is
    left out the second, what was skipped is tried again and skipped again."""
    root = folder(spark, "stream")
    events = table(spark, d, "events").select("event_id", "event_type")
    for _ in range(2):
        events.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        dedup.run(source, gold=f"{root}/gold", checkpoint=f"{root}/checkpoint", key="event_id", written=(F.col("event_type") != "error") & (F.col("event_id") % 7 != 0))
    return spark.read.parquet(f"{root}/gold").select("event_id", "event_type")


# --- perturbed fractions, told by the binary value


@query("four_digits", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.4g', l_extendedprice / 7) AS text FROM lineitem")
def four_digits(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", perturb.four_digits(F.col("l_extendedprice") / 7).alias("text"))
