"""Question-answering views over the driver's tables, in Spark and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS {text})"


def _qa(text: str, names: dict[str, str]) -> str:
    m = lambda x: _MONEY.format(x, text=text)
    return f"""
SELECT concat('chartqa:', event_id) AS sample_id, 'chartqa' AS dataset,
  concat('What is the value for event ', event_id, '?') AS question, {m("value")} AS gold, 'numeric' AS answer_type,
  CASE event_id % 4 WHEN 0 THEN {m("value")} WHEN 1 THEN concat({m("value")}, '0%') WHEN 2 THEN {m("value + 1")} ELSE 'about five' END AS prediction,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) END AS latency_ms
FROM {names["events"]}
UNION ALL
SELECT concat('figureqa:', doc_id), 'figureqa', concat('Is document ', doc_id, ' of high quality?'),
  CASE quality WHEN 1 THEN 'Yes.' ELSE 'No.' END, 'yes_no',
  CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN ' False ' ELSE 'maybe' END, CAST(doc_id % 20 AS DOUBLE)
FROM {names["labels"]}
UNION ALL
SELECT concat('plotqa_qa:', p_partkey), 'plotqa_qa',
  CASE p_partkey % 3 WHEN 0 THEN 'What is the difference in price?' WHEN 1 THEN 'What is the maximum price?' ELSE 'How many units are shown?' END,
  {m("p_retailprice")}, 'numeric',
  CASE p_partkey % 3 WHEN 0 THEN concat({m("p_retailprice")}, '00') WHEN 1 THEN CAST(p_size AS {text}) ELSE 'n/a' END, NULL
FROM {names["part"]}
UNION ALL
SELECT concat('mmc_benchmark:', o_orderkey), 'mmc_benchmark', concat('Which priority applies to order ', o_orderkey, '?'),
  o_orderpriority, 'multiple_choice',
  CASE o_orderkey % 2 WHEN 0 THEN concat('  ', lower(o_orderpriority), '. ') ELSE '1-URGENT' END, CAST(10.0 AS DOUBLE)
FROM {names["orders"]}"""


def _tagged(names: dict[str, str]) -> str:
    return f"""
SELECT e.event_id AS sample_id, p.provider, p.ord,
  CASE WHEN (e.event_id + p.ord) % 11 = 0 THEN NULL
       WHEN (e.event_id + p.ord) % 7 = 0 THEN '<perceive>bar</perceive><extract></extract><answer>x</answer>'
       ELSE concat('<perceive>bar chart</perceive><extract>', e.event_type, ' is ', e.user_id % 10, ' in 2014 and 3.5 in 2015</extract><ANSWER> ',
            CASE WHEN (e.event_id + 2 * p.ord) % 3 = 0 THEN upper(e.event_type) WHEN p.ord = 1 AND e.event_id % 5 = 0 THEN 'other' ELSE e.event_type END, ' </ANSWER>') END AS text,
  CASE WHEN (e.event_id + p.ord) % 11 = 0 THEN 'missing provider batch result' END AS error, e.event_type, e.user_id
FROM {names["events"]} e JOIN (SELECT 'a' AS provider, 0 AS ord UNION ALL SELECT 'b', 1) p ON true"""


def _structure(text: str, joined: str, names: dict[str, str]) -> str:
    j = lambda x: joined.format(f"CAST({x} AS {text})")
    full = f"{j('yr')}, '</s_x><s_y>', {j('mx')}"
    return f"""
SELECT o_custkey AS sample_id,
  concat('<s><s_x>', {full}, '</s_y><s_name>Cust ', o_custkey, '</s_name></s>') AS gold,
  CASE o_custkey % 5
    WHEN 0 THEN concat('<s><s_name>cust ', o_custkey, '</s_name><s_x>', {full}, '</s_y></s>')
    WHEN 1 THEN concat('<s><s_x>', {j("yr")}, '</s_x><s_y>', {j("CAST(mx * 2 AS DECIMAL(18,2))")}, '</s_y><s_name>Other</s_name></s>')
    WHEN 2 THEN '<s><s_x>x1<sep/>x2</s_x><s_y>y1<sep/>y2</s_y><s_name>Cust</s_name></s>'
    WHEN 3 THEN 'no tags here' ELSE '' END AS prediction
FROM (SELECT o_custkey, year(o_orderdate) AS yr, CAST(max(o_totalprice) AS DECIMAL(18,2)) AS mx FROM {names["orders"]} GROUP BY 1, 2) g
GROUP BY o_custkey"""


def _pairs(names: dict[str, str]) -> str:
    return f"""
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM {names["conversations"]} u JOIN {names["conversations"]} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def _spark(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], build) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in tables}
    return spark.sql(build({t: "{" + t + "}" for t in tables}), **frames)


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, ("events", "labels", "part", "orders"), lambda n: _qa("STRING", n))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, ("events",), _tagged)


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, ("orders",), lambda n: _structure("STRING", "listagg({}, '<sep/>') WITHIN GROUP (ORDER BY yr)", n))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, ("conversations",), _pairs)


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key


QA = _qa("VARCHAR", _Same())
TAGGED = _tagged(_Same())
STRUCTURE = _structure("VARCHAR", "string_agg({}, '<sep/>' ORDER BY yr)", _Same())
PAIRS = _pairs(_Same())
