"""Operators, sources and sinks on small tables."""

import datetime as dt
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.operators import adapters, builders, consensus, mixture, reports, rows, scoring
from gristmill.sources import catalog, config, images, records
from gristmill.streaming import dedup, log


def test_agreement_is_plurality_of_two(spark):
    ok = "<perceive>p</perceive><extract>e</extract><answer>{}</answer>"
    data = [(1, "a", 0, ok.format("Five  x")), (1, "b", 1, ok.format("five x")), (2, "a", 0, ok.format("7.30")), (2, "b", 1, ok.format("7.3")), (3, "a", 0, "bad"), (3, "b", 1, ok.format("1"))]
    data += [(4, "a", 0, ok.format("q")), (4, "b", 1, ok.format("r")), (4, "c", 2, ok.format("R")), (4, "d", 3, ok.format("Q"))]
    voted = consensus.votes(spark.createDataFrame(data, "sample_id long, provider string, ord int, text string"))
    agreed = consensus.agreed(voted)
    assert {r.sample_id: r.agreed_output for r in agreed.collect()} == {1: "Five  x", 4: "q"}
    assert {r.sample_id: r.dissenters for r in consensus.dissenters(voted, agreed).collect()} == {1: [], 4: ["b", "c"]}
    assert {(r.sample_id, r.norm, r.n) for r in consensus.top_votes(voted).collect()} == {(1, "five x", 2), (2, "7.30", 1), (3, "1", 1), (4, "q", 2)}


def test_pivots_and_filled_responses(spark):
    items = spark.createDataFrame([("x",), ("y",)], "custom_id string")
    given = spark.createDataFrame([("x", "text", None)], "custom_id string, text string, error string")
    assert {(r.custom_id, r.error) for r in consensus.fill_missing(items, given).collect()} == {("x", None), ("y", consensus.MISSING)}
    long = spark.createDataFrame([(1, "a", "t", None), (1, "b", None, "e")], "sample_id long, provider string, text string, error string")
    r = consensus.pivot_texts(long).first()
    assert r.texts == {"a": "t"} and r.errors == {"b": "e"}


def test_mixture_cut_is_binary_floating_point(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("record_key"), F.lit("chartqa").alias("dataset"))
    for val, train in ((0.9, int(10 * (1 - 0.9))), (0.05, 9), (0.0, 10)):
        n = mixture.split(df, key="record_key", dataset="dataset", val_split=val).filter("split = 'train'").count()
        assert n == train
    assert mixture.split(df, key="record_key", dataset="dataset", cap=4, val_split=0.5).groupBy("split").count().orderBy("split").collect()[0]["count"] == 2


def test_contrastive_last_wins(spark):
    mix = spark.createDataFrame([("k", "train"), ("m", "val")], "record_key string, split string")
    wrong = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("z", 3, "lost")], "record_key string, ord int, output string")
    got = mixture.attach_contrastive(mix, wrong, order="ord").filter("output is not null").collect()
    assert [(r.record_key, r.split, r.output) for r in got] == [("k", "train", "new")]


def test_offsets_count_source_rows(spark):
    df = spark.createDataFrame([(i, "img", [("q1", "yes"), ("q2", "3")]) for i in range(5)], "source_index long, image string, qa array<struct<question:string,answer:string>>")
    got = adapters.figureqa(rows.source_slice(df, "source_index", 2, 2)).collect()
    assert sorted(r.id for r in got) == [f"figureqa:{i}:{j}" for i in (2, 3) for j in (0, 1)]
    assert {r.answer_type for r in got} == {"yes_no", "numeric"}


def test_adapters_share_the_core_schema(spark):
    frames = {
        "chartqa": spark.createDataFrame([("How many?", ["3"], "i", "human")], "query string, label array<string>, image string, human_or_machine string"),
        "plotqa_structure": spark.createDataFrame([(0, "i", "<s></s>")], "source_index long, image string, text string"),
        "plotqa_qa": spark.createDataFrame([(4, None, " What is the sum? ", "7", "p")], "source_index long, question string, user string, label string, img string"),
        "chartbench": spark.createDataFrame([("c", "/train/x.png", ("bar", "t"), [("q", "yes")])], "id string, image string, type struct<chart:string,task:string>, conversation array<struct<query:string,label:string>>"),
        "mmc_benchmark": spark.createDataFrame([("", "Which?", "B", '["A","B"]', "im")], "instruction string, question string, label string, options string, image_id string"),
    }
    got = {k: adapters.adapt(k, df).first() for k, df in frames.items()}
    assert all(tuple(r.asDict()) == adapters.CORE for r in got.values())
    assert got["plotqa_qa"].id == "plotqa_qa:4" and got["plotqa_qa"].question == "What is the sum?" and got["plotqa_qa"].image == "p"
    assert json.loads(got["plotqa_qa"].metadata)["plotqa_answer_mode"] == "computed_oov"
    assert json.loads(got["chartbench"].metadata)["image_archive"] == "data/train.zip" and got["chartbench"].task_type == "t"
    assert got["mmc_benchmark"].answer_type == "multiple_choice" and got["mmc_benchmark"].question == "Which?"
    with pytest.raises(KeyError):
        adapters.adapt("other", frames["chartqa"])
    with pytest.raises(Exception, match="question and an answer"):
        adapters.plot_qa(spark.createDataFrame([(1, None, "a")], "source_index long, question string, answer string")).collect()


def test_split_aliases(spark):
    assert rows.resolve_split("plotqa_qa", "test") == "train" and rows.resolve_split("chartqa", "validation") == "val" and rows.resolve_split("figureqa", "odd") == "odd"
    got = spark.range(1).select(rows.split_column("mmc_benchmark", F.lit("train")), rows.split_column("mmc_benchmark", F.lit("x"))).first()
    assert tuple(got) == ("test", "x")
    assert catalog.card_table(spark).count() == 6


def test_catalog_scan(spark, tmp_path):
    spark.createDataFrame([("Is it?", ["Yes"], "i", "human")], "query string, label array<string>, image string, human_or_machine string").write.parquet(f"{tmp_path}/chartqa/val")
    assert catalog.samples(spark, str(tmp_path), "chartqa", "validation").first().answer_type == "yes_no"


def test_sample_limit():
    assert rows.sample_limit(5) == 5 and rows.sample_limit(all_samples=True) is None
    for bad in ({}, {"samples": 3, "all_samples": True}, {"samples": 0}):
        with pytest.raises(ValueError):
            rows.sample_limit(**bad)


def test_ranks_and_batches(spark):
    df = spark.createDataFrame([(i * 40_000,) for i in range(20)], "k long")
    assert [r.batch_id for r in rows.batch_ids(df, "k", 8).orderBy("k").collect()] == [0] * 8 + [1] * 8 + [2] * 4
    ids = [r.k for r in rows.shuffled(df, "k", 3).collect()]
    assert ids == [r.k for r in rows.shuffled(df, "k", 3).collect()] != sorted(ids)


def test_empty_summary(spark):
    empty = spark.createDataFrame([], "correct boolean, score double, latency_ms double")
    r = scoring.summarize(empty).first()
    assert (r.total, r.correct, r.accuracy, r.average_score, r.average_latency_ms) == (0, 0, 0.0, 0.0, None)


def test_score_dispatch(spark):
    df = spark.createDataFrame([("plotqa_qa", "numeric", "7.3", "7.30"), ("chartqa", "numeric", "7.3", "7.30"), ("plotqa_structure", "structure", "x", "x"), (None, "text", "a", "b")], "dataset string, answer_type string, gold string, prediction string")
    assert sorted((r.dataset or "", r.correct) for r in scoring.score_predictions(df).collect()) == [("", False), ("chartqa", True), ("plotqa_qa", True), ("plotqa_structure", True)]


def test_report_means(spark):
    df = spark.createDataFrame([(1.0, True), (None, None)], "x double, f boolean")
    r = df.select(reports.mean_or_zero("x"), F.avg("x"), reports.flag_rate("f")).first()
    assert tuple(r) == (0.5, 1.0, 0.5)


def test_jsonl_and_guard(spark, tmp_path):
    df = spark.createDataFrame([("k1", "sft-train-data-v1", "ü"), ("k2", "old", None)], "record_key string, schema_version string, text string")
    path = f"{tmp_path}/out.jsonl"
    records.write_jsonl(df, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines[1] == '{"record_key":"k2","schema_version":"old","text":null}' and "ü" in lines[0]
    back = records.read_jsonl(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))
    assert records.bad_keys(back) == ["k2"]
    with pytest.raises(Exception, match="k2"):
        records.guarded(back).collect()
    assert records.guarded(back.filter("record_key = 'k1'")).count() == 1


def test_routes_and_manifest(spark, tmp_path):
    paths = records.record_paths(str(tmp_path), "d", "train")
    df = spark.createDataFrame([("a", "gold"), ("b", "skipped"), ("c", "gold"), ("d", "contrastive")], "record_key string, route string")
    records.write_routed(df, paths)
    assert [spark.read.json(paths[k]).count() for k in ("gold", "contrastive", "skipped")] == [2, 1, 1]
    records.write_manifest(spark, paths["manifest"], records.manifest("d", "train", {}, {"total": 4}, paths, str(tmp_path)))
    told = json.loads((tmp_path / "d_train_manifest.json").read_text())
    assert told["paths"]["gold"] == "d_train.jsonl" and told["stats"] == {"total": 4}


def test_failures_go_out_and_come_back(spark, tmp_path):
    schema = "id string, dataset string, image string, question string, answer string, answer_type string, supervision string, chart_type string, task_type string, tag string, metadata map<string,string>, prediction string"
    df = spark.createDataFrame([("s", "chartqa", "i.png", "q", "g", "text", "qa", None, None, "real", {"image_ref": "r.png", "k": "v"}, "p")], schema)
    folder = records.write_failures(records.failures(df, F.lit("wrong")), str(tmp_path), "slice", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert folder.endswith("slice_20240102T030405Z")
    back = records.replay(records.read_failures(spark, folder)).first()
    assert (back.id, back.answer, back.tag, back.image) == ("s", "g", "real", "r.png")
    assert back.metadata == {"image_ref": "r.png", "k": "v", "tag": "real", "prediction": "p", "error_type": "wrong"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        records.write_failures(records.failures(df), str(tmp_path), "slice", dt.datetime(2024, 1, 2, 3, 4, 5))


def test_labelled_inputs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"dataset": "d", "correct": true}\n\n{"dataset": "d", "correct": false}\n')
    got = records.read_labelled(spark, [f" base :{tmp_path}/a.jsonl"], "dataset string, correct boolean")
    assert {r.label for r in got.collect()} == {"base"} and got.count() == 2
    with pytest.raises(ValueError):
        records.read_labelled(spark, ["nolabel"], "dataset string")


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/test/area/chart_0/image.png", b"one")
        z.writestr("data/test/bar/chart_1/image.png", b"two")
        z.writestr("deep/only.png", b"three")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("image_benchmark-4000.png")
        info.size = 4
        t.addfile(info, io.BytesIO(b"four"))
    found = images.read_archives(spark, [f"{tmp_path}/a.zip", f"{tmp_path}/b.tar.gz"]).collect()
    assert {bytes(r.content) for r in found} == {b"one", b"two", b"three", b"four"}
    names = spark.createDataFrame([("a.zip", "data/test/area/chart_0/image.png"), ("a.zip", "data/test/bar/chart_1/image.png"), ("a.zip", "deep/only.png")], "archive string, member string")
    asked = spark.createDataFrame([(1, "a.zip", "./data/test/area/chart_0/image.png"), (2, "a.zip", "x/data/test/bar/chart_1/image.png"), (3, "a.zip", "image.png"), (4, "a.zip", "nly.png"), (5, "a.zip", "none.png")], "id int, archive string, image_ref string")
    got = {r.id: r.member for r in images.find_members(asked, names).collect()}
    assert got == {1: "data/test/area/chart_0/image.png", 2: "data/test/bar/chart_1/image.png", 3: None, 4: "deep/only.png", 5: None}
    with pytest.raises(ValueError):
        images.archive_kind("a.rar")


def test_extracted_lookup_and_resolution(spark):
    asked = spark.createDataFrame([(1, "d", "./p/i.png", "./p/i.png", None, None), (2, "d", "gone.png", "gone.png", "z.zip", "gone.png"), (3, "d", "plain", None, None, None), (4, "d", "lost", "lost", "z.zip", None)], "id int, dataset string, image string, image_ref string, archive string, member string")
    listing = spark.createDataFrame([("root/d/i.png",), ("root/p/i.png",)], "path string")
    got = {r.id: (r.image_path, r.image_error) for r in images.resolve(images.find_extracted(asked, listing, "root")).collect()}
    assert got == {1: ("root/p/i.png", None), 2: ("z.zip!/gone.png", None), 3: ("plain", None), 4: (None, "Missing image: lost")}


def test_image_store_writes_each_content_once(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, bytearray(b"y"))], "id int, content binary")
    stored = images.stored(df)
    assert [r.id for r in images.first_of_each(stored, "id").orderBy("id").collect()] == [1, 3]
    images.write_store(stored, str(tmp_path))
    images.write_store(stored, str(tmp_path))
    assert len(list((tmp_path / "images").iterdir())) == 2
    with pytest.raises(Exception, match="output root"):
        images.write_store(stored.withColumn("ref", F.lit("../../out.png")), str(tmp_path))


def test_stream_dedup_retries_skipped_and_drops_written(spark, tmp_path):
    def feed(name, data):
        spark.createDataFrame(data, "record_key string, good boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    def run():
        source = spark.readStream.schema("record_key string, good boolean").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return dedup.run(source, gold=f"{tmp_path}/gold", checkpoint=f"{tmp_path}/check", key="record_key", written=F.col("good"))

    feed("a", [("x", True), ("x", True), ("y", False)])
    assert run() == {"total": 3, "written": 2, "skipped": 1, "deduped": 0}
    feed("b", [("x", True), ("y", True)])
    assert run() == {"total": 2, "written": 1, "skipped": 0, "deduped": 1}
    assert sorted(r.record_key for r in spark.read.parquet(f"{tmp_path}/gold").collect()) == ["x", "x", "y"]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_stream_broadcasts_no_keys(spark, tmp_path, kind):
    """Keys that were written don't go through the driver, files don't follow the shuffle's partitions."""
    frame = lambda low, high: spark.range(low, high).selectExpr(f"CAST(CASE WHEN id % 5 > 0 THEN id END AS {kind}) AS k", "id % 3 > 0 AS good")

    def run(low, high):
        frame(low, high).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(f"k {kind}, good boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return dedup.run(source, gold=f"{tmp_path}/gold", checkpoint=f"{tmp_path}/check", key="k", written=F.col("good"))

    own = {"spark.sql.maxBroadcastTableSize": "1k", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in (*own, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert run(0, 6_000) == {"total": 6_000, "written": 4_000, "skipped": 2_000, "deduped": 0}
        assert run(1_500, 7_500) == {"total": 6_000, "written": 1_000 + 600, "skipped": 2_000, "deduped": 2_400}
        assert run(0, 60) == {"total": 60, "written": 8, "skipped": 20, "deduped": 32}
    finally:
        for k in own:
            spark.conf.set(k, before[k])
    assert {k: spark.conf.get(k) for k in before} == before
    got = spark.read.parquet(f"{tmp_path}/gold").groupBy("k").count()
    assert got.filter("k IS NOT NULL AND count > 1").count() == 0 and got.filter("k IS NULL").first()["count"] == 800 + 800 + 8
    assert len(list((tmp_path / "gold" / "batch=1").glob("*.parquet"))) <= 4


def test_stream_goes_on_after_a_bad_row_and_reports_a_failure(spark, tmp_path):
    schema = "record_key string, image string, good boolean"
    paths = records.record_paths(str(tmp_path), "d", "train")
    report = dedup.manifest_report(spark, "d", "train", {"batch": 2}, paths, str(tmp_path))

    def run(data, written):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        error = F.when(F.col("image").isNull(), "image_prepare_failed")
        return dedup.run(source, gold=f"{tmp_path}/gold", checkpoint=f"{tmp_path}/check", key="record_key", written=written, error=error, skipped=f"{tmp_path}/skipped", report=report)

    told = lambda: json.loads((tmp_path / "d_train_manifest.json").read_text())["stats"]
    stats = run([("x", "i", True), ("y", None, True), ("z", "i", False), (None, "i", None)], F.col("good"))
    assert stats == told() == {"total": 4, "written": 1, "skipped": 3, "deduped": 0}
    left = spark.read.parquet(f"{tmp_path}/skipped").select("record_key", "skip_error").collect()
    assert {tuple(r) for r in left} == {("y", "image_prepare_failed"), ("z", None), (None, None)}
    with pytest.raises(Exception, match="no teacher"):
        run([("v", "i", True)], F.raise_error(F.lit("no teacher")).cast("boolean"))
    assert told() == {"total": 0, "written": 0, "skipped": 0, "deduped": 0}
    assert run([], F.col("good"))["written"] == 1  # the batch that failed runs again
    assert sorted(r.record_key for r in spark.read.parquet(f"{tmp_path}/gold").collect()) == ["v", "x"]


def test_log_lines():
    shown = log.JsonLines()
    record = log.LOGGER.makeRecord("gristmill", 20, "f", 1, "stream_progress", (), None, extra={"fields": {"event": "stream_progress", "rows": 3}})
    assert json.loads(shown.format(record)).items() >= {"level": "INFO", "logger": "gristmill", "event": "stream_progress", "rows": 3}.items()
    plain = log.LOGGER.makeRecord("gristmill", 30, "f", 1, "%s rows", (7,), None)
    assert json.loads(shown.format(plain))["message"] == "7 rows"


def test_prepared_and_requests(spark):
    schema = "id string, dataset string, image string, image_path string, image_ref string, image_sha256 string, question string, answer string, answer_type string, task_type string, chart_type string, metadata map<string,string>"
    df = spark.createDataFrame([("s", "d", "i", "/p", "r", "h", "q", "a", "text", None, None, {"image_ref": "own", "k": "v"}), ("t", "d", "i", "/p", "r", "h", "q", "a", "numeric", "arithmetic", "bar", None)], schema)
    prompt = builders.prompt_for("task_type", "answer_type", {"arithmetic": "compute"}, {"text": "write"}, "answer")
    got = {r.sample_id: r for r in builders.prepared(df, prompt).collect()}
    assert got["s"].metadata == {"k": "v", "dataset": "d", "sample_id": "s", "image_ref": "r", "image_sha256": "h"} and got["s"].system_prompt == "write"
    assert got["t"].system_prompt == "compute" and got["t"].imgname == "/p" and len(got["t"].asDict()) == 10
    asked = {r.sample_id: r for r in builders.requests(df, prompt).collect()}
    assert asked["t"].metadata == {"dataset": "d", "answer_type": "numeric", "chart_type": "bar", "task_type": "arithmetic"}


def test_command_and_config(tmp_path):
    assert builders.command(*range(11))["resume"] == 10
    with pytest.raises(ValueError):
        builders.command(1)
    (tmp_path / "c.toml").write_text("[inference]\nmax_new_tokens = 64\nadapter_path = ''\n")
    got = config.load_settings(tmp_path / "c.toml")
    assert got["inference"]["max_new_tokens"] == 64 and got["inference"]["adapter_path"] is None and got["model"]["path"] == "artifacts/pretrained/tiny"
    assert config.config_hash({"b": {3, 1}, "a": (1,)}) == config.config_hash({"a": [1], "b": [1, 3]})


def test_running_accuracy_of_a_hot_group(spark):
    from pyspark.sql import Window

    df = spark.range(3_000).selectExpr(
        "concat('s', id) AS sample_id",
        "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN concat('g', id % 3) END AS dataset",
        "CASE WHEN id % 7 > 0 THEN id % 3 = 0 END AS correct",
    )
    out = scoring.running_accuracy(df, "sample_id", "dataset")
    w = Window.partitionBy("dataset").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.selectExpr("*", "CAST(correct AS long) AS c").withColumns({"c": F.sum("c").over(w), "n": F.count("*").over(w)})
    key = lambda r: r[0]
    got = sorted(map(tuple, out.select("sample_id", "dataset", "running_correct", "running_total").collect()), key=key)
    assert got == sorted(map(tuple, want.select("sample_id", "dataset", "c", "n").collect()), key=key)
    assert scoring.running_accuracy(df.limit(0), "sample_id", "dataset").count() == 0
