import json

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import readings as stream


def test_labels_and_manifests(spark, tmp_path):
    good = {"source": "a", "reviewed": True, "scale_idx": 0, "value": [[0.5] * 35] * 2, "present": [[1] * 35, [0] * 35]}
    for name, change in (("a", {}), ("b", {"source": "b", "reviewed": False}), ("c", {"source": "c", "value": [[1.0]]})):
        (tmp_path / f"{name}.labels.json").write_text(json.dumps(good | change, indent=1))
    got = files.corpus_labels(spark, str(tmp_path / "*.json"))
    assert [r.source for r in got.collect()] == ["a"]
    days = files.label_days(got).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum("present").alias("p")).collect()
    assert {(r.series, r.n, r.p) for r in days} == {("temp", 35, 35), ("lh", 35, 0)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/manifest.json").write_text(json.dumps({"version": "v1", "files": [{"name": "f", "bytes": 3, "sha256": "x"}], "iforest_score_percentiles": {"p5": -1.0, "p50": 0.0, "p95": 1.0}}))
    m = files.manifests(spark, str(tmp_path / "m")).first()
    assert (m.version, m.files[0].bytes, m.iforest_score_percentiles.p95) == ("v1", 3, 1.0)
    assert files.images(spark, str(tmp_path / "m")).first().bytes > 0


def test_resize_and_table(spark):
    df = spark.createDataFrame([(1, x, y, 10 * x, 0, 7) for x in range(4) for y in range(4)], "image_id long, x int, y int, r int, g int, b int")
    half = {(r.x, r.y): r.r for r in files.resize(df, 0.5).collect()}
    assert half == {(0, 0): 5, (0, 1): 5, (1, 0): 25, (1, 1): 25} or half == {(0, 0): 5, (0, 1): 5, (1, 0): 25, (1, 1): 25}
    double = files.resize(df, 2.0)
    assert double.count() == 64 and double.where("x = 7 and y = 0").first().r == 30
    size = spark.range(1).select(files.work_size(F.lit(600), F.lit(300)).alias("s")).first().s
    assert (size.width, size.height) == (1200, 600)
    cells = spark.createDataFrame([(1, "CD", 2, "7", "text"), (1, "CD", 1, "6", "text")], "image_id long, row_name string, day int, text string, kind string")
    out = json.loads(files.table_json(cells, ("calendar", "CD")).first().json)
    assert [r["name"] for r in out["rows"]] == ["calendar", "CD"] and [c["text"] for c in out["rows"][1]["cells"]] == ["6", "7"]


def test_stream_recomputes_touched_cycles(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        q = stream.start(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()

    put("1.json", [{"cycle_id": c, "day": d, "temp": 36.25, "seen_at": "2024-01-01T00:00:00"} for c in (1, 2) for d in range(1, 11)])
    run()
    put("2.json", [{"cycle_id": 1, "day": d, "temp": 36.75, "seen_at": "2024-01-02T00:00:00"} for d in range(9, 14)])
    run()
    first = {r.cycle_id: r.n_temp_observed for r in spark.read.parquet(str(tmp_path / "out/batch=0")).collect()}
    second = {r.cycle_id: (r.n_temp_observed, r.estimated_ovulation_day) for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()}
    assert first == {1: 10.0, 2: 10.0} and second == {1: (13.0, 8.0)}


def test_watermarked_windows(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/1.json").write_text("\n".join(json.dumps({"cycle_id": i, "day": 1, "temp": 36.5, "seen_at": f"2024-01-01T0{i % 3}:10:00"}) for i in range(6)))
    for df, name in ((stream.hourly_counts(stream.read(spark, str(tmp_path / "w"))), "hours"), (stream.latest(stream.read(spark, str(tmp_path / "w"))), "latest")):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.readings for r in spark.table("hours").collect()) == [2, 2, 2]
    assert spark.table("latest").count() == 6
