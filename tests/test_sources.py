import json

from pyspark.sql import functions as F

from stitchspark import plans
from stitchspark.operators import curation
from stitchspark.sources import files, pages, traces


def test_csv_with_bom_and_json_cells(spark, tmp_path):
    p = tmp_path / "rows.csv"
    p.write_bytes(b'\xef\xbb\xbfsample_id,counts,score\r\na,"{""x"": 1}",\r\nb,,0.5\r\n')
    df = files.scan_csv(spark, str(p))
    assert df.columns == ["sample_id", "counts", "score"]
    rows = {r["sample_id"]: r for r in df.collect()}
    assert rows["a"]["counts"] == '{"x": 1}' and rows["a"]["score"] is None
    assert files.scan_csv(spark, str(tmp_path / "none.csv"), "a string", missing_ok=True).count() == 0
    both = files.union_tables([df, spark.createDataFrame([("c", 1)], "sample_id string, extra int")])
    assert both.columns == ["sample_id", "counts", "score", "extra"] and both.count() == 3
    out = str(tmp_path / "out")
    files.sink_csv(both, out)
    assert files.scan_csv(spark, out).count() == 3


def test_eval_reports(spark, tmp_path):
    for method, sample, doc in (("m1", "s1", {"pred": {"jump_count": 3, "jump_path_mm": 2.5}, "gt": {}}), ("m2", "s1", {"jump_count": 7})):
        d = tmp_path / method / sample
        d.mkdir(parents=True)
        (d / "eval.json").write_text(json.dumps(doc, indent=1))
    got = {r["method"]: r for r in files.scan_eval_reports(spark, f"{tmp_path}/*/*/eval.json").collect()}
    assert got["m1"]["jump_count"] == 3 and got["m1"]["sample_id"] == "s1" and got["m2"]["jump_count"] == 7 and got["m2"]["jump_path_mm"] is None


def test_commands_tsv_keeps_line_order(spark, tmp_path):
    head = "region_id\tcolor_index\tstitch_type\tcommand\tx_mm\ty_mm\n"
    for name in ("d1", "d2"):
        (tmp_path / f"{name}.tsv").write_text(head + "".join(f"1\t0\trun\tSTITCH\t{i}.5\t0\n" for i in range(50)))
    df = files.scan_commands_tsv(spark, str(tmp_path))
    rows = df.filter("design_id = 'd2'").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(50)) and [r["x_mm"] for r in rows] == [i + 0.5 for i in range(50)]


def test_discover_roots(spark):
    names = ["r/a/rows.csv", "r/a/cov.csv", "r/a/s1/out.dst", "r/a/s2/out.dst", "r/b/rows.csv", "r/b/s1/out.dst", "r/c_old/rows.csv", "r/c_old/cov.csv", "r/c_old/s1/out.dst"]
    got = files.discover_roots(spark.createDataFrame([(n,) for n in names], "path string"), ["rows.csv", "cov.csv"], "out.dst", exclude="_old$").collect()
    assert [(r["root"], r["outputs"]) for r in got] == [("r/a", 2)]


def test_traces(spark, tmp_path):
    d = tmp_path / "m2_trace_p1"
    d.mkdir()
    node = lambda i: {"node_id": i, "point_count": 2, "length_mm": 1.0, "start_mm": [0, 0], "end_mm": [1, 0], "bbox_px": [0, 0, 1, 1]}
    edges = [{"step": 0, "from_node": -1, "to_node": 0, "reverse": False}, {"step": 1, "from_node": 0, "to_node": 1, "reverse": True}]
    (d / "trace.json").write_text(json.dumps({"tasks": [{"task_index": 0, "type_id": 1, "graph": {"nodes": [node(0), node(1)], "selected_edges": edges}},
                                                        {"task_index": 1, "graph": {"nodes": [node(0)], "selected_edges": edges[:1]}}]}))
    tasks, nodes, e = traces.scan_route_traces(spark, f"{tmp_path}/*/trace.json")
    s = traces.trace_summary(tasks, e).first()
    assert (s["sample_id"], s["tasks"], s["nodes"], s["skipped_single_node_tasks"], s["decisions"]) == ("p1", 2, 3, 1, 1) and nodes.count() == 3


def test_sketches_and_index(spark, tmp_path):
    good = {"key_id": "9", "recognized": True, "drawing": [[[0, 200], [0, 200]], [[10, 20], [5, 6]]]}
    lines = [json.dumps(good), json.dumps({**good, "key_id": "3"}), json.dumps({**good, "key_id": "1", "recognized": False}), "{broken"]
    (tmp_path / "cat.ndjson").write_text("\n".join(lines))
    got = curation.sketch_per_category(files.scan_sketches(spark, str(tmp_path / "cat.ndjson"))).collect()
    assert [(r["category"], r["key_id"], r["accepted"]) for r in got] == [("cat", "3", 2)]
    (tmp_path / "index.json").write_text(json.dumps({"items": [{"id": "a", "source": "s", "features": {"area_ratio": 0.5}, "stats": {"path_graph_nodes": 3}}]}))
    item = files.scan_index(spark, str(tmp_path / "index.json"), ["area_ratio", "fill_ratio"]).first()
    assert item["area_ratio"] == 0.5 and item["fill_ratio"] is None


def test_dots_are_not_gathered(spark):
    rows = [("cat", 1, float(i % 200), float(i % 190)) for i in range(500)] + [("cat", k, x, x) for k in (3, 2) for x in (0.0, 180.0)] + [("cat", 0, 1.0, None), ("dog", 5, 9.0, 9.0)]
    dots = spark.createDataFrame(rows, "category string, key_id long, x double, y double")
    got = curation.dots_per_category(dots)
    assert [tuple(r) for r in got.collect()] == [("cat", 2, 2)]
    drawn = dots.groupBy("category", "key_id").agg(F.collect_list(F.array(F.array("x"), F.array("y"))).alias("drawing")).withColumn("recognized", F.lit(True))
    assert curation.sketch_per_category(drawn).collect() == got.collect()
    plan = plans.RUN["sketch_per_category"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_promoted_and_fallback_artifacts(spark, tmp_path):
    art = spark.createDataFrame([("s1", "r1", "f1"), ("s1", "r2", "f2"), ("s2", "r2", "f3")], "sample_id string, root string, file string")
    sel = spark.createDataFrame([("s1", "r2", "p"), ("s2", "r2", "p")], "sample_id string, root string, profile string")
    assert {r["file"] for r in files.promote_outputs(sel, art, ["sample_id", "root"], str(tmp_path / "o")).collect()} == {"f2", "f3"}
    assert {r["file"] for r in files.first_available(sel, art, "sample_id", ["r1", "r2"]).collect()} == {"f1", "f3"}


def test_page_record(spark):
    html = ("<html><head><title>t</title></head><body><h1>Rose &amp; <b>Leaf</b></h1><p>Size: 90 x 80 mm  Colors: 4 Stitches: 12000</p>"
            "<img src='/files/rose.jpg'><a href='/dl/rose.dst'>Format: DST</a><a href=\"http://x.org/p\">more</a></body></html>")
    df = spark.createDataFrame([(1, "http://h.org/a/b.html?q=1", html), (2, "http://h.org/z/stem.html", "<p>none</p>")], "page_id bigint, url string, html string")
    r = {x["page_id"]: x for x in pages.extract_page_records(df).collect()}
    assert r[1]["title"].split() == ["Rose", "&", "Leaf"] and r[1]["size_text"] == "90 x 80 mm" and r[1]["colors"] == "4" and r[1]["stitches"] == "12000"
    assert r[1]["preview_url"] == "http://h.org/files/rose.jpg" and r[1]["dst_url"] == "http://h.org/dl/rose.dst" and r[1]["link_count"] == 2
    assert r[2]["title"] == "stem" and r[2]["link_count"] == 0


def test_page_titles_as_their_sql_reads_them(spark, tmp_path):
    import duckdb
    from stitchspark import plans
    titles = ["a &amp b", "&amp;lt; &lt;b&gt;", "caf&eacute; &#39;x&#39; &quot;y&quot;", "&copy 1 &#x41;", "plain"]
    rows = [(i, f"https://x.org/{i}", f"<h1>{t}</h1><a href='/p'>p</a>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = plans.RUN["page_records"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(plans.SQL["page_records"]).fetchall())
