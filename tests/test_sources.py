import json

from pyspark.sql import functions as F

from pagequarry.sources import io
from pagequarry.streaming import ledger


def test_gold_csv(spark, tmp_path):
    good = json.dumps([{"name": "A B", "rasses": "X; Y", "corresponding_author": "yes"}])
    rows = [["1", "10.1/A", "l", good, "abs", "https://p", "TRUE", "captcha", "TRUE", "FALSE"], ["2", "10.1/b", "l", "N/A`", "N/A", "", "", "", "", ""], ["3", "10.1/c", "l", "[{broken", "", "", "", "", "", ""], ["4", "10.1/d", "l", "Journal of X", "", "", "", "", "", ""], ["", "10.1/e", "l", "", "", "", "", "", "", ""]]
    head = ["No", "DOI", "Link", "Authors", "Abstract", "PDF URL", "Status", "Notes", "Has Bot Check", "Resolves To PDF"]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    path = tmp_path / "gold.csv"
    path.write_text("\n".join(",".join(map(quote, r)) for r in [head, *rows]))
    got = {r["no"]: r for r in io.gold_csv(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["authors"] == [("A B", ["X", "Y"], True)] and got[1]["doi"] == "10.1/a" and got[1]["failure_modes"] == ["bot_check"]
    assert [got[i]["gold_quality"] for i in (1, 2, 3, 4)] == ["ok", "ok", "broken-json", "journal-title-leaked"]
    assert got[2]["abstract"] is None and got[2]["has_bot_check"] is None
    io.gold_ndjson(io.gold_csv(spark, str(path)), str(tmp_path / "out"), "10.1")
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_ndjson_and_pages(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"task_id":"t","status":"x"}\n\nnot json\n')
    assert [r["task_id"] for r in io.ndjson(spark, str(tmp_path / "a.ndjson"), io.CLAIM).collect()] == ["t"]
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / ("a" * 40 + ".html")).write_text("<p>é</p>")
    (folder / ("b" * 40 + ".html")).write_bytes(b"%PDF-1.4")
    got = {r["key"][0]: (r["is_pdf"], r["html"]) for r in io.page_store(spark, str(folder)).collect()}
    assert got == {"a": (False, "<p>é</p>"), "b": (True, None)}
    assert spark.range(1).select(io.cache_key(F.lit("ABC")).alias("k")).first()["k"] == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    lines = [{"run_id": "r", "timestamp": f"2024-01-01T00:00:0{i}Z", "action": f"a{i}", "status": s, "agent_role": "Nobody", "progress_current": i} for i, s in enumerate(["started", "ok", "weird"])]
    (source / "1.json").write_text("\n".join(map(json.dumps, lines)))
    q = ledger.append(ledger.normalized(ledger.events(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    stored = spark.read.json(str(tmp_path / "out"))
    assert sorted(r["status"] for r in stored.collect()) == ["ok", "ok", "started"] and stored.where("agent_role = 'Scribe'").count() == 3
    q = ledger.progress(ledger.normalized(ledger.events(spark, str(source)))).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("select * from progress").first()
    assert (row["n_ok"], row["n_started"], row["latest_action"], row["progress_current"]) == (2, 1, "a2", 2)
    assert [r["action"] for r in io.tail(stored, "r", 2).collect()] == ["a2", "a1"]


def test_candidates_once(spark, tmp_path):
    source = tmp_path / "c"
    source.mkdir()
    rows = [{"doi": d, "field": "f", "proposed_at": "2024-01-01T00:00:00Z"} for d in ("D1", "d1", "d2")]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = ledger.candidates_once(spark, str(source)).writeStream.outputMode("append").format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from once").count() == 2
