"""Files in and out, and incremental runs, on temporary folders."""

from __future__ import annotations

import csv
import glob
import json
import time

from pyspark.sql import functions as F

from foliospark.operators import templates
from foliospark.plans.organize import organize_plan
from foliospark.queries.stub import stub_responder
from foliospark.sources import files
from foliospark.streaming import incremental


def make_parser():
    """A function within a function goes to the tasks whole."""

    def parser(content: bytes):
        """Lines of page|y|x|text; some contents fail in different ways."""
        if content.startswith(b"LOCKED"):
            raise PermissionError("encrypted")
        if content.startswith(b"BROKEN"):
            raise ValueError("no header")
        if content.startswith(b"SLOW"):
            time.sleep(30)
        if content.startswith(b"SPIN"):  # in native code, which a signal handler cannot end
            import ctypes

            ctypes.PyDLL(None).usleep(30_000_000)
        if content.startswith(b"ABORT"):
            import os

            os.abort()
        out = []
        for line in content.decode().splitlines():
            page, y, x, text = line.split("|")
            out.append((int(page), float(y), float(x), text))
        return out

    return parser


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_scan_and_folders(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "one/c.pdf", "one/deep/d.pdf", "two-sort/e.pdf", "three/x.txt", "three/i.png"):
        write(tmp_path, name, b"0|1|1|x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(files.scan_pdfs(spark, str(tmp_path))) == ["a.pdf", "c.pdf", "d.pdf", "e.pdf"]
    assert names(files.scan_pdfs(spark, str(tmp_path), recursive=False)) == ["a.pdf"]
    assert names(files.scan_pdfs(spark, str(tmp_path), False, "*.[pP][dD][fF]")) == ["a.pdf", "b.PDF"]
    assert names(files.scan_images(spark, str(tmp_path))) == ["i.png"]
    found = files.folders(files.scan_pdfs(spark, str(tmp_path)), str(tmp_path)).collect()
    assert [r.folder for r in found] == [str(tmp_path), f"{tmp_path}/one"]


def test_extract_and_badlist(spark, tmp_path):
    write(tmp_path, "good.pdf", b"1|5|1|second page\n0|10.04|2|right\n0|10.01|1|left\n0|1|1|  top  \n0|2|1|  \n9|1|1|beyond")
    write(tmp_path, "locked.pdf", b"LOCKED")
    write(tmp_path, "broken.pdf", b"BROKEN")
    write(tmp_path, "slow.pdf", b"SLOW" + b" " * files.ISOLATE_BYTES)
    scanned = files.scan_pdfs(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(scanned, make_parser(), timeout=1.0).collect()}
    assert got["good.pdf"].text == "top\n\nleft\n\nright\n\nsecond page" and got["good.pdf"].status == "ok"
    assert (got["locked.pdf"].status, got["broken.pdf"].status, got["slow.pdf"].status) == ("blocked", "error", "timeout")
    assert got["broken.pdf"].listed and not got["locked.pdf"].listed and got["broken.pdf"].error == "no header"
    assert got["slow.pdf"].listed  # large ones too
    bad = files.bad_files(files.extract(scanned, make_parser(), timeout=1.0))
    assert bad.count() == 2
    again = {r.path.rsplit("/", 1)[1]: r for r in files.extract(scanned, make_parser(), timeout=1.0, badlist=bad).collect()}
    assert again["broken.pdf"].status == "error"
    fast = {r.path.rsplit("/", 1)[1]: r.text for r in files.extract(scanned, make_parser(), timeout=1.0, structured=False).collect()}
    assert fast["good.pdf"] == "second page\nright\nleft\n  top  \n  "


def test_extraction_survives_its_parser(spark, tmp_path):
    """Parsers that hang in native code or abort cost their own file only."""
    good = b"0|1|1|fine"
    for i, content in enumerate([good, b"ABORT", good, b"SPIN", good, b"ABORT", good]):
        write(tmp_path, f"{i}.pdf", content)
    scanned = files.scan_pdfs(spark, str(tmp_path)).coalesce(1)
    got = {r.path.rsplit("/", 1)[1][0]: r for r in files.extract(scanned, make_parser(), timeout=2.0).collect()}
    assert [got[str(i)].status for i in range(7)] == ["ok", "no-result", "ok", "timeout", "ok", "no-result", "ok"]
    assert all(got[str(i)].text == "fine" and not got[str(i)].listed for i in (0, 2, 4, 6)) and all(got[str(i)].listed for i in (1, 3, 5))
    readable = files.extract(scanned, make_parser(), timeout=2.0).select(files.is_readable(F.col("text"), F.col("status")).alias("r"))
    assert readable.filter("r").count() == 4


def _templates(spark, n=4):
    return spark.range(n).select(
        F.col("id"), F.concat(F.lit("f"), "id").alias("fingerprint"), F.concat(F.lit("h"), "id").alias("header_hash"), F.lit("hint").alias("company_hint"), F.lit("germany").alias("country"),
        F.lit("invoice").alias("doc_type"), F.lit("financial").alias("doc_category"), F.lit("x").alias("company"), F.lit(0.9).alias("confidence"), (F.col("id") * 2).alias("hit_count"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_hit_at"),
    )


def test_template_exchange(spark, tmp_path):
    t = _templates(spark)
    files.export_templates(t, f"{tmp_path}/whole")
    assert sorted(map(str, files.read_templates(spark, f"{tmp_path}/whole").collect())) == sorted(map(str, t.collect()))
    files.export_templates(t, f"{tmp_path}/compat", compat=True)
    back = files.read_templates(spark, f"{tmp_path}/compat")
    assert all(r.header_hash is None and r.id is None for r in back.collect())
    (tmp_path / "array.json").write_text(json.dumps([{"fingerprint": "f1", "country": "x"}, {"fingerprint": "new", "country": "y"}, {"fingerprint": "new", "country": "y"}]))
    merged = templates.import_templates(t, files.read_templates(spark, f"{tmp_path}/array.json"))
    assert sorted(r.fingerprint for r in merged.collect()) == ["f0", "f1", "f2", "f3", "new"]
    assert {r.country for r in merged.filter("fingerprint = 'f1'").collect()} == {"germany"}


PLAN = "file_path string, filename string, country string, doc_type string, doc_category string, company string, year int, confidence double, is_valid boolean, error string"


def test_reports_and_moves(spark, tmp_path):
    rows = [
        (f"{tmp_path}/in/a.pdf", "a.pdf", "germany", "invoice", "financial", "Acme", 2020, 0.9, True, None), (f"{tmp_path}/in/b.pdf", "b.pdf", None, None, None, None, None, 0.95, True, None),
        (f"{tmp_path}/in/c.pdf", "c.pdf", "france", "invoice", "financial", None, None, 0.1, True, None), (f"{tmp_path}/in/d.pdf", "d.pdf", None, None, None, None, None, None, None, "unreadable"),
    ]
    plan = organize_plan(spark.createDataFrame(rows, PLAN), f"{tmp_path}/out")
    files.write_report_csv(plan, f"{tmp_path}/csv")
    lines = [x for p in glob.glob(f"{tmp_path}/csv/*.csv") for x in csv.DictReader(open(p))]
    assert len(lines) == 4 and list(lines[0]) == files.REPORT
    by_source = {x["source"].rsplit("/", 1)[1]: x for x in lines}
    assert by_source["a.pdf"]["confidence"] == "0.90" and by_source["d.pdf"]["destination"] == "" and by_source["d.pdf"]["error"] == "unreadable"
    files.write_report_json(plan, f"{tmp_path}/json")
    summary = [json.loads(x) for p in glob.glob(f"{tmp_path}/json/summary/*.json") for x in open(p)]
    assert summary == [{"total_files": 4, "successful": 2, "moved_to_trash": 1, "skipped": 0, "errors": 1, "by_country": {"germany": 1, "unknown": 1}, "by_doc_type": {"invoice": 1, "unknown": 1}}]
    results = spark.read.json(f"{tmp_path}/json/results")
    assert results.count() == 4 and results.filter("status = 'success' and classification.company = 'Acme'").count() == 1
    files.write_report_csv(plan.limit(0), f"{tmp_path}/empty")
    for path, *_ in rows[:2]:
        write(tmp_path, path.removeprefix(f"{tmp_path}/"), b"x")
    moved = {r.source.rsplit("/", 1)[1]: r for r in files.move_files(plan).collect()}
    assert moved["a.pdf"].error is None and moved["c.pdf"].error and "d.pdf" not in moved
    files.write_report_document(plan, f"{tmp_path}/report.json")
    document = json.load(open(f"{tmp_path}/report.json"))
    assert document["summary"]["total_files"] == 4 and document["summary"]["by_country"] == {"germany": 1, "unknown": 1}
    assert [r["source"] for r in document["results"]] == [r[0] for r in rows] and document["results"][0]["classification"]["company"] == "Acme"
    assert glob.glob(f"{tmp_path}/out/**/a.pdf", recursive=True) and not glob.glob(f"{tmp_path}/in/*.pdf")


def _letter(i, kind):
    return f"Company {chr(65 + kind)}{chr(66 + kind)} GMBH\nVAT: DE136695976\nDate: 01.02.2021\nIBAN DE89370400440532013000\nTotal: 12.50 EUR\n{'text of the letter ' * 3}"


def test_incremental_runs(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    work = f"{tmp_path}/work"

    def run(**options):
        q = incremental.run_incremental(spark, f"{tmp_path}/in", work, stub_responder, max_files=1, compact_every=2, **options)
        q.awaitTermination()
        assert q.exception() is None

    arrive("1", [(1, _letter(1, 0)), (2, "short"), (3, "words of a text that says nothing at all about a country or a year")])
    run()
    first = {r.doc_id: r for r in incremental.read_progress(spark, work).collect()}
    assert first[1].status == "ok" and first[1].source == "llm"
    assert first[2].status == "error" and first[2].error_msg == "Empty or too short text" and first[3].status == "ok"
    run()  # nothing new: nothing changes
    assert incremental.read_progress(spark, work).count() == 3
    assert incremental.read_templates(spark, work).count() == 1
    # learned before: served by the table once it is sure enough; again for a document that failed
    arrive("2", [(4, _letter(4, 0)), (5, _letter(5, 1)), (3, _letter(3, 0))])
    run()
    second = {r.doc_id: r for r in incremental.read_progress(spark, work).collect()}
    assert sorted(second) == [1, 2, 3, 4, 5] and second[3].status == "ok" and second[1] == first[1]
    whole = {r.fingerprint: r for r in incremental.read_templates(spark, work).collect()}
    assert len(whole) == 2 and max(r.hit_count for r in whole.values()) == 2
    assert spark.read.parquet(f"{work}/results/batch=1").count() == 3
    arrive("3", [(6, _letter(6, 2))])
    run(cache_only=True)
    third = {r.doc_id: r for r in incremental.read_progress(spark, work).collect()}
    assert third[6].status == "pending_llm" and third[6].error_msg == "No cache match (cache-only mode)"
    assert incremental.read_templates(spark, work).count() == 2
    counters = incremental.session_counters(spark, work)
    assert (counters["rows"], counters["ok"], counters["errors"], counters["pending_llm"], counters["queries"]) == (7, 5, 1, 1, 6)
