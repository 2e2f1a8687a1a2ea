"""Versioned tables, sessions, free names and moves, against plain Python and SQLite."""

from __future__ import annotations

import glob
import json
import os
import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from foliospark.functions.paths import path_hash
from foliospark.operators import templates
from foliospark.operators.free_names import existing_files, resolve_conflicts
from foliospark.operators.ranking import running_sum
from foliospark.plans.sessions import Sessions
from foliospark.queries.stub import stub_responder
from foliospark.sources import files, moves
from foliospark.sources.template_store import TemplateStore
from foliospark.sources.versioned import VersionConflict, VersionedTable
from foliospark.streaming import incremental


@pytest.fixture
def shuffled(spark):
    """Ranges of few rows, so that groups span several."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_of_hot_groups(shuffled):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.randrange(5)) for i in range(600)]
    df = shuffled.createDataFrame(rows, "g string, i int, w int").repartition(5)
    got = {x["i"]: x["s"] for x in running_sum(df, ["g"], ["i"], "s", F.col("w")).collect()}
    sums, want = {}, {}
    for g, i, w in rows:
        want[i] = sums[g] = sums.get(g, 0) + w
    assert got == want
    assert sorted(x["n"] for x in running_sum(df, [], [F.desc("i")], "n").collect()) == list(range(1, 601))


def placed_in_turn(rows, there):
    """First all that can keep their name, in order; then the others, each the first free number."""
    taken, out = set(there), {}
    for i, dest in sorted(rows):
        if dest not in taken:
            taken.add(dest)
            out[i] = dest
    for i, dest in sorted(rows):
        if i not in out:
            folder, name = dest.rsplit("/", 1)
            stem, dot, ext = name.rpartition(".")
            stem, ext = (stem, dot + ext) if dot else (name, "")
            k = 1
            while f"{folder}/{stem}_{k}{ext}" in taken:
                k += 1
            out[i] = f"{folder}/{stem}_{k}{ext}"
            taken.add(out[i])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_free_names_against_a_loop(shuffled, seed):
    r = random.Random(seed)
    names = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_1_1.pdf", "a_01.pdf", "b", "b_1", "c.tar.gz", "a_3.pdf", "a_1_2.pdf", "a_7.txt"]
    rows = [(i, f"/out/{r.choice('xy')}/{r.choice(names)}") for i in range(200)] + [(1000 + i, "/out/x/hot.pdf") for i in range(150)]
    there = sorted({f"/out/{r.choice('xy')}/{r.choice(names + ['a_5.pdf', 'hot.pdf', 'hot_3.pdf', 'hot_140.pdf'])}" for _ in range(12)})
    df = shuffled.createDataFrame(rows + [(5000, None)], "i int, dest string").repartition(4)
    got = {x["i"]: x["dest"] for x in resolve_conflicts(df, "dest", "i", shuffled.createDataFrame([(t,) for t in there], "path string")).collect()}
    assert got.pop(5000) is None
    assert got == placed_in_turn(rows, there)
    assert len(set(got.values()) | set(there)) == len(got) + len(there)


def test_existing_files(spark, tmp_path):
    assert existing_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a b.pdf").write_text("1")
    assert [r["path"] for r in existing_files(spark, str(tmp_path)).collect()] == [str(tmp_path / "x" / "a b.pdf")]


# --- moves


def plan_of(spark, pairs, status="success"):
    return spark.createDataFrame([(s, d, status) for s, d in pairs], "file_path string, dest_path string, status string").repartition(3)


def test_moves_replace_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    for name in "abcd":
        (tmp_path / f"{name}.pdf").write_text(f"content {name}")
    (tmp_path / "out" / "a.pdf").write_text("older")
    os.link(tmp_path / "c.pdf", tmp_path / "out" / "c.pdf")  # a run died between link and unlink
    (tmp_path / "out" / "d.pdf").write_text("content d")  # or, between file systems, after the copy
    pairs = [(f"{tmp_path}/{n}.pdf", f"{tmp_path}/out/{n}.pdf") for n in "abcde"]
    journal = f"{tmp_path}/journal"
    got = {r["source"][-5]: r["error"] for r in moves.move_files_journaled(plan_of(spark, pairs), journal).collect()}
    assert got == {"a": "the destination exists", "b": None, "c": None, "d": None, "e": "File not found (already moved?)"}
    assert (tmp_path / "out" / "a.pdf").read_text() == "older" and (tmp_path / "a.pdf").read_text() == "content a"
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.pdf": "older"} | {f"{n}.pdf": f"content {n}" for n in "bcd"}
    # the same plan again changes nothing, and what worked once has worked
    again = {r["source"][-5]: r["error"] for r in moves.move_files_journaled(plan_of(spark, pairs), journal).collect()}
    assert again == got
    lines = [json.loads(x) for p in glob.glob(f"{journal}/parts/*") for x in open(p)]
    assert {x["kind"] for x in lines} == {"intent", "outcome"} and len(glob.glob(f"{journal}/commit-*.json")) == 2


def test_moves_of_a_task_that_dies(spark, tmp_path, monkeypatch):
    """A writer that stops halfway and is run again: every file is at one place, none twice, none lost."""
    for i in range(40):
        (tmp_path / f"{i}.pdf").write_text(f"content {i}")
    rows = [(f"{tmp_path}/{i}.pdf", f"{tmp_path}/out/{i % 4}/{i}.pdf") for i in range(40)]
    schema = plan_of(spark, rows).select(F.col("file_path").alias("source"), F.col("dest_path").alias("destination")).schema
    writer = moves._Writer({"journal": f"{tmp_path}/journal"}, schema)
    real, calls = os.unlink, []

    def failing(path, *a, **k):
        calls.append(path)
        if len(calls) == 17:
            raise KeyboardInterrupt
        real(path, *a, **k)

    monkeypatch.setattr(moves, "CHUNK", 10)
    monkeypatch.setattr(os, "unlink", failing)
    with pytest.raises(KeyboardInterrupt):
        writer.write(iter(rows))
    monkeypatch.setattr(os, "unlink", real)
    writer.abort([None])
    message = writer.write(iter(rows))
    writer.commit([message])
    assert (message.done, message.failed) == (40, 0)
    assert {os.path.relpath(p, tmp_path / "out") for p in glob.glob(f"{tmp_path}/out/*/*")} == {f"{i % 4}/{i}.pdf" for i in range(40)}
    assert not glob.glob(f"{tmp_path}/*.pdf") and not glob.glob(f"{tmp_path}/out/*/.*")
    assert all(open(d).read() == f"content {s.rsplit('/', 1)[1][:-4]}" for s, d in rows)


def test_results_beside_moves(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("a")
    got = moves.move_files_journaled(plan_of(spark, [(f"{tmp_path}/a.pdf", f"{tmp_path}/archive/a.pdf")]), f"{tmp_path}/journal", results=f"{tmp_path}/results").collect()
    assert got[0]["error"] is None
    written = glob.glob(f"{tmp_path}/results/a-*.json")
    assert len(written) == 1 and json.load(open(written[0]))["file_path"] == f"{tmp_path}/a.pdf"
    assert files.read_json_results(spark, f"{tmp_path}/results").first()["status"] == "success"


def test_one_json_document(shuffled, tmp_path):
    r = random.Random(4)
    rows = [(i, "".join(r.choice('aé"\\\n日') for _ in range(r.randrange(30))) or None) for i in range(500)]
    df = shuffled.createDataFrame(rows, "i int, t string").repartition(7)
    files.write_json_document(df, f"{tmp_path}/all.json", ["i"], df.agg(F.count("*").alias("n")))
    assert json.load(open(f"{tmp_path}/all.json")) == {"summary": {"n": 500}, "results": [{"i": i, "t": t} for i, t in rows]}
    files.write_json_document(df.limit(0), f"{tmp_path}/none.json", ["i"])
    assert json.load(open(f"{tmp_path}/none.json")) == {"results": []}
    assert sorted(os.listdir(tmp_path)) == ["all.json", "none.json"]


# --- versioned tables


SCHEMA, COUNTERS = "k string, v int, n bigint, at timestamp", {"n": "sum", "at": "max"}


def as_dict(df):
    return {r["k"]: (r["v"], r["n"]) for r in df.collect()}


def test_versions_against_a_dictionary(spark, tmp_path):
    t, r, want, history = VersionedTable(spark, str(tmp_path), SCHEMA, "k", COUNTERS), random.Random(5), {}, {}
    assert t.read().count() == 0 and t.last_batch() == -1
    at = F.lit("2024-01-01").cast("timestamp")
    for step in range(12):
        rows = [(k, r.randrange(100)) for k in sorted({r.choice("abcdef") for _ in range(2)})]
        counts = [(k, r.randrange(1, 5)) for k in sorted({r.choice("abcdef") for _ in range(3)})]
        gone = [(k,) for k in sorted({r.choice("abcdef") for _ in range(r.randrange(2))})]
        t.commit(
            spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame(counts, "k string, n long").withColumn("at", at),
            spark.createDataFrame(gone, "k string") if gone else None, batch=step, stats={"rows": len(rows)},
        )
        held = want.setdefault("counts", {})
        for k, n in counts:
            held[k] = held.get(k, 0) + n
        for k, v in rows:
            want.setdefault("rows", {})[k] = v
        for (k,) in gone:
            held.pop(k, None)
            want["rows"].pop(k, None)
        state = {k: (v, held.get(k, 0)) for k, v in want["rows"].items()}
        # counts of a key without a row wait for it
        assert as_dict(t.read()) == state
        history[t.manifest()["version"]] = state
        if step in (4, 9):
            # a compaction keeps rows; what was counted for keys without a row goes
            t.compact()
            want["counts"] = {k: n for k, n in held.items() if k in want["rows"]}
            assert as_dict(t.read()) == state
    assert t.last_batch() == 11 and t.manifest()["stats"]["rows"] > 0
    assert all(as_dict(t.read(v)) == s for v, s in history.items())
    data = len(os.listdir(tmp_path / "data"))
    assert t.vacuum(keep=1, grace=3600) == [] and len(os.listdir(tmp_path / "data")) == data
    t.vacuum(keep=1, grace=0)
    assert len(os.listdir(tmp_path / "data")) < data and as_dict(t.read()) == state and len(t.versions()) == 1


def test_a_crash_between_write_and_publication(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path), SCHEMA, "k", COUNTERS)
    row = spark.createDataFrame([("a", 1)], "k string, v int")
    t.commit(row)

    def dies(manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        t.commit(row.withColumn("v", F.lit(2)))
    with pytest.raises(KeyboardInterrupt):
        t.compact()
    fresh = VersionedTable(spark, str(tmp_path), SCHEMA, "k", COUNTERS)
    assert as_dict(fresh.read()) == {"a": (1, 0)} and fresh.versions() == [1]
    assert len(fresh.vacuum(grace=0)) == 2 and as_dict(fresh.read()) == {"a": (1, 0)}


def test_readers_and_writers_at_once(spark, tmp_path):
    """Commits of several threads all count, and a reader sees whole versions only."""
    t = TemplateStore(spark, str(tmp_path))
    hits = spark.createDataFrame([("f", 1)], "fingerprint string, hit_count long").withColumn("last_hit_at", F.current_timestamp())
    t.commit(rows=spark.createDataFrame([(1, "f")], "id long, fingerprint string").select(*(F.col(c) if c in ("id", "fingerprint") else F.lit(None).cast(x).alias(c) for c, x in t.types.items())))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append([tuple(r) for r in t.read().select("id", "hit_count").collect()])

    def write():
        for _ in range(3):
            t._retry(lambda version: t.commit(counts=hits, expect=version))

    threads = [threading.Thread(target=write) for _ in range(3)]
    reader = threading.Thread(target=read)
    reader.start()
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t.compact()
    stop.set()
    reader.join()
    assert t.read().first()["hit_count"] == 9 and t.changes() == 0
    assert all(len(s) == 1 and s[0][0] == 1 for s in seen) and [s[0][1] for s in seen] == sorted(s[0][1] for s in seen)
    with pytest.raises(VersionConflict):
        t.commit(counts=hits, expect=1)


def test_ageing_and_imports(spark, tmp_path):
    t = TemplateStore(spark, str(tmp_path))
    row = lambda i, day, hits: (i, f"f{i}", day, hits)
    given = spark.createDataFrame([row(1, "2024-01-01", 5), row(2, "2024-05-01", 1), row(2, "2024-05-01", 1), row(3, None, 0)], "id long, fingerprint string, day string, hit_count long")
    given = given.withColumn("created_at", F.col("day").cast("timestamp")).drop("day")
    assert t.import_new(given) == 3 and t.import_new(given) == 0
    now = F.lit("2024-06-01").cast("timestamp")
    assert t.age_out(now, 90) == 2  # the old one, and the one of unknown age, as the filter on created_at has it
    assert [(r["fingerprint"], r["hit_count"]) for r in t.read().collect()] == [("f2", 1)]
    assert t.import_new(given.filter("id = 1")) == 1 and {r["fingerprint"]: r["hit_count"] for r in t.read().collect()} == {"f1": 5, "f2": 1}


# --- runs


def letter(kind, mark="x"):
    return f"Company {chr(65 + kind)}{chr(66 + kind)} GMBH\nVAT: DE136695976\nDate: 01.02.2021\nIBAN DE89370400440532013000\nTotal: 12.50 EUR\n{mark} {'text of the letter ' * 3}"


def test_hits_of_streamed_batches(spark, tmp_path):
    """Three batches and a replay give the counts of a loop, and hits change which template a header gets."""
    work = f"{tmp_path}/work"

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        q = incremental.run_incremental(spark, f"{tmp_path}/in", work, stub_responder, max_files=1, hit_threshold=0.85, compact_every=2)
        q.awaitTermination()
        assert q.exception() is None

    batches = [[(1, letter(0)), (2, letter(1))], [(3, letter(0)), (4, letter(0)), (5, "too short")], [(6, letter(0)), (7, letter(1)), (8, letter(2))]]
    for b in batches:
        arrive(b)
        run()
    # templates of the first batch serve the later ones: 0 three times, 1 once; the third is new
    got = sorted((r["company_hint"][:10], r["hit_count"]) for r in incremental.read_templates(spark, work).collect())
    assert [n for _, n in got] == [3, 1, 0]
    store = incremental.stores(spark, work)[0]
    assert store.totals() == {"total_queries": 7, "total_hits": 4, "hit_rate": 4 / 7}
    # the checkpoint of the last batch is lost: it comes again, and nothing changes
    for p in glob.glob(f"{work}/checkpoint/commits/2") + glob.glob(f"{work}/checkpoint/commits/.2.crc"):
        os.remove(p)
    run()
    assert store.totals()["total_hits"] == 4 and sorted((r["company_hint"][:10], r["hit_count"]) for r in incremental.read_templates(spark, work).collect()) == got
    counters = incremental.session_counters(spark, work)
    assert (counters["rows"], counters["cache_hits"], counters["llm_calls"], counters["errors"]) == (8, 4, 3, 1)


def test_hits_change_the_most_used_template(spark, tmp_path):
    store = TemplateStore(spark, str(tmp_path))
    now = F.lit("2024-06-01").cast("timestamp")
    rows = [(1, "fa", "h", "germany", 0.97, 1), (2, "fb", "h", "france", 0.97, 0)]
    given = spark.createDataFrame(rows, "id long, fingerprint string, header_hash string, country string, confidence double, hit_count long")
    store.import_new(given)
    docs = spark.createDataFrame([(1, "t" * 60, "other", "h", None)], "doc_id long, text string, fingerprint string, header_hash string, company_hint string")
    assert templates.match_templates(docs, store.read()).first()["hit"]["id"] == 1
    used = spark.createDataFrame([("exact", "fb")] * 3, "tier string, template string").selectExpr(
        "tier", "template", "0L as doc_id", "'template_cache' as source", "true as is_valid", "0.97D as confidence", "0.97D as country_confidence", "'fb' as fingerprint", "'h' as header_hash",
        "cast(null as string) as company_hint", "'france' as country", "'invoice' as doc_type", "'financial' as doc_category", "'x' as company",
    )
    store.record(used, now, {"queries": 3, "hits": 3}, 0)
    assert templates.match_templates(docs, store.read()).first()["hit"]["id"] == 2
    assert {r["id"]: r["last_hit_at"] is not None for r in store.read().collect()} == {1: False, 2: True}


class Ledger:
    """Sessions one file at a time over SQLite."""

    def __init__(self):
        self.db = sqlite3.connect(":memory:")
        self.db.executescript(
            """create table files (id integer primary key autoincrement, run int, path text unique, folder text, status text default 'pending', source text, error text);
            create table runs (id integer primary key autoincrement, root text, status text, total int, ok int, hits int, llm int, errors int)"""
        )

    def session(self, files, classify, folder=None):
        row = self.db.execute("select id from runs where status = 'running' order by id desc").fetchone()
        run = row[0] if row else self.db.execute("insert into runs (root, status) values ('/in', 'running')").lastrowid
        stopped = False
        here = {p: t for p, f, t in files if folder in (None, f)}
        for p, f, _ in sorted(files, key=lambda x: (x[1], x[0])):
            if folder in (None, f):
                self.db.execute("insert or ignore into files (run, path, folder) values (?, ?, ?)", (run, p.lower(), f))
        self.db.execute("update runs set total = (select count(*) from files where run = ?) where id = ?", (run, run))
        folders = {f for _, f, _ in files if folder in (None, f)}
        here = {p.lower(): t for p, t in here.items()}
        for i, p, f in self.db.execute("select id, path, folder from files where status in ('pending', 'pending_llm') order by id").fetchall():
            if f not in folders:
                continue
            if p not in here:
                self.db.execute("update files set status = 'error', error = 'File not found (already moved?)' where id = ?", (i,))
                continue
            status, source, error = classify(here[p])
            stopped |= error == "All servers dead"
            if status == "ok":
                self.db.execute("update files set status = 'ok', source = ? where id = ?", (source, i))
            else:
                self.db.execute("update files set status = ?, error = ? where id = ?", (status, error, i))
        if not stopped:
            one = lambda c: self.db.execute(f"select count(*) from files where run = ? and {c}", (run,)).fetchone()[0]
            numbers = one("status = 'ok'"), one("source = 'template_cache'"), one("source = 'llm'"), one("status = 'error'")
            self.db.execute("update runs set status = 'finished', ok = ?, hits = ?, llm = ?, errors = ? where id = ?", (*numbers, run))

    def retry(self, folder=None):
        where = "status in ('error', 'pending_llm')" + (" and folder = ?" if folder else "")
        return self.db.execute(f"update files set status = 'pending', error = null where {where}", (folder,) if folder else ()).rowcount

    def reset(self, folder):
        return self.db.execute("delete from files where folder = ?", (folder,)).rowcount


def responder(dead):
    def ask(rows):
        country = F.when(F.contains("ask_text", F.lit("germany")), '{"country": "germany", "doc_type": "invoice"}').otherwise("no answer")
        out = rows.withColumn("raw_response", F.when(F.col("ask_text").isNotNull(), country))
        return out.withColumn("response_error", F.when(F.col("ask_text").isNotNull() & F.contains("ask_text", F.lit(dead)), "All LLM servers are DEAD"))

    return ask


def test_sessions_against_sqlite(spark, tmp_path):
    book, ledger = Sessions(spark, f"{tmp_path}/work"), Ledger()
    now = F.lit("2024-06-01").cast("timestamp")
    body = " and the words of a text that is long enough to be looked up"

    def rule(dead):
        def classify(text):
            if len(text.strip()) < 20:
                return "error", None, "Empty or too short text"
            if dead in text:
                return "pending_llm", None, "All servers dead"
            return ("ok", "llm", None) if "germany" in text else ("error", None, "Failed to parse JSON from response (conf=0.00)")

        return classify

    def state():
        # ids order the files; SQLite leaves gaps where it ignored a row
        ours = [(r["batch_run_id"], r["file_path"].lower(), r["folder"], r["status"], r["source"], r["error_msg"]) for r in book.files.read().orderBy("id").collect()]
        assert ours == ledger.db.execute("select run, path, folder, status, source, error from files order by id").fetchall()
        runs = sorted((r["id"], r["status"], r["total_files"], r["processed_files"], r["cache_hits"], r["llm_calls"], r["errors"]) for r in book.runs.read().collect())
        theirs = [tuple(x or 0 if k > 1 else x for k, x in enumerate(r)) for r in ledger.db.execute("select id, status, total, ok, hits, llm, errors from runs").fetchall()]
        assert [tuple(x or 0 if k > 1 else x for k, x in enumerate(r)) for r in runs] == theirs

    def both(rows, dead="nobody", folder=None):
        df = spark.createDataFrame([(p, f, 1, t) for p, f, t in rows], "file_path string, folder string, file_size long, text string")
        numbers = book.run(df, "/in", responder(dead), folder=folder, hit_threshold=2.0, now=now)
        ledger.session(rows, rule(dead), folder)
        state()
        return numbers

    first = [("/in/a/1.pdf", "a", "germany 1" + body), ("/in/a/2.pdf", "a", "short"), ("/in/b/3.pdf", "b", "nothing known" + body), ("/in/b/4.pdf", "b", "germany down" + body)]
    got = both(first, dead="down")
    assert (got["registered"], got["ok"], got["dead"]) == (4, 1, 1)
    # the run goes on: one file is gone, one is new, and a path differs in case only
    second = [("/IN/a/1.pdf", "a", "germany 1" + body), first[2], ("/in/b/5.pdf", "b", "germany 5" + body)]
    both(second)
    assert book.retry("b") == ledger.retry("b")
    state()
    both(first + second[2:], folder="b")
    assert book.retry() == ledger.retry()
    both(first + second[2:])
    assert book.reset("b") == ledger.reset("b")
    state()
    status = book.status()
    assert status["overall"].first()["total"] == 2 and status["runs"].count() >= 2 and status["folders"].first()["shown"] == "a" and status["cache"].first()["total_queries"] > 0
    assert spark.range(1).select(path_hash(F.lit("/IN\\a"))).first()[0] == spark.range(1).select(path_hash(F.lit("/in/a"))).first()[0]


def test_a_session_that_moves(spark, tmp_path):
    texts = {"1.pdf": letter(0), "2.pdf": letter(1), "3.pdf": "short"}
    (tmp_path / "inbox").mkdir()
    for name, text in texts.items():
        (tmp_path / "inbox" / name).write_text(text)
    book = Sessions(spark, f"{tmp_path}/work")
    df = spark.createDataFrame([(f"{tmp_path}/inbox/{n}", "inbox", len(t), t) for n, t in texts.items()], "file_path string, folder string, file_size long, text string")
    book.run(df, str(tmp_path), stub_responder, journal=f"{tmp_path}/journal")
    got = {r["file_path"][-5:]: r for r in book.files.read().collect()}
    assert got["3.pdf"]["status"] == "error" and (tmp_path / "inbox" / "3.pdf").exists()
    for name in ("1.pdf", "2.pdf"):
        assert got[name]["status"] == "ok" and open(got[name]["dest_path"]).read() == texts[name] and not (tmp_path / "inbox" / name).exists()
        assert got[name]["dest_path"].startswith(f"{tmp_path}/inbox-sort/germany/")
