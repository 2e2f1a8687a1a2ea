"""The stages of the corpus pipeline on small tables with odd rows, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from foliospark.llm import jaccard_join
from test_operators import ids_of, jaccard_brute, personal  # noqa: E402  the brute-force versions

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, score double"
ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"


def _rows():
    r = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("mor", "tel", "gan", "wis", "pru", "lov") for b in ("en", "ith", "ad", "ust", "or", "ely")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(r.randrange(20, 80)), "en") for i in range(60)]
    near = rows[3][1].split()
    rows += [(100, " ".join(near[:-1] + ["other"]), "en"), (101, rows[3][1], None), (102, rows[4][1], "en"), (102, rows[4][1], "en")]
    rows += [(200, f"{prose(5)} {ITEM} {prose(5)}", "en"), (None, f"{prose(6)} {ITEM}", None), (201, prose(30), "en"), (201, f"{ITEM} {prose(9)}", "en")]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34", None), (None, prose(12), "en"), (303, prose(3), "en")]
    rows += [(400, f"mail a.b1@c.example.com or +1 (017) 555-7713 {prose(8)}", "en"), (401, f"{prose(20_000)} 8.8.8.8 {prose(10)}", "en")]
    return [(i, t, lang, "web", None if t is None else len(t), 7, 0.5) for i, t, lang in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(_rows(), COLUMNS).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}"


def _docs(spark, rows=None):
    return spark.createDataFrame(_rows() if rows is None else rows, COLUMNS).repartition(3)


def _kept(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return Counter((r.doc_id, r.text) for r in df.collect())


def _all():
    return Counter((i, t) for i, t, *_ in _rows())


def test_language_keeps_the_labelled_and_the_unlabelled(spark, sf_dir):
    kept = _kept(corpus_pipeline.language(spark, _docs(spark), sf_dir))
    assert _all() - kept == Counter({(300, None): 1, (301, ""): 1, (302, "12 34"): 1}) and not kept - _all()


def test_language_without_labels_rejects_only_texts_without_letters(spark, sf_dir):
    rows = [(i, t, None, *rest) for i, t, _, *rest in _rows()]
    kept = _kept(corpus_pipeline.language(spark, _docs(spark, rows), sf_dir))
    assert _all() - kept == Counter({(300, None): 1, (301, ""): 1, (302, "12 34"): 1})


def test_near_duplicates_against_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t, *_ in _rows()]
    component = jaccard_brute(rows, 5, 80, 100)
    expect = Counter((i, t) for i, t in rows if i is None or component[i] == i)
    assert _kept(corpus_pipeline.near_duplicates(spark, _docs(spark), sf_dir)) == expect
    assert component[100] == component[101] == 3 and component[102] == 4


def test_decontaminate_against_brute_force(spark, sf_dir):
    expect = Counter((i, t) for i, t, *_ in _rows() if ITEM not in (t or ""))
    assert _kept(corpus_pipeline.decontaminate(spark, _docs(spark), sf_dir)) == expect
    assert (201, next(t for i, t, *_ in _rows() if i == 201)) in expect and sum(expect.values()) == len(_rows()) - 3


def test_personal_data_against_brute_force(spark, sf_dir):
    def redacted(t):
        out, at = [], 0
        for kind, a, e in sorted((x.split(":") for x in personal(t).split(",") if x), key=lambda x: int(x[1])):
            out.append(t[at : int(a)] + f"[{kind.upper()}]")
            at = int(e)
        return "".join(out) + t[at:]

    got = corpus_pipeline.personal_data(spark, _docs(spark), sf_dir).select(*corpus_pipeline.COLUMNS).collect()
    expect = Counter((i, t if t is None else redacted(t)) for i, t, *_ in _rows())
    assert Counter((r.doc_id, r.text) for r in got) == expect
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert any("[EMAIL] or [PHONE]" in (t or "") for _, t in expect)


def test_run_over_the_whole_table(spark, sf_dir):
    rows = [(i, t) for i, t, *_ in _rows()]
    component = jaccard_brute(rows, 5, 80, 100)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    stays = lambda i, t: t and any(c.isalpha() for c in t) and (i is None or component[i] == i) and ITEM not in t
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, t in rows if stays(i, t))
    assert sum(r.length for r in out if r.doc_id == 303) == len(ids_of(next(t for i, t in rows if i == 303)))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = _docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_entry_works_without_the_training_subpackage(monkeypatch):
    import importlib

    import __spark_entry__

    def missing(name):
        raise ImportError(name)

    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setattr(importlib, "import_module", missing)
    names = set(__spark_entry__.queries())
    assert "doc_fingerprint" in names and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) and "pipeline" not in names


def test_near_duplicates_chance_meetings(spark, monkeypatch):
    """Texts with a passage in common are not compared with each other in groups of all of them."""
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [passage + " " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(300)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, texts[7] + " more", "en", "s", 1)]
    placed, run = [], jaccard_join._run_groups
    monkeypatch.setattr(jaccard_join, "_run_groups", lambda texts, p, *a: placed.append(p.count()) or run(texts, p, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert sum(placed) < 60
