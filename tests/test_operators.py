import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tellgrid.functions import columns, native
from tellgrid.operators import documents as ops
from tellgrid.operators import model_pass, tables
from tellgrid.plans.errors import UnknownPresetError
from tellgrid.plans.profile import Profile, default_profile, resolve
from tellgrid.sources import readers, sinks


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "In summary, it works — well."), (2, None), (3, ""), (4, "Plain words."), (5, "robust\n" * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("findings_old", F.lit(1))


def test_nulls_and_extra_columns(docs):
    rows = {r.doc_id: r for r in ops.score(ops.fix(docs)).collect()}
    assert rows[2].cleaned is None and rows[2].findings == [] and rows[2].score is None
    assert rows[3].cleaned == "" and rows[3].score.value == 0
    assert rows[1].cleaned == "It works, well." and rows[1].findings_old == 1
    assert [f.line for f in rows[5].findings] == [1, 2, 3]


def test_findings_table_and_report_lines(docs):
    got = ops.findings(docs).orderBy("doc_id", "offset").collect()
    assert [(r.doc_id, r.rule) for r in got][:2] == [(1, "phrase:in summary,"), (1, "char:—")]
    lines = [r.line for r in sinks.report_lines(ops.check(docs.where("doc_id = 1").withColumn("path", F.lit("a.md")))).collect()]
    assert lines == ['a.md:1:1 phrase:in summary,: "In summary, i" -> "I"', 'a.md:1:22 char:—: "—" -> ", "']


def test_gate(docs):
    assert ops.gate(docs).first().exit_code == 1
    assert ops.gate(docs.where("doc_id = 4")).first().exit_code == 0
    assert ops.gate(docs.limit(0)).first().exit_code == 0
    assert ops.gate(docs, most=0).first().exit_code == 1


def test_drift(spark):
    d = spark.createDataFrame([(1, "5 apples and 5 pears at 3%", "5 apples and 6 pears at 3%"), (2, None, "7")], "doc_id long, a string, b string")
    got = {r.doc_id: (r.dropped, r.added) for r in ops.anchor_drift(d, "a", "b").collect()}
    assert got == {1: (["5"], ["6"]), 2: ([], ["7"])}
    many = spark.createDataFrame([([str(i) for i in range(25)],)], "x array<string>").select(ops.drift_report(F.col("x"), "dropped").alias("r")).first().r
    assert len(many) == 21 and many[-1] == "and 5 more dropped"


def test_segments_and_top(docs):
    d = ops.check(docs.where("doc_id = 1"))
    cut = d.select(ops.segments(F.col("text"), F.col("findings")).alias("s")).first().s
    assert "".join(x.text for x in cut) == "In summary, it works — well." and [x.rule for x in cut].count(None) == 2
    assert ops.top_findings(d, 1).first().more == 1


def test_chop(spark):
    rows = [("In summary, we leverage it.", None, None, None), ("  ", None, None, None), ("x", ["nope"], None, None), ("keep robust", [], None, '{"keep": ["robust"]}'), ("x" * 20, None, "{", None), (None, None, None, None)]
    got = [r.asDict(True) for r in ops.chop(spark.createDataFrame(rows, "text string, presets array<string>, profile string, voice string"), most_bytes=100).collect()]
    assert got[0]["output"] == "We use it." and got[0]["score_after"]["value"] == 0 and got[0]["error"] is None
    assert got[1]["error"] == got[5]["error"] == "text is required"
    assert "unknown preset" in got[2]["error"] and got[2]["output"] is None
    assert got[3]["findings"] == []
    assert "profile decode" in got[4]["error"]


def test_json_report(docs):
    r = json.loads(ops.report_json(ops.fix(docs.where("doc_id = 1"))).first().report)
    assert r["cleaned"] == "It works, well." and "order" not in r["findings"][0]


def test_catalogs(spark):
    assert tables.catalog_text().startswith("character swaps (12):\n") and '"—" => ", "' in tables.catalog_text()
    page = tables.catalog_markdown()
    assert "## Stock phrases (33)" in page and "## Preset cleaver" in page
    assert ops.profile_row(spark, default_profile()).first().collapseSpaces is True


def test_evaluation(spark):
    rows = [("ai", "In summary, we leverage a robust plan."), ("human", "He went home at six and slept.")]
    d = spark.createDataFrame(rows, "label string, text string")
    e = tables.evaluate(d, F.col("label") == "ai").first()
    assert (e.recall, e.precision, e.f1) == (1.0, 1.0, 1.0) and e.margin >= 40
    assert {r.label: r.with_tells for r in tables.evaluate_tells(d).collect()} == {"ai": 1, "human": 0}


def test_native_equals_exact_on_odd_texts(spark):
    texts = ["", "a", "One. Two three! Four?  ", "é ü\n\nx; y", "😀 b\tc", "A an hour. An user.", "x ,. y"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select("text", native.cadence_cv("text").alias("cv"), native.word_count("text").alias("w"), native.utf16_length("text").alias("u"), columns.score("text", Profile())["words"].alias("words")).collect()
    from tellgrid.functions.kernel import cadence_cv

    for r in got:
        assert r.cv == pytest.approx(cadence_cv(r.text)) and r.w == r.words and r.u == len(r.text.encode("utf-16-le")) // 2
    tidy = d.select("text", native.double_spaces(native.space_before_punctuation("text")).alias("t")).collect()
    assert {r.text: r.t for r in tidy}["x ,. y"] == "x,. y"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("x — y\n")
    (tmp_path / "b.md").write_text("fine")
    d = readers.read_texts(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.md")])
    assert sorted(r.text for r in d.collect()) == ["fine", "x — y\n"]
    (tmp_path / "bad.bin").write_bytes(b"ok \xff")
    assert readers.read_binary_texts(spark, str(tmp_path / "bad.bin")).first().replaced == 1
    (tmp_path / "c.jsonl").write_text('{"label":"ai","text":"t"}\n\n{"label":"human","text":"u","note":"n"}\n')
    assert readers.read_corpus(spark, str(tmp_path / "c.jsonl")).count() == 2
    path = tmp_path / "a.md"
    os.chmod(path, 0o640)
    sinks.replace_file(str(path), "x, y\n")
    assert path.read_text() == "x, y\n" and stat.S_IMODE(path.stat().st_mode) == 0o640
    sinks.write_cleaned(ops.fix(d.withColumnRenamed("path", "p")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == cores
    assert readers.spread(spark.range(10).repartition(cores + 3)).rdd.getNumPartitions() == cores + 3


def test_errors_come_before_jobs(spark, docs):
    with pytest.raises(UnknownPresetError):
        ops.check(docs, resolve(presets=["nope"]))


def test_sql_functions(spark, docs):
    from tellgrid import sql

    sql.register(spark)
    docs.createOrReplaceTempView("d")
    assert spark.sql("SELECT fix_text(text) t FROM d WHERE doc_id = 1").first().t == "It works, well."
    assert spark.sql("SELECT size(check_text(text)) n FROM d WHERE doc_id = 5").first().n == 3
    assert spark.sql("SELECT score_text(text).value v FROM d WHERE doc_id = 3").first().v == 0
    assert spark.sql("SELECT f.rule FROM d, LATERAL findings(d.text) f WHERE doc_id = 5").count() == 3
    assert spark.sql("SELECT anchors('see 42') a").first().a == ["42"]


# --- the model pass with fakes ---------------------------------------------------------


def test_rewrite_keeps_newline_and_rechecks():
    from tellgrid.functions.kernel import Engine

    out = model_pass.rewrite_one(Engine(), "We have 5 apples.\n", lambda s, u: "  We have six — robust apples. ")
    assert out["cleaned"] == "We have six, robust apples.\n"
    assert any("robust" in w for w in out["warnings"]) and "dropped 5" in out["warnings"]


def test_judge_retries_with_feedback_and_fails_closed():
    from tellgrid.functions.kernel import Engine

    seen = []

    def model(system, user):
        seen.append(system)
        return "Changed."

    bad = lambda s, u: '```{"faithful": false, "issues": [{"kind": "changed", "was": "5", "now": "6", "note": "n"}]}```'
    out = model_pass.rewrite_one(Engine(), "In summary, 5.", model, bad, retries=1)
    assert out["cleaned"] == "In summary, 5." or out["cleaned"] == Engine().clean("In summary, 5.")
    assert len(seen) == 2 and 'keep "5"' in seen[1] and out["verdict"]["faithful"] is False
    broken = model_pass.rewrite_one(Engine(), "x", model, lambda s, u: "no json")
    assert broken["cleaned"] == "x" and "could not run" in broken["verdict"]["issues"][0]["note"]
    good = model_pass.rewrite_one(Engine(), "x", model, lambda s, u: '{"faithful": true, "issues": []}')
    assert good["cleaned"] == "Changed." and good["verdict"]["faithful"]


def test_rewrite_column(spark):
    def fake(system, user):
        if "boom" in user:
            raise RuntimeError("down")
        return user.upper()

    rows = [(1, "a b"), (2, None), (3, "boom")]
    got = {r.i: r for r in model_pass.rewrite(spark.createDataFrame(rows, "i int, text string"), fake).collect()}
    assert got[1].cleaned == "A B" and got[2].cleaned is None and got[3].error == "down"


def test_feedback_is_bounded():
    notes = model_pass.feedback_notes([{"was": "x" * 500}] * 50)
    assert len(notes) == 32 and len(notes[0]) < 260


def test_shared_judge():
    d = {"p": "m1"}
    assert model_pass.shares_judge(("p", "", ""), ("", "", ""), d)
    assert model_pass.shares_judge(("p", "m1", ""), ("p", "", ""), d)
    assert not model_pass.shares_judge(("p", "", ""), ("p", "m2", ""), d)


def test_learn():
    assert model_pass.learn_tone(["Some sample"], lambda s, u: '["Short", "dry"]', ["short"]) == ["short", "dry"]
