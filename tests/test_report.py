from termlake.operators import report
from termlake.sources import corpus


def test_tables_and_log(tmp_path):
    rows = [{"name": "a", "n": 1, "x": 0.5}, {"name": "longer", "n": 22, "x": None}]
    lines = report.text_table(rows).split("\n")
    assert lines[0].split() == ["name", "n", "x"] and lines[2].split() == ["a", "1", "0.5000"] and lines[3].split() == ["longer", "22", "-"]
    assert report.text_table([]) == "(no rows)"
    for _ in range(2):
        report.append_log(str(tmp_path / "log"), "run", rows)
    assert (tmp_path / "log").read_text().count("UTC  run") == 2


def test_phases():
    phases = report.Phases()
    assert phases.bottleneck() is None and phases.rows() == []
    for name in ("build", "search", "build"):
        with phases(name):
            sum(range(200_000 if name == "build" else 10))
    assert phases.bottleneck() == "build" and [r["phase"] for r in phases.rows()] == ["build", "search"]
    assert abs(sum(r["share"] for r in phases.rows()) - 1) < 1e-9


def test_saved_results_and_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, score double")
    report.save_results(df, str(tmp_path / "r"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "r"))
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, 0.5)]
    (tmp_path / "d.jsonl").write_text('{"id": "1", "title": "T", "text": "a"}\n{"id": "2", "content": "b"}\n')
    assert [(r.id, r.title, r.content) for r in corpus.read_dump(spark, str(tmp_path / "d.jsonl")).orderBy("id").collect()] == [("1", "T", "a"), ("2", "", "b")]
    assert corpus.read_dump(spark, str(tmp_path / "d.jsonl"), 1).count() == 1
