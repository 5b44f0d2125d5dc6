import pytest

from tarnflow import cli


def test_programs(spark, tmp_path, capsys):
    (tmp_path / "words").write_text("a b a\nc a\n")
    (tmp_path / "links").write_text("0 1\n1 2\n2 0\n")
    (tmp_path / "roads").write_text("0 1 2.5\n1 2 1.5\n0 2 9\n")
    out = lambda name: spark.read.parquet(f"{tmp_path}/{name}.out")
    run = lambda name, *words: cli.main([name, *words, "--output", f"{tmp_path}/{name}.out"], spark)
    assert run("wordcount", "--input", f"{tmp_path}/words") == 0
    assert {tuple(r) for r in out("wordcount").collect()} == {("a", 3), ("b", 1), ("c", 1)}
    run("pagerank", "--input", f"{tmp_path}/links", "--iterations", "3", "--checkpoint-every", "2")
    assert {r.dk: round(r.dv, 6) for r in out("pagerank").collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    run("sssp", "--input", f"{tmp_path}/roads")
    assert {r.dk: r.dv for r in out("sssp").collect()} == {0: 0.0, 1: 2.5, 2: 4.0}
    run("query", "--name", "distinct", "--data", "/root/testdata/sf0.001")
    assert out("query").count() > 0
    with pytest.raises(Exception, match="(?i)exists"):
        run("wordcount", "--input", f"{tmp_path}/words")
    assert cli.main([]) == 2 and "wordcount" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["grep", "--input", "x", "--output", "y"])
