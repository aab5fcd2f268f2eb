from leafwright import __main__ as cli
from leafwright.operators import images


def test_missing_images(spark):
    rows = [("a", "x ![p](f/1.png) y ![q](f/2.png)\n\n\n\n![r]( f/2.png ) z"), ("b", "![w](https://h/1.png) ![d](data:x)"), ("c", None), ("d", "none")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "id string, t string, target string")
    files = spark.createDataFrame([("f/1.png",), ("f/1.png",)], "target string")
    out = {r.id: r.t for r in images.without_missing_images(df, ["id"], "t", files).collect()}
    assert out == {"a": "x ![p](f/1.png) y \n\n z", "b": rows[1][1], "c": None, "d": "none"}
    assert images.without_missing_images(df.limit(0), ["id"], "t", files).count() == 0


def test_commands(spark, tmp_path, capsys):
    cli.main(["list"])
    assert "q_audit" in capsys.readouterr().out
    (tmp_path / "a.txt").write_text("short text")
    cli.main(["audit", str(tmp_path)])
    assert "low_word_count" in capsys.readouterr().out
