import json

from pyspark.sql import functions as F

from sievelake.__main__ import main
from sievelake.operators.report import change_lines, section_lines, write_report


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", "key_evidence", 1, "A <b> *x*", "not_reported"), ("t", "audit_only", 2, "B\nC", "usual_care")], "topic_id string, section string, rank int, title string, arm string")
    for style, want in (("markdown", "- **A &lt;b&gt; \\*x\\*** Arm: Not reported"), ("html", "<article><h3>A &lt;b&gt; *x*</h3><p>Arm: Not reported</p></article>")):
        lines = section_lines(rows, ["topic_id"], "title", {"Arm": "arm"}, style)
        write_report(lines, f"file://{tmp_path}/r-{style}", ["section_place", "kind", "rank"], "T", style)
        text = (tmp_path / f"r-{style}").read_text()
        assert want in text and text.index("Key evidence (1)") < text.index("A &lt;") < text.index("Audit only (1)")


def test_change_lines(spark):
    rows = spark.createDataFrame([(4, "study", "changed", "a.b", None, "x|y", "1"), (4, "study", "added", "c", "u", "v", "0")], "priority int, category string, change_type string, field_path string, baseline string, target string, change_id string").withColumn("pmid", F.lit("7"))
    lines = [r.line for r in change_lines(rows, "pmid").orderBy("priority", "category", "kind", "change_id").collect()]
    assert lines == ["## study (2)", "- 7: added c, u to v", "- 7: changed a.b, none to x\\|y"]


def test_command_line(spark, tmp_path, capsys):
    for name, topic in (("a", "t"), ("b", "u")):
        (tmp_path / name).write_text(json.dumps({"topic": topic, "query": "q", "schema_version": "b5", "articles": []}))
    assert main(["compare", f"file://{tmp_path}/a", f"file://{tmp_path}/a"]) == 0 and '"same_topic"' in capsys.readouterr().out
    assert main(["compare", f"file://{tmp_path}/a", f"file://{tmp_path}/b"]) == 2 and "incomparable_snapshots" in capsys.readouterr().out
    assert main(["query", "html_escape", "--data", "/root/testdata/sf0.001", "--save", f"file://{tmp_path}/out"]) == 0
