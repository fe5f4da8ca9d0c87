import json

import pytest

from sievelake.operators import snapshots as S
from sievelake.operators.cues import Lexicon, Reading, Step
from sievelake.operators.diff import ComparisonError
from sievelake.operators.metrics import chosen_labels


def test_loading(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    good = lambda topic, version="b5": json.dumps({"topic": topic, "query": "q", "schema_version": version, "articles": [{"pmid": "1"}]})
    a, b, c = (S.load_snapshot(spark, put(n, good(x))) for n, x in (("a", "t"), ("b", "t "), ("c", "u")))
    S.check_versions(a, b)
    assert S.require_comparable(a, b).first().query_status == "same"
    for run, code in (
        (lambda: S.require_comparable(a, c), "incomparable_snapshots"),
        (lambda: S.load_snapshot(spark, put("d", "{")), "snapshot_unreadable"),
        (lambda: S.load_snapshot(spark, put("e", "[1]")), "malformed_snapshot"),
        (lambda: S.load_snapshot(spark, f"file://{tmp_path}/none"), "snapshot_not_found"),
        (lambda: S.check_versions(S.load_snapshot(spark, put("f", good("t", "b4")))), "unsupported_version"),
        (lambda: S.check_versions(S.load_snapshot(spark, put("g", "{}"))), "malformed_snapshot"),
    ):
        with pytest.raises(ComparisonError) as e:
            run()
        assert e.value.code == code


def test_labels(spark):
    rows = spark.createDataFrame([(1, "draft", "direct"), (2, "draft", None)], "id int, status string, gold string")
    assert [r.id for r in chosen_labels(rows, "status", "gold").collect()] == [1]
    with pytest.raises(ValueError):
        chosen_labels(rows, "status", "gold", official=True)


def test_cues():
    read = Reading("Seen, then given X. Given for long", Lexicon({"a": ("seen",), "b": ("given",), "c": ("for long",)}))
    assert read.said(Step("a"), Step("b", 20)) == "Seen, then given" and read.said(Step("a"), Step("b", 3)) is None
    assert read.said(Step("b"), Step("c")) == "Given for long" and read.chain(Step("a"), Step("c", 99)) is None
