import json

import pytest

from sievelake.__main__ import main


@pytest.fixture
def files(tmp_path):
    def article(pmid, **more):
        return {"pmid": pmid, "title": f"T{pmid}", "final_evidence_rank": int(pmid)} | more

    def put(name, articles, **more):
        (tmp_path / name).write_text(json.dumps({"topic": "t", "query": "q", "schema_version": "b5", "articles": articles} | more))
        return f"file://{tmp_path}/{name}"

    return put("a", [article("1"), article("2")]), put("b", [article("2", final_evidence_rank=9), article("3")]), put("c", [], topic="other")


def test_compare_prints_every_change(spark, files, capsys, tmp_path):
    a, b, c = files
    assert main(["compare", a, b]) == 0
    about, *changes = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert about["scope"] == "same_topic" and not about["identical_content"] and len(about["comparison_id"]) == 64
    assert [(x["category"], x["change_type"], x["key"]) for x in changes] == [("membership", "added", "3"), ("membership", "removed", "1"), ("ranking", "rank_changed", "2")]
    assert main(["compare", a, a, "--save", f"file://{tmp_path}/out"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["identical_content"]
    assert main(["compare", a, c]) == 2 and json.loads(capsys.readouterr().out.splitlines()[-1])["error"] == "incomparable_snapshots"


def test_triage_saves_decisions_and_prints_counters(spark, capsys, tmp_path):
    rows = [{"pmid": "1", "title": "Acyclovir in herpes", "abstract": "Safety in patients.", "retrieval_pos": 0, "publication_types": [], "mesh_descriptors": [], "keywords": [], "abstract_sections": [], "integrity_relations": []}]
    (tmp_path / "in.json").write_text("\n".join(json.dumps(r) for r in [*rows, rows[0] | {"retrieval_pos": 1}, rows[0] | {"pmid": "2", "title": "Rain", "abstract": ""}]))
    code = main(["triage", "--articles", f"file://{tmp_path}/in.json", "--topic", "acyclovir for herpes safety", "--intervention", "acyclovir", "--condition", "herpes", "--fetched-at", "2024-01-01", "--save", f"file://{tmp_path}/out"])
    said = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1])
    assert code == 0 and said["raw_candidate_count"] == 3 and said["candidate_count"] == 2 and said["included_count"] == 1 and said["excluded_irrelevant_count"] == 1
    saved = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["pmid"]: r["decision"] for r in saved} == {"1": "included_direct", "2": "excluded_irrelevant"}
