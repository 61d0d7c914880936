import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["task_id", "severity", "n_issues"] and df.count() > 0


def test_composed_jobs_return_the_rows_of_their_operators(spark):
    import json

    rows = entry.queries()["analyze_corpus"](spark, entry.SMALL).collect()
    of = lambda n: [r for r in rows if r["result"] == n]
    alone = entry.queries()["reconstruct_sections"](spark, entry.SMALL).collect()
    same = [(r["task_id"], r["item_id"], r["title"], json.loads(r["value"])["page"], json.loads(r["value"])["summary"]) for r in of("sections")]
    assert sorted(same) == sorted((r["task_id"], r["section_id"], r["title"], r["page"], r["summary"]) for r in alone)
    blocks = {}
    for r in suite_blocks(spark).collect():
        blocks.setdefault((r["task_id"], r["page"]), []).append(r["text"])
    # clauses and located evidence are texts of their page, and every fact stands once
    assert of("clauses") and all((r["task_id"], json.loads(r["value"])["page"]) in blocks for r in of("clauses"))
    assert of("evidence") and all((r["task_id"], json.loads(r["value"])["page"]) in blocks for r in of("evidence"))
    facts = [(r["task_id"], r["title"], json.loads(r["value"])["value"], json.loads(r["value"])["page"]) for r in of("facts")]
    assert facts and len(facts) == len(set(facts))
    assert {r["task_id"] for r in of("exec")} == {t for t, _ in blocks}


def suite_blocks(spark):
    from auditframe.plans import bridge

    return bridge.blocks(spark, entry.SMALL)
