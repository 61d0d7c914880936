"""Composed jobs over a whole corpus.  Tables read by several later steps are staged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clauses as C
from ..operators import compare as K
from ..operators import issues as I
from ..operators import registry as G
from ..operators import retrieval as V
from ..operators import rules as R
from ..operators import structure as S
from ..session import stage


def ingest_corpus(policies: DataFrame, templates: DataFrame, dim: int = 1536) -> dict[str, DataFrame]:
    """Knowledge documents -> clauses with vectors and rule drafts."""
    pc, drafts = G.ingest_policies(policies, dim)
    return {"policy_clauses": pc, "template_clauses": G.ingest_templates(templates, dim), "rule_drafts": drafts}


def evaluate_rules(tasks: DataFrame, sections: DataFrame, clauses: DataFrame, facts: DataFrame, configs: DataFrame, available: DataFrame, table=None) -> dict[str, DataFrame]:
    """Decision rules on stored results, with the reconciliation of configurations and matches."""
    inputs = C.rule_input(tasks, sections, clauses, facts)
    raw = R.eval_decision_table(inputs, table) if table else R.eval_decision_table(inputs)
    matches = stage(R.decision_matches(raw, configs))
    missing = R.missing_configured(configs, available)
    unmatched = R.unmatched_returned(matches, configs)
    status = R.engine_status(tasks, configs, tasks, missing, unmatched)
    return {"matches": matches, "missing": missing, "unmatched": unmatched, "status": status, "exec": R.rule_exec_status(status, configs, matches, missing)}


def analyze_corpus(blocks: DataFrame, tasks: DataFrame, configs: DataFrame, available: DataFrame) -> dict[str, DataFrame]:
    """Blocks -> sections -> clauses -> facts -> evidence, decision rules, focuses, verification, confidence."""
    sections = stage(S.reconstruct_sections(blocks))
    clauses = stage(C.clause_dedupe(C.anchor_clauses(blocks, sections)).withColumn("structured_fields", F.create_map().cast("map<string,string>")))
    facts = stage(C.extract_key_facts(blocks, clauses))
    rules = evaluate_rules(tasks, sections, clauses, facts, configs, available)
    focuses = stage(I.generate_focuses(I.focuses_from_rules(rules["exec"], clauses), None, I.focuses_from_relations(clauses, configs)))
    items = I.verification([I.verify_required(tasks, clauses), I.verify_keywords(clauses), I.verify_confidence(clauses), I.verify_external(focuses), I.verify_structure(sections),
                            I.verify_engine(rules["status"], rules["matches"], rules["missing"], rules["unmatched"], clauses)])
    return {"sections": sections, "clauses": clauses, "facts": facts, "focuses": focuses, "verification": items, "clause_links": I.clause_focus_links(clauses, focuses),
            "confidence": I.confidence_overview(tasks, sections, clauses, focuses), "evidence": K.attach_evidence(K.evidence_targets(sections, clauses, facts), blocks), **rules}


def review_corpus(tasks: DataFrame, sections: DataFrame, clauses: DataFrame, facts: DataFrame, kb: DataFrame, rules: DataFrame, day: int, dim: int = 1536) -> dict[str, DataFrame]:
    """Classify, extract the schema, match and compare templates, run rules, collect issues with their basis, report, suggest clauses."""
    categories = stage(C.classify_contract(tasks, sections, facts, clauses))
    fields = stage(C.schema_fields(C.contract_schema(facts, clauses), tasks))
    titles = clauses.groupBy("task_id").agg(F.array_sort(F.collect_list("title")).alias("keywords"))
    flags = C.profile_flags(categories, fields, clauses)
    sig = stage(V.contract_signatures(categories.select("task_id", "category").join(titles, "task_id", "left").join(flags, "task_id").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))))
    matched = stage(V.template_match(sig, V.template_topk(sig, kb, day)))
    templates = kb.where(F.col("template_id").isNotNull())
    match = stage(K.best_clause_match(clauses, templates, matched))
    missing, weakened = K.missing_clauses(match), K.weakened_clauses(match)
    con = categories.select("task_id", "category").join(fields, "task_id").join(
        matched.select("task_id", "template_id", "template_name", F.coalesce("category_lv1", "category_lv2").alias("template_category")), "task_id", "left").join(R.outdated_tasks(missing), "task_id", "left")
    hits = R.run_rules(con, rules)
    first = lambda df: df.groupBy("task_id", "title").agg(F.min("template_ord").alias("template_ord"))  # noqa: E731  (of equal titles an issue names the first; chosen before texts are made)
    issues = stage(I.issues(I.issues_missing(first(missing), fields, matched), I.issues_weakened(first(weakened), matched), I.issues_rules(hits, matched)))
    pool = V.effective_on(kb.where(F.col("doc_type") == "policy"), day)
    full = stage(I.with_basis(issues, pool, templates))
    report = I.report_summary(issues, con.select("task_id", "category", "template_id"))
    # suggestions depend only on the category, so each distinct category is searched once
    queries = categories.select(F.col("category").alias("query_id"), F.col("category").alias("query")).distinct().withColumn("vector", X.hash_embedding("query", dim))
    found = V.hybrid_topk(kb, queries, 5, day, ("title",)).withColumnRenamed("query_id", "category")
    return {"categories": categories, "matched": matched, "comparison": match, "additional": K.additional_clauses(clauses, match), "issues": full, "report": report,
            "suggestions": categories.select("task_id", "category").join(found, "category")}


def audit_corpus(blocks: DataFrame, tasks: DataFrame, kb: DataFrame, configs: DataFrame, available: DataFrame, rules: DataFrame, day: int, dim: int = 1536) -> dict[str, DataFrame]:
    """Analysis and review of every contract, with focuses and verification items merged by id."""
    a = analyze_corpus(blocks, tasks, configs, available)
    r = review_corpus(tasks, a["sections"], a["clauses"], a["facts"].withColumn("ord", F.col("ord")), kb, rules, day, dim)
    kb_focus = I.focuses_from_issues(r["issues"])
    cols = ["task_id", "focus_id", "title", "focus_source", "risk_level", "confidence", "location", "review"]
    merged = I.merge_by_id("focus_id", a["focuses"].select(*cols), kb_focus.select(*cols))
    items = I.merge_by_id("item_id", a["verification"], I.verify_issues(r["issues"]))
    return {**a, **r, "focuses": merged, "verification": items}
