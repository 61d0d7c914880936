"""Sources, sinks, table maintenance (survey section 2.1)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.plans import bridge as B
from auditframe.session import scratch_path
from auditframe.sources import configs as G
from auditframe.sources import tables as R

from . import sqlkit as S
from .clauses import rule_inputs, RIN
from .registry import query

NAMED = "source || '_' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.png' WHEN 'de' THEN '.jpeg' ELSE '.docx' END"


@B.memo
def named(spark, sf):
    d = B.documents(spark, sf)
    ext = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".png").when(F.col("lang") == "de", ".jpeg").otherwise(".docx")
    return d.select("doc_id", "text", F.concat("source", F.lit("_"), "doc_id", ext).alias("name"))


@query("read_raw_files", f"""SELECT doc_id, name, sha256(raw) AS file_hash, '.' || lower(split_part(name, '.', 2)) AS suffix, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'image' WHEN 'de' THEN 'image' ELSE 'unknown' END AS file_type,
    lang IN ('fr', 'de') AS is_scanned, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'image' WHEN 'de' THEN 'image' ELSE 'unsupported' END AS pipeline FROM (SELECT *, {NAMED} AS name FROM docs)""")
def _(spark, sf):
    return R.route_texts(named(spark, sf), "name", "text").drop("text")


@query("skip_processed", """WITH i AS (SELECT doc_id, sha256(text) AS file_hash FROM documents), l AS (SELECT DISTINCT file_hash FROM i JOIN labels USING (doc_id)), m AS (SELECT file_hash, min(doc_id) AS lead_id FROM i GROUP BY file_hash)
    SELECT doc_id, file_hash, lead_id, CASE WHEN file_hash IN (SELECT file_hash FROM l) THEN 'reuse' WHEN doc_id = lead_id THEN 'extract' ELSE 'share' END AS action FROM i JOIN m USING (file_hash)""")
def _(spark, sf):
    i = B.load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return R.skip_processed(i, i.join(B.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query("response_ledger", """WITH r AS (SELECT conv_id, turn, sha256('{"role":' || to_json(role) || ',"text":' || to_json(text) || '}') AS fingerprint FROM conversations WHERE role = 'user'),
    a AS (SELECT fingerprint, arg_min(c.text, r.conv_id) AS stored_response FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1 WHERE r.turn = 0 GROUP BY fingerprint)
    SELECT conv_id, turn, fingerprint, stored_response, stored_response IS NOT NULL AS cached FROM r LEFT JOIN a USING (fingerprint)""")
def _(spark, sf):
    c = B.load(spark, sf, "conversations")
    reqs = c.where(F.col("role") == "user")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    led = reqs.where(F.col("turn") == 0).withColumn("fingerprint", R.fingerprint("role", "text")).join(nxt, ["conv_id", "turn"])
    led = led.groupBy("fingerprint").agg(F.min_by("response", "conv_id").alias("response"))
    return R.response_ledger(reqs, led, ["role", "text"]).select("conv_id", "turn", "fingerprint", "stored_response", "cached")


@query("load_pages", "SELECT task_id, page, string_agg(text, chr(10) ORDER BY block_no) AS page_text FROM blocks GROUP BY task_id, page")
def _(spark, sf):
    return R.load_pages(B.blocks(spark, sf))


@query("document_text", f"SELECT task_id, {S.clean_text('t')} AS text FROM (SELECT task_id, string_agg(p, chr(10) || chr(10) ORDER BY page) AS t FROM (SELECT task_id, page, string_agg(text, chr(10) ORDER BY block_no) AS p FROM blocks GROUP BY task_id, page) GROUP BY task_id)")
def _(spark, sf):
    return R.document_text(R.load_pages(B.blocks(spark, sf)))


@query("load_ocr_lines", """SELECT task_id, page, CASE WHEN block_no % 3 = 0 THEN 'remote_paddle_' || printf('%03d', page) || '_' || printf('%03d', i) ELSE block_id END AS line_id, trim(text) AS text,
    CASE WHEN block_no % 6 = 0 THEN 0 ELSE x END::BIGINT AS x, CASE WHEN block_no % 6 = 0 THEN 0 ELSE y END::BIGINT AS y, CASE WHEN block_no % 6 = 0 THEN 1 ELSE width END::BIGINT AS width, CASE WHEN block_no % 6 = 0 THEN 1 ELSE height END::BIGINT AS height, score,
    row_number() OVER (PARTITION BY task_id, page ORDER BY CASE WHEN block_no % 6 = 0 THEN 0 ELSE y END, CASE WHEN block_no % 6 = 0 THEN 0 ELSE x END, i) AS line_no
    FROM (SELECT *, row_number() OVER (PARTITION BY task_id, page ORDER BY block_no) AS i FROM blocks)""")
def _(spark, sf):
    b = B.blocks(spark, sf)
    n, j = F.col("block_no"), lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    rect = F.format_string("[%d,%d,%d,%d]", "x", "y", "width", "height")
    x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    poly = F.format_string("[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", "x", "y", x2, "y", x2, y2, "x", y2)
    box = F.when(n % 6 == 0, F.lit("")).when(n % 2 == 0, F.concat(F.lit('"bbox":'), rect, F.lit(","))).otherwise(F.concat(F.lit('"box":'), poly, F.lit(",")))
    ident = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit('"id":"'), "block_id", F.lit('",')))
    value = F.regexp_extract(j("text"), r'(?s)^\{"v":(.*)\}$', 1)
    obj = F.concat(F.lit("{"), ident, box, F.when(n % 2 == 0, '"text":').otherwise('"content":'), value, F.when(n % 2 == 0, ',"score":').otherwise(',"confidence":'), F.col("score").cast("string"), F.lit("}"))
    arr = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", obj.alias("o")))), lambda s: s["o"]), ",")
    p = b.groupBy("task_id", "page").agg(F.concat(F.lit("["), arr, F.lit("]")).alias("a"))
    wrap = F.when(F.col("page") % 3 == 0, F.concat(F.lit('{"lines":'), "a", F.lit("}"))).when(F.col("page") % 3 == 1, F.concat(F.lit('{"result":{"items":'), "a", F.lit("}}"))).otherwise(F.concat(F.lit('{"lines":[],"data":'), "a", F.lit("}")))
    return R.load_ocr_lines(p.select("task_id", "page", wrap.alias("payload")))


@query("load_model_candidates", """SELECT 'conv_' || conv_id AS task_id, turn AS reply_id, unnest([1, 2])::BIGINT AS item_no, unnest([role, 'second']) AS title, unnest([text, NULL]) AS reason FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 7 <> 0""")
def _(spark, sf):
    c = B.load(spark, sf, "conversations").where(F.col("role") == "assistant")
    k = (F.col("conv_id") + F.col("turn")) % 7
    items = F.to_json(F.array(F.struct(F.col("role").alias("title"), F.col("text").alias("reason")), F.struct(F.lit("second").alias("title"), F.lit(None).cast("string").alias("reason"))))
    key = F.when(k % 2 == 0, "auditFocuses").otherwise("audit_focuses")
    body = F.concat(F.lit('{"note":"x","'), key, F.lit('":'), items, F.lit("}"))
    raw = (F.when(k == 0, F.lit("no json here"))
           .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(k == 2, F.concat(F.lit("Result: "), body, F.lit(" done")))
           .when(k == 3, F.concat(body, F.lit("} trailing {broken")))
           .otherwise(body))
    return R.load_model_candidates(c.select(F.concat(F.lit("conv_"), "conv_id").alias("task_id"), F.col("turn").alias("reply_id"), raw.alias("raw_text")), ["auditFocuses", "audit_focuses"], ["title", "reason"])


@query("load_decision_table", f"""WITH {RIN}, d AS (SELECT * FROM {S.values([(r[3], r[4], r[5]) for r in P.DECISION_RULES])} t(rule_id, rule_name, severity))
    SELECT rule_id, rule_name, severity, count_if(CASE rule_id WHEN 'missing_contract_number' THEN number IS NULL WHEN 'payment_without_acceptance_gate' THEN hasPaymentClause AND NOT hasAcceptanceClause WHEN 'missing_breach_clause' THEN NOT hasBreachClause
      WHEN 'missing_account_info' THEN account IS NULL ELSE amount IS NOT NULL AND NOT hasPaymentClause END)::BIGINT AS n_hits FROM d, ri GROUP BY ALL""")
def _(spark, sf):
    from auditframe.operators.rules import eval_decision_table
    t = G.default_decision_table(spark)
    n = eval_decision_table(rule_inputs(spark, sf), P.DECISION_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "rule_id", "left").select("rule_id", "rule_name", "severity", F.coalesce("n", F.lit(0)).alias("n_hits"))


@query("load_audit_configs", f"""SELECT id, name, config_type, count(clause_id)::BIGINT AS n_expected FROM {S.values([(c[1], c[2], c[7], c[10]) for c in P.AUDIT_CONFIGS])} t(id, name, config_type, ex) LEFT JOIN clauses ON list_contains(ex, core_label) GROUP BY ALL""")
def _(spark, sf):
    cfg = G.load_audit_configs(spark)
    want = cfg.select("id", F.explode("expected_clauses").alias("core_label"))
    n = B.clauses(spark, sf).groupBy("core_label").agg(F.count(F.lit(1)).alias("n"))
    got = want.join(n, "core_label").groupBy("id").agg(F.sum("n").alias("n"))
    return cfg.join(got, "id", "left").select("id", "name", "config_type", F.coalesce("n", F.lit(0)).alias("n_expected"))


@B.memo
def config_tables(spark, sf):
    d = B.load(spark, sf, "documents").select(F.concat(F.lit("cfg_"), "doc_id").alias("id"), F.col("doc_id").alias("position"), F.col("source").alias("name"))
    lab = B.load(spark, sf, "labels").select("doc_id", F.concat(F.lit("label_"), "quality").alias("name"))
    new = lab.select(F.concat(F.lit("cfg_"), "doc_id").alias("id"), F.col("doc_id").alias("position"), "name")
    added = lab.select(F.concat(F.lit("new_"), "doc_id").alias("id"), F.col("doc_id").alias("position"), "name")
    return d, new.unionByName(added)


@query("config_upsert", """SELECT 'cfg_' || d.doc_id AS id, d.doc_id AS position, coalesce('label_' || quality, source) AS name FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'new_' || doc_id, (SELECT max(doc_id) FROM documents) + doc_id, 'label_' || quality FROM labels""")
def _(spark, sf):
    return R.config_upsert(*config_tables(spark, sf), "id", "position")


@query("config_delete", "SELECT 'cfg_' || doc_id AS id, doc_id AS position, source AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return R.config_delete(*config_tables(spark, sf), "id")


@query("kb_documents_list", "SELECT document_id, created_at, row_number() OVER (ORDER BY created_at DESC, document_id) AS pos FROM kb_docs")
def _(spark, sf):
    d = R.kb_documents_list(B.kb_documents(spark, sf))
    # position check without a global window: ids follow creation time one to one
    n = B.kb_documents(spark, sf).agg(F.max("created_at").alias("m"))
    return d.join(F.broadcast(n)).select("document_id", "created_at", ((F.col("m") - F.col("created_at")) / 60 + 1).cast("long").alias("pos"))


@query("kb_document_upsert", "SELECT document_id, name, CASE WHEN quality = 0 THEN 'expired' ELSE status END AS status, effective_ts FROM kb_docs LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    ch = B.load(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.when(F.col("quality") == 0, "expired").alias("status"), F.lit(None).cast("string").alias("name"))
    return R.patch(B.kb_documents(spark, sf), ch, "document_id", ["status", "name"]).select("document_id", "name", "status", "effective_ts")


@query("kb_clauses_write", "SELECT doc_type, document_id, count(*)::BIGINT AS n FROM kb GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "kb_clauses_write")
    R.kb_clauses_write(B.kb_clauses(spark, sf), path)
    return spark.read.parquet(path).groupBy("doc_type", "document_id").agg(F.count(F.lit(1)).alias("n"))


@query("kb_clauses_list", "SELECT clause_id, template_id, page_start, clause_no FROM kb WHERE doc_type = 'template' ORDER BY coalesce(template_id, ''), page_start, clause_no, clause_id")
def _(spark, sf):
    return R.kb_clauses_list(B.kb_clauses(spark, sf), doc_type="template").select("clause_id", "template_id", "page_start", "clause_no")


@query("kb_clause_get", "SELECT clause_id, title, content FROM kb WHERE clause_id = 'kc_5_1'")
def _(spark, sf):
    return R.kb_clause_get(B.kb_clauses(spark, sf), "kc_5_1").select("clause_id", "title", "content")


RULE_ROWS = "rr AS (SELECT 'RULE_' || (doc_id % 97) AS rule_id, document_id AS source_document_id, doc_id AS written, doc_id % 2 = 0 AS enabled FROM kb_docs)"


@B.memo
def rule_rows(spark, sf):
    return B.kb_documents(spark, sf).select(F.concat(F.lit("RULE_"), F.col("doc_id") % 97).alias("rule_id"), F.col("document_id").alias("source_document_id"), F.col("doc_id").alias("written"), (F.col("doc_id") % 2 == 0).alias("enabled"))


@query("rules_upsert", f"WITH {RULE_ROWS} SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY written DESC) = 1")
def _(spark, sf):
    r = rule_rows(spark, sf)
    return R.rules_upsert(r.where(~F.col("enabled")), r.where("enabled"))


@query("rules_list", f"WITH {RULE_ROWS} SELECT rule_id, written FROM rr ORDER BY rule_id")
def _(spark, sf):
    return R.rules_list(rule_rows(spark, sf)).select("rule_id", "written")


@query("rules_delete", f"WITH {RULE_ROWS} SELECT * FROM rr WHERE rule_id NOT IN (SELECT 'RULE_' || (doc_id % 97) FROM labels WHERE quality = 0)")
def _(spark, sf):
    gone = B.load(spark, sf, "labels").where("quality = 0").select(F.concat(F.lit("RULE_"), F.col("doc_id") % 97).alias("rule_id"))
    return R.delete_ids(rule_rows(spark, sf), gone, "rule_id")


@query("rules_by_source", f"WITH {RULE_ROWS} SELECT rule_id, source_document_id FROM rr WHERE source_document_id = 'doc_7'")
def _(spark, sf):
    return R.rules_by_source(rule_rows(spark, sf), "doc_7").select("rule_id", "source_document_id")


@query("source_tasks", "SELECT 'task_' || d.doc_id AS task_id, quality::BIGINT AS result FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    lab = B.load(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("result"))
    t = B.documents(spark, sf).join(lab, "doc_id", "left").withColumn("created_at", F.col("doc_id"))
    return R.source_tasks(t).select("task_id", "result")


@query("page_lookup", "SELECT task_id, page, string_agg(text, chr(10) ORDER BY block_no) AS page_text FROM blocks WHERE task_id = 'task_3' AND page = 1 GROUP BY ALL")
def _(spark, sf):
    return R.page_lookup(R.load_pages(B.blocks(spark, sf)), "task_3", 1)


@query("evidence_lookup", "SELECT task_id, 'ev_' || core_label AS evidence_id, min(page) AS page, arg_min(block_id, page * 1000000 + block_no) AS block_id FROM blocks GROUP BY ALL")
def _(spark, sf):
    e = B.blocks(spark, sf).select("task_id", F.concat(F.lit("ev_"), "core_label").alias("evidence_id"), "page", F.col("block_no").alias("segment_index"), "block_id")
    return R.evidence_lookup(e).select("task_id", "evidence_id", "page", "block_id")


@query("export_results", """SELECT d.task_id, (SELECT count(*) FROM clauses c WHERE c.task_id = d.task_id)::BIGINT AS n_clauses, (SELECT count(*) FROM key_facts f WHERE f.task_id = d.task_id)::BIGINT AS n_facts,
    (SELECT arg_min(clause_id, sort_order) FROM clauses c WHERE c.task_id = d.task_id) AS first_clause FROM docs d""")
def _(spark, sf):
    c = B.clauses(spark, sf).select("task_id", "clause_id", "label", "summary", "sort_order")
    f = B.key_facts(spark, sf).select("task_id", "fact_id", "label", "value", "sort_order")
    out = R.export_results(B.documents(spark, sf).select("task_id", "file_name"), {"clauses": (c, ["sort_order"]), "key_facts": (f, ["sort_order"])})
    n = lambda k: F.coalesce(F.json_array_length(F.get_json_object("bundle", f"$.{k}")), F.lit(0))
    return out.select("task_id", n("clauses").alias("n_clauses"), n("key_facts").alias("n_facts"), F.get_json_object("bundle", "$.clauses[0].clause_id").alias("first_clause"))


@query("persist_tasks", "SELECT 'task_' || doc_id AS task_id, source || '_' || doc_id || '.' || lang AS file_name, doc_id AS created_at FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "persist_tasks")
    R.persist_tasks(B.documents(spark, sf).select("task_id", "file_name", F.col("doc_id").alias("created_at")), path)
    return R.load_tasks(spark, path, "task_id string, file_name string, created_at long")


@query("write_reports", "SELECT 'contract_task_' || doc_id AS contract_id, source AS summary FROM documents WHERE doc_id = 7")
def _(spark, sf):
    path = scratch_path(spark, "write_reports")
    R.write_reports(B.documents(spark, sf).select(F.concat(F.lit("contract_"), "task_id").alias("contract_id"), F.col("source").alias("summary")), path)
    return R.read_report(spark, path, "contract_task_7")
