"""Retrieval, ranking, top-k (survey section 2.5)."""

from pyspark.sql import functions as F

from auditframe import params as P
from auditframe.functions import text as X
from auditframe.operators import clauses as C
from auditframe.operators import retrieval as V
from auditframe.plans import bridge as B
from auditframe.session import stage

from . import sqlkit as S
from .clauses import HAY, PROFILE, classified, schema
from .registry import query
from .sqlkit import DAY

LIVE = S.live()

# keyword queries: the three longest distinct words of each benchmark item, plus a clause word for every third item
QSQL = f"""qw AS (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[{S.WS}]+'), lambda x: x <> '') AS ws FROM benchmark)) GROUP BY ALL),
    qs AS (SELECT item_id AS query_id, string_agg(w, ' ' ORDER BY r) || ' ' || CASE item_id % 3 WHEN 0 THEN '付款条件 付款条件' WHEN 1 THEN '仲裁 第三条' ELSE '' END AS query FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, p) AS r FROM qw) WHERE r <= 3 GROUP BY item_id),
    qt AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(query, '[{S.WS}]+'), lambda x: x <> '')) AS term FROM qs) GROUP BY ALL)"""


@B.memo
def keyword_queries(spark, sf):
    b = B.load(spark, sf, "benchmark")
    words = F.array_distinct(F.filter(F.split("text", f"[{X.WS}]+", -1), lambda x: x != ""))
    ranked = F.slice(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("p"), w.alias("w")))), 1, 3)
    extra = F.when(F.col("item_id") % 3 == 0, "付款条件 付款条件").when(F.col("item_id") % 3 == 1, "仲裁 第三条").otherwise("")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.array_join(F.transform(ranked, lambda s: s["w"]), " "), F.lit(" "), extra).alias("query"))


# the order of equal scores: the place of a clause in the list of all
PLACE = "coalesce(template_id, '') AS k1, page_start AS k2, clause_no AS k3"


def lex(where, k):
    return f"""lx AS (SELECT query_id, clause_id, k1, k2, k3, sum(weight) AS score FROM qt JOIN (SELECT clause_id, {PLACE}, title || chr(10) || content AS h FROM kb WHERE {where}) ON contains(h, term) GROUP BY ALL),
    lt AS (SELECT query_id, clause_id, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k1, k2, k3, clause_id) AS rank FROM lx QUALIFY rank <= {k})"""


@query("effective_on", f"SELECT clause_id, status FROM kb WHERE {LIVE}")
def _(spark, sf):
    return V.effective_on(B.kb_clauses(spark, sf), DAY).select("clause_id", "status")


@query("lexical_topk", f"WITH {QSQL}, {lex('TRUE', 10)} SELECT * FROM lt")
def _(spark, sf):
    return V.lexical_topk(B.kb_clauses(spark, sf), keyword_queries(spark, sf), 10)


@query("lexical_topk_by_category", f"""WITH {QSQL}, {lex(LIVE + " AND doc_type = 'template' AND category_lv1 = '服务合同类'", 10)} SELECT * FROM lt""")
def _(spark, sf):
    return V.lexical_topk(B.kb_clauses(spark, sf), keyword_queries(spark, sf), 10, day=DAY, doc_type="template", category_lv1="服务合同类")


@query("policy_search", f"""WITH {QSQL}, {lex(LIVE + " AND doc_type = 'policy'", 5)} SELECT * FROM lt""")
def _(spark, sf):
    return V.policy_search(B.kb_clauses(spark, sf), keyword_queries(spark, sf), DAY)


def hash_vec(x, n=32):
    return f"list_transform(range({n}), lambda i: ('0x' || substr(sha256({S.strip(x)}), i * 2 + 1, 2))::INT / 255.0::DOUBLE * 2 - 1)"


COS = "CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0.0::DOUBLE ELSE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) END"


@query("vector_topk", f"""WITH q AS (SELECT item_id AS query_id, list_concat({hash_vec('text')}, {hash_vec("reverse(text)")}) AS v FROM benchmark), e AS (SELECT vec_id AS clause_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s AS (SELECT query_id, clause_id, round({COS}, 9) AS score FROM q a, e b) SELECT query_id, clause_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, clause_id) AS rank FROM s QUALIFY rank <= 5""")
def _(spark, sf):
    q = B.load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(X.hash_embedding("text", 32), X.hash_embedding(F.reverse("text"), 32)).alias("vector"))
    e = B.load(spark, sf, "embeddings").select(F.col("vec_id").alias("clause_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return V.vector_topk(e, q, 5)


@query("hybrid_topk", f"""WITH {QSQL}, {lex(LIVE + " AND doc_type = 'policy'", 5)}, a AS (SELECT query_id, {hash_vec('query')} AS v FROM qs), b AS (SELECT clause_id, {PLACE}, {hash_vec("(title || chr(10) || content)")} AS v FROM kb WHERE {LIVE}),
    sv AS (SELECT query_id, clause_id, k1, k2, k3, round({COS}, 9) AS score FROM a, b), vt AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k1, k2, k3, clause_id) <= 5),
    u AS (SELECT query_id, clause_id, sum(score) AS score FROM (SELECT query_id, clause_id, (6 - rank)::DOUBLE AS score FROM lt UNION ALL SELECT query_id, clause_id, score FROM vt) GROUP BY ALL)
    SELECT query_id, clause_id, round(u.score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY u.score DESC, k1, k2, k3, clause_id) AS rank FROM u JOIN (SELECT clause_id, {PLACE} FROM kb) USING (clause_id) QUALIFY rank <= 5""")
def _(spark, sf):
    kb = B.kb_clauses(spark, sf).withColumn("vector", X.hash_embedding(X.joined("title", "content"), 32))
    q = keyword_queries(spark, sf).withColumn("vector", X.hash_embedding("query", 32))
    return V.hybrid_topk(kb, q, 5, DAY)


SIG = f"""{PROFILE}, kw AS (SELECT task_id, list(title ORDER BY title) AS keywords FROM (SELECT task_id, title FROM clauses) GROUP BY task_id),
    fl AS (SELECT task_id, list_filter([{", ".join(f"CASE WHEN {S.has('profile', w)} THEN '{k}' END" for k, w in P.PROFILE_WORDS.items())}], lambda v: v IS NOT NULL) AS flags FROM prof),
    sg AS (SELECT task_id, category, coalesce(keywords, []) AS keywords, flags FROM cls LEFT JOIN kw USING (task_id) JOIN fl USING (task_id)),
    sd AS (SELECT sha256(category || chr(31) || array_to_string(keywords, chr(30)) || chr(31) || array_to_string(flags, chr(30))) AS signature, * FROM sg),
    tc AS (SELECT * FROM kb WHERE doc_type = 'template' AND {LIVE}),
    ss AS (SELECT DISTINCT signature, category, keywords, flags FROM sd),
    tw AS (SELECT keyword, template_id, count(*) AS n FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM ss) JOIN tc ON contains(title, keyword) OR contains(content, keyword) GROUP BY ALL),
    tn AS (SELECT category, template_id, 3.0::DOUBLE * count(*) AS s FROM (SELECT DISTINCT category FROM ss) JOIN tc ON contains(coalesce(category_lv1, ''), category) OR contains(coalesce(category_lv2, ''), category) GROUP BY ALL),
    tcd AS (SELECT signature, template_id, sum(s) AS score FROM (SELECT signature, template_id, n::DOUBLE AS s FROM (SELECT signature, unnest(keywords) AS keyword FROM ss) JOIN tw USING (keyword) UNION ALL SELECT signature, template_id, s FROM ss JOIN tn USING (category)) GROUP BY ALL),
    ti AS (SELECT template_id, min(template_name) AS template_name, min(category_lv1) AS category_lv1, min(category_lv2) AS category_lv2 FROM tc GROUP BY template_id)"""


@B.memo
def signatures(spark, sf):
    categories = stage(classified(spark, sf))  # read twice
    fields = C.schema_fields(schema(spark, sf), B.documents(spark, sf))
    flags = C.profile_flags(categories, fields, B.clauses(spark, sf))
    kw = B.clauses(spark, sf).groupBy("task_id").agg(F.array_sort(F.collect_list("title")).alias("keywords"))
    s = categories.select("task_id", "category").join(kw, "task_id", "left").join(flags, "task_id")
    return V.contract_signatures(s.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))))


@query("template_candidates", f"WITH {SIG} SELECT signature, template_id, template_name, category_lv1, category_lv2, score FROM tcd JOIN ti USING (template_id)")
def _(spark, sf):
    return V.template_candidates(signatures(spark, sf), B.kb_clauses(spark, sf), DAY)


def _adj():
    cond = []
    for _, flag, present, colname, word, exact, pts, _r in P.TEMPLATE_ADJUSTMENTS:
        t = f"coalesce({colname}, '') = '{word}'" if exact else f"contains(coalesce({colname}, ''), '{word}')"
        cond.append((f"list_contains(flags, '{flag}') = {S.q(present)} AND {t}", pts, _r))
    return " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END" for c, p, _ in cond), "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {S.q(r)} END" for c, _, r in cond) + "], lambda v: v IS NOT NULL), '|')"


ADJ, REASONS = _adj()
RESC = f"{SIG}, rs AS (SELECT signature, template_id, template_name, category_lv1, category_lv2, score AS base_score, score + {ADJ} AS score, {REASONS} AS reasons FROM tcd JOIN ti USING (template_id) JOIN ss USING (signature))"


@B.memo
def rescored(spark, sf):
    s = signatures(spark, sf)
    return s, V.rescored_candidates(s, B.kb_clauses(spark, sf), DAY)


@query("template_rescore", f"WITH {RESC} SELECT * FROM rs")
def _(spark, sf):
    return rescored(spark, sf)[1]


MATCH = f"""{RESC}, t5 AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY score DESC, template_id) AS rank FROM rs QUALIFY rank <= 5),
    man AS (SELECT 'task_' || doc_id AS task_id, 'tpl_' || doc_id AS template_id FROM labels WHERE quality = 0),
    al AS (SELECT template_id, min(template_name) AS template_name, min(category_lv1) AS category_lv1, min(category_lv2) AS category_lv2 FROM kb WHERE template_id IS NOT NULL GROUP BY template_id),
    cho AS (SELECT 'task_' || doc_id AS task_id, 'tpl_' || (doc_id + 1) AS c, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.8 END AS f FROM labels),
    u AS (SELECT task_id, CASE WHEN c = template_id AND f >= 0.55 THEN 1 ELSE 2 END AS tier, rank, template_id, template_name, category_lv1, category_lv2, score, CASE WHEN c = template_id AND f >= 0.55 THEN 'llm_rerank' ELSE 'heuristic_top_candidate' END AS match_reason, CASE WHEN c = template_id AND f >= 0.55 THEN f ELSE 0.5 END::DOUBLE AS match_confidence FROM sd JOIN t5 USING (signature) LEFT JOIN cho USING (task_id)
      UNION ALL SELECT task_id, 0, 0, template_id, template_name, category_lv1, category_lv2, 999, 'manual_selected', NULL FROM man JOIN al USING (template_id)),
    mt AS (SELECT * EXCLUDE (tier, rank) FROM u QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY tier, rank) = 1)"""


@B.memo
def matches(spark, sf):
    s = stage(signatures(spark, sf))
    kb = stage(B.kb_clauses(spark, sf).where(F.col("template_id").isNotNull()).drop("clause_type", "core_label"))  # read several times
    lab = B.load(spark, sf, "labels")
    manual = lab.where("quality = 0").select(F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.concat(F.lit("tpl_"), "doc_id").alias("template_id"))
    choice = lab.select(F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.concat(F.lit("tpl_"), F.col("doc_id") + 1).alias("template_id"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.8).alias("confidence"), F.lit("").alias("reason"))
    return V.template_match(s, V.template_topk(s, kb, DAY), manual, choice, kb)


@query("template_match", f"WITH {MATCH} SELECT * FROM mt")
def _(spark, sf):
    return matches(spark, sf)


def usage_sql(variant):
    reg = variant == "registry"
    nt, nc, cut = (10, 8, 180) if reg else (8, 6, 160)
    st = P.USAGE_STORAGE if reg else P.USAGE_STORAGE_RETRIEVAL
    sv, te = (P.USAGE_SURVEY, P.USAGE_TECHNICAL) if reg else (P.USAGE_SURVEY_RETRIEVAL, P.USAGE_TECHNICAL_RETRIEVAL)
    b = lambda w: f"({S.words_in('h', w)})[1:4]"
    orn = (lambda w: f"CASE WHEN len({b(w)}) > 0 THEN {b(w)} ELSE [template_name] END") if reg else b
    case = f"""CASE WHEN contains(d, '仓储') AND len({b(st['occupancy'])}) >= greatest(2, len({b(st['service'])})) THEN struct_pack(u := '场地占用型仓储合同', b := {b(st['occupancy'])})
      WHEN contains(d, '仓储') AND len({b(st['service'])}) > 0 THEN struct_pack(u := '标准仓储服务型合同', b := {b(st['service'])}) WHEN contains(d, '仓储') THEN struct_pack(u := '通用仓储合同模板', b := {orn(st['generic'])})
      WHEN contains(d, '技术服务') AND len({b(sv)}) > 0 THEN struct_pack(u := '测量采集型技术服务模板', b := {b(sv)}) WHEN contains(d, '技术服务') THEN struct_pack(u := '通用技术服务模板', b := {orn(te)})
      WHEN contains(d, '审计') AND len({b(P.USAGE_AUDIT)}) > 0 THEN struct_pack(u := '审计鉴证服务型模板', b := {b(P.USAGE_AUDIT)})"""
    if reg:
        case += f""" WHEN (contains(d, '勘察') OR contains(d, '设计')) AND len({b(P.USAGE_DESIGN)}) > 0 THEN struct_pack(u := '工程勘察设计型模板', b := {b(P.USAGE_DESIGN)})
      WHEN (contains(d, '检测') OR contains(d, '检验')) AND len({b(P.USAGE_LAB)}) > 0 THEN struct_pack(u := '检测检验服务型模板', b := {b(P.USAGE_LAB)}) WHEN (contains(d, '法律') OR contains(d, '律师')) AND len({b(P.USAGE_LEGAL)}) > 0 THEN struct_pack(u := '法律服务型模板', b := {b(P.USAGE_LEGAL)})
      WHEN contains(template_name, '仓储合同') THEN struct_pack(u := '通用仓储合同模板', b := fb) WHEN contains(template_name, '技术服务合同') THEN struct_pack(u := '通用技术服务模板', b := fb) WHEN contains(template_name, '合同') THEN struct_pack(u := '通用合同模板', b := fb) ELSE struct_pack(u := NULL, b := fb) END"""
    else:
        case += " ELSE struct_pack(u := NULL::VARCHAR, b := []::VARCHAR[]) END"
    dom = "concat_ws(chr(10), min(template_name), min(category_lv1), min(category_lv2))" if reg else "min(template_name)"
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY page_start, clause_no, title) AS p FROM kb WHERE template_id IS NOT NULL),
    g AS (SELECT template_id, min(template_name) AS template_name, {dom} AS d, {dom} || chr(10) || string_agg(title, chr(10)) || chr(10) || string_agg({S.strip('content')}, chr(10)) AS h, list(title ORDER BY p) FILTER (p <= 4) AS fl FROM r GROUP BY template_id),
    f AS (SELECT *, fl[1:3] AS fb FROM g) SELECT template_id, c.u AS usage_profile, array_to_string(c.b, '|') AS usage_basis FROM (SELECT template_id, {case} AS c FROM f)"""


@query("usage_profile", usage_sql("registry"))
def _(spark, sf):
    return V.usage_profile(B.kb_clauses(spark, sf))


@query("usage_profile_retrieval", usage_sql("retrieval"))
def _(spark, sf):
    return V.usage_profile(B.kb_clauses(spark, sf), "retrieval")


POOLQ = f"pq AS (SELECT DISTINCT query FROM (SELECT title AS query FROM kb WHERE doc_type = 'template' UNION ALL SELECT unnest({S.lst([r[1] for r in P.RULES])}) AS query))"
POOL = f"""pool AS (SELECT * FROM kb WHERE doc_type = 'policy' AND {LIVE}), ph AS (SELECT clause_id, title || chr(10) || content AS h FROM pool),
    pt AS (SELECT query, list_filter(regexp_split_to_array(translate(query, '，。/', '   '), '[{S.WS}]+'), lambda x: x <> '') AS ts, list_filter(list_distinct(string_split(query, '')), lambda c: NOT regexp_matches(c, '^[{S.WS}]*$')) AS cs FROM pq),
    pd AS (SELECT query, cs, clause_id, h, CASE WHEN contains(h, query) THEN 5 ELSE 0 END + len(list_filter(ts, lambda t: contains(h, t))) AS s FROM pt, ph),
    px AS (SELECT query, clause_id, CASE WHEN s > 0 THEN s::DOUBLE WHEN len(list_filter(cs, lambda c: contains(h, c))) >= 2 THEN len(list_filter(cs, lambda c: contains(h, c))) / length(query)::DOUBLE ELSE 0 END AS score FROM pd),
    pk AS (SELECT query, clause_id, round(px.score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY px.score DESC, k1, k2, k3, clause_id) AS rank FROM px JOIN (SELECT clause_id, {PLACE} FROM kb) USING (clause_id) WHERE px.score > 0 QUALIFY rank <= 3)"""


@B.memo
def pool(spark, sf):
    return V.effective_on(B.kb_clauses(spark, sf).where(F.col("doc_type") == "policy"), DAY)


@B.memo
def pool_queries(spark, sf):
    titles = B.kb_clauses(spark, sf).where(F.col("doc_type") == "template").select(F.col("title").alias("query"))
    rules = spark.createDataFrame([(r[1],) for r in P.RULES], "query string")
    return titles.unionByName(rules).distinct()


@query("policy_pool_topk", f"WITH {POOLQ}, {POOL} SELECT * FROM pk")
def _(spark, sf):
    return V.policy_pool_topk(pool_queries(spark, sf), pool(spark, sf))


@query("policy_basis", f"""WITH pq AS (SELECT DISTINCT title AS query FROM kb WHERE doc_type = 'template'), {POOL}, rq AS (SELECT clause_id AS request_id, title AS query, CASE WHEN doc_id % 2 = 0 THEN ['kc_' || (doc_id + 1) || '_1', 'kc_' || doc_id || '_2', 'kc_' || (doc_id + 3) || '_1'] ELSE []::VARCHAR[] END AS ids FROM kb WHERE doc_type = 'template'),
    gv AS (SELECT request_id, cid AS clause_id, pos FROM (SELECT request_id, unnest(ids) AS cid, unnest(range(1, len(ids) + 1)) AS pos FROM rq) SEMI JOIN pool ON cid = pool.clause_id),
    al AS (SELECT * FROM gv UNION ALL SELECT request_id, clause_id, rank FROM rq JOIN pk USING (query) WHERE request_id NOT IN (SELECT request_id FROM gv))
    SELECT clause_id, request_id, pos, title, content, page_start, page_end, document_id FROM al JOIN pool USING (clause_id)""")
def _(spark, sf):
    k = B.kb_clauses(spark, sf).where(F.col("doc_type") == "template")
    i = F.col("doc_id")
    ids = F.array(F.concat(F.lit("kc_"), i + 1, F.lit("_1")), F.concat(F.lit("kc_"), i, F.lit("_2")), F.concat(F.lit("kc_"), i + 3, F.lit("_1")))
    r = k.select(F.col("clause_id").alias("request_id"), F.col("title").alias("query"), F.when(i % 2 == 0, ids).otherwise(F.array().cast("array<string>")).alias("clause_ids"))
    return V.policy_basis(r, pool(spark, sf))


@query("template_basis", """WITH t AS (SELECT * FROM kb WHERE template_id IS NOT NULL), rq AS (SELECT task_id, 'tpl_' || doc_id AS template_id, label AS title, clause_id AS rid FROM clauses)
    SELECT rid AS request_id, template_id, rq.title, arg_min(t.title, CASE WHEN contains(t.title, rq.title) OR contains(rq.title, t.title) THEN 0 ELSE 1 END * 1000000000 + page_start * 10000 + rn) AS matched_title,
    arg_min(t.page_start, CASE WHEN contains(t.title, rq.title) OR contains(rq.title, t.title) THEN 0 ELSE 1 END * 1000000000 + page_start * 10000 + rn) AS matched_page FROM rq JOIN (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY page_start, clause_no, clause_id) AS rn FROM t) t USING (template_id) GROUP BY ALL""")
def _(spark, sf):
    r = B.clauses(spark, sf).select(F.col("clause_id").alias("request_id"), F.concat(F.lit("tpl_"), "doc_id").alias("template_id"), F.col("label").alias("title"))
    return V.template_basis(r, B.kb_clauses(spark, sf)).select("request_id", "template_id", "title", "matched_title", "matched_page")
