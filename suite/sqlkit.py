"""SQL text used by the oracle queries: shared expressions and the bridge as CTEs."""

from __future__ import annotations

import re

from auditframe import params as P
from auditframe.functions.text import BREAKS, WS
from auditframe.plans.bridge import NUMERALS, SUFFIXES


def q(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return str(s)
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lst(v) + ("::VARCHAR[]" if not v else "") if isinstance(v, list) else q(v) for v in r) + ")" for r in rows) + ")"


def sub(x, pattern, repl="") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip(x) -> str:
    return sub(x, f"^[{WS}]+|[{WS}]+$")


def clean_text(x) -> str:
    x = f"replace(replace(replace({x}, chr(12288), ' '), chr(160), ' '), chr(8203), '')"
    x = sub(x, "\r\n?", "\n")
    return strip(sub(sub(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_lines(x) -> str:
    x = f"replace(replace({x}, chr(12288), ' '), chr(13), chr(10))"
    return strip(sub(x, f"[{WS}]*[{BREAKS}][{WS}]*", "\n"))


def one_line(x) -> str:
    return strip(sub(f"replace({clean_lines(x)}, chr(10), ' ')", f"[{WS}]+", " "))


def compact_summary(x, n) -> str:
    y = one_line(x)
    if n is None:
        return y
    return f"(CASE WHEN length({y}) <= {n} THEN {y} ELSE {sub(f'left({y}, {max(8, n - 1)})', '[，；。,:： ]+$')} || '…' END)"


def no_space(x) -> str:
    return f"replace({clean_lines(x)}, ' ', '')"


def has(x, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def count_words(x, words) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {q(w)}) THEN 1 ELSE 0 END)" for w in words) + ")"


def words_in(x, words) -> str:
    return f"list_filter({lst(words)}, lambda w: contains({x}, w))"


def distinct_list(x) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def mapped(x, mapping, default=None) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {x if default is None else q(default)} END)"


def clause_type(x) -> str:
    return "(CASE " + " ".join(f"WHEN {has(x, w)} THEN {q(n)}" for n, w in P.CLAUSE_TYPE_KEYWORDS.items()) + " ELSE 'general' END)"


def section_code(x) -> str:
    y = no_space(x)
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({y}, {q(p)}, 0), '')" for p, _ in P.HEADING_RULES) + ")"


def is_heading(x) -> str:
    y = no_space(x)
    return f"(length({y}) BETWEEN 1 AND 42 AND (" + " OR ".join(f"regexp_matches({y}, {q(p)})" for p, _ in P.HEADING_RULES) + "))"


def heading_level(x) -> str:
    y = no_space(x)
    rules = [(r"^第[一二三四五六七八九十百零\d]+[章节条款]", 1), *P.HEADING_RULES[1:]]
    return "(CASE " + " ".join(f"WHEN regexp_matches({y}, {q(p)}) THEN {n}" for p, n in rules) + " ELSE 1 END)"


def contract_number(x) -> str:
    y, opts = clean_lines(x), []
    pats = [P.CONTRACT_NUMBER_PATTERNS[0],
            r"(?:^|[^\p{L}\p{N}_])([A-Z]{1,8}-\d{4,}(?:[-A-Z0-9/]*[A-Z0-9])?)(?:$|[^\p{L}\p{N}_])",
            r"(?:^|[^\p{L}\p{N}_])(\d{2,}-\d{4,}(?:[A-Za-z0-9-]*[A-Za-z0-9])?)(?:$|[^\p{L}\p{N}_])"]
    for p in pats:
        h = sub(strip(f"regexp_extract({y}, {q(p)}, 1)"), "^[。；;,，:：]+|[。；;,，:：]+$")
        opts.append(f"CASE WHEN length({h}) >= 4 AND NOT (contains({h}, '合同') AND NOT regexp_matches({h}, '[0-9]')) AND regexp_matches({h}, '[A-Za-z0-9]') THEN {h} END")
    return "coalesce(" + ", ".join(opts) + ")"


def cross_refs(x) -> str:
    y = f"regexp_extract_all({clean_lines(x)}, {q(P.CROSS_REF_PATTERN)}, 1)"
    return f"({distinct_list(y)})"


LIVE = "status IN ('effective', 'partially_effective')"
DAY = 20240601


def live(alias="", day=DAY) -> str:
    a = alias + "." if alias else ""
    return f"({a}status IN ('effective', 'partially_effective') AND {a}effective_ts <= {day} AND {a}abolish_ts >= {day})"


CATS = [*P.CATEGORY_KEYWORDS, P.DEFAULT_CATEGORY]
TEMPLATE_NAMES = ["技术服务合同", "第三方审计合同", "工程勘察合同", "检测委托合同", "仓储合同"]

CTES: dict[str, str] = {
    "lines": """SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)""",
    "blocks": f"""SELECT doc_id, 'task_' || doc_id AS task_id, 'b_' || doc_id || '_' || n AS block_id, n::BIGINT AS block_no,
        ((n - 1) // 4 + 1)::BIGINT AS page, text, (40 + 30 * (length(text) % 3))::BIGINT AS x,
        (60 + 52 * ((n - 1) % 4) + 6 * (length(text) % 5))::BIGINT AS y, least(900, 12 * length(text))::BIGINT AS width,
        24::BIGINT AS height, round(0.7::DOUBLE + (length(text) % 30) / 100.0::DOUBLE, 2) AS score,
        ({lst([c for c, _ in SUFFIXES])})[n % 7 + 1] AS core_label
        FROM (SELECT doc_id, n,
            (CASE WHEN n % 5 = 1 THEN '第' || ({lst(NUMERALS)})[(n // 5) % 10 + 1] || '章 '
                  WHEN n % 5 IN (2, 4) THEN '第' || ({lst(NUMERALS)})[n % 10 + 1] || '条 ' ELSE '' END)
            || line || ({lst([s for _, s in SUFFIXES])})[n % 7 + 1]
            || (CASE WHEN n % 7 = 5 THEN (20240000 + doc_id)::VARCHAR WHEN n % 7 = 6 THEN (10000 + doc_id * 7 + n)::VARCHAR || '元' ELSE '' END) AS text
            FROM lines)""",
    "docs": """SELECT doc_id, lang, source, 'task_' || doc_id AS task_id, 'doc_' || doc_id AS document_id,
        source || '_' || doc_id || '.' || lang AS file_name, CASE WHEN lang = 'en' THEN 'policy' ELSE 'template' END AS doc_type, text AS raw FROM documents""",
    "texts": """SELECT d.*, coalesce(t.text, '') AS text FROM docs d LEFT JOIN
        (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id) t USING (doc_id)""",
    "clauses": f"""SELECT doc_id, task_id, 'c_' || doc_id || '_' || block_no AS clause_id, core_label AS label, core_label,
        (['core', 'user_configured', 'agent_discovered'])[block_no % 3 + 1] AS label_source, core_label AS title,
        {compact_summary('text', None)} AS summary, text AS raw_text, page, round(0.5::DOUBLE + (length(text) % 50) / 100.0::DOUBLE, 2) AS confidence,
        block_no AS sort_order, length(text) % 4 = 0 AS need_review, block_id FROM blocks WHERE core_label <> '其他重要条款'""",
    "key_facts": f"""SELECT doc_id, task_id, 'f_' || substr(clause_id, 3) AS fact_id, label,
        CASE WHEN sort_order % 5 = 0 THEN '' ELSE {compact_summary('raw_text', None)} END AS value, page, confidence, sort_order, block_id FROM clauses""",
    "kb_docs": """SELECT doc_id, 'doc_' || doc_id AS document_id, source AS name, CASE WHEN lang = 'en' THEN 'policy' ELSE 'template' END AS doc_type,
        CASE WHEN doc_id % 11 = 0 THEN 'abolished' WHEN doc_id % 13 = 0 THEN 'superseded' WHEN doc_id % 4 = 0 THEN 'partially_effective' ELSE 'effective' END AS status,
        (20200101 + 10000 * (doc_id % 5))::BIGINT AS effective_ts, (CASE WHEN doc_id % 7 = 0 THEN 20230101 ELSE 99991231 END)::BIGINT AS abolish_ts,
        CASE WHEN doc_id % 13 = 0 THEN 'doc_' || (doc_id + 60) END AS replaced_by, doc_id % 13 <> 0 AS current_version,
        (1704067200 + doc_id * 60)::BIGINT AS created_at, sha256(text) AS file_hash FROM documents""",
    "kb": f"""SELECT *, {clause_type("(title || chr(10) || content)")} AS clause_type FROM (
        SELECT b.doc_id, 'kc_' || b.doc_id || '_' || block_no AS clause_id, document_id, doc_type,
        CASE WHEN doc_type = 'template' THEN 'tpl_' || b.doc_id END AS template_id,
        CASE WHEN doc_type = 'template' THEN ({lst(TEMPLATE_NAMES)})[b.doc_id % 5 + 1] END AS template_name,
        CASE WHEN doc_type = 'template' THEN ({lst(CATS)})[b.doc_id % 6 + 1] ELSE '总则' END AS category_lv1,
        CASE WHEN doc_type = 'template' AND b.doc_id % 2 = 0 THEN '工程勘察设计合同' END AS category_lv2,
        block_no::VARCHAR AS clause_no, regexp_extract(text, '^(第[^ ]+ )?', 1) || core_label AS title, text AS content,
        page AS page_start, page AS page_end, status, effective_ts, abolish_ts, core_label, block_no
        FROM blocks b JOIN kb_docs k ON b.doc_id = k.doc_id)""",
}


def build(sql: str) -> str:
    """Prepend the CTEs a query names, with their own inputs, in definition order."""
    need: set[str] = set()

    def visit(text):
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need]
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if m:
        return f"WITH {m.group(1) or ''}" + ",\n".join([*parts, sql[m.end():]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
