"""Row-level text expressions.  Every function takes and returns a Column, so
the whole chain stays inside generated JVM code and can be pushed next to a scan."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P

# Blank and line-break classes, spelled out because the default \s of the JVM is ASCII only.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BREAKS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# The characters of WS one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A text of no blank but plain ones inside.  It is read in runs of one range each; a class that lists all blanks is tried range by range at every character.
PLAIN = r"^(?! )(?:[ -~]++|[\u4e00-\u9fff]++|[\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}]++)*+(?<! )\z"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def sub(c, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(repl))


def bound(c, fn) -> Column:
    """fn of a text that it names several times: a computed text is bound once, not computed again at each place."""
    return fn(col(c)) if isinstance(c, str) else F.get(F.transform(F.array(c), fn), F.lit(0))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def text_of(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def sql_lit(v) -> str:
    """SQL text of a Python literal; a list becomes an array, a dict a named struct.

    Dictionaries are handed to the planner as one expression text: building them
    value by value costs a driver round trip each.
    """
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v) if abs(v) < 1 << 31 else f"{v}L"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(map(sql_lit, v))})" if v else "CAST(array() AS ARRAY<STRING>)"
    if isinstance(v, dict):
        return f"named_struct({', '.join(f'{sql_lit(k)}, {sql_lit(x)}' for k, x in v.items())})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(v) -> Column:
    return F.expr(sql_lit(v))


def literal_map(mapping: dict) -> Column:
    return F.expr(f"map({', '.join(f'{sql_lit(k)}, {sql_lit(v)}' for k, v in mapping.items())})")


def contains_any(c, words) -> Column:
    """True when any of the words occurs in the text.  A stored column is tested word by word; a computed
    text is scanned once by one alternation, so that its expression is not repeated per word."""
    if isinstance(c, str):
        return F.expr("(" + " OR ".join(f"contains({c}, {sql_lit(w)})" for w in words) + ")")
    if len(words) < 3:
        return reduce(lambda a, b: a | b, [col(c).contains(w) for w in words], F.lit(False))
    return F.rlike(c, F.lit("|".join(re.escape(w) for w in words)))


def contained_words(c: str, words) -> Column:
    """Array of the listed words that occur in the column, in list order."""
    return F.expr(f"filter({sql_lit(list(words))}, w -> contains({c}, w))")


def count_words(c: str, words) -> Column:
    return F.expr("(" + " + ".join(f"CAST(contains({c}, {sql_lit(w)}) AS INT)" for w in words) + ")")


#: Runs of Latin letters, digits and signs, in one range.
LATIN = "[ -\u024f]+"


def searched(c, words) -> Column:
    """The text as far as a search for the words needs it: without Latin runs, if no word holds such a character."""
    return col(c) if any(ch <= "\u024f" for w in words for ch in w) else sub(c, LATIN, " ")


def word_bits(c: str, words) -> Column:
    """Bit mask of the listed words that occur in the column."""
    return F.expr("(" + " | ".join(f"IF(contains({c}, {sql_lit(w)}), {1 << i}L, 0L)" for i, w in enumerate(words)) + ")")


def first_words(mask: str, words, n: int, shift: int = 0) -> Column:
    """The words whose bits are set, in list order, n at most."""
    tests = ", ".join(f"IF(({mask} & {1 << (i + shift)}L) != 0, {sql_lit(w)}, NULL)" for i, w in enumerate(words))
    return F.expr(f"slice(array_compact(array({tests})), 1, {n})")


def first_key(c: str, table: dict, default: str) -> Column:
    """Name of the first entry that has a word in the column."""
    cases = " ".join(f"WHEN {' OR '.join(f'contains({c}, {sql_lit(w)})' for w in ws)} THEN {sql_lit(k)}" for k, ws in table.items())
    return F.expr(f"CASE {cases} ELSE {sql_lit(default)} END")


def all_keys(c: str, table: dict) -> Column:
    """Names of all entries that have a word in the column, in table order."""
    tests = ", ".join(f"IF({' OR '.join(f'contains({c}, {sql_lit(w)})' for w in ws)}, {sql_lit(k)}, NULL)" for k, ws in table.items())
    return F.expr(f"array_compact(array({tests}))")


def clean_text(c) -> Column:
    x = text_of(c)
    for old, new in (("\u3000", " "), ("\xa0", " "), ("\u200b", ""), ("\r\n", "\n"), ("\r", "\n")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return strip(sub(sub(x, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))


def compact_text(c) -> Column:
    return sub(clean_text(c), f"[{WS}]+")


def clean_lines(c) -> Column:
    """Trim every line and drop empty ones: a blank run holding a break is one newline.

    Most texts are one plain line, which stays as it is; the pattern of the runs, which is tried at every character, runs only where there is a break.
    """
    def lines(x):
        y = F.replace(F.replace(x, F.lit("\u3000"), F.lit(" ")), F.lit("\r"), F.lit("\n"))
        y = F.when(F.rlike(y, F.lit(f"[{BREAKS}]")), sub(y, f"[{WS}]*[{BREAKS}][{WS}]*", "\n")).otherwise(y)
        return F.when(F.rlike(x, F.lit(PLAIN)), x).otherwise(strip(y))
    return F.coalesce(bound(c, lambda x: lines(x.cast("string"))), F.lit(""))


def compact_summary(c, limit: int | None) -> Column:
    """One line; text longer than a limit is cut, loses trailing punctuation and gets an ellipsis.

    A text whose blanks are single plain ones is a line already.  The cut looks at the first characters only; it leaves a
    marker (a code point no text holds) and a second pattern turns it, with the punctuation before it, into the ellipsis;
    so the text expression appears once in the plan.
    """
    def line(x):
        plain = F.when(F.contains(x, F.lit("  ")), sub(x, " {2,}", " ")).otherwise(x)
        return F.when(F.rlike(x, F.lit(PLAIN)), plain).otherwise(strip(sub(x, f"[{WS}]+", " ")))
    one = F.coalesce(bound(c, lambda x: line(x.cast("string"))), F.lit(""))
    if limit is None:
        return one
    keep = max(8, limit - 1)
    return sub(sub(F.substring(one, 1, max(limit + 1, keep)), f"(?s)^(?=.{{{limit + 1}}})(.{{0,{keep}}}).*$", "$1\uffff"), "[，；。,:： ]*\uffff$", "…")


def normalize_title(c) -> Column:
    return F.lower(sub(text_of(c), f"[{WS}:：、，。；\\-（）()\\[\\]]+"))


def normalize_match(c) -> Column:
    return F.lower(sub(text_of(c), r"[^0-9A-Za-z\p{L}\p{N}]+"))  # the plain letters first: they need no table


def drop_blank(c) -> Column:
    return sub(text_of(c), f"[{WS}]+")


def normalize_eval(c) -> Column:
    return drop_blank(F.lower(text_of(c)))


def no_space(c) -> Column:
    return F.replace(clean_lines(c), F.lit(" "), F.lit(""))


def _matches(x: Column, pattern: str) -> Column:
    return F.rlike(x, F.lit(pattern))


def is_heading(c, rules=P.HEADING_RULES) -> Column:
    any_rule = "|".join(p.lstrip("^") for p, _ in rules)
    return _matches(no_space(c), f"(?s)^(?=.{{1,42}}$)(?:{any_rule})")


def is_heading_layout(c, tokens=P.LAYOUT_HEADING_TOKENS) -> Column:
    x = strip(text_of(c))
    numbered = (F.length(x) <= 24) & _matches(x, "^[一二三四五六七八九十]、")
    return numbered | ((F.length(x) <= 26) & contains_any(x, tokens))


def heading_level(c) -> Column:
    x = no_space(c)
    expr = F.when(_matches(x, r"^第[一二三四五六七八九十百零\d]+[章节条款]"), 1)
    for pattern, level in P.HEADING_RULES[1:]:
        expr = expr.when(_matches(x, pattern), level)
    return expr.otherwise(1)


def section_code(c) -> Column:
    any_rule = "|".join(p.lstrip("^") for p, _ in P.HEADING_RULES)
    return F.nullif(F.regexp_extract(no_space(c), f"^(?:{any_rule})", 0), F.lit(""))


def norm_section_code(c) -> Column:
    x = sub(sub(clean_lines(c), f"[{WS}]+"), "[：:]")
    return F.when(F.length(clean_lines(c)) > 0, F.substring(x, 1, 24))


def valid_section_title(c, blocklist=P.SECTION_TITLE_BLOCKLIST) -> Column:
    x, code = no_space(c), section_code(c)
    ok = _matches(x, "(?s)^.{1,80}$") & ~contains_any(x, blocklist) & ~_matches(x, "(?s)^.{0,17}[：:]$")
    return ok & F.coalesce(~_matches(code, r"^(\d|（|\()"), F.lit(False))


def plausible_number(c) -> Column:
    x = strip(c)
    wordy = x.contains("合同") & ~_matches(x, r"(?U)\d")
    return (F.length(x) >= 4) & ~wordy & _matches(x, "[A-Za-z0-9]")


def _needed(x: Column, words: list[str], sign: str) -> Column:
    may = reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    return may & F.rlike(x, F.lit("(?U)" + sign)) if sign else may


def may_hold_number(c) -> Column:
    """False for texts without any contract number; cleaning neither adds nor parts what this looks for."""
    return reduce(lambda a, b: a | b, [_needed(col(c), *n) for n in {repr(n): n for n in P.CONTRACT_NUMBER_NEEDS}.values()])


def contract_number(c) -> Column:
    """First pattern whose hit looks like a number; an implausible hit falls through.

    A pattern runs only on texts that hold a word and a sign of it (CONTRACT_NUMBER_NEEDS).
    """
    def plausible(hit):
        return bound(sub(strip(hit), "^[。；;,，:：]+|[。；;,，:：]+$"), lambda h: F.when(plausible_number(h), h))

    def first(x):
        return F.coalesce(*[F.when(_needed(x, *n), plausible(F.regexp_extract(x, "(?U)" + p, 1))) for p, n in zip(P.CONTRACT_NUMBER_PATTERNS, P.CONTRACT_NUMBER_NEEDS)])
    return bound(clean_lines(c), first)


def ordered_distinct(arr: Column, limit: int | None = None) -> Column:
    out = F.array_distinct(arr)
    return F.slice(out, 1, limit) if limit else out


def cross_references(c, limit: int | None = None) -> Column:
    return ordered_distinct(F.regexp_extract_all(clean_lines(c), F.lit(P.CROSS_REF_PATTERN), F.lit(1)), limit)


def _split_list(c, seps: str, cleaner, limit) -> Column:
    parts = F.transform(F.split(text_of(c), seps, -1), cleaner)
    return ordered_distinct(F.filter(parts, lambda x: F.length(x) > 0), limit)


def reference_list(c, limit: int | None = None) -> Column:
    return _split_list(c, "[，,；;\n]+", clean_lines, limit)


def block_id_list(c) -> Column:
    return _split_list(c, f"[,;{WS}]+", strip, None)


def lookup(c, mapping: dict, default=None) -> Column:
    """Closed mapping as a literal map; unknown keys give ``default`` (or the key itself)."""
    lit_map = literal_map(mapping)
    return F.coalesce(F.try_element_at(lit_map, col(c)), col(c) if default is None else F.lit(default))


def core_label(c) -> Column:
    x = clean_lines(c)
    y = lookup(x, P.CORE_LABEL_ALIASES)
    return F.when((F.length(x) > 0) & y.isin(P.CLAUSE_LABELS), y).otherwise(F.lit(P.DEFAULT_LABEL))


def label_source(given, label, core) -> Column:
    g = F.lower(clean_lines(given))
    return (
        F.when(g.isin("core", "user_configured", "agent_discovered"), g)
        .when((col(core) == P.DEFAULT_LABEL) & ~col(label).isin(P.CLAUSE_LABELS), "agent_discovered")
        .when(col(label) == col(core), "core")
        .otherwise("user_configured")
    )


def overview_label(c) -> Column:
    return lookup(no_space(c), P.OVERVIEW_ALIASES)


def fact_value(label, value, chars: int | None = None, short_chars: int | None = None) -> Column:
    lab = col(label)
    return bound(compact_summary(value, chars), lambda text: (
        F.when(F.length(text) == 0, "")
        .when(lab == "合同编号", F.coalesce(contract_number(text), F.lit("未提取")))
        .when(lab.isin("主体摘要", "甲乙方信息", "服务内容", "付款条件", "履约期限", "验收标准", "争议解决", "账户信息"),
              text if short_chars is None else compact_summary(text, short_chars))
        .otherwise(text)
    ))


def null_if_missing(c) -> Column:
    x = strip(col(c))
    return F.when(~x.isin(P.MISSING_VALUES), x)


def clamp_confidence(c, default: float = 0.72) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.coalesce(strip(text_of(c)).try_cast("double"), F.lit(default)), F.lit(0.99)))


def coerce_level(c) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(strip(text_of(c)).try_cast("int"), F.lit(1)), F.lit(6)))


def coerce_order(c, fallback) -> Column:
    return F.greatest(F.lit(1), F.coalesce(strip(text_of(c)).try_cast("int"), col(fallback)))


def to_bool(c, words=("true", "1", "yes", "y", "是")) -> Column:
    return F.lower(strip(text_of(c))).isin(*words)


def structured_fields(m) -> Column:
    """Clean keys, shorten values to 80 characters, drop empty ones; a later duplicate key wins."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(clean_lines(e["key"]).alias("key"),
                                                             compact_summary(e["value"], 80).alias("value")))
    pairs = F.filter(pairs, lambda e: (F.length(e["key"]) > 0) & (F.length(e["value"]) > 0))
    keep = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(keep)


def risk_level(c) -> Column:
    x = F.lower(strip(text_of(c)))
    return F.when(x.isin("low", "medium", "high", "pending_verification"), x).otherwise(
        F.coalesce(F.try_element_at(literal_map(P.RISK_ALIASES), x),
                   F.lit("pending_verification")))


def focus_source(given, n_relations, n_external) -> Column:
    x = F.lower(strip(text_of(given)))
    return (
        F.when(x == "user_rule_check", "agent_discovered")
        .when(x.isin("user_relation_check", "user_external_check", "agent_discovered"), x)
        .when(col(n_external) > 0, "user_external_check")
        .when(col(n_relations) > 0, "user_relation_check")
        .otherwise("agent_discovered")
    )


def source_of_config(c) -> Column:
    return F.when(col(c) == "rule_check", "user_rule_check").when(col(c) == "external_check", "user_external_check").otherwise("user_relation_check")


def tool_labels(arr) -> Column:
    m = literal_map(P.TOOL_LABELS)
    words = F.filter(F.transform(col(arr), strip), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(words, lambda x: F.coalesce(F.try_element_at(m, x), x)))


def severity_to_risk(c) -> Column:
    return F.when(col(c) == "must_modify", "high").when(col(c) == "suggest_modify", "medium").otherwise("pending_verification")


def severity_to_status(c) -> Column:
    return F.when(col(c) == "must_modify", "fail").when(col(c) == "suggest_modify", "warning").otherwise("external_pending")


def joined(title, content) -> Column:
    return F.concat(text_of(title), F.lit("\n"), text_of(content))


def clause_type(title, content, words=P.CLAUSE_TYPE_KEYWORDS) -> Column:
    flat = [w for keys in words.values() for w in keys]
    return bound(searched(joined(title, content), flat), lambda x: F.coalesce(*[F.when(_holds(x, keys), name) for name, keys in words.items()], F.lit("general")))


def risk_tags(title, content, words=P.RISK_TAG_KEYWORDS) -> Column:
    flat = [w for keys in words.values() for w in keys]
    return bound(searched(joined(title, content), flat), lambda x: F.array_compact(F.array(*[F.when(_holds(x, keys), name) for name, keys in words.items()])))


def _holds(x: Column, words) -> Column:
    """True when any of the words occurs in a text that is bound already."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words], F.lit(False))


def title_content(part, fallback) -> Column:
    """First non-empty line as title (120 characters), the rest as content; the lines are taken apart once."""
    def cut(lines):
        title = F.when(F.length(lines[0]) > 0, F.substring(lines[0], 1, 120)).otherwise(col(fallback))
        rest = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.size(lines)), "\n")).otherwise(lines[0])
        return F.struct(title.alias("title"), clean_text(rest).alias("content"))
    return bound(F.split(clean_lines_only(part), "\n", -1), cut)


def clean_lines_only(c) -> Column:
    """Line trimming without the full-width fold (carriage returns still end lines)."""
    return strip(sub(text_of(c), f"[{WS}]*[\r{BREAKS}][{WS}]*", "\n"))


def search_tokens(*cs, limit: int | None = None) -> Column:
    def one(c):
        parts = F.split(text_of(c), f"[{WS}:：，。；;（）()【】\\[\\]/\\\\\\-]+", -1)
        long = F.filter(parts, lambda x: F.length(x) >= 2)
        return long if limit is None else F.slice(long, 1, limit)
    return F.array_distinct(F.flatten(F.array(*[one(c) for c in cs])))


def location_hint(c) -> Column:
    x = text_of(c)
    ascii_at, wide_at = F.instr(x, ":"), F.instr(x, "：")
    tail = F.when(ascii_at > 0, F.substr(x, ascii_at + 1)).when(wide_at > 0, F.substr(x, wide_at + 1)).otherwise(x)
    has_colon = (ascii_at > 0) | (wide_at > 0)
    return F.when(F.length(x) == 0, None).when(has_colon, strip(tail)).otherwise(F.nullif(strip(x), F.lit("")))


def date_key(c) -> Column:
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def chained_digests(texts: list[bytes], dim: int):
    """The numbers of the chained digests of each text, dim a text, as a matrix; a text without bytes gets zeros."""
    import hashlib

    import numpy as np
    rounds = (dim + 31) // 32

    def chain(text):
        parts = [hashlib.sha256(text).digest()]
        while len(parts) < rounds:
            parts.append(hashlib.sha256(parts[-1]).digest())
        return b"".join(parts[:rounds])

    held = np.frombuffer(b"".join(map(chain, texts)), dtype=np.uint8).reshape(len(texts), 32 * rounds)[:, :dim]
    out = (np.arange(256) / 255.0 * 2 - 1)[held]
    out[[i for i, t in enumerate(texts) if not len(t)]] = 0.0
    return out


@lru_cache
def _embedding(dim: int):
    def vectors(texts: pa.Array) -> pa.Array:
        import numpy as np
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype="int32") * dim, chained_digests(texts.to_pylist(), dim).ravel())
    return F.arrow_udf(vectors, "array<double>")


def embedded_text(c, chars: int | None = None) -> Column:
    """The bytes that hash_embedding makes its numbers of."""
    text = strip(text_of(c))
    return (text if chars is None else F.substring(text, 1, chars)).cast("binary")


def hash_embedding(c, dim: int = 1536, chars: int | None = None) -> Column:
    """Chained sha256 bytes of the text (or of its first characters) scaled to [-1, 1]; one digest gives 32 numbers.

    The numbers are made by Arrow batch: as an expression, each of them is a text that is cut out, converted and cast.
    """
    return _embedding(dim)(embedded_text(c, chars))


def fit_vector(c, dim: int) -> Column:
    return F.slice(F.concat(col(c), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def seq_ratio_bound(a, b) -> Column:
    """Exact upper bound of the sequence ratio: shared characters, counted with multiplicity."""
    la, lb = F.length(a), F.length(b)
    shared = F.aggregate(
        F.array_distinct(F.split(col(a), "")), F.lit(0),
        lambda s, ch: s + F.least(_occurrences(col(a), ch), _occurrences(col(b), ch)))
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * shared / (la + lb))


def _occurrences(text: Column, ch: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, ch, F.lit("")))
