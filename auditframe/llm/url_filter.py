"""URL filter: domain rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

Rules (host, path) are written host/path.  A rule fits its host and all subdomains if the path starts with the rule's; of the rules that
fit, the one with the longest host, then the longest path decides.  Without a rule the vocabulary does: a term counts where neither
neighbour is a letter or digit (ASCII), so `bet` is not found in `better`; one strict term blocks the URL, and so do at least `min_soft`
distinct soft terms whose weights, each term once, reach `limit`.

Rules and terms are settings, broadcast with the function; the automaton is built once per task.  The hosts' suffixes are looked up in a
dictionary, so the cost of a URL grows with its length, not with the number of rules.  Null URLs and URLs without `://` have an empty
host and path, fit no rule, and are judged by the vocabulary alone (null: no term, allowed).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import query, table

#: Fixed values of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: A vocabulary by topic, of general words.  Strict ones hardly stand in a harmless address.
STRICT = """
casino casinos roulette blackjack baccarat sportsbook sportsbooks bookmaker bookmakers
viagra cialis levitra kamagra tramadol phentermine
porn porno pornography xxx hentai milf camgirl camgirls camsex bdsm erotica striptease
warez keygen keygens nulled
""".split()
#: Weight 2: words of a topic that also have a plain sense; weight 1: words of advertisements everywhere.
TOPIC = """
bet bets betting gamble gambling gambler poker slots jackpot jackpots lottery lotto wager bingo
pills pill pharmacy pharma steroids opioids xanax
adult adults sex sexy nude nudes escort escorts webcam webcams dating hookup hookups fetish erotic naked
loan loans payday forex binary
crack cracked cracks serial torrent torrents hacked cheats malware phishing spyware
spam clickbait replica replicas counterfeit
""".split()
WEAK = "free cheap cheapest discount bonus bonuses win winner winners credit cash prize prizes hot deal deals promo instant guaranteed unlimited unlocked download downloads girls buy online now".split()
SOFT = {**dict.fromkeys(TOPIC, 2), **dict.fromkeys(WEAK, 1)}
#: Soft terms block when there are at least MIN_SOFT different ones and their weights reach LIMIT: two weak words do not, a weak and a topical one do.
MIN_SOFT, LIMIT = 2, 3

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = _until(rest, "?#")
    at = rest.find("/")
    return (rest.translate(LOWER), "") if at < 0 else (rest[:at].translate(LOWER), rest[at:])


def _until(text: str, stops: str) -> str:
    ends = [i for c in stops if (i := text.find(c)) >= 0]
    return text[: min(ends)] if ends else text


def index(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule text, verdict), longest path first."""
    out: dict[str, list] = {}
    for verdict, host, path in rules:
        out.setdefault(host.translate(LOWER), []).append((path, host + path, verdict))
    return {h: sorted(r, key=lambda x: (-len(x[0]), x)) for h, r in out.items()}


def rule_for(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """Rule text and verdict of the longest host that has a rule for this path."""
    while host:
        for start, text, verdict in by_host.get(host, ()):
            if path.startswith(start):
                return text, verdict
        host = host.partition(".")[2]
    return None


def automaton(strict: list[str], soft: dict[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in [*soft.items(), *((s, 0) for s in strict)]:
        a.add_word(t, (t, w))
    a.make_automaton()
    return a


def terms(url: str, a) -> tuple[set[str], dict[str, int]]:
    """Distinct strict terms, and soft ones with weights, that stand alone in the URL."""
    text = url.translate(LOWER)
    strict, soft = set(), {}
    for end, (t, w) in a.iter(text):
        start = end - len(t)
        if (start < 0 or text[start] not in LETTERS) and (end + 1 == len(text) or text[end + 1] not in LETTERS):
            if w:
                soft[t] = w
            else:
                strict.add(t)
    return strict, soft


def judged(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, strict: list[str] = STRICT, soft: dict[str, int] = SOFT, limit: int = LIMIT, min_soft: int = MIN_SOFT) -> DataFrame:
    """pages with host, path, rule, verdict, n_strict, n_soft and soft_weight (columns of these names are replaced)."""
    new = ["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]
    kept = [c for c in pages.columns if c not in new]
    pages = pages.select(*kept, url) if url not in kept else pages.select(*kept)
    by_host = index(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for batch in batches:
            out: list[list] = [[] for _ in new]
            for u in batch.column(url).to_pylist():
                host, path = parts(u)
                hit = rule_for(host, path, by_host)
                s, w = terms(u or "", a)
                weight = sum(w.values())
                verdict = hit[1] if hit else "block" if s or (len(w) >= min_soft and weight >= limit) else "allow"
                for c, v in zip(out, (host, path, hit[0] if hit else None, verdict, len(s), len(w), weight)):
                    c.append(v)
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*batch.schema.names, *new])

    fields = [T.StructField(n, T.LongType() if n in new[4:] else T.StringType()) for n in new]
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, *fields]))


def _words(ts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in ts) + "]"


_FITS = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': {len(h) * 1000 + len(p)}, 'rule': '{h}{p}', 'verdict': '{v}'}} END" for v, h, p in RULES)
ORACLE = f"""
WITH r AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') u,
  CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END rest FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/]*(/.*)?$', 1, 's') path FROM r),
t AS (SELECT *, list_distinct(regexp_extract_all(u, '[a-z0-9]+')) ws FROM p),
f AS (SELECT *, list_sort(list_filter([{_FITS}], lambda x: x IS NOT NULL), 'DESC')[1] fit,
  len(list_intersect(ws, {_words(STRICT)})) n_strict, len(list_intersect(ws, {_words(TOPIC)})) n_topic, len(list_intersect(ws, {_words(WEAK)})) n_weak FROM t)
SELECT page_id, host, path, fit.rule rule, coalesce(fit.verdict, CASE WHEN n_strict > 0 OR (n_topic + n_weak >= {MIN_SOFT} AND 2 * n_topic + n_weak >= {LIMIT}) THEN 'block' ELSE 'allow' END) verdict,
  n_strict::BIGINT n_strict, (n_topic + n_weak)::BIGINT n_soft, (2 * n_topic + n_weak)::BIGINT soft_weight FROM f
"""


@query("op1_url_filter", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
