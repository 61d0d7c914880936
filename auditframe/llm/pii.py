"""Personal data by weak supervision, with DataFrame operations only.

Base spans.  Four patterns (e-mail, IPv4, card, phone) with their checks; leftmost, not overlapping within a kind.  Places come from the
lengths of the pieces between matches, so a text is scanned twice per kind and nothing is shuffled.  The patterns are written without
backtracking and start only where a run starts or the last match ended, which finds the same spans in linear time.

Added spans.  A wide pattern proposes candidates: assigned credentials, national numbers and bank account numbers.  Labelers vote on
each: a strict pattern, a shape test, a gazetteer of field names, and two context labelers (words before it that speak for or against);
each says yes, no or nothing.  The corpus is reduced to the counts of vote patterns (at most 3 ** labelers rows), from which
expectation-maximisation estimates how reliable each labeler is in either class.  The posteriors of the patterns are the soft labels of a
final span classifier, a naive Bayes model over hashed features of the span and its left context (BUCKETS values each); candidates with
log-odds above zero are added.  Base spans always stay.

Null texts are empty and have no spans; null ids and repeated rows are treated like any other row; an empty table trains nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, query, table

SPAN = "array<struct<start:bigint,end:bigint,m:string,left:string>>"
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain at least for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = 24
#: Characters of a block of a text that is taken apart.
BLOCK = 4096

CANDIDATE = r"""(?<![A-Za-z0-9_])(?:[A-Za-z_-]{2,24}+ ?[=:] ?["']?[A-Za-z0-9_/+=.-]{8,}+["']?|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"""
FIELDS = ["password", "passwd", "pwd", "passphrase", "token", "secret", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "ssn", "iban", "passport", "pin", "login", "private_key"]
FOR = ["my", "your", "user", "account", "bank", "social", "security", "number", "key", "id", "personal", "contact", "login", "member", "customer"]
AGAINST = ["page", "version", "chapter", "section", "figure", "table", "price", "total", "build", "isbn", "http", "https", "doi", "volume", "lines"]
LABELERS = ["strict", "shape", "gazetteer", "speaks_for", "speaks_against"]
BUCKETS = 64
ROUNDS = 40


def running(sizes: Column, total=lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v), join=lambda a, b: a + b) -> Column:
    """Sums (or another total) of all earlier entries, for each entry; by blocks of about the square root of the length."""
    def blocks(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")

        def with_step(b: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / b).cast("int")), lambda j: total(F.slice(x, j * b + 1, b)))
            before = let(sums, lambda s: F.transform(s, lambda _, j: total(F.slice(s, 1, j))))
            return let(before, lambda p: F.transform(x, lambda _, i: join(F.get(p, F.floor(i / b).cast("int")), total(F.slice(x, F.floor(i / b).cast("int") * b + 1, i % b)))))
        return let(step, with_step)
    return let(sizes, blocks)


def found(text: Column, pattern: str, needed: str | None = None) -> Column:
    """Matches with start, end (code points, end exclusive), the matched text and what stands before it."""
    def placed(ps: Column, ms: Column) -> Column:
        return let(running(F.transform(ms, lambda m, i: (F.length(m) + F.length(F.get(ps, i))).cast("long"))), lambda run: F.transform(ms, lambda m, i: F.struct(
            (F.get(run, i) + F.length(F.get(ps, i))).alias("start"), (F.get(run, i) + F.length(F.get(ps, i)) + F.length(m)).alias("end"), m.alias("m"), F.right(F.get(ps, i), F.lit(CONTEXT)).alias("left"))))
    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), lambda ps: placed(ps, ms))).otherwise(F.array().cast(SPAN)))
    return out if needed is None else F.when(F.contains(text, F.lit(needed)), out).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substr(back, i + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(F.when(F.length(q) <= 3, q).try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(F.translate(m, " -", ""), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, PATTERNS[kind], NEEDED[kind]), lambda s: valid(kind, s["m"]))


def _word(words: list[str], text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)(?<![A-Za-z])(?:" + "|".join(words) + r")(?![A-Za-z])"))


def votes(m: Column, left: Column) -> list[Column]:
    """One vote per labeler: 1, 0, or -1 for none."""
    value = F.regexp_replace(F.regexp_replace(m, r"^[A-Za-z_-]+ ?[=:] ?", ""), "[\"']", "")
    letters, digits = F.length(F.translate(value, "0123456789 -", "")), F.length(F.regexp_replace(value, "[^0-9]", ""))
    assigned = F.rlike(m, F.lit("[=:]"))
    return [
        F.when(F.rlike(value, F.lit(r"^(?:[0-9a-f]{16,}|[0-9a-zA-Z_/+=-]{32,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,})$")), 1).when(F.length(value) < 10, 0).otherwise(-1),
        F.when((letters > 0) & (digits >= 4), 1).when((digits == 0) | F.rlike(value, F.lit(r"^(?:\.?[A-Za-z]+\.?)+$")), 0).otherwise(-1),
        F.when(_word(FIELDS, F.when(assigned, m).otherwise(left)), 1).when(assigned, 0).otherwise(-1),
        F.when(_word(FOR, left), 1).otherwise(-1),
        F.when(_word(AGAINST, F.concat_ws(" ", left, F.regexp_extract(m, "^[A-Za-z_-]+", 0))) | F.rlike(m, F.lit("^https?:")), 0).otherwise(-1),
    ]


def features(m: Column, left: Column) -> list[Column]:
    """Bucket numbers of the features of a span."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    hashed = lambda i, x: F.pmod(F.xxhash64(F.lit(i), x), F.lit(BUCKETS)).cast("int")
    return [hashed(0, F.left(shape, F.lit(6))), hashed(1, F.lower(F.regexp_extract(m, "^[A-Za-z_-]+", 0))), hashed(2, F.lower(F.regexp_extract(left, "([A-Za-z]+)[^A-Za-z]*$", 1))),
            F.least(F.length(m), F.lit(BUCKETS - 1)).cast("int"), F.least(F.length(F.regexp_replace(m, "[^0-9]", "")), F.lit(BUCKETS - 1)).cast("int")]


def expect(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list]:
    """Posterior of class 1 for each vote pattern, and the reliabilities: for each labeler and class the chances of -1, 0 and 1."""
    total = sum(patterns.values())
    post = {}
    for v in patterns:
        yes, no = v.count(1), v.count(0)
        post[v] = (yes + 0.5) / (yes + no + 1)
    rates: list = []
    for _ in range(rounds):
        share = (sum(n * post[v] for v, n in patterns.items()) + 1) / (total + 2)
        rates = []
        for j in range(len(LABELERS)):
            of = []
            for y in (0, 1):
                mass = {-1: 1.0, 0: 1.0, 1: 1.0}
                for v, n in patterns.items():
                    mass[v[j]] += n * (post[v] if y else 1 - post[v])
                of.append({x: a / sum(mass.values()) for x, a in mass.items()})
            rates.append(of)
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[j][1][x] / rates[j][0][x]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def train(docs: DataFrame, text: str = "text") -> list[list[float]] | None:
    """Log-odds by feature and bucket; the last entry holds the prior alone.  None if there is no candidate."""
    spans = docs.select(F.explode(found(F.coalesce(F.col(text), F.lit("")), CANDIDATE)).alias("s")).select("s.m", "s.left")
    voted = spans.select(F.array(*votes(F.col("m"), F.col("left"))).alias("v"), F.array(*features(F.col("m"), F.col("left"))).alias("f"))
    # at most 3 ** labelers * features * BUCKETS rows: what both estimators need
    cells = voted.select("v", F.posexplode("f").alias("j", "b")).groupBy("v", "j", "b").count().collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in cells:
        if r["j"] == 0:
            patterns[tuple(r["v"])] = patterns.get(tuple(r["v"]), 0) + r["count"]
    if not patterns:
        return None
    post, _ = expect(patterns)
    n_features = 1 + max(r["j"] for r in cells)
    yes = sum(n * post[v] for v, n in patterns.items())
    no = sum(patterns.values()) - yes
    mass = [[[1.0, 1.0] for _ in range(BUCKETS)] for _ in range(n_features)]
    for r in cells:
        p = post[tuple(r["v"])]
        mass[r["j"]][r["b"]][1] += r["count"] * p
        mass[r["j"]][r["b"]][0] += r["count"] * (1 - p)
    return [[math.log(a[1] / (yes + BUCKETS)) - math.log(a[0] / (no + BUCKETS)) for a in f] for f in mass] + [[math.log((yes + 1) / (no + 1))]]


def accepted(weights: list[list[float]], m: Column, left: Column) -> Column:
    odds = F.lit(weights[-1][0])
    for w, b in zip(weights, features(m, left)):
        odds = odds + F.get(F.array(*map(F.lit, w)), b)
    return odds > 0


def added_kind(m: Column) -> Column:
    return F.when(F.rlike(m, F.lit("^[A-Za-z_-]{2,} ?[=:]")), "secret").otherwise("number")


KINDS = [*PATTERNS, "secret", "number"]


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii", weights: list[list[float]] | None = None) -> DataFrame:
    """docs with a struct column: for each base kind its spans, and added (kind, start, end), in order of start.  Trains, unless it is given weights."""
    weights = weights or train(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({f"_{out}_{k}": base_spans(t, k) for k in PATTERNS})
    if weights:
        more = F.filter(found(t, CANDIDATE), lambda s: accepted(weights, s["m"], s["left"]))
        more = F.transform(more, lambda s: F.struct(added_kind(s["m"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    else:
        more = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    docs = docs.withColumn(f"_{out}_added", more)
    parts = [F.transform(F.col(f"_{out}_{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS]
    return docs.withColumn(out, F.struct(*parts, F.col(f"_{out}_added").alias("added"))).drop(*[f"_{out}_{k}" for k in [*PATTERNS, "added"]])


def spliced(text: Column, spans: Column) -> Column:
    """text with a tag in place of each run of overlapping spans (start, end, tag number of KINDS), which name the longest of the run."""
    highest = lambda a: F.coalesce(F.array_max(a), F.lit(0).cast("long"))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def runs(x: Column) -> Column:
        before = running(F.transform(x, lambda s: s["end"]), highest, F.greatest)
        return let(before, lambda top: let(F.filter(F.transform(x, lambda s, i: F.when(s["start"] >= F.get(top, i), i)), lambda i: i.isNotNull()), lambda heads: F.transform(heads, lambda h, k: let(
            F.slice(x, h + 1, F.coalesce(F.get(heads, k + 1), F.size(x)) - h), lambda own: F.struct(F.get(x, h)["start"].alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"),
                F.get(tags, -F.array_max(F.transform(own, lambda s: F.struct(s["end"] - s["start"], -s["kind"])))["col2"]).alias("tag"))))))

    def joined(blocks: Column, rs: Column) -> Column:
        # pieces are taken from the blocks they touch: a place in a long text is only found by counting from its start
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            return F.when(b > a, F.substr(F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), ""), (a % BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")
        end = lambda k: F.coalesce(F.get(rs, k)["end"], F.lit(0).cast("long"))
        parts = F.transform(rs, lambda r, k: F.concat(piece(F.when(k > 0, end(k - 1)).otherwise(0).cast("long"), r["start"]), r["tag"]))
        return F.concat(F.array_join(parts, ""), piece(end(F.size(rs) - 1), F.length(text).cast("long")))

    done = let(F.array_sort(spans), lambda x: let(runs(x), lambda rs: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: joined(blocks, rs))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every base or added span of the text replaced by its kind in brackets; n_chars follows, if there is such a column.

    Overlapping spans of the whole text are replaced as one.  What only matches once they are gone is replaced kind by kind after that.
    """
    weights = train(docs, text)
    pii, own = "spans", " ".join(docs.columns).lower()
    while pii in own:
        pii += "_"

    def replaced(t: Column, pattern: str, needed: str | None, tag) -> Column:
        done = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, t).otherwise(let(F.split(t, pattern, -1), lambda ps: F.array_join(F.transform(
            ps, lambda p, i: F.concat(p, F.coalesce(tag(F.get(ms, i), F.right(p, F.lit(CONTEXT))), F.lit("")))), ""))))
        return done if needed is None else F.when(F.contains(t, F.lit(needed)), done).otherwise(t)

    def base(k: str):
        return lambda t: replaced(t, PATTERNS[k], NEEDED[k], lambda m, left: F.when(m.isNotNull(), F.when(valid(k, m), F.lit(f"[{k.upper()}]")).otherwise(m)))

    numbered = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind")))
    every = [numbered(F.col(f"{pii}.{k}"), lambda s, n=n: F.lit(n)) for n, k in enumerate(PATTERNS)]
    every.append(numbered(F.col(f"{pii}.added"), lambda s: (F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) - 1).cast("int")))
    whole = with_spans(docs, text, pii, weights).withColumn(pii, F.concat(*every)).withColumn(text, spliced(F.col(text), F.col(pii)))

    new = F.col(text)
    for k in PATTERNS:
        new = let(new, base(k))
    if weights:
        new = let(new, lambda t: replaced(t, CANDIDATE, None, lambda m, left: F.when(m.isNotNull(), F.when(accepted(weights, m, left), F.concat(F.lit("["), F.upper(added_kind(m)), F.lit("]"))).otherwise(m))))
    out = whole.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    line = lambda k: F.transform(F.col(f"pii.{k}"), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    more = lambda k: F.transform(F.filter("pii.added", lambda s: s["kind"] == k), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.concat_ws(",", *[line(k) for k in PATTERNS])
    return got.select("doc_id", *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(base, 256).alias("base_sha256"),
                      F.concat_ws(",", *[line(k) for k in PATTERNS], *[more(k) for k in ("secret", "number")]).alias("spans"))
