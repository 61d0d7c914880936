"""Retrieval and ranking: effective-dated filters, lexical / vector / hybrid top-k, template and policy lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions import ordered as O
from ..functions import text as X
from ..session import stage



def effective_on(kb: DataFrame, day: int) -> DataFrame:
    return kb.where(F.col("status").isin(P.LIVE_STATUSES) & (F.col("effective_ts") <= day) & (F.col("abolish_ts") >= day))


# --- containment ------------------------------------------------------------


LITERAL_LIMIT = 256


def bounded_values(df: DataFrame, column: str, limit: int) -> list | None:
    """The distinct values when there are at most ``limit``; None when there are more."""
    got = df.select(column).where(F.length(column) > 0).distinct().limit(limit + 1).collect()
    return None if len(got) > limit else sorted(r[0] for r in got)


GRAM = 3
#: Rows whose grams are counted to choose keys; the choice decides the work, never the result.
COUNTED = 20_000


def grams(c: Column, sizes: list[int]) -> Column:
    """Character runs of the given sizes (up to GRAM), in one pass over the characters."""
    def runs(chars: Column) -> Column:
        of = lambda n: F.transform(chars, lambda x, i: F.concat(x, *[F.get(chars, i + j) for j in range(1, n)]))
        return F.array_compact(F.concat(*[of(n) for n in sizes]))
    # bound once: a plain expression would be split again for each element
    return F.get(F.transform(F.array(F.split(c, "")), runs), F.lit(0))


def rarest_grams(needles: DataFrame, texts: DataFrame, text_col: str, needle_col: str, within: list[str], counted: int = COUNTED) -> tuple[DataFrame, list[int]]:
    """Each needle with the one of its grams that occurs least in at most `counted` texts (those of smallest hash)."""
    size = F.least(F.length(needle_col), F.lit(GRAM))
    sizes = sorted(r[0] for r in needles.select(size.alias("s")).distinct().collect())  # at most GRAM values
    of = F.when(F.length(needle_col) > GRAM, grams(F.col(needle_col), [GRAM])).otherwise(F.array(needle_col))
    own = stage(needles.select(*within, needle_col, F.explode(F.array_distinct(of)).alias("_gram")))
    if not sizes:
        return own, [1]
    some = texts.select(F.col(text_col).alias("_t")).orderBy(F.xxhash64("_t")).limit(counted)
    seen = some.select(F.explode(grams(F.col("_t"), sizes)).alias("_gram")).join(own.select("_gram").distinct(), "_gram", "left_semi")
    counts = seen.groupBy("_gram").agg(F.count("*").alias("_n"))
    ranked = own.join(counts, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    least = ranked.groupBy(*within, needle_col).agg(F.min(F.struct("_n", "_gram")).alias("_m"))
    return least.select(*within, needle_col, F.col("_m._gram").alias("_gram")), sizes


def words_holding(texts: DataFrame, row_col: str, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """(row, needle) for needles without blanks: such a needle lies inside one word of a text.

    The words of all texts form a vocabulary; needles are looked for in its distinct words only, keyed by their rarest gram, and the
    (word, needle) pairs found lead back to the rows by an equi join on the word.
    """
    words = texts.select(row_col, F.explode(F.array_distinct(F.split(text_col, f"[{X.WS}]+"))).alias("_word"))
    vocabulary = stage(words.select("_word").where(F.length("_word") > 0).distinct())
    keyed, sizes = rarest_grams(needles, vocabulary, "_word", needle_col, [])
    held = vocabulary.select("_word", F.explode(F.array_distinct(grams(F.col("_word"), sizes))).alias("_gram"))
    hits = held.join(stage(keyed), "_gram").where(F.contains("_word", needle_col)).select("_word", needle_col)
    return words.join(stage(hits), "_word").select(row_col, needle_col)


def substring_pairs(texts: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_col: str, within: tuple[str, ...] = (), literal_limit: int = LITERAL_LIMIT) -> DataFrame:
    """(id, needle) for every distinct needle (null and empty ones aside) that occurs in the text.

    Few needles (checked, and no groups): one pass over the texts, needles as a literal array.  More, with the same result: needles without
    blanks are looked for in the distinct words (words_holding), and so are the parts of the others, whose candidates are the rows of their
    rarest part.  Needles of nothing but blanks, and those of large groups, are keyed by their rarest gram (up to three characters); texts
    state their grams, and row numbers meet needles by an equi join on the keys.  Each text meets its own candidates once, by its
    number, and they are verified.  Texts are never shuffled with their grams.
    With `within`, columns of both sides, only needles of the same group are looked for, so work is linear in the groups; the result has these
    columns as well.  A group of few needles is searched directly, as an array that meets each text of the group; only the texts of
    groups with more state their grams.
    """
    within = list(within)
    few = None if within else bounded_values(needles, needle_col, literal_limit)
    if few is not None:
        return texts.select(id_col, F.explode(F.filter(X.literal(few), lambda n: F.contains(F.col(text_col), n))).alias(needle_col))
    n = stage(needles.select(*within, needle_col).where(F.length(needle_col) > 0).distinct())
    texts = texts.where(F.length(text_col) > 0).select(*within, id_col, text_col)
    direct = None
    if within:
        size = n.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
        small, large = [size.where(c).select(*within) for c in (F.col("_n") <= literal_limit, F.col("_n") > literal_limit)]
        lists = n.join(small, within, "left_semi").groupBy(*within).agg(F.collect_list(needle_col).alias("_set"))
        direct = texts.join(lists, within).select(*within, id_col, F.explode(F.filter("_set", lambda x: F.contains(F.col(text_col), x))).alias(needle_col))
        if large.isEmpty():
            return direct
        texts, n = [df.join(large, within, "left_semi") for df in (texts, n)]
    # read three times; a row number stands for the id, which may be a wide struct
    rows = stage(texts.withColumn("_row", F.monotonically_increasing_id()))
    listed = lambda found: found.groupBy("_row").agg(F.collect_set(needle_col).alias("_set"))
    verified = lambda found: rows.join(listed(found), "_row").select(*within, id_col, F.explode(F.filter("_set", lambda x: F.contains(F.col(text_col), x))).alias(needle_col))
    if not within:
        # a needle with blanks can only be where its parts are: the part in fewest rows leads to its candidates
        split = stage(n.select(needle_col, F.explode_outer(F.array_distinct(F.filter(F.split(needle_col, f"[{X.WS}]+", -1), lambda x: x != ""))).alias("_part")))
        parts = split.where(F.col("_part").isNotNull())
        held = stage(words_holding(rows, "_row", text_col, parts.select("_part").distinct(), "_part"))
        plain = held.join(parts.where(F.col("_part") == F.col(needle_col)).select("_part"), "_part", "left_semi").select("_row", F.col("_part").alias(needle_col))
        direct = rows.select("_row", id_col).join(listed(plain), "_row").select(id_col, F.explode("_set").alias(needle_col))  # certain, so the texts stay where they are
        count = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        rarest = parts.where(F.col("_part") != F.col(needle_col)).join(count, "_part", "left").groupBy(needle_col).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_part")).alias("_m"))
        direct = direct.unionByName(verified(held.join(rarest.select(needle_col, F.col("_m._part").alias("_part")), "_part").select("_row", needle_col)))
        n = split.where(F.col("_part").isNull()).select(needle_col)  # nothing but blanks
        if n.isEmpty():
            return direct
    keyed, sizes = rarest_grams(n, rows, text_col, needle_col, within)
    held = rows.select(*within, "_row", F.explode(grams(F.col(text_col), sizes)).alias("_gram"))
    out = verified(held.join(stage(keyed), [*within, "_gram"]).select("_row", needle_col))
    return out if direct is None else direct.unionByName(out)


PLACE = ["template_id", "page_start", "clause_no"]


def _place(kb: DataFrame) -> Column:
    """Where a clause stands in the list of all clauses, the order of equal scores; its id comes last."""
    at = [F.coalesce(F.col(c), F.lit(0 if c == "page_start" else "")).alias(c) for c in PLACE if c in kb.columns]
    return F.struct(*at, "clause_id")


def query_terms(queries: DataFrame) -> DataFrame:
    """Whitespace terms with their multiplicity (a repeated term counts each time)."""
    t = queries.select("query_id", F.explode(F.filter(F.split("query", f"[{X.WS}]+", -1), lambda x: x != "")).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def lexical_topk(kb: DataFrame, queries: DataFrame, k: int, day: int | None = None, order: list | None = None, **filters) -> DataFrame:
    """Top k clauses per query by the number of query terms contained in title and content."""
    for name, v in filters.items():
        if v is not None:
            kb = kb.where(F.col(name) == v)
    if day is not None:
        kb = effective_on(kb, day)
    terms = stage(query_terms(queries))  # read several times
    texts = kb.select(_place(kb).alias("k"), X.joined("title", "content").alias("hay"))
    pairs = substring_pairs(texts, "k", "hay", terms, "term")
    scored = pairs.join(terms, "term").groupBy("query_id", "k").agg(F.sum("weight").alias("score"))
    return O.top_k(scored, ["query_id"], [F.desc("score"), F.col("k")], k).select("query_id", "k.clause_id", "score", "rank")


def policy_search(kb: DataFrame, queries: DataFrame, day: int, k: int = 5) -> DataFrame:
    return lexical_topk(kb, queries, k, day=day, doc_type="policy")


# --- vectors ----------------------------------------------------------------


#: Vectors of a batch that are held at a time, as a matrix.
ROWS = 2048


def vector_topk(kb: DataFrame, queries: DataFrame, k: int, day: int | None = None, chunk: int = 20000, query_chunk: int = 1024, few: int = LITERAL_LIMIT) -> DataFrame:
    """Exact cosine top k per query (0 when a norm is 0).

    kb: clause_id, vector (and dates when ``day`` is given); queries: query_id, vector.  A kb without vectors has title and content,
    and its vectors are their hash embeddings.
    At most ``few`` queries (checked) go to the clauses, which stay where they are; embeddings are made there and never leave the
    task.  With more, both sides are cut into bounded chunks by hash; each (clause chunk, query chunk) cell is one matrix product.
    Either way only the k best per query are returned.
    """
    if day is not None:
        kb = effective_on(kb, day)
    rows = [(r["query_id"], r["vector"]) for r in queries.select("query_id", "vector").limit(few + 1).collect()]
    dim = len(rows[0][1]) if rows else 0
    made = "vector" not in kb.columns
    if made:
        text = X.joined("title", "content")
        kb = kb.withColumn("vector", X.embedded_text(text) if len(rows) <= few else X.hash_embedding(text, dim))
    own = [c for c in PLACE if c in kb.columns]
    ct, qt = kb.schema["clause_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    a = kb.select(_place(kb).alias("k"), "vector").select("k.*", "vector")
    schema = f"query_id {qt}, {''.join(f'{c} {dict(a.dtypes)[c]}, ' for c in own)}clause_id {ct}, score double"

    def cell(left, right):
        import numpy as np
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], **{c: left[c][:0] for c in own}, "clause_id": left["clause_id"][:0], "score": pd.Series([], dtype="float64")})
        q = np.stack(right["vector"].to_numpy()).astype("float64")
        left = left.sort_values([*own, "clause_id"], kind="stable")  # equal scores: first in the list of clauses
        m = X.chained_digests(list(left["vector"]), dim) if made and len(rows) <= few else np.stack(left["vector"].to_numpy()).astype("float64")
        den = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
        s = np.divide(q @ m.T, den, out=np.zeros_like(den), where=den != 0).round(9)
        ids = left["clause_id"].to_numpy()
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), best.shape[1]), **{c: left[c].to_numpy()[best].ravel() for c in own}, "clause_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    if len(rows) <= few:
        def batches(frames):
            import pandas as pd
            right = pd.DataFrame({"query_id": pd.Series([q for q, _ in rows], dtype="object"), "vector": pd.Series([v for _, v in rows], dtype="object")})
            for left in frames:
                for at in range(0, len(left), ROWS):
                    yield cell(left[at:at + ROWS], right)

        out = a.mapInPandas(batches, schema)
    else:
        n_kb, n_q = kb.count(), queries.count()
        parts, blocks = max(1, -(-n_kb // chunk)), max(1, -(-n_q // query_chunk))
        cells = lambda df, own, n_own, other, n_other, key: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        a = cells(a, "_part", parts, "_block", blocks, "clause_id")
        b = cells(queries.select("query_id", "vector"), "_block", blocks, "_part", parts, "query_id").withColumn("_part", F.col("_part").cast("long"))
        a = a.withColumn("_block", F.col("_block").cast("long"))
        out = a.groupBy("_part", "_block").cogroup(b.groupBy("_part", "_block")).applyInPandas(cell, schema)
    return O.top_k(out, ["query_id"], [F.desc("score"), *own, F.col("clause_id")], k).select("query_id", "clause_id", "score", "rank")


def hybrid_topk(kb: DataFrame, queries: DataFrame, k: int, day: int, shown: tuple[str, ...] = ()) -> DataFrame:
    """Rank points of the lexical policy hits plus the cosine of the hits among all live clauses, with the columns of kb to be shown."""
    text = policy_search(kb, queries, day, k).select("query_id", "clause_id", (F.lit(k) + 1 - F.col("rank")).cast("double").alias("score"))
    vec = vector_topk(kb, queries, k, day).select("query_id", "clause_id", "score")
    both = text.unionByName(vec).groupBy("query_id", "clause_id").agg(F.sum("score").alias("score"))
    placed = both.join(kb.select("clause_id", _place(kb).alias("k"), *shown), "clause_id")
    return O.top_k(placed, ["query_id"], [F.desc("score"), F.col("k")], k).drop("k")


# --- templates --------------------------------------------------------------


def contract_signatures(schema: DataFrame) -> DataFrame:
    """Contracts with equal category, keywords and profile flags get equal candidates: give them one signature.

    schema: task_id, category, keywords (array) and optionally ``flags`` (array of profile names).
    """
    flags = F.col("flags") if "flags" in schema.columns else F.array().cast("array<string>")
    words = F.array_sort(F.filter("keywords", lambda w: w != ""))
    s = schema.select("task_id", "category", words.alias("keywords"), flags.alias("flags"))
    return s.withColumn("signature", F.sha2(F.concat_ws("\x1f", "category", F.array_join("keywords", "\x1e"), F.array_join("flags", "\x1e")), 256))


def template_lists(sig: DataFrame, kb: DataFrame, day: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What scores are made of: words (signature, keyword, times), hits (template_id, keyword, n), fit (template_id, category, n)
    and info (template_id and its names).

    Keyword hits are counted once per template, the category part uses the distinct category names: work grows with distinct
    signatures, not with contracts.
    """
    t = effective_on(kb, day).where((F.col("doc_type") == "template") & F.col("template_id").isNotNull())
    words = sig.select("signature", F.explode("keywords").alias("keyword")).groupBy("signature", "keyword").agg(F.count(F.lit(1)).alias("times"))
    hay = t.select(F.struct("template_id", "clause_id").alias("k"), X.joined("title", "content").alias("hay"))
    hits = substring_pairs(hay, "k", "hay", words, "keyword").groupBy(F.col("k.template_id").alias("template_id"), "keyword").agg(F.count(F.lit(1)).alias("n"))
    # one pass for names and categories: a row for each template and category
    heads = stage(t.groupBy("template_id", "category_lv1", "category_lv2").agg(F.min_by("template_name", _place(t)).alias("template_name"), F.min(_place(t)).alias("place"), F.count(F.lit(1)).alias("n")))
    info = heads.groupBy("template_id").agg(F.min_by(F.struct(*NAMES), "place").alias("i")).select("template_id", "i.*")
    cats = heads.groupBy("template_id", F.coalesce("category_lv1", F.lit("")).alias("l1"), F.coalesce("category_lv2", F.lit("")).alias("l2")).agg(F.sum("n").alias("n"))
    names = sig.select("category").where(F.col("category") != "").distinct()
    pairs = substring_pairs(cats.select(F.struct("l1", "l2").alias("c"), F.concat_ws("\x1f", "l1", "l2").alias("hay")).distinct(), "c", "hay", names, "category")
    fit = cats.join(pairs.select("c.l1", "c.l2", "category"), ["l1", "l2"]).groupBy("category", "template_id").agg(F.sum("n").alias("n"))
    return words, hits, fit, info


#: Templates of a class are handed out in chunks of about so many, so that no join key makes more rows than signatures times this.
MEMBERS = 1024


def template_classes(hits: DataFrame, fit: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hits and fit of one template, the first by id, for each class of templates with the same entries and names; and members
    (class, template_id and its names), where class is the id of that template.

    Templates of a class score alike with every signature, so a class is scored once.
    """
    lists = lambda df, key: df.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct(key, "n"))).alias(f"_{key}"))
    both = lists(hits, "keyword").join(lists(fit, "category"), "template_id", "full_outer").join(info, "template_id")
    like = F.sha2(F.to_json(F.struct("_keyword", "_category", *NAMES)), 256)
    members = stage(both.select("template_id", *NAMES, like.alias("_like")))
    members = stage(members.join(members.groupBy("_like").agg(F.min("template_id").alias("class")), "_like").select("class", "template_id", *NAMES))
    first = members.select(F.col("class").alias("template_id")).distinct()
    return hits.join(first, "template_id", "left_semi"), fit.join(first, "template_id", "left_semi"), members


def class_scores(sig: DataFrame, kb: DataFrame, day: int) -> tuple[DataFrame, DataFrame]:
    """Candidate scores of every class per signature (template_id is the class), and the members of the classes."""
    words, hits, fit, _info = template_lists(sig, kb, day)
    hits, fit, members = template_classes(stage(hits), stage(fit), _info)
    by_word = hits.join(words, "keyword").select("signature", "template_id", (F.col("n") * F.col("times")).cast("double").alias("s"))
    by_cat = fit.join(sig.select("signature", "category"), "category").select("signature", "template_id", (F.col("n") * 3.0).alias("s"))
    return by_word.unionByName(by_cat).groupBy("signature", "template_id").agg(F.sum("s").alias("score")), members


def each_member(scores: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of a class for each of its templates.  A large class is cut into chunks, so its rows are dealt to many tasks."""
    sizes = members.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("_chunks"))
    m = members.join(sizes, "class").select("class", F.pmod(F.xxhash64("template_id"), F.col("_chunks")).alias("_chunk"), "template_id", *NAMES)
    s = scores.withColumnRenamed("template_id", "class").join(sizes, "class").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks", *NAMES)
    return s.join(m, ["class", "_chunk"]).drop("class", "_chunk")


def template_candidates(signatures: DataFrame, kb: DataFrame, day: int) -> DataFrame:
    """Score of every template per signature: 3 per clause of a fitting category, 1 per keyword contained in a clause."""
    sig = stage(signatures.select("signature", "category", "keywords", "flags").distinct())  # read several times
    return each_member(*class_scores(sig, kb, day)).select("template_id", "signature", "score", *NAMES)


def rescored_candidates(signatures: DataFrame, kb: DataFrame, day: int, table=P.TEMPLATE_ADJUSTMENTS) -> DataFrame:
    """template_rescore(template_candidates()), with the adjustments made once for each class of templates."""
    sig = stage(signatures.select("signature", "category", "keywords", "flags").distinct())
    scores, members = class_scores(sig, kb, day)
    names = members.where(F.col("class") == F.col("template_id")).select("template_id", *NAMES)
    rescored = template_rescore(scores.join(names, "template_id"), sig, table)
    return each_member(rescored, members).select("signature", "template_id", "score", *NAMES, "base_score", "reasons")


NAMES = ["template_name", "category_lv1", "category_lv2"]
#: Levels of template strength for each doubling; they decide which templates share a block, never the result.
LEVELS = 4


def template_blocks(hits: DataFrame, fit: DataFrame, info: DataFrame) -> DataFrame:
    """template_id, block: templates of the same names (so with equal adjustments) and about the same strength (sum of all their list entries)."""
    power = hits.select("template_id", "n").unionByName(fit.select("template_id", "n")).groupBy("template_id").agg(F.sum("n").alias("w"))
    level = F.floor(F.log2(F.col("w").cast("double")) * LEVELS).cast("string")
    return power.join(info, "template_id").select("template_id", F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in NAMES], level).alias("block"), *NAMES)


def block_bounds(sig: DataFrame, words: DataFrame, hits: DataFrame, fit: DataFrame, names: DataFrame, table=P.TEMPLATE_ADJUSTMENTS) -> DataFrame:
    """signature, block, bound (no rescored template of the block is above it), least (at least so many are candidates).

    hits and fit carry the block; a block's part of a list is summed up by its maximum and its length.
    """
    top = lambda df, key: df.groupBy("block", key).agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("least"))
    by_word = top(hits, "keyword").join(words, "keyword").select("signature", "block", (F.col("m") * F.col("times")).cast("double").alias("score"), "least")
    by_cat = top(fit, "category").join(sig.select("signature", "category"), "category").select("signature", "block", (F.col("m") * 3.0).alias("score"), "least")
    sums = by_word.unionByName(by_cat).groupBy("signature", "block").agg(F.sum("score").alias("score"), F.max("least").alias("least"))
    return template_rescore(sums.join(names, "block"), sig, table).select("signature", "block", F.col("score").alias("bound"), "least")


def template_topk(signatures: DataFrame, kb: DataFrame, day: int, k: int = 5, table=P.TEMPLATE_ADJUSTMENTS) -> DataFrame:
    """The k best rows of template_rescore(template_candidates()) per signature (score, then template_id), without writing that table.

    A threshold search over the lists of template_lists(), one template for each class of equal lists and names; these lie in blocks of
    equal names and like strength.  Each signature first visits its blocks of highest bound until they hold k candidates for certain; the
    k-th best score found there is its floor, and of the other blocks only those whose bound reaches the floor are visited.  Nothing else
    can be among the k best, ties included.  The k best templates are among the k first ones of the k best classes.
    """
    sig = stage(signatures.select("signature", "category", "keywords", "flags").distinct())
    words, hits, fit, info = template_lists(sig, kb, day)
    words = stage(words)
    hits, fit, members = template_classes(stage(hits), stage(fit), info)
    blocks = stage(template_blocks(hits, fit, info))
    hits, fit = [stage(df.join(blocks.select("template_id", "block"), "template_id")) for df in (hits, fit)]
    names = blocks.groupBy("block").agg(*[F.min(c).alias(c) for c in NAMES])
    bounds = stage(block_bounds(sig, words, hits, fit, names, table))

    def best(visits: DataFrame) -> DataFrame:
        by_word = visits.join(words, "signature").join(hits, ["block", "keyword"]).select("signature", "template_id", (F.col("n") * F.col("times")).cast("double").alias("s"))
        by_cat = visits.join(sig.select("signature", "category"), "signature").join(fit, ["block", "category"]).select("signature", "template_id", (F.col("n") * 3.0).alias("s"))
        total = by_word.unionByName(by_cat).groupBy("signature", "template_id").agg(F.sum("s").alias("score"))
        scored = template_rescore(total.join(blocks.select("template_id", *NAMES), "template_id"), sig, table)
        return O.top_k(scored, ["signature"], [F.desc("score"), F.col("template_id")], k)

    # a signature's blocks are few (names x levels), so one window may hold them
    before = Window.partitionBy("signature").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    order = bounds.withColumn("_have", F.coalesce(F.sum("least").over(before), F.lit(0)))
    first = stage(best(order.where(F.col("_have") < k).select("signature", "block")))
    floor = first.where(F.col("rank") == k).select("signature", F.col("score").alias("_floor"))
    rest = order.where(F.col("_have") >= k).join(floor, "signature").where(F.col("bound") >= F.col("_floor")).select("signature", "block")
    both = O.top_k(first.unionByName(best(rest)).drop("rank"), ["signature"], [F.desc("score"), F.col("template_id")], k).drop("rank")
    leading = O.top_k(members.select("class", F.col("template_id").alias("_id")), ["class"], ["_id"], k).drop("rank")
    each = both.join(leading, both["template_id"] == leading["class"]).withColumn("template_id", F.col("_id")).drop("class", "_id")
    return O.top_k(each, ["signature"], [F.desc("score"), F.col("template_id")], k).drop("rank")


def profile_flags(profiles: DataFrame, words: dict = P.PROFILE_WORDS) -> DataFrame:
    return profiles.select("task_id", X.all_keys("profile", words).alias("flags"))


def template_rescore(candidates: DataFrame, signatures: DataFrame, table=P.TEMPLATE_ADJUSTMENTS) -> DataFrame:
    """Adjust candidate scores by profile words and template names, with reasons."""
    c = candidates.join(signatures.select("signature", "flags").distinct(), "signature")
    tests = []
    for _, flag, present, column, word, exact, _, _ in table:
        name = f"coalesce({column}, '')"
        test = f"{name} = {X.sql_lit(word)}" if exact else f"contains({name}, {X.sql_lit(word)})"
        tests.append(f"array_contains(flags, {X.sql_lit(flag)}) = {X.sql_lit(present)} AND {test}")
    adjust = F.expr(" + ".join(f"IF({t}, {r[6]!r}D, 0D)" for t, r in zip(tests, table)))
    reasons = F.expr("array_compact(array(" + ", ".join(f"IF({t}, {X.sql_lit(r[7])}, NULL)" for t, r in zip(tests, table)) + "))")
    return c.withColumn("base_score", F.col("score")).withColumn("score", F.col("score") + adjust).withColumn("reasons", reasons).drop("flags")


def template_match(signatures: DataFrame, rescored: DataFrame, manual: DataFrame | None = None, choices: DataFrame | None = None, templates: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Manual choice, else an accepted model choice among the best five, else the best candidate."""
    top = O.top_k(rescored, ["signature"], [F.desc("score"), F.col("template_id")], k)
    t = signatures.select("task_id", "signature").join(top, "signature")
    tier, conf, reason = F.lit(2), F.lit(0.5), F.lit("heuristic_top_candidate")
    if choices is not None:
        c = choices.select("task_id", F.col("template_id").alias("_c"), F.col("confidence").alias("_f"), F.col("reason").alias("_r"))
        t = t.join(c, "task_id", "left")
        ok = (F.col("_c") == F.col("template_id")) & (F.col("_f") >= 0.55)
        tier, conf = F.when(ok, 1).otherwise(2), F.when(ok, F.col("_f")).otherwise(0.5)
        reason = F.when(ok, F.coalesce(F.nullif("_r", F.lit("")), F.lit("llm_rerank"))).otherwise("heuristic_top_candidate")
    cols = ["template_id", "template_name", "category_lv1", "category_lv2", "score", "match_reason", "match_confidence"]
    t = t.withColumn("match_reason", reason).withColumn("match_confidence", conf).withColumn("_tier", tier).select("task_id", "_tier", "rank", *cols)
    if manual is not None:
        info = templates.groupBy("template_id").agg(*[F.min(c).alias(c) for c in ("template_name", "category_lv1", "category_lv2")])
        m = manual.select("task_id", "template_id").join(info, "template_id").select(
            "task_id", F.lit(0).alias("_tier"), F.lit(0).cast("long").alias("rank"), "template_id", "template_name", "category_lv1", "category_lv2",
            F.lit(999.0).alias("score"), F.lit("manual_selected").alias("match_reason"), F.lit(None).cast("double").alias("match_confidence"))
        t = t.unionByName(m)
    return O.first_by(t, ["task_id"], ["_tier", "rank"]).drop("_tier", "rank")


def usage_profile(clauses: DataFrame, variant: str = "registry", n_title: int | None = None, n_content: int | None = None, content_chars: int | None = None) -> DataFrame:
    """Usage type of each template from its name, categories and clauses (all, or the leading ones).

    The context is never concatenated: each piece gives a bit mask of the
    dictionary words and the masks are OR-ed per template.
    """
    reg = variant == "registry"
    storage = P.USAGE_STORAGE if reg else P.USAGE_STORAGE_RETRIEVAL
    survey, technical = (P.USAGE_SURVEY, P.USAGE_TECHNICAL) if reg else (P.USAGE_SURVEY_RETRIEVAL, P.USAGE_TECHNICAL_RETRIEVAL)
    lists = {"occupancy": storage["occupancy"], "service": storage["service"], "storage": storage["generic"], "survey": survey, "technical": technical, "audit": P.USAGE_AUDIT}
    if reg:
        lists |= {"design": P.USAGE_DESIGN, "lab": P.USAGE_LAB, "legal": P.USAGE_LEGAL}
    c = clauses.where(F.col("template_id").isNotNull())
    head = c.groupBy("template_id").agg(*[F.min(x).alias(x) for x in ("template_name", "category_lv1", "category_lv2")])
    order = ["page_start", F.coalesce("clause_no", F.lit("")), "title"]
    lead = O.numbered(c.select("template_id", "title", "content", "page_start", "clause_no"), ["template_id"], order, "_p", F.col("page_start"))
    lead = lead if n_title is None else lead.where(F.col("_p") <= n_title)
    content = X.strip(X.text_of("content")) if content_chars is None else F.substring(X.strip(X.text_of("content")), 1, content_chars)
    piece = F.concat_ws("\n", X.strip(X.text_of("title")), content if n_content is None else F.when(F.col("_p") <= n_content, content))
    domain = F.concat_ws("\n", "template_name", "category_lv1", "category_lv2") if reg else F.col("template_name")
    pieces = lead.select("template_id", piece.alias("t"), F.col("_p"), F.col("title")).unionByName(head.select("template_id", domain.alias("t"), F.lit(0).cast("long").alias("_p"), F.lit(None).cast("string").alias("title")))
    aggs = []
    for name, words in lists.items():
        aggs.append(F.bit_or(X.word_bits("t", words)).alias(f"m_{name}"))
    titles = F.collect_list(F.when((F.col("_p") > 0) & (F.col("_p") <= 4) & (F.length(X.strip("title")) > 0), F.struct("_p", X.strip("title").alias("v"))))
    u = pieces.groupBy("template_id").agg(*aggs, F.slice(F.transform(F.array_sort(titles), lambda s: s["v"]), 1, 3).alias("fallback")).join(head, "template_id")
    u = u.withColumns({f"b_{n}": X.first_words(f"m_{n}", w, 4) for n, w in lists.items()})
    name = F.coalesce("template_name", F.lit(""))
    dom = F.concat_ws("\n", "template_name", "category_lv1", "category_lv2") if reg else name
    u = u.withColumn("_d", dom).withColumn("_n", name)
    has = lambda n: F.size(f"b_{n}") > 0
    out = lambda n, b: F.struct(F.lit(P.USAGE_NAMES[n]).alias("usage_profile"), b.alias("usage_basis"))
    or_name = (lambda b: F.when(F.size(b) > 0, b).otherwise(F.array("_n"))) if reg else (lambda b: b)
    d = lambda *ws: reduce(lambda a, b: a | b, [F.col("_d").contains(w) for w in ws])
    r = F.when(d("仓储") & (F.size("b_occupancy") >= F.greatest(F.lit(2), F.size("b_service"))), out("occupancy", F.col("b_occupancy")))
    r = r.when(d("仓储") & has("service"), out("service", F.col("b_service"))).when(d("仓储"), out("storage", or_name(F.col("b_storage"))))
    r = r.when(d("技术服务") & has("survey"), out("survey", F.col("b_survey"))).when(d("技术服务"), out("technical", or_name(F.col("b_technical"))))
    r = r.when(d("审计") & has("audit"), out("audit", F.col("b_audit")))
    if reg:
        r = r.when(d("勘察", "设计") & has("design"), out("design", F.col("b_design"))).when(d("检测", "检验") & has("lab"), out("lab", F.col("b_lab")))
        r = r.when(d("法律", "律师") & has("legal"), out("legal", F.col("b_legal")))
        for w, n in (("仓储合同", "storage"), ("技术服务合同", "technical"), ("合同", "generic")):
            r = r.when(F.col("_n").contains(w), out(n, F.col("fallback")))
    none = F.struct(F.lit(None).cast("string").alias("usage_profile"), (F.col("fallback") if reg else F.array().cast("array<string>")).alias("usage_basis"))
    return u.select("template_id", r.otherwise(none).alias("u")).select("template_id", "u.*")


# --- policy and template basis ----------------------------------------------


RICH = 64


def shared_letters_topk(sets: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """set, sig, c: per set of characters the k signatures that share most of them (at least two), equal counts by first_id.

    sets: set (sorted distinct characters); texts: sig (distinct characters as a string), first_id, one row a signature.
    Prefix filter: the k-th best overlap with the RICH signatures of most characters is a floor of each set.  A signature that reaches
    it holds one of the set's (size - floor + 1) rarest characters, so only their postings are joined, by row numbers; the overlap is
    then counted on the candidates.
    """
    sigs = stage(texts.select("sig", "first_id", F.monotonically_increasing_id().alias("_s")))
    rich = [r[0] for r in sigs.orderBy(F.desc(F.length("sig")), "sig").select("sig").limit(RICH).collect()]
    overlap = F.transform(X.literal(rich or [""]), lambda s: F.size(F.filter("set", lambda c: F.contains(s, c))))
    floor = F.greatest(F.coalesce(F.get(F.sort_array(overlap, asc=False), F.lit(k - 1)), F.lit(0)), F.lit(2))
    sets = stage(sets.select("set").distinct().withColumn("floor", floor).withColumn("_q", F.monotonically_increasing_id()))
    letters = sets.select("_q", F.explode("set").alias("ch"))
    postings = sigs.select("_s", F.explode(F.split("sig", "")).alias("ch"))
    counts = postings.join(letters.select("ch").distinct(), "ch", "left_semi").groupBy("ch").agg(F.count(F.lit(1)).alias("f"))
    rarest = letters.join(counts, "ch", "left").groupBy("_q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "ch"))).alias("by_f"))
    prefix = rarest.join(sets, "_q").select("_q", F.explode(F.slice("by_f", F.lit(1), F.greatest(F.size("by_f") - F.col("floor") + 1, F.lit(0)))).alias("p"))
    pairs = prefix.select("_q", F.col("p.ch").alias("ch")).join(postings, "ch").select("_q", "_s").distinct()
    held = F.size(F.filter("set", lambda c: F.contains(F.col("sig"), c)))
    scored = pairs.join(sets, "_q").join(sigs, "_s").select("set", "sig", "first_id", "floor", held.alias("c")).where(F.col("c") >= F.col("floor"))
    return O.top_k(scored, ["set"], [F.desc("c"), F.col("first_id")], k, "_g").select("set", "sig", "c")


def policy_pool_topk(queries: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """Top clauses per distinct query: 5 for the whole query, 1 per term; shared characters where neither occurs.

    Queries whose needles that occur anywhere are the same score alike and form a class; clauses are scored once for each class.
    Shared characters can only matter when the k-th direct score is at most 1, so only those queries are searched by characters.  There,
    queries of the same characters are one set, and clauses with the same relevant characters score alike and are one signature.
    """
    q = stage(queries.select("query").where(F.col("query") != "").distinct())  # read several times
    norm = F.translate("query", "，。/", "   ")
    terms = q.select("query", F.explode(F.filter(F.split(norm, f"[{X.WS}]+", -1), lambda x: x != "")).alias("needle")).groupBy("query", "needle").agg(F.count(F.lit(1)).cast("double").alias("w"))
    needles = terms.unionByName(q.select("query", F.col("query").alias("needle"), F.lit(5.0).alias("w")))
    texts = pool.select(_place(pool).alias("k"), X.joined("title", "content").alias("hay"))
    pairs = stage(substring_pairs(texts, "k", "hay", needles, "needle"))  # read by the classes and by the scores
    needles = needles.join(pairs.select("needle").distinct(), "needle", "left_semi")
    classes = stage(needles.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("needle", "w"))).alias("ns")).withColumn("class", F.sha2(F.to_json("ns"), 256)))
    weights = classes.groupBy("class").agg(F.first("ns").alias("ns")).select("class", F.explode("ns").alias("n")).select("class", "n.*")
    direct = pairs.join(weights, "needle").groupBy("class", "k").agg(F.sum("w").alias("score"))
    lead = stage(O.top_k(direct, ["class"], [F.desc("score"), F.col("k")], k)).join(classes.select("query", "class"), "class").drop("class")
    sure = lead.where((F.col("rank") == k) & (F.col("score") > 1)).select("query")
    open_q = q.join(sure, "query", "left_anti")
    letters = F.array_sort(F.array_distinct(F.filter(F.split("query", ""), lambda c: ~F.rlike(c, F.lit(f"^[{X.WS}]*$")))))
    open_q = stage(open_q.select("query", F.length("query").alias("n"), letters.alias("set")))
    alphabet = bounded_values(open_q.select(F.explode("set").alias("ch")), "ch", 20000)
    own = F.array_distinct(F.split("hay", ""))
    if alphabet is not None:
        own = F.array_intersect(own, X.literal(alphabet))
    sig = stage(texts.select("k", F.array_join(F.array_sort(own), "").alias("sig")))
    # a direct hit scores at least 1 and characters at most 1, so the best 2k clauses by characters are enough
    groups = shared_letters_topk(open_q, sig.groupBy("sig").agg(F.min("k").alias("first_id")), 2 * k)
    groups = groups.join(open_q, "set").select("query", "sig", (F.col("c") / F.col("n")).alias("score"))
    fuzzy = groups.join(O.top_k(sig, ["sig"], ["k"], 2 * k, "_r"), "sig").select("query", "k", "score")
    allc = lead.select("query", "k", "score").unionByName(fuzzy).groupBy("query", "k").agg(F.max("score").alias("score"))
    return O.top_k(allc, ["query"], [F.desc("score"), F.col("k")], k).select("query", "k.clause_id", "score", "rank")


def policy_basis(requests: DataFrame, pool: DataFrame, k: int = 3, content_chars: int | None = None) -> DataFrame:
    """Basis clauses per request: the given ids that are live, in order; else the pool lookup.

    requests: request_id, query, clause_ids.  Rows come with position and details.
    """
    given = requests.select("request_id", F.posexplode("clause_ids").alias("pos", "clause_id")).join(pool.select("clause_id"), "clause_id", "left_semi")
    given = given.select("request_id", "clause_id", (F.col("pos") + 1).cast("long").alias("pos"))
    rest = requests.join(given.select("request_id").distinct(), "request_id", "left_anti")
    looked = rest.select("request_id", "query").join(policy_pool_topk(rest, pool, k), "query").select("request_id", "clause_id", F.col("rank").alias("pos"))
    detail = pool.select("clause_id", "title", "content" if content_chars is None else F.substring("content", 1, content_chars).alias("content"), "page_start", "page_end", "document_id")
    return given.unionByName(looked).join(detail, "clause_id")


def template_basis(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """First template clause whose title contains or is contained in the given title, else the first clause.

    Distinct (template, title) pairs are resolved once; the best row is a combinable aggregate.
    """
    pairs = requests.select("template_id", "title").distinct()
    t = templates.where(F.col("template_id").isNotNull()).select("template_id", F.col("title").alias("matched_title"), F.col("page_start").alias("matched_page"), "page_start", F.coalesce("clause_no", F.lit("")).alias("no"), "clause_id")
    titles = t.groupBy("template_id", "matched_title").agg(F.min(F.struct("page_start", "no", "clause_id")).alias("o"))
    j = pairs.join(titles, "template_id").where(F.contains("matched_title", "title") | F.contains("title", "matched_title"))
    hit = j.groupBy("template_id", "title").agg(F.min_by(F.struct("matched_title", F.col("o.page_start").alias("matched_page")), "o").alias("b"))
    first = t.groupBy("template_id").agg(F.min_by(F.struct("matched_title", "matched_page"), F.struct("page_start", "no", "clause_id")).alias("f"))
    r = pairs.join(first, "template_id").join(hit, ["template_id", "title"], "left").withColumn("m", F.coalesce("b", "f"))
    return requests.join(r.select("template_id", "title", "m.matched_title", "m.matched_page"), ["template_id", "title"])
