"""Sequence similarity.  The exact ratio is the standard library's; Spark decides
which pairs are compared and where, and bounded chunks keep every call small."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher
    return SequenceMatcher(None, a, b).ratio()


#: Titles come back in every chunk of a task; the bound keeps a worker's memory fixed, never the result.
title_ratio = lru_cache(maxsize=1 << 14)(_ratio)


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matched characters (argument order matters above 200 characters)."""
    memo = {}
    out = []
    for x, y in zip(a, b):
        if (x, y) not in memo:
            memo[x, y] = _ratio(x or "", y or "")
        out.append(memo[x, y])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.LongType())
def matching_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher
    return pd.Series([sum(m.size for m in SequenceMatcher(None, x or "", y or "").get_matching_blocks()) for x, y in zip(a, b)], dtype="int64")


def char_counts(texts: list[str]):
    """(counts matrix, lengths) over the characters of the given texts."""
    import numpy as np
    n = np.array([len(t) for t in texts], dtype="int64")
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="uint32")
    seen = np.flatnonzero(np.bincount(codes)) if len(codes) else np.array([0])
    cells = np.repeat(np.arange(len(texts)), n) * len(seen) + np.searchsorted(seen, codes)
    m = np.bincount(cells, minlength=len(texts) * len(seen)).reshape(len(texts), len(seen))
    return m.astype("int32"), n


def upper_bounds(m, n, i: int, rows):
    """Upper bound of the ratio of text i with each of the given texts: shared characters with multiplicity."""
    import numpy as np
    total = n[i] + n[rows]
    shared = np.minimum(m[i][None, :], m[rows]).sum(axis=1)
    return np.where(total == 0, 1.0, 2.0 * shared / np.maximum(total, 1))


class Subsequences:
    """Length of the longest common subsequence of a text and each of the given ones: matching blocks form a common subsequence,
    so twice that over the lengths is never below the ratio.

    All texts lie behind each other in one number, a bit a character and an empty bit between two, and are searched in one pass.
    """

    def __init__(self, texts: list[str]):
        import numpy as np
        self.codes, ends = _joined([t + "\0" for t in texts])
        self.starts, self.n = ends[:-1], np.diff(ends) - 1
        self.size = -(-len(self.codes) // 8)
        inside = np.ones(len(self.codes), dtype="uint8")
        inside[ends[1:] - 1] = 0
        self.inside, self.full, self.masks = inside, self._number(inside), {}

    @staticmethod
    def _number(bits) -> int:
        import numpy as np
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def _mask(self, ch: str) -> int:
        if ch not in self.masks:
            self.masks[ch] = self._number((self.codes == ord(ch)) & self.inside)
        return self.masks[ch]

    def lengths(self, text: str):
        import numpy as np
        v = full = self.full
        for mask in map(self._mask, text):
            if mask:  # other characters change nothing
                u = v & mask
                v = ((v + u) | (v - u)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes(self.size, "little"), dtype="uint8"), bitorder="little")
        return self.n - np.add.reduceat(bits, self.starts, dtype="int64")


def places(text: str) -> tuple[str, set | None]:
    """The text as the sequence ratio looks it up: of 200 characters or more, the frequent ones start no match and are
    blotted out; with the set of the others (None when there are none to blot out)."""
    if len(text) < 200:
        return text, None
    from collections import Counter
    held = Counter(text)
    rare = {ch for ch, times in held.items() if times <= len(text) // 100 + 1}
    if len(rare) == len(held):
        return text, None
    return "".join(ch if ch in rare else "\ud800" for ch in text), rare  # a code no text of a table can hold


def ratio_to(a: str, b: str, at: tuple[str, set | None], least: float = 0.0) -> float:
    """SequenceMatcher(None, a, b).ratio() with at = places(b), or -1 as soon as it can't reach ``least``.

    The longest match (first in a, then in b) grows by plain text search: a longer one is looked for at each place of a once.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    y, rare = at
    if rare is None:
        x, starts = a, range(len(a))
    else:
        x = "".join(ch if ch in rare else "\ud801" for ch in a)
        starts = [i for i, ch in enumerate(x) if ch in rare]
    from bisect import bisect_left
    matched, rest, need = 0, min(len(a), len(b)), (least - 1e-9) * total / 2
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        if matched + rest < need:
            return -1.0
        alo, ahi, blo, bhi = open_.pop()
        rest -= min(ahi - alo, bhi - blo)
        i0, j0, size = alo, blo, 0
        for i in (range(alo, ahi) if rare is None else starts[bisect_left(starts, alo):bisect_left(starts, ahi)]):
            while i + size < ahi and y.find(x[i:i + size + 1], blo, bhi) >= 0:
                i0, size = i, size + 1
        if size:
            j0 = y.find(x[i0:i0 + size], blo, bhi)
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            matched += size
            for part in ((alo, i0, blo, j0), (i0 + size, ahi, j0 + size, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    open_.append(part)
                    rest += min(part[1] - part[0], part[3] - part[2])
    return 2.0 * matched / total


#: A slice of ratios_of holds pairs of at most about so many characters of b; pairs with more match points than that go one by one.
SLICE = 1 << 18
POINTS = 1 << 21


def _joined(texts: list[str]):
    """(code points of all texts, one after the other, and where each begins, with the end)."""
    import numpy as np
    ends = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("int64"), ends


def _spans(first, count):
    """The numbers first[x] .. first[x] + count[x] - 1 for each x, one after the other, and x for each."""
    import numpy as np
    x = np.repeat(np.arange(len(count)), count)
    return np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + first[x], x


class Grams:
    """Where the runs of k characters of texts a, by value, occur; and which of them begin at each place of texts b (frequent ones start none)."""

    def __init__(self, a, b, rare, k: int):
        import numpy as np
        code = lambda c, width: sum(c[s:len(c) - k + 1 + s] * width ** (k - 1 - s) for s in range(k)) if len(c) >= k else c[:0]
        width = int(max(a.max(initial=0), b.max(initial=0))) + 1
        own, held = code(a, width), code(b, width)
        seen = np.unique(own)
        self.k, self.n = k, len(a) + 1
        self.at = np.sort(np.searchsorted(seen, own) * self.n + np.arange(len(own)))
        self.index = self.at % self.n
        value = np.minimum(np.searchsorted(seen, held), max(len(seen) - 1, 0))
        known = seen[value] == held if len(seen) else np.zeros(len(held), dtype=bool)
        for s in range(k):
            known &= rare[s:len(b) - k + 1 + s] if len(b) >= k else False
        self.places = np.flatnonzero(known)
        self.value = value[self.places]

    def spots(self, alo, ahi, blo, bhi):
        """Per place of b inside a range that begins a run held by the range's part of a: range, place, first index in ``at`` and their number."""
        import numpy as np
        lo = np.searchsorted(self.places, blo)
        n = np.maximum(np.searchsorted(self.places, bhi - self.k + 1) - lo, 0)
        x, r = _spans(lo, np.where(ahi - alo >= self.k, n, 0))
        value = self.value[x] * self.n
        first = np.searchsorted(self.at, value + alo[r])
        count = np.searchsorted(self.at, value + ahi[r] - self.k + 1) - first
        hit = count > 0
        return r[hit], self.places[x[hit]], first[hit], count[hit]


def _blocks(a, b, grams: Grams, ranges, spots, matched):
    """Take the longest common block of each range, then of the two ranges beside it, while one of k characters is left.

    ranges: pair, alo, ahi, blo, bhi.  Adds the sizes to ``matched`` by pair and returns the ranges left without such a block.
    All ranges advance together: match points are sorted by range and diagonal once, a run of them is a block.
    """
    import numpy as np
    k = grams.k
    pair, alo, ahi, blo, bhi = ranges
    r, j, first, count = spots
    at, x = _spans(first, count)
    j, r = j[x], r[x]
    i, j = grams.index[at] - alo[r], j - blo[r]
    # powers of two, so that a sorted key is taken apart by shifts
    low, high = [int(max((to - lo).max(initial=0), 1)).bit_length() for lo, to in ((alo, ahi), (blo, bhi))]
    both = max(low, high) + 1
    key = (r << both | (j - i + (1 << low))) << low | i
    key.sort()
    i, d, r = key & ((1 << low) - 1), key >> low & ((1 << both) - 1), key >> (low + both)
    j = d - (1 << low) + i + blo[r]
    i += alo[r]
    left = []
    while True:
        some = np.zeros(len(pair), dtype=bool)
        some[r] = True
        left.append(np.stack([v[~some] for v in (pair, alo, ahi, blo, bhi)]))
        if not len(r):
            return np.concatenate(left, axis=1)
        r = (np.cumsum(some) - 1)[r]
        pair, alo, ahi, blo, bhi = [v[some] for v in (pair, alo, ahi, blo, bhi)]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1]))
        size = np.diff(np.append(start, len(key)))
        # the longest, of these the first in a, of these the first in b
        o = r[start]
        rank = (size << low | ((1 << low) - 1 - (i[start] - alo[o]))) << high | ((1 << high) - 1 - (j[start] - blo[o]))
        top = np.full(len(pair), -1)
        np.maximum.at(top, o, rank)
        best = np.flatnonzero(rank == top[o])
        best = best[np.argsort(o[best])]
        i0, j0, size = i[start[best]], j[start[best]], size[best] + k - 1
        # frequent characters next to the block belong to it
        go = np.arange(len(pair))
        while len(go):
            go = go[(i0[go] > alo[go]) & (j0[go] > blo[go])]
            go = go[a[i0[go] - 1] == b[j0[go] - 1]]
            i0[go] -= 1
            j0[go] -= 1
            size[go] += 1
        go = np.arange(len(pair))
        while len(go):
            go = go[(i0[go] + size[go] < ahi[go]) & (j0[go] + size[go] < bhi[go])]
            go = go[a[i0[go] + size[go]] == b[j0[go] + size[go]]]
            size[go] += 1
        np.add.at(matched, pair, size)
        before = (i + k <= i0[r]) & (j + k <= j0[r])
        keep = before | ((i >= (i0 + size)[r]) & (j >= (j0 + size)[r]))
        key, i, j = key[keep], i[keep], j[keep]
        r = 2 * r[keep] + ~before[keep]
        two = lambda x, y: np.stack([x, y], axis=1).ravel()
        pair, alo, ahi, blo, bhi = two(pair, pair), two(alo, i0 + size), two(i0, ahi), two(blo, j0 + size), two(j0, bhi)


def ratios_of(a_texts: list[str], b_texts: list[str]):
    """A function of (ia, jb), arrays of places in the lists: SequenceMatcher(None, a_texts[ia], b_texts[jb]).ratio() of each pair.

    The blocks of many pairs are found together, those of three characters or more first, then of two, then of one: a range without a
    longer run never gets one, since its parts only shrink.
    """
    import numpy as np
    a, a0 = _joined(a_texts)
    b, b0 = _joined(b_texts)
    seen = np.flatnonzero(np.bincount(np.concatenate([a, b]))) if len(a) + len(b) else np.array([0])
    a, b = np.searchsorted(seen, a), np.searchsorted(seen, b)
    n = np.diff(b0)
    owner = np.repeat(np.arange(len(n)), n)
    cell, times = np.unique(owner * len(seen) + b, return_inverse=True, return_counts=True)[1:]
    rare = (n[owner] < 200) | (times[cell] <= n[owner] // 100 + 1)
    grams = [Grams(a, b, rare, k) for k in (3, 2, 1)]

    def sliced(ia, jb):
        matched = np.zeros(len(ia), dtype="int64")
        ranges = np.stack([np.arange(len(ia)), a0[ia], a0[ia + 1], b0[jb], b0[jb + 1]])
        for g in grams:
            ranges = ranges[:, (ranges[2] - ranges[1] >= 1) & (ranges[4] - ranges[3] >= 1)]
            spots = g.spots(*ranges[1:])
            if spots[3].sum() > POINTS:
                if len(ia) == 1:
                    return np.array([ratio_to(a_texts[ia[0]], b_texts[jb[0]], places(b_texts[jb[0]]))])
                half = len(ia) // 2
                return np.concatenate([sliced(ia[:half], jb[:half]), sliced(ia[half:], jb[half:])])
            ranges = _blocks(a, b, g, ranges, spots, matched)
        # where nothing starts a match, the frequent characters that both parts begin with still are one
        pair, i, ahi, j, bhi = ranges
        go = np.arange(len(pair))
        while len(go):
            go = go[(i[go] < ahi[go]) & (j[go] < bhi[go])]
            go = go[a[i[go]] == b[j[go]]]
            i[go] += 1
            j[go] += 1
            np.add.at(matched, pair[go], 1)
        total = np.diff(a0)[ia] + n[jb]
        return np.where(total == 0, 1.0, 2.0 * matched / np.maximum(total, 1))

    at = {t: x for x, t in enumerate(a_texts)}
    same = np.array([at.get(t, -1) for t in b_texts], dtype="int64")

    def ratios(ia, jb):
        ia, jb = np.asarray(ia, dtype="int64"), np.asarray(jb, dtype="int64")
        out = np.ones(len(ia))  # equal texts match as a whole
        other = np.flatnonzero(same[jb] != ia)
        ia, jb = ia[other], jb[other]
        part = np.cumsum(n[jb]) // SLICE
        for x in np.unique(part):
            out[other[part == x]] = sliced(ia[part == x], jb[part == x])
        return out

    return ratios


def _places_of(texts: list[str]):
    """The distinct texts and the place of each in them."""
    import numpy as np
    at: dict[str, int] = {}
    where = np.array([at.setdefault(t, len(at)) for t in texts], dtype="int64")
    return list(at), where


def best_of_tasks(template: list, contract: list) -> list[tuple]:
    """Best contract clause of each task for each template clause, among the given clauses of any number of tasks.

    Candidates of a task are tried in descending order of their bound, the first of all tasks together, then the second;
    the others follow only where their bound can reach the best score.  Equal scores go to the earlier contract clause.
    """
    import numpy as np
    k = len(template)
    a_texts, a_at = _places_of([t["content"] for t in template])
    b_texts, b_at = _places_of([c["content"] for c in contract])
    m, n = char_counts(a_texts + b_texts)
    ratios = ratios_of(a_texts, b_texts)
    tasks = _places_of([c["task_id"] for c in contract])[1]
    ords = np.array([c["ord"] for c in contract], dtype="int64")
    kinds, kind = _places_of([(c["norm"], c["core_label"], c["title"]) for c in contract])
    ti, cj, title, bonus, bound = [], [], [], [], []
    for i, t in enumerate(template):
        by_kind = np.array([title_ratio(t["norm"], norm) for norm, _, _ in kinds])[kind]
        more = np.array([(t["clause_type"] == label) + (t["clause_type"] == "general" and t["title"] in full) for _, label, full in kinds])[kind]
        base = by_kind * P.TITLE_WEIGHT + more * P.MATCH_BONUS
        la, lb = n[a_at[i]], n[len(a_texts) + b_at]
        by_length = np.where(la + lb == 0, 1.0, 2.0 * np.minimum(la, lb) / np.maximum(la + lb, 1))
        rows = np.flatnonzero(base + by_length * P.CONTENT_WEIGHT + 1e-9 >= P.MISSING_BELOW)
        upper = base[rows] + upper_bounds(m, n, a_at[i], len(a_texts) + b_at[rows]) * P.CONTENT_WEIGHT
        live = upper + 1e-9 >= P.MISSING_BELOW
        rows = rows[live]
        ti.append(np.full(len(rows), i))
        cj.append(rows)
        title.append(by_kind[rows])
        bonus.append(more[rows])
        bound.append(upper[live])
    ti, cj, title, bonus, bound = map(np.concatenate, (ti, cj, title, bonus, bound))
    group = tasks[cj] * k + ti
    order = np.lexsort((ords[cj], -bound, group))
    ti, cj, title, bonus, bound, group = [v[order] for v in (ti, cj, title, bonus, bound, group)]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
    at = np.cumsum(first) - 1
    nth = np.arange(len(at)) - np.flatnonzero(first)[at]
    score = np.full(len(at), -1.0)
    best = np.full(int(first.sum()), P.MISSING_BELOW)
    for turn in (nth == 0, nth == 1, nth > 1):
        x = np.flatnonzero(turn & (bound + 1e-9 >= best[at]))
        pairs, own = np.unique(a_at[ti[x]] * len(b_texts) + b_at[cj[x]], return_inverse=True)
        ratio = ratios(*np.divmod(pairs, max(len(b_texts), 1)))[own]
        s = title[x] * P.TITLE_WEIGHT + ratio * P.CONTENT_WEIGHT
        for step in (1, 2):  # the two bonuses are added one after the other, as separate steps
            s = np.where(bonus[x] >= step, s + P.MATCH_BONUS, s)
        score[x] = s
        np.maximum.at(best, at[x], s)
    won = np.flatnonzero((score >= P.MISSING_BELOW) & (score == best[at]))
    won = won[np.lexsort((ords[cj[won]], group[won]))]
    won = won[np.concatenate([[True], group[won][1:] != group[won][:-1]])] if len(won) else won
    return [(contract[c]["task_id"], template[t]["clause_id"], contract[c]["clause_id"], int(ords[c]), s, int(contract[c]["length"]))
            for t, c, s in zip(ti[won].tolist(), cj[won].tolist(), score[won].tolist())]


def best_clauses(template: list, contract: list) -> list[tuple]:
    """best_of_tasks for the clauses of one contract, without its id."""
    return [r[1:] for r in best_of_tasks(template, [{**c, "task_id": ""} for c in contract])]


def runs_of(blocks: list) -> list[tuple]:
    """(page, block_no, size, text) of each run of one to MAX_RUN consecutive blocks of a page that holds more than blanks."""
    runs = []
    for s, b in enumerate(blocks):
        filled, text = False, ""
        for size, w in enumerate(blocks[s:s + P.MAX_RUN], start=1):
            if w["page"] != b["page"]:
                break
            filled, text = filled or bool(w["text"].strip()), text + w["norm"]
            if filled:
                runs.append((b["page"], b["block_no"], size, text))
    return runs


def holding(text: str, runs: list[tuple]) -> list[int]:
    """Places of the runs that hold the text or are held by it; neither is empty.

    Runs of one beginning follow each other, each beginning with the one before: a text that is not in the longest is in none of them,
    and what follows a run that is not in the text is not in it either.
    """
    out, j = [], 0
    while j < len(runs):
        end = j + 1
        while end < len(runs) and runs[end][3].startswith(runs[end - 1][3]):
            end += 1
        first = next((x for x in range(j, end) if runs[x][3]), end)
        for x in range(first, end):
            if runs[x][3] not in text:
                break
            out.append(x)
        if text in runs[end - 1][3]:
            done = set(out[-(end - j):])
            out += [x for x in range(first, end) if x not in done and text in runs[x][3]]
        j = end
    return out


def best_runs(targets: list, blocks: list) -> list[tuple]:
    """Best run of one to four consecutive blocks of a page for each target inside one chunk pair.

    A target states the score it already has (``floor``); only runs that reach it are looked for, in descending order of their bound
    (longest common subsequence, of those that may win by their shared characters).
    """
    import numpy as np
    runs = runs_of(blocks)
    if not runs:
        return []
    cut = P.EVIDENCE_CHARS
    a_texts, a_at = _places_of([t["norm"][:cut] for t in targets])
    b_texts, b_at = _places_of([r[3][:cut] for r in runs])
    m, n = char_counts(a_texts + b_texts)
    rows = len(a_texts) + b_at
    pages = np.array([r[0] for r in runs])
    empty = np.array([not r[3] for r in runs])
    common, held_at, out = None, {}, []
    for i, t in enumerate(targets):
        hint = np.where(pages == t["page_hint"], P.HINT_BONUS, 0.0)
        best, pick, score, closed, o = t["floor"], None, hint.copy(), empty | (not t["norm"]), []
        if t["norm"]:
            held = holding(t["norm"], runs)
            score[held] += P.CONTAINED_SCORE
            closed[held] = True
            # no ratio is above that of the lengths
            top = max(best, score[held].max(initial=-1.0))
            o = np.flatnonzero(~closed)
            both = n[rows[o]] + n[a_at[i]]
            o = o[2.0 * np.minimum(n[rows[o]], n[a_at[i]]) / np.maximum(both, 1) + hint[o] >= top]
            plain = upper_bounds(m, n, a_at[i], rows[o])
            closed[o[plain == 0]] = True
            o = o[(plain > 0) & (plain + hint[o] >= top)]
        c = np.flatnonzero(closed)
        if len(c):
            first = int(c[np.argmax(score[c])])
            if score[first] >= best:
                best, pick = float(score[first]), first
        if len(o):
            common = Subsequences(b_texts) if common is None else common
            bound = 2.0 * common.lengths(a_texts[a_at[i]])[b_at[o]] / (n[rows[o]] + n[a_at[i]]) + hint[o]
            for x in np.argsort(-bound, kind="stable"):
                j, least = int(o[x]), float(hint[o[x]])
                if bound[x] < best:
                    break
                # a run that can only be equal to an earlier one is not looked at; bounds and ratios are rounded alike
                if pick is not None and j > pick and bound[x] == best:
                    continue
                if j not in held_at:
                    held_at[j] = places(b_texts[b_at[j]])
                v = ratio_to(a_texts[a_at[i]], b_texts[b_at[j]], held_at[j], best - least)
                if v < 0:
                    continue
                v += least
                if v > best or (v == best and (pick is None or j < pick)):
                    best, pick = v, j
        if pick is not None:
            r = runs[pick]
            out.append((t["target_id"], int(r[0]), int(r[1]), int(r[2]), float(best)))
    return out
