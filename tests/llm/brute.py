"""Plain Python versions that the operators are held against."""
import hashlib
import math
import re
import zlib
from collections import Counter

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def low(t):
    return (t or "").translate(ASCII_LOWER)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def near(docs, percent=85):
    """docs: {id: text} -> {id: (n_shingles, component)}"""
    s = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(low(t))) else set() for i, t in docs.items()}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in s if s[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def contaminated(docs, items, window=13):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = {}
    spans = [(str(k), x[a : a + window]) for k, t in items for x in [w(t)] if x for a in range(max(1, len(x) - window + 1))]
    for i, t in docs.items():
        d, hit, names = w(t), set(), set()
        for name, s in spans:
            for a in range(len(d) - len(s) + 1):
                if d[a : a + len(s)] == s:
                    hit.update(range(a, a + len(s)))
                    names.add(name)
        out[i] = (len(d), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(d))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(t):
    out, n = [], {}
    for k, r in PII.items():
        own = []
        for m in re.finditer(r, t or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                own.append(f"{k}:{m.start()}:{m.end()}")
        out, n[k] = out + own, len(own)
    return n, ",".join(out)


def stats(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, hit = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            hit.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


class Ppm:
    """Order-4 byte model with escape d / (n + d) and exclusion."""

    def __init__(self, texts, order=4):
        self.k, self.ctx = order, {}
        for t in texts:
            b = b"\xff" * order + (t or "").encode() + b"\xff"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.ctx.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def cost(self, c, s):
        gone, left = set(), 1.0
        for k in range(self.k, -1, -1):
            node = self.ctx.get(c[len(c) - k :], {})
            own = {x: n for x, n in node.items() if x not in gone}
            if own:
                den = sum(own.values()) + len(own)
                if s in own:
                    return math.log10(left * own[s] / den)
                left *= len(own) / den
                gone |= set(node)
        return math.log10(left / (256 - len(gone)))

    def score(self, t):
        b = b"\xff" * self.k + (t or "").encode() + b"\xff"
        return sum(self.cost(b[i - self.k : i], b[i]) for i in range(self.k, len(b)))


def unigram(docs, held=2, parts=7):
    train = [words(low(t)) for i, t in docs.items() if fold(i, parts) != held]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + (len(train) > 0)
    out = {}
    for i, t in docs.items():
        w = words(low(t))
        out[i] = (len(w) + 1, sum(c[x] > 0 for x in w) + (len(train) > 0), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1)))
    return out


def mix(rows, weights, epochs, per_mille, seed, domain):
    """rows: (id, text, lang, source) -> {id: copies}"""
    leaf = {}
    for i, t, lang, source in rows:
        leaf.setdefault((domain(source), lang, source), []).append((i, t, len(words(t))))
    cap = {p: epochs * sum(x[2] for x in d) for p, d in leaf.items()}
    total = sum(x[2] for d in leaf.values() for x in d) * per_mille // 1000

    def share(budget, prefix):
        depth = len(prefix)
        kids = sorted({p[depth] for p in cap if p[:depth] == prefix}, key=str)
        hold = {k: sum(c for p, c in cap.items() if p[: depth + 1] == (*prefix, k)) for k in kids}
        w = {k: weights[depth].get(k, 1) for k in kids}
        given, open_, left = {}, set(kids), float(budget)
        while open_:
            full = {k for k in open_ if hold[k] <= left * w[k] / sum(w[x] for x in open_)}
            if not full:
                given |= {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
                break
            given |= {k: float(hold[k]) for k in full}
            left -= sum(hold[k] for k in full)
            open_ -= full
        out = {}
        for k in kids:
            out |= {(*prefix, k): given[k]} if depth == 2 else share(given[k], (*prefix, k))
        return out

    shares = share(min(total, sum(cap.values())), ()) if cap else {}
    out = {}
    for p, d in leaf.items():
        tokens = sum(x[2] for x in d)
        b = math.floor(shares[p] + 1e-9)
        full = b // tokens if tokens else 0
        rest = b - full * tokens
        key = lambda x: hashlib.md5(":".join([str(seed), str(full), "null" if x[0] is None else str(x[0]), *([] if x[1] is None else [str(len(x[1]))])]).encode()).hexdigest()
        upto, open_ = 0, True
        for x in sorted(d, key=key):
            upto += x[2]
            open_ = open_ and upto <= rest
            out[x[0]] = full + int(rest > 0 and open_)
    return out
