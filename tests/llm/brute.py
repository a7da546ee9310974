"""The contracts in plain Python, for small inputs: rows are dicts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def top_k(rows, k=5):
    """Rows of (query_id, rank, vec_id, score), in order; each row is a candidate of its own, whatever its id."""
    vs = [(r["vec_id"], [math.floor(256 * float(x)) for x in r["embedding"]]) for r in rows if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    out = []
    for i, (q, v) in enumerate(vs):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(vs) if j != i and len(w) == len(v))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def classes(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def near(rows, size=4, percent=85):
    """{place: (n, smallest place reachable)}: rows are told apart by their place."""
    sets = []
    for r in rows:
        w = words((r["text"] or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [(len(s), c) for s, c in zip(sets, classes(range(len(rows)), links).values(), strict=True)]


def base_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[(w[i], w[i + 1], w[i + 2])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def line_dedup(rows):
    holders = defaultdict(set)

    def key(x):
        return x.strip(SPACE).translate(LOWER)

    for r in rows:
        for x in (r["text"] or "").split("\n"):
            holders[key(x)] |= {r["doc_id"]} - {None}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r["doc_id"]]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def targets(sizes, weights=(5, 2, 1)):
    """{source: target} with exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return out


def minimax(sizes, shards):
    """The smallest capacity of contiguous shards, by trying out every cut."""
    best = {0: 0}
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    for _ in range(shards):
        best = {j: min(max(best[i], ends[j] - ends[i]) for i in best if i <= j) for j in range(len(ends))}
    return best[len(sizes)]


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def divergence(rows, common=24, letters=8, rare=1000, marks=".,;:!?"):
    """[(char distance, word distance)] of each row from the nearest language, without guards."""
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>", SPACE]
    bare = [[w.lower().rstrip(marks) for w in words(r["text"])] for r in rows]
    by_lang = defaultdict(Counter)
    for r, ws in zip(rows, bare, strict=True):
        if r["lang"] is not None:
            by_lang[r["lang"]].update(w for w in ws if len(w) <= letters)
    known = sorted({w for c in by_lang.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:common] if w and n * rare >= sum(c.values())})
    hists = []
    for r, ws in zip(rows, bare, strict=True):
        t, count = r["text"] or "", Counter(ws)
        hist = [count[w] for w in known]
        hists.append(([sum(c in k for c in t) for k in classes] + [len(t.encode()) - len(t)], hist + [len(ws) - sum(hist)]))

    def shares(h):
        return [x / sum(h) for x in h] if sum(h) else None

    def far(p, q):
        pairs = [(a, b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in pairs) / 2))

    refs = {la: [shares([sum(x) for x in zip(*(h[k] for r, h in zip(rows, hists, strict=True) if r["lang"] == la), strict=True)]) for k in (0, 1)] for la in by_lang}
    return [tuple(min((far(shares(h[k]), ref[k]) for ref in refs.values() if ref[k]), default=0.0) if sum(h[k]) else None for k in (0, 1)) for h in hists]


def mixture(p, counts, rounds=12):
    """Shares of languages by EM: p[gram][language], counts[gram]."""
    n = len(p[0])
    share = [1 / n] * n
    for _ in range(rounds):
        new = [0.0] * n
        for g, c in counts.items():
            joint = [s * q for s, q in zip(share, p[g], strict=True)]
            for k in range(n):
                new[k] += c * joint[k] / sum(joint)
        share = [x / sum(new) for x in new]
    return share


def site_posteriors(rows):
    """[(site, quality)] for rows of (host, path, evidence, counted)."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, _, c in rows:
        hosts[h].append(c)
        paths[(h, p)].append(c)
    everything = [c for *_, c in rows]
    mean = min(max(sum(everything) / len(everything), 1e-6), 1 - 1e-6)

    def strength(groups, center):
        n = sum(len(g) for g in groups.values())
        v = sum(len(g) * (sum(g) / len(g) - center(k)) ** 2 for k, g in groups.items())
        between = (v - mean * (1 - mean) * len(groups)) / n
        return min(1000.0, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0

    k_host = strength(hosts, lambda _: mean)
    k_path = strength(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]))

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    out = []
    for h, p, e, c in rows:
        above = (sum(hosts[h]) - c + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        site = (sum(paths[(h, p)]) - c + k_path * above) / (len(paths[(h, p)]) - 1 + k_path)
        out.append((site, 1 / (1 + math.exp(-(logit(e) + logit(site) - logit(mean))))))
    return out
