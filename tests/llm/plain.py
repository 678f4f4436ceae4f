"""Brute-force versions, in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items):
    """doc -> (words, words hit, item ids)"""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    ids |= found
                    hit.update(range(s, s + n))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def near_groups(texts, threshold=0.8):
    """For each text the first of its group, and its number of links."""
    sets = [shingle_set(t) for t in texts]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g] if j < i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], links


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""

    def __init__(self, texts, order=4):
        self.order = order
        self.counts = {order: Counter()}
        for t in texts:
            b = bytes(order - 1) + t.encode()
            self.counts[order].update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, c in self.counts.items():
            m = Counter(c.values())
            y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else None
            self.discounts[k] = [0.0] + [min(max(i - (i + 1) * y * m[i + 1] / m[i] if y is not None and m[i] else i / 2, 0.05 * i), float(i)) for i in (1, 2, 3)]
            ctx = self.contexts[k] = defaultdict(lambda: [0, 0.0])
            for g, n in c.items():
                ctx[g[:-1]][0] += n
                ctx[g[:-1]][1] += self.discounts[k][min(n, 3)]

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / 256
        if gram[:-1] not in self.contexts[k]:
            return below
        total, held = self.contexts[k][gram[:-1]]
        n = self.counts[k][gram]
        return (max(0.0, n - self.discounts[k][min(n, 3)]) + held * below) / total

    def perplexity(self, text):
        b = bytes(self.order - 1) + text.encode()
        return math.exp(-sum(math.log(self.p(b[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(b))) / (len(b) - self.order + 1))


def percentile(values, q):
    """The least value that a share q of the values doesn't exceed."""
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v) - 1e-9)) - 1]


def judgements(docs, labels, fold_of, quantile, prior):
    """doc_id -> (perplexity, kept). docs: (doc_id, lang, text)."""
    quality = defaultdict(lambda: 1)
    for i, q in labels:
        quality[i] = min(quality[i], q)
    trusted = {i for i, _ in labels if quality[i] == 1}
    langs = defaultdict(list)
    for i, lang, t in docs:
        langs[lang or "und"].append((i, t or ""))
    out = {}
    for own in langs.values():
        train = [t for i, t in own if i in trusted and fold_of(i) > 0]
        model = KneserNey(train) if train else None
        score = {i: model.perplexity(t) for i, t in own if t} if model else {}
        held = [i for i, t in own if t and i in trusted and fold_of(i) == 0 and model]
        middle = percentile([math.log(score[i]) for i in held], 0.5) if held else None
        evidence = {i: math.exp((len(t.encode()) * math.log(score[i]) + prior * middle) / (len(t.encode()) + prior)) for i, t in own if t and held}
        limit = percentile([evidence[i] for i in held], quantile) if held else None
        for i, t in own:
            out[i] = (score.get(i), bool(t) and (limit is None or evidence[i] <= limit))
    return out


def bucket(a, b, c):
    return ((a << 16 | b << 8 | c) * 2_654_435_761 % (1 << 32)) >> 16


def grams(text):
    b = text.lower().encode()
    return [bucket(*b[i : i + 3]) for i in range(len(b) - 2)]


def language_posteriors(pages, docs, main_text, most=100, host_weight=5.0, domain_weight=20.0, even=1.0, agree=20.0):
    """page_id -> language -> probability. pages: (page_id, url, html); docs: (lang, text)."""
    counts = defaultdict(Counter)
    for lang, t in docs:
        counts[lang].update(grams(t))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    read = []
    for i, url, page in pages:
        g = grams(main_text(page))
        fit = {x: sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * 65536)) for b in g) * min(1, most / max(1, len(g))) for x in langs}
        top = max(fit.values())
        fit = {x: v - top for x, v in fit.items()}
        z = sum(math.exp(v) for v in fit.values())
        host = (re.search(r"://([^/?#]*)", url or "") or [0, ""])[1].lower()
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", page or "", re.I)
        said = said[1].lower() if said else "none"
        read.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said if said in (*langs, "none") else "other", fit, {x: math.exp(v) / z for x, v in fit.items()}))

    def added(at):
        out = defaultdict(lambda: [0, Counter()])
        for r in read:
            out[r[at]][0] += 1
            out[r[at]][1].update(r[6])
        return out

    hosts, domain, suffix, markup = added(1), added(2), added(3), added(4)
    all_ = Counter()
    for r in read:
        all_.update(r[6])
    pages_ = sum(all_.values())
    out = {}
    for i, h, d, s, m, fit, own in read:
        score = {}
        less = lambda counts, x: max(0.0, counts[x] - own[x])  # noqa: B023, E731 - a page is no evidence for itself
        for x in langs:
            share = (less(all_, x) + even) / (pages_ - 1 + even * len(langs))
            in_domain = (less(domain[d][1], x) + domain_weight * share) / (domain[d][0] - 1 + domain_weight)
            prior = (less(hosts[h][1], x) + host_weight * in_domain) / (hosts[h][0] - 1 + host_weight) if h else share
            by_suffix = math.log((less(suffix[s][1], x) + even) / (less(all_, x) + even * len(suffix))) if h else 0.0
            score[x] = fit[x] + math.log(prior) + by_suffix + math.log((less(markup[m][1], x) + even + agree * (m == x)) / (less(all_, x) + even * (len(langs) + 2) + agree))
        top = max(score.values())
        z = sum(math.exp(v - top) for v in score.values())
        out[i] = {x: math.exp(v - top) / z for x, v in score.items()}
    return out


def longest_match(text, item, window=10):
    """(words, start) of the longest stretch of the item, starting with a window, in the text; of equals the first in the item, then in the text."""
    w, own, best = words(text), words(item), None
    for j in range(len(own)):
        need = min(window, len(own) - j)
        if need < window and j:
            continue
        for p in range(len(w)):
            k = 0
            while p + k < len(w) and j + k < len(own) and w[p + k] == own[j + k]:
                k += 1
            if k >= need and (best is None or (-k, j, p) < best):
                best = (-k, j, p)
    return best and (-best[0], best[2])


def simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n, counts, total = min(4, len(w)), [0] * 64, 0
    for i in range(len(w) - n + 1 if n else 0):
        h, total = xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42), total + 1
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > total)


def bit_components(fps, radius=4):
    """For each fingerprint the place of the first that it hangs together with."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, f in enumerate(fps):
        for j in range(i + 1, len(fps)):
            if (f ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def whitening(rows, components=4):
    """vec_id -> (deviation, [whitened by component]), n, shares of the trace; signs as they come. rows: (vec_id, vector)"""
    import numpy as np

    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    e, axes = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    e, axes = e[::-1], axes[:, ::-1][:, :components]
    out = [(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), (np.array(x) - s / n) @ axes / np.sqrt(e[:components])) for i, x in kept]
    return out, n, e[:components] / e.sum()


def spelling(docs, least=5, times=5):
    """word -> (form, root, n, n_near, form_n). docs: (doc_id, text)"""
    import zlib

    counts = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= least}
    near, gaps = {w: set() for w in n}, defaultdict(list)
    for w in n:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].append(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for same in gaps.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= times * n[w]}
    out = {}
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out[w] = (form.get(w), r, n[w], len(near[w]), n.get(form.get(w)))
    return out
