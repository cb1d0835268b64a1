"""Plain versions of the operators, one document or pair at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def media(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    return len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:])


BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def licences(text):
    w = words(text)
    found = [(i, label) for label, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def substrings(rows):
    first = {}
    split = [SPACED.findall(t or "") for _, t in rows]
    last = 1 << 63
    for (doc, _), w in zip(rows, split):
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, last), last if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (last if doc is None else doc):
                gone.update(range(i, i + 50))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def substrings_left(rows):
    """The words that ``substrings`` leaves of each text, joined by one space."""
    first, out = {}, {}
    split = [(doc, SPACED.findall(t or "")) for doc, t in rows]
    for doc, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, doc), doc)
    for doc, w in split:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < doc for j in range(i, i + 50)}
        out[doc] = " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def decontaminate(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent):
    sets = [(doc, shingles(t)) for doc, t in rows]
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least.get(find(i))) for i, (doc, s) in enumerate(sets)]


def url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (m[1].translate(A_Z), m[2]) if m else ("", "")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def grams(text):
    """n-grams of one to three letters of blank-edged words, as numbers of 21 bits a character."""
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.replace("\u03a3", "\u03c3").lower()).split():
        codes = [32, *map(ord, w), 32]
        out.update(ord(c) for c in w)
        out.update((a << 21) | b for a, b in zip(codes, codes[1:]))
        out.update((a << 42) | (b << 21) | c for a, b, c in zip(codes, codes[1:], codes[2:]))
    return out


def language_scores(texts, labelled, k=300):
    """Closeness of each text to the nearest profile of the labelled (text, lang) rows; None without a letter."""
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]]
    seen = defaultdict(Counter)
    for t, lang in labelled:
        if t is not None and lang is not None:
            seen[lang].update(grams(t))
    ranks = [{g: r for r, g in enumerate(top(c))} for c in seen.values()]
    out = []
    for t in texts:
        own = top(grams(t or ""))
        far = [sum(min(k, abs(p[g] - r)) if g in p else k for r, g in enumerate(own)) for p in ranks]
        out.append(1 - min(far) / (k * len(own)) if own else None)
    return out


def lm(texts, learnt, discount, steps):
    """(tokens, known, base score, score) of each text by counts of all triples of ``learnt``."""
    tok = lambda t: [*SPACED.findall((t or "").translate(A_Z)), "\n"]
    one, two, three = Counter(), Counter(), Counter()
    for t in learnt:
        w = tok(t)
        one.update(w)
        two.update(zip(["\n", *w], w))
        three.update(zip(["\n", *w], w, w[1:]))
    after, after2 = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)
    q = lambda p: 10 ** (-min(255, round(-math.log10(p) * steps)) / steps)
    n, size = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 1) / (n + size + 1)

    def p2(a, b):
        low = p1(b) if a not in one else q(discount * after[a] / one[a]) * p1(b)
        return low + (q((two[a, b] - discount) / one[a]) if (a, b) in two else 0)

    def p3(a, b, c):
        if (a, b) not in two:
            return p2(b, c)
        return q(discount * after2[a, b] / two[a, b]) * p2(b, c) + (q((three[a, b, c] - discount) / two[a, b]) if (a, b, c) in three else 0)

    out = []
    for t in texts:
        w = tok(t)
        logs = [math.log10(p2("\n", w[0])), *(math.log10(p3(*x)) for x in zip(["\n", *w], w, w[1:]))]
        out.append((len(w), sum(x in one for x in w), sum(math.log10(p1(x)) for x in w), sum(logs)))
    return out


def judged_urls(rows):
    """Verdicts and block probabilities of (url, html) rows: words by the best split, naive Bayes over tokens."""
    text = " ".join(re.sub("<[^>]*>", " ", h or "").lower() for _, h in rows)
    seen = Counter(w for w in re.split("[^a-z]+", text) if 2 <= len(w))
    total = math.log(sum(seen.values()) + 1)
    known = {}

    def split(run):
        if run not in known:
            best = [(0.0, 0)]
            for i in range(1, len(run) + 1):
                options = []
                for j in range(i):
                    w = run[j:i]
                    options.append((best[j][0] + (total - math.log(seen[w]) if w in seen else total + 2.5 * (i - j)), j))
                best.append(min(options))
            out, i = [], len(run)
            while i:
                out.append(run[best[i][1] : i])
                i = best[i][1]
            known[run] = out[::-1]
        return known[run]

    def tokens(host, path):
        out = []
        for mark, s in (("h:", host.lower()), ("p:", path.lower())):
            for run in re.findall("[a-z]+|[0-9]+", s):
                out += [mark + w for w in split(run)] if run[0].isalpha() else [f"{mark}#{len(run)}"]
        return out

    plain = [url(u) for u, _ in rows]
    counts, n = {"block": Counter(), "allow": Counter()}, Counter()
    for host, path, _, said in plain:
        if said:
            n[said] += 1
            counts[said].update(tokens(host, path))
    size, sums = len({*counts["block"], *counts["allow"]}), {k: sum(c.values()) for k, c in counts.items()}
    out = []
    for host, path, rule, said in plain:
        odds = math.log((n["block"] + 1) / (n["allow"] + 1))
        for t in tokens(host, path):
            odds += math.log((counts["block"][t] + 1) / (sums["block"] + size)) - math.log((counts["allow"][t] + 1) / (sums["allow"] + size))
        p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        out.append((host, path, rule, said or ("block" if p > 0.5 else "allow"), p))
    return out
