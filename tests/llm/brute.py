"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- patterns ---------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, m):
    hit, digits = m.group(), re.sub("[^0-9]", "", m.group())
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(m.group(2)) >= 8,
        "access": lambda: len(hit) >= 16,
        "hex": lambda: len(hit) >= 32,
    }[kind]()


def spans(text, patterns):
    found = [
        (m.start(), place, m.end(), kind)
        for place, (kind, p) in enumerate(patterns.items())
        for m in re.finditer(p, text or "")
        if passes(kind, m)
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def digest(found):
    return hashlib.sha256(",".join(found).encode()).hexdigest()


def entropies(run, window):
    """Shannon entropy of every window, counted anew."""
    out = []
    for at in range(len(run) - window + 1):
        counts = Counter(run[at : at + window]).values()
        out.append(-sum(c / window * math.log2(c / window) for c in counts))
    return out


# --- quality ----------------------------------------------------------------------------


def quality(rows, limit=100, keep_percent=30):
    """rows: (id, host, text); a result per row, in order."""

    def lines(text):
        own = {}
        for line in (text or "").split("\n"):
            if words(line):
                normal = " ".join(line.lower().split())
                own[normal] = own.get(normal, 0) + len(words(line))
        return own

    documents = defaultdict(dict)
    low = lambda i: (i is not None, i)
    for key, host, text in rows:
        own = lines(text)
        for line in own:
            seen, content = documents[host or "", line], frozenset(own)
            seen[content] = min(seen.get(content, (low(key), text)), (low(key), text))
    frequent = {k: min(v.values(), key=lambda x: x[0]) for k, v in documents.items() if len(v) > limit}
    out = []
    for key, host, text in rows:
        w = words(text)
        windows = list(zip(w, w[1:], w[2:]))
        counts = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
        seen, duplicates = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                duplicates += line in seen
                seen.add(line)
        lost = sum(
            n for line, n in lines(text).items() if (host or "", line) in frequent and frequent[host or "", line] != (low(key), text)
        )
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        kept = not failed and 100 * (len(w) - lost) >= keep_percent * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        out.append((key, len(w), sum(map(len, w)), symbols, duplicates, len(repeated), failed, kept, lost))
    return out


# --- near-duplicates --------------------------------------------------------------------


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def near_duplicates(rows, n=5):
    """rows: (id, text), ids that compare; id -> (class, copy, links) by comparing all pairs."""
    sets = [(key, shingles(text, n)) for key, text in rows]
    first = {}
    for key, s in sets:
        first[s] = min(first.get(s, key), key)
    distinct = sorted(first, key=first.get)
    group = {s: s for s in distinct}

    def root(s):
        while group[s] is not s:
            s = group[s]
        return s

    links = Counter()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            both = len(a & b)
            if both and 5 * both >= 4 * (len(a) + len(b) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)), key=first.get)
                group[y] = x
    return [(key, first[root(s)], first[s], links[s]) for key, s in sets]


# --- language model ---------------------------------------------------------------------


def lower_words(text):
    return [w.encode().lower() for w in words(text)]


class NGrams:
    """Interpolated modified Kneser-Ney with dictionaries; None is the end token."""

    def __init__(self, texts, order=2):
        own = [[None, *lower_words(t), None] for t in texts]
        self.order = order
        self.c = Counter(w for x in own for w in x[1:])
        self.n, self.v = sum(self.c.values()), len(self.c)
        grams = {k: Counter(tuple(x[i - k : i]) for x in own for i in range(k, len(x) + 1)) for k in range(2, order + 1)}
        self.counts = {order: grams[order]}
        for k in range(1, order):
            self.counts[k] = Counter(g[1:] for g in grams[k + 1])  # distinct words before
            if k > 1:  # what begins a text has none before it
                self.counts[k] |= Counter({g: n for g, n in grams[k].items() if g[0] is None})
        self.d = {k: self.discounts(c) for k, c in self.counts.items()}
        self.total = {k: Counter() for k in self.counts}
        self.left = {k: defaultdict(float) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.left[k][g[:-1]] += self.d[k][min(n, 3)]

    @staticmethod
    def discounts(counts):
        t = [sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
        raw = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else k * y for k in (1, 2, 3)]
        return [0, *(min(max(d, 0), k) for k, d in zip((1, 2, 3), raw))]

    def p(self, context, w):
        k = len(context) + 1
        shorter = self.p(context[1:], w) if context else 1 / (self.v + 1)
        if not self.total[k].get(context):
            return shorter
        n = self.counts[k].get((*context, w), 0)
        return (n - self.d[k][min(n, 3)] + self.left[k][context] * shorter) / self.total[k][context]

    def scores(self, text):
        x = [None, *lower_words(text), None]
        base = sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in x[1:])
        own = sum(math.log10(self.p(tuple(x[max(0, i - self.order + 1) : i]), x[i])) for i in range(1, len(x)))
        return len(x) - 1, sum(w in self.c for w in x[1:]), base, own


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


# --- unigram pieces ---------------------------------------------------------------------


def unigram_counter(vocabulary):
    """The tokenizers library's own model over the same pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.Unigram([*vocabulary, ("<unk>", 0.0)], unk_id=len(vocabulary), byte_fallback=False))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(own.encode(text or "").ids)


# --- URLs -------------------------------------------------------------------------------


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c.group().lower(), host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


# --- SimHash ----------------------------------------------------------------------------


def ascii_lower(text):
    return re.sub("[A-Z]", lambda c: c.group().lower(), text or "")


def simhash(text, n=3):
    import xxhash

    w = words(ascii_lower(text))
    parts = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked_components(keys, prints, radius=2):
    """keys compare; the least key reachable from each, by comparing all pairs of different fingerprints."""
    distinct = sorted(set(prints))
    group = {p: p for p in distinct}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                group[root(b)] = root(a)
    least = {}
    for key, p in zip(keys, prints):
        r = root(p)
        least[r] = min(least.get(r, key), key)
    return [least[root(p)] for p in prints]


# --- collocations -----------------------------------------------------------------------


def collocations(rows, least=100, longest=5, percent=100, top=2000):
    """rows: (lang, text)."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    outer[p[i : i + k]] = max(outer[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if outer[p] == 0 or 100 * outer[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


# --- Merkle trees -----------------------------------------------------------------------


def joined_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_hash(values):
    return joined_hash(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_ways(leaves, fanout=3):
    """The root, and for each leaf its place and siblings, level by level."""
    ways, where, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for way, at in zip(ways, where):
            first = at - at % fanout
            way.append((at - first, [x for i, x in enumerate(row[first : first + fanout]) if i != at - first]))
        row = [joined_hash(row[i : i + fanout]) for i in range(0, len(row), fanout)]
        where = [at // fanout for at in where]
    return row[0], ways


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        key, text = row[0], row[4]
        changed = key is not None and zlib.crc32(str(key).encode()) % 2 == 0 and text is not None
        groups[row[1]].append((key is not None, key, row_hash(row), row_hash([*row[:4], text.replace("\n", "")]) if changed else row_hash(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: tree_ways([leaf for _, _, leaf, _ in sorted(groups[name])]) for name in names}
    root, above = tree_ways([trees[name][0] for name in names]) if names else (None, [])
    out = []
    for name, up in zip(names, above):
        for (_, key, leaf, claim), way in zip(sorted(groups[name]), trees[name][1]):
            digest = claim
            for place, others in [*way, *up]:
                digest = joined_hash([*others[:place], digest, *others[place:]])
            proof = joined_hash([x for _, others in [*way, *up] for x in others])
            out.append((key, leaf, trees[name][0], root, proof, digest, digest == root))
    return out
