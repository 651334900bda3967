"""Plain Python versions of the operators, one row at a time and all pairs, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def shingles(text):
    t = words(text, True)
    return {tuple(t)} if 0 < len(t) < 5 else {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


def near(rows):
    """(size of set, component) of each (id, text), all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 70 * (len(a) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[root(i)] = min(key, lowest.get(root(i), key))
    return [(len(s), lowest.get(root(i)) if s else key) for i, (s, (key, _)) in enumerate(zip(sets, rows))]


def exact(rows):
    """(kept id, size of group) of each (id, text)."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    last = {t: max((k for k in g if k is not None), default=None) for t, g in groups.items()}
    return [(last[t or ""], len(groups[t or ""])) for _, t in rows]


def base_counts(text):
    t = words(text)
    grams = Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4))
    repeated = {i + k for i in range(len(t) - 4) if grams[tuple(t[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(t) < 10 or 100 * len(repeated) > 20 * len(t)
    return len(t), sum(map(len, t)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def char_class(c):
    for i, chars in enumerate(("aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:!?", "'\"()-[]", "#*$%&|<>+/=@\\^_`{}~")):
        if c in chars:
            return i
    return 12 if ord(c) < 0x80 else 9 if ord(c) < 0x800 else 10 if ord(c) < 0x10000 else 11


def js(p, q):
    total = 0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0), q.get(k, 0)
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(total, 0))


def share(counts):
    n = sum(counts.values())
    return {k: v / n for k, v in counts.items()} if n else {}


def quality(rows, rules):
    """(char distance, word distance, kept) of each (lang, text)."""
    of_words, of_chars = defaultdict(Counter), defaultdict(Counter)
    for lang, text in rows:
        if not base_counts(text)[-1]:
            of_words[lang].update(words(text, True))
            of_chars[lang].update(map(char_class, text or ""))
    total = sum(c.total() for c in of_words.values())
    refs = {}
    for lang, counts in of_words.items():
        n = counts.total()
        if lang is not None and n and n >= min(rules.REFERENCE, total * rules.LANGUAGE):
            common = {w: c / n for w, c in counts.items() if c >= rules.COMMON * n}
            refs[lang] = (common, common | {None: 1 - sum(common.values())}, share(of_chars[lang]))
    out = []
    for lang, text in rows:
        n, failed = base_counts(text)[0], base_counts(text)[-1]
        found = []
        for name, (common, ref_words, ref_chars) in refs.items() if n >= rules.MIN_WORDS else ():
            if lang in (name, None):
                hist = share(Counter(w if w in common else None for w in words(text, True)))
                found.append((js(share(Counter(map(char_class, text))), ref_chars), js(hist, ref_words)))
        chars, by_words = min(found, key=sum, default=(None, None))
        noise = math.sqrt(4 / max(n, 1))
        far = bool(found) and (chars > rules.CHAR_BOUND + noise / 2 or by_words > rules.WORD_BOUND + noise)
        out.append((chars, by_words, not failed and not far))
    return out


def lm(rows, training, order=3, weights=(0.1, 0.3)):
    """(tokens, known, base score, score with exact counts) of each text."""
    counts = Counter()
    for text in training:
        t = [*words(text, True), None]
        for k in range(1, order + 1):
            counts.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    out = []
    for text in rows:
        t = [*words(text, True), None]
        base = score = 0
        for i in range(len(t)):
            p = (counts[(t[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(t[i - k + 1 : i + 1])
                if i >= k - 1 and counts[gram[:-1]]:
                    p = weights[k - 2] * counts[gram] / counts[gram[:-1]] + (1 - weights[k - 2]) * p
            score += math.log10(p)
        out.append((len(t), sum(counts[(x,)] > 0 for x in t), base, score))
    return out


def fill(pool, children):
    """Shares of (weight, capacity), by raising one level until the pool is used."""
    out = {i: 0.0 for i in range(len(children))}
    live = {i for i, (w, c) in enumerate(children) if w > 0 and c > 0}
    while live and pool > 1e-9:
        weight = sum(children[i][0] for i in live)
        step = min([pool / weight, *((children[i][1] - out[i]) / children[i][0] for i in live)])
        for i in live:
            out[i] += step * children[i][0]
        pool -= step * weight
        live = {i for i in live if children[i][1] - out[i] > 1e-9}
    return list(out.values())


def mixing(rows, m, share=None):
    """Copies of each (id, lang, source, tokens, place), ordered within a leaf as ``m`` (the module) says."""
    leaf = [(m.DOMAINS.get(s or "", "other"), lang or "", s or "") for _, lang, s, _, _ in rows]
    sizes = Counter()
    for path, row in zip(leaf, rows):
        sizes[path] += row[3]
    weight = [lambda p, n=n: m.WEIGHTS[n].get(p[-1], 1) for n in m.LEVELS]
    capacity = Counter()
    for path, n in sizes.items():
        if all(weight[i](path[: i + 1]) > 0 for i in range(3)):
            for i in range(4):
                capacity[path[:i]] += n * m.MAX_EPOCHS
    given = {(): (m.SHARE if share is None else share) * sum(sizes.values())}
    for depth in range(3):
        for parent in [p for p in given if len(p) == depth]:
            below = sorted({p[: depth + 1] for p in sizes if p[:depth] == parent})
            given |= zip(below, fill(given[parent], [(weight[depth](c), capacity[c]) for c in below]))
    out = [0] * len(rows)
    for path, n in sizes.items():
        budget = math.floor(given[path] + 1e-6)
        whole, rest = (min(budget // n, m.MAX_EPOCHS), budget % n) if n else ((m.MAX_EPOCHS if budget else 0), 0)
        mine = [i for i in range(len(rows)) if leaf[i] == path]

        def order(i):
            key = rows[i][0]
            text = ":".join(map(str, (m.SEED, whole, "" if key is None else key)))
            return hashlib.md5(text.encode()).hexdigest(), key is not None, key or 0, rows[i][4]

        used = 0
        for i in sorted(mine, key=order):
            used += rows[i][3]
            out[i] = whole + (rest > 0 and used <= rest)
    return out


def pieces(ids, capacity):
    """(piece, start, ids) of one document."""
    head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
    cut = [0, *range(head, len(ids) + 1, capacity)]
    return [(i, a, ids[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:]))]


def packed_well(rows, capacity):
    """Checks that sequences are gapless and fit; their number and the least there can be."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)
