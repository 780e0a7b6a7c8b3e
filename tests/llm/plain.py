"""Plain versions of the operators over lists of (doc_id, text)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def repeats(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[k : k + 200] for _, x in data for k in range(len(x) - 199))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def components(rows, width, num, den):
    """Size of the set, and the least id that is reached, for each row."""
    found = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(found):
        for g in s:
            holders[g].append(k)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if den * len(found[a] & found[b]) >= num * len(found[a] | found[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(found[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)]


def links(rows, width, num, den):
    """How many other rows each row is linked with."""
    found = [shingles(t, width) for _, t in rows]
    return [sum(b != a and bool(x) and den * len(x & y) >= num * len(x | y) for b, y in enumerate(found)) for a, x in enumerate(found)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def align(item, text):
    """Smith-Waterman by the book: match 2, mismatch and gap -1."""
    rows = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best / (2 * len(item))


def importance(rows, target, smoothing, stretch):
    """Log weights by exact n-grams: tokens, pairs and triples of token shapes, no hashing."""
    found = []
    for _, text in rows:
        kind = lambda c: 1 if c.isalpha() or ord(c) > 127 else 2 if c.isdigit() else 0 if c in " \t\n\r\x0b\x0c" else 3
        tokens, last = [], 0
        for c in text or "":
            k = kind(c)
            if k and k == last:
                tokens[-1] += c
            elif k:
                tokens.append(c)
            last = k
        upper = lambda t, j: len(t) > j and "A" <= t[j] <= "Z"
        back = lambda i, by: tokens[i - by] if i >= by else None
        shapes = [(kind(t[0]), t == back(i, 1), t == back(i, 2), upper(t, 0), upper(t, 1)) for i, t in enumerate(tokens)]
        shape = lambda i: shapes[i] if i >= 0 else None
        found.append([[("t", t), ("p", t, back(i, 1)), ("s", shape(i), shape(i - 1), shape(i - 2))] for i, t in enumerate(tokens)])
    every, aim = Counter(f for d in found for t in d for f in t), Counter(f for (i, _), d in zip(rows, found, strict=True) if i in target for t in d for f in t)
    size, wanted = ({k: sum(n for f, n in c.items() if f[0] == k) for k in "tps"} for c in (every, aim))
    ratio = {f: math.log((aim[f] + smoothing) / (n * wanted[f[0]] / max(1, size[f[0]]) + smoothing)) for f, n in every.items()}
    sums = [sum(ratio[f] for t in d for f in t) for d in found]
    return [x * stretch / max(3 * len(d), stretch) for x, d in zip(sums, found, strict=True)]


def sketch(text, k=128, width=5):
    """The k least hashes of the shingles, as signed numbers."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text or "")]

    def chain(values):
        seed = 42
        for x in values:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    found = {chain(h[i : i + width]) for i in range(len(h) - width + 1)} if len(h) >= width else {chain(h)} if h else set()
    return sorted(found)[:k]


def likeness(a, b, k=128):
    low = sorted({*a, *b})[:k]
    return len(set(low) & set(a) & set(b)) / len(low) if low else 1.0


def em(rows, rounds=40):
    """EM with NumPy-free loops over single spans (votes of four labelers, shape): prior, tables [labeler][class][vote], posteriors."""
    prior, table = 0.5, [[[0.34, 0.6, 0.06], [0.33, 0.07, 0.6]] for _ in range(4)]
    for _ in range(rounds):
        post = []
        for votes, _ in rows:
            real, false = prior, 1 - prior
            for j, v in enumerate(votes):
                real, false = real * table[j][1][v], false * table[j][0][v]
            post.append(real / (real + false))
        prior = (sum(post) + 1) / (len(rows) + 2)
        for j in range(4):
            for cls in (0, 1):
                mass = [1 + sum((p if cls else 1 - p) for p, (votes, _) in zip(post, rows, strict=True) if votes[j] == v) for v in range(3)]
                table[j][cls] = [x / sum(mass) for x in mass]
    return prior, table, post
