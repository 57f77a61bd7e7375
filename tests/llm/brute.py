"""Plain versions of the contracts of the numbered queries, document by document, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring_dedup(rows, width=35):
    docs = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def fingerprint(text, width=4):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def reach(ids, linked):
    """Smallest id reachable from each, linked(i) giving the neighbours' ids."""
    out = {}
    for start in sorted(ids):
        if start in out:
            continue
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in out:
                out[i] = start
                todo += linked(i)
    return out


def simhash(rows, width=4, errors=4):
    prints = {i: fingerprint(t, width) for i, t in rows}
    by = defaultdict(list)
    for i, f in prints.items():
        by[f].append(i)
    linked = lambda i: [j for f, js in by.items() if (f ^ prints[i]).bit_count() <= errors for j in js]
    component = reach(prints, linked)
    return [(i, f"{f:016x}", component[i]) for i, f in prints.items()]


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    count = Counter(f[2] for f in found)
    return count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def base_scores(rows):
    import math

    lower = [(i, [w.lower() for w in words(t)]) for i, t in rows]
    count = Counter()
    for i, w in lower:
        if remainder(i, 10):
            count.update([*w, None])
    total, distinct = sum(count.values()), len(count)
    unit = math.log10(total + 0.1 * (distinct + 1))
    out = []
    for i, w in lower:
        tokens = [*w, None]
        out.append((i, not remainder(i, 10), len(tokens), sum(count[t] > 0 for t in tokens), total, sum(math.log10(count[t] + 0.1) - unit for t in tokens)))
    return out


def context_tree(rows, depth, train):
    """log10 probabilities by context-tree weighting as in its definition: a recursion over contexts."""
    import math

    end = b"\xff"
    counts = defaultdict(lambda: [0, 0])

    def choices(text):
        data = end * depth + (text or "").encode().lower() + end
        for k in range(depth, len(data)):
            for t in range(8):
                yield data[k - depth : k][::-1], (1 << t) | (data[k] >> (8 - t)), data[k] >> (7 - t) & 1

    for i, t in rows:
        if train(i):
            for context, node, bit in choices(t):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
    children = defaultdict(set)
    for context, node in list(counts):
        if context:
            children[context[:-1], node].add(context)
    memo = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(context, node):
        return sum(weight(c, node) for c in children[context, node])

    def weight(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) < depth:
                under = below(context, node)
                top = max(own, under)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(under - top))
            memo[context, node] = own
        return memo[context, node]

    def probability(context, node, bit):
        p = None
        for d in range(depth, -1, -1):
            a, b = counts.get((context[:d], node), (0, 0))
            own = ((a, b)[bit] + 0.5) / (a + b + 1)
            if p is None:
                p = own
            else:
                x = kt(a, b) - below(context[:d], node)
                share = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
                p = share * own + (1 - share) * p
        return p

    return {i: sum(math.log10(probability(*c)) for c in choices(t)) for i, t in rows}


def quality_counts(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(covered)


def vector_links(rows, threshold=0.95):
    import math

    good = {i: v for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in good.items()}
    near = defaultdict(list)
    ids = list(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and sum(x * y for x, y in zip(good[a], good[b], strict=True)) / norm[a] / norm[b] >= threshold:
                near[a].append(b)
                near[b].append(a)
    component = reach([i for i, _ in rows], lambda i: near[i])
    return [(i, len(near[i]), component[i], component[i] == i) for i, _ in rows]


def conversations(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out
