"""Lexical search, prefix trie and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import SCHEMA, SMALL, rows
from weblens.llm import lexical, prefix_trie, queries, toxicity
from weblens.llm import text as T

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    """Scores every document for every item, one by one."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total, df = len(bags), sum(x for *_, x in bags), Counter(t for _, b, _ in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i].update(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, b, size in bags:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_search(spark):
    docs = [tuple(r) for r in queries.documents(spark, SMALL).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_lexical_search(spark, SMALL).collect())
    assert got == ranked(docs, items) and len(got) > len(items)


@pytest.mark.parametrize("blocks", [{}, {"postings": 3}, {"at_once": 1}])
def test_search_of_odd_rows(spark, blocks):
    texts = [(1, "Alpha beta, beta_gamma!"), (2, "alpha beta, beta_gamma?"), (2, "alpha beta, beta_gamma?"), (3, None), (4, ""), (None, "gamma gamma Élan"), (5, "élan ÉLAN été 1 2 3"), (6, "z" * 5000 + " gamma " * 3000),
             (7, ",.; \t"), *((k, "copies of gamma and alpha") for k in range(100, 140)), (8, "alpha\x7fbeta\x00gamma\x85x"), (9, "unrelated")]
    asked = [(1, "GAMMA alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "Élan été"), (1, "beta"), (None, "alpha"), (6, "gamma gamma")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in texts], SCHEMA)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in asked], "item_id long, text string, rank int, score string")
    got = sorted(tuple(r) for r in lexical.search(docs, items, **blocks).collect())
    assert got == ranked(texts, asked)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_search_counts_only_terms_whose_bytes_are_the_same():
    import pyarrow as pa

    block = lexical.Block(pa.table({"item": [1, 1], "term": [b"one", b"two"]}))
    data, hashes, a, b, _ = lexical.terms(pa.array(["one sixty two"]))
    hashes[1] = hashes[0]  # as if both words had one hash
    hit, _ = block.find(data, hashes, a, b)
    assert hit.tolist() == [0, 2]


def prefixes(turns):
    """All distinct beginnings of the rebuilt conversations, in a dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    own = {p: (len(c) - 1) * len(brute.words(p[-1][1])) if p else 0 for p, c in nodes.items()}
    under = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    return sorted((min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), kids[p], sum(not kids[q] for q in under[p]), sum(own[q] for q in under[p]),
                   hashlib.sha256(",".join(map(str, sorted(x for x in c if built[x] == p))).encode()).hexdigest()) for p, c in nodes.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, node string, path int"


def trie(df):
    return sorted(tuple(r) for r in df.select(*TRIE).collect())


def test_prefix_trie(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie(queries.op12_prefix_trie(spark, SMALL)) == prefixes(turns)


def test_prefix_trie_of_odd_rows(spark):
    random.seed(3)
    say = lambda n: random.choice(["a b", "a b", "c", "", None, "d e  f\n"][:n])
    turns = []
    for c in range(90):  # few texts: long common beginnings, conversations that end inside of others
        turns += [(c, t, random.choice(["user", None]) if t > 3 else "user", say(2 if c % 3 else 6)) for t in range(random.choice([1, 2, 3, 7, 12]))]
    turns += [(c, t, "u", "same") for c in range(1000, 1060) for t in range(5)]  # copies
    turns += [(500, t, "u", f"w{t}") for t in range(130)] + [(501, t, "u", f"w{t}" if t < 77 else "x") for t in range(80)]  # long ones
    turns += [(None, 1, "u", "lost"), (77, None, "u", "first"), (77, None, "u", "first"), (8, 0, "a", "b"), (-3, 1, "user", "a b")]
    df = spark.createDataFrame([(*t, "n", 1) for t in turns if t[0] != 8], TURNS)
    assert trie(prefix_trie.prefix_trie(df)) == prefixes([t for t in turns if t[0] != 8])
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    turnless = [(c, 0, "u", "x") for c in (1, 3, 4, 6)]  # shorter than what the block's first one would give
    assert trie(prefix_trie.prefix_trie(spark.createDataFrame([(*t, "n", 1) for t in turnless], TURNS))) == prefixes(turnless)


def test_fattest_number(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_digests_of_many_ids(spark):
    ids = [*range(0, 3000, 3), 70000, 1 << 40, -5]
    df = spark.createDataFrame([(b"n", i) for i in random.sample(ids, len(ids))] + [(b"m", 4)], "node binary, conv long")
    want = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert {bytes(r.node): r.digest for r in prefix_trie.digests(df).collect()} == {b"n": want(ids), b"m": want([4])}


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == queries.documents(spark, "/root/testdata/sf0.01").count()
    assert all(r.held_out == (brute.remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in known) > 0.93 * len(known) and sum(p for p, y in known if not y) <= 0.02 * len(known)


def test_toxicity_of_odd_rows(spark):
    random.seed(4)
    plain = lambda n: " ".join(random.choice("the a of river stone green walks over under bridge and slowly".split()) for _ in range(n))
    bad = lambda: " ".join(random.sample(["zorgon", "zorgish", "you zorgling", plain(9)], 3))
    texts = [(k, bad() if k % 4 == 0 else plain(20)) for k in range(400)] + [(1000, None), (1001, ""), (None, bad()), (1002, "z" * 9000), (1003, plain(9000)), (1004, "ZORGON, zorgul zorgish!!"), (1004, "ZORGON, zorgul zorgish!!")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in texts], SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(0, 400, 1)] + [(None, 1, "x"), (5, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, votes string")
    train = "doc_id % 5 <> 0"
    got = toxicity.rate(docs, labels, train).collect()
    assert len(got) == len(texts)
    score = {r.doc_id: r.score for r in got}
    assert all((score[k] >= 0.5) == (k % 4 == 0) for k in range(400))
    assert score[1000] == score[1001] < 0.5 and score[1002] < 0.5 and score[1003] < 0.5 and score[1004] >= 0.5
    # without any label the fixed lexicon speaks
    insults = spark.createDataFrame([(k, ("you idiot and moron, " if k % 4 == 0 else "") + plain(20)) for k in range(200)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.rate(insults, labels.limit(0)).collect()}
    assert all((found[k] > 0.5) == (k % 4 == 0) for k in range(200))
    assert toxicity.rate(docs.limit(0), labels).count() == 0


def test_toxic_stems_are_counted_by_text(spark):
    texts = [("Bad badly, bad", 1), ("bad apples", 0), ("été étéstone", 1), ("", 0)]
    want = defaultdict(lambda: [0, 0])
    names = {}
    for text, label in texts:
        stems = set()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            stems |= {w} | {w[:n] + "*" for n in toxicity.LENGTHS if len(w) > n}
        for s in stems:
            want[s][0] += label
            want[s][1] += 1
    for s in want:
        h = T.words(d := np.frombuffer(s.rstrip("*").encode(), np.uint8), np.array([0, len(d)]))[0] if s[-1] != "*" else toxicity.beginnings(d := np.frombuffer(s[:-1].encode(), np.uint8), np.array([0]), np.array([len(d)]), len(s) - 1)
        names[int(h.view(np.int64)[0])] = s
    got = {names[r.hash]: [r.toxic, r.n] for r in toxicity.stem_counts(spark.createDataFrame(texts, "text string, label int")).collect()}
    assert got == dict(want)


def test_label_model_is_the_tree_it_says_it_is():
    """Posteriors against the product of the tree's tables, voter by voter; accuracies, correlations and share of a sampled tree are found again."""
    rng = np.random.default_rng(1)
    n, m = 60_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.2
    x = rng.random((n, m)) < np.where(y[:, None], 0.6, 0.08)
    x[:, 1] = np.where(rng.random(n) < 0.9, x[:, 0], x[:, 1])  # a copy of another voter counts little
    given = np.where(rng.random(n) < 0.3, np.where(rng.random(n) < 0.97, y, ~y), -1)
    votes = (x.astype(np.int64) << np.arange(m)).sum(1)
    import pyarrow as pa

    model = toxicity.label_model(pa.table({"votes": votes, "given": given.astype(np.int64), "weight": np.ones(n, np.int64)}))
    assert abs(model.prior - 0.2) < 0.02 and 1 in (model.parent[0] == 1, model.parent[1] == 0)
    q = model.posterior(x[:300].astype(np.int64), given[:300])
    for k in range(300):
        like = [1 - model.prior, model.prior]
        for label in (0, 1):
            for i, p in enumerate(model.parent):
                chance = model.table[i, label, int(x[k, p]) if p >= 0 else 0]
                like[label] *= chance if x[k, i] else 1 - chance
            if given[k] >= 0:
                like[label] *= model.accuracy[label] if given[k] == label else 1 - model.accuracy[label]
        assert math.isclose(q[k], like[1] / sum(like), rel_tol=1e-6, abs_tol=1e-12)
    alone = 2  # a voter without a tie: its table is its accuracy
    assert np.allclose(model.table[alone, 1].mean(), 0.6, atol=0.1) and np.allclose(model.table[alone, 0].mean(), 0.08, atol=0.06)
    assert ((model.posterior(x.astype(np.int64), np.full(n, -1)) > 0.5) == y).mean() > 0.97
