"""Toxicity by weak supervision: voters, a generative label model of them, and a linear classifier trained on its posterior labels.

Stems are the lower-cased words of a text and their beginnings.  Those that labelled toxic texts have much oftener than others (by a log-likelihood ratio; at most MOST_TEXTS texts of either label are looked at) are dealt into lexicons, a
voter each; further voters are a fixed lexicon of insults, patterns (insults addressed to someone, many or dense ones, masked and repeated letters, shouting) and their absence.  A vote is a
bit; a document's votes are one number, and equal numbers are counted in Spark.

The label model is a tree: every voter depends on the hidden label and on the voter that it shares most information with, given the label (Chow and Liu, 1968), so lexicons of stems of one word do not
count twice.  Expectation maximisation estimates the accuracies, the correlations and the share of toxic texts from the counts of vote patterns; a given label is the vote of one more voter,
whose accuracy is estimated too.  A logistic regression over the stems and votes then learns the posterior labels of all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.shared import saved

#: Code points of the beginnings that are stems beside whole words.
LENGTHS = (3, 4, 5, 6)
#: Stems that are taken at most, by log-likelihood ratio; the least ratio (a chance of about 10^-6 for one stem); the least number of toxic texts that have the stem.
STEMS, RATIO, TEXTS = 4096, 24.0, 3
#: Share of the texts with a stem that are toxic at least.
SHARE = 0.9
#: Labelled texts of either label from whose words stems are taken at most: those of the lowest hashes.
MOST_TEXTS = 20_000
LEXICONS = 12
ROUNDS = 25
#: Pseudo-counts of the label model.
PRIOR = 2.0
# Common insults of some languages, in their plain forms.
INSULTS = (
    "arschloch asshole bastard bitch cabrón clown connard crétin depp disgusting dumb dumbass estúpida estúpido idiot idiota idiote "
    "imbécil imbécile loser merde mierda moron pathetic puta putain retard salaud salope scum scumbag shit slut stupid trash trottel "
    "whore wichser worthless"
).split()
# End of fixed values.
PATTERNS = ("insult", "addressed", "several", "dense", "masked", "stretched", "shouting", "none")
VOTERS = (*(f"lexicon_{k}" for k in range(LEXICONS)), *PATTERNS)
YOU = "you your du dich dir ihr sie tu toi vous tú te usted eres es".split()
#: Letters for the marks and digits that stand for them in masked words.
MASKS = {"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"}
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[x for x in range(128) if not chr(x).isalpha()]] = 32
UNMASKED = LETTERS.copy()
UNMASKED[[ord(x) for x in MASKS]] = [ord(x) for x in MASKS.values()]
#: Words between an insult and the one who is addressed; share of such words that is dense; capital letters that are shouting.
NEAR, DENSE, LOUD = 3, 0.02, 10
SLICE = 2 << 20


class Words:
    """Words of texts (runs of letters), numbered through, and hashes of their stems."""

    def __init__(self, column: pa.Array):
        self.bytes, self.at = T.buffer(pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string()))
        self.data = LETTERS[self.bytes]
        self.hash, self.first, self.past, self.count = T.words(self.data, self.at)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words (their numbers) and hashes: the whole words, then the beginnings of each length of longer ones."""
        yield np.arange(len(self.hash)), self.hash
        heads = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        start = np.searchsorted(heads, self.first)
        for n in LENGTHS:
            past = heads[np.minimum(start + n, len(heads) - 1)]
            longer = np.flatnonzero(past < self.past)
            yield longer, beginnings(self.data, self.first[longer], past[longer], n)


def beginnings(data: np.ndarray, first: np.ndarray, past: np.ndarray, n: int) -> np.ndarray:
    """Hashes of short runs of bytes, apart from those of words and of other lengths."""
    out, width = np.full(len(first), n * T.WORD_BASE & (1 << 64) - 1, np.uint64), past - first
    for k in range(int(width.max(initial=0))):
        live = width > k
        out[live] = (out[live] ^ data[first[live] + k].astype(np.uint64)) * np.uint64(0x100000001B3)
    return T.mix(out + width.astype(np.uint64))


def word_hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return T.words(raw, np.array([0, len(raw)], np.int64))[0]


def stem_counts(labelled: DataFrame) -> DataFrame:
    """hash, toxic, n: labelled texts that have a stem, and those of them that are toxic. labelled: text, label."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                label = part.column("label").to_numpy().astype(np.int64)
                for word, stem in words.stems():
                    found, code = np.unique(stem, return_inverse=True)
                    pair = np.unique(code * len(label) + words.owner[word])
                    code, toxic = pair // len(label), label[pair % len(label)]
                    n = np.bincount(code, minlength=len(found))
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.bincount(code, toxic, len(found)).astype(np.int64)), pa.array(n)], names=["hash", "toxic", "n"])

    return labelled.mapInArrow(go, "hash long, toxic long, n long").groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def telling(counts: DataFrame, toxic: int, clean: int, odds: float, most: int = STEMS) -> np.ndarray:
    """Hashes of the stems that mostly toxic texts have, oftener than by chance, the most telling first. toxic, clean: texts that were counted; odds: toxic to clean ones of all, to those of the counted."""

    def term(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * float(toxic + clean) / (row * column))).otherwise(0.0)

    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c, d = toxic - a, clean - b
    ratio = 2 * (term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d))
    found = counts.where((F.col("toxic") >= TEXTS) & (a * odds >= SHARE * (a * odds + b)) & (a * clean > b * toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    rows = found.orderBy(F.desc("ratio"), "hash").limit(most).collect()
    return np.array([r.hash for r in rows], np.int64).view(np.uint64)


def vote(docs: DataFrame, stems: np.ndarray) -> DataFrame:
    """id, train, votes (bit k: VOTERS[k] fires), stems (numbers of the telling stems of the text, ascending). docs: id, train, text."""
    order = np.argsort(stems)
    shared = docs.sparkSession.sparkContext.broadcast((stems[order], order, np.sort(word_hashes(INSULTS)), np.sort(word_hashes(YOU))))  # at most STEMS numbers

    def place(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        return hit, at[hit]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, insults, you = shared.value
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                words, rows = Words(part.column("text")), part.num_rows
                owner, total = words.owner, len(words.hash)
                bad = np.zeros(total, bool)
                pairs = []
                for word, stem in words.stems():
                    hit, at = place(known, stem)
                    bad[word[hit]] = True
                    pairs.append(owner[word[hit]] * len(known) + number[at])
                pairs = np.unique(np.concatenate(pairs))
                has = np.zeros((rows, len(VOTERS)), bool)
                row, stem = pairs // max(1, len(known)), pairs % max(1, len(known))
                has[row, stem % LEXICONS] = True
                said, _ = place(insults, words.hash)
                bad[said] = True
                asked = np.zeros(total + 1, np.int64)
                asked[place(you, words.hash)[0] + 1] = 1
                asked = np.cumsum(asked)
                ends = np.cumsum(words.count)
                low = np.maximum(np.arange(total) - NEAR, (ends - words.count)[owner])
                high = np.minimum(np.arange(total) + NEAR + 1, ends[owner])
                hits = np.bincount(owner[bad], minlength=rows)
                masked = T.words(UNMASKED[words.bytes], words.at)
                changed = np.append(0, np.cumsum(UNMASKED[words.bytes] != words.data))
                hidden, _ = place(insults, masked[0])
                hidden = hidden[changed[masked[2][hidden]] > changed[masked[1][hidden]]]
                d = words.data
                thrice = np.flatnonzero((d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & (d[2:] > 64) & (d[2:] < 128))
                raw, at = T.buffer(part.column("text"))
                capital, letter = ((x := np.append(0, np.cumsum(t)))[at[1:]] - x[at[:-1]] for t in ((raw > 64) & (raw < 91), ((raw | 32) > 96) & ((raw | 32) < 123)))
                for name, voice in {
                    "insult": np.bincount(owner[said], minlength=rows) > 0, "addressed": np.bincount(owner[bad & (asked[high] > asked[low])], minlength=rows) > 0, "several": hits > 1,
                    "dense": (hits > 0) & (hits >= DENSE * words.count), "masked": np.bincount(np.searchsorted(words.at, masked[1][hidden], "right") - 1, minlength=rows) > 0,
                    "stretched": np.bincount(np.searchsorted(words.at, thrice, "right") - 1, minlength=rows) > 0, "shouting": (capital >= LOUD) & (2 * capital > letter), "none": (hits == 0) & (words.count > 0),
                }.items():
                    has[:, VOTERS.index(name)] = voice
                votes = (has.astype(np.int64) << np.arange(len(VOTERS))).sum(1)
                bounds = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32())
                yield pa.record_batch([part.column("id"), part.column("train"), pa.array(votes), pa.ListArray.from_arrays(bounds, pa.array(stem, pa.int32()))], names=["id", "train", "votes", "stems"])

    return docs.mapInArrow(go, f"id {dict(docs.dtypes)['id']}, train boolean, votes long, stems array<int>")


class LabelModel:
    """Hidden label, its voters as a tree, and given labels as a voter of known least accuracy.

    prior: share of toxic texts; parent: voter on which each depends, or -1; table[i, y, p]: probability that voter i fires if the label is y and its parent does (p = 1) or not; accuracy: of given
    labels, by hidden label.
    """

    #: Given labels are taken to be right this often at least.
    TRUST = 0.9

    def __init__(self, share: float, voters: int = len(VOTERS)):
        self.prior, self.accuracy = share, np.array([0.98, 0.98])
        self.parent, self.table = np.full(voters, -1), np.full((voters, 2, 2), 0.5)

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability that the label is 1. votes: rows of 0 and 1; given: label 0 or 1, or -1."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for i, p in enumerate(self.parent):
            chance = self.table[i][:, votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)].T
            logs += np.log(np.where(votes[:, i, None] > 0, chance, 1 - chance))
        right = np.where(given[:, None] == [0, 1], self.accuracy, 1 - self.accuracy)
        logs += np.where(given[:, None] >= 0, np.log(right), 0)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    def learn(self, votes: np.ndarray, given: np.ndarray, weight: np.ndarray, q: np.ndarray, tree: bool) -> None:
        """Estimates all numbers from rows of that weight and posterior; with `tree` the voters' dependences too."""
        m = votes.shape[1]
        mass, both = np.zeros(2), np.zeros((2, m, m))
        x = votes.astype(float)
        for y, w in enumerate((weight * (1 - q), weight * q)):
            mass[y], both[y] = w.sum(), x.T @ (x * w[:, None])
        self.prior = float(np.clip((mass[1] + 1) / (mass.sum() + 2), 1e-4, 0.9))
        for y in (0, 1):
            w = weight * (q if y else 1 - q) * (given >= 0)
            self.accuracy[y] = np.clip((w[given == y].sum() + 98) / (w.sum() + 100), self.TRUST, 0.999)
        single = np.einsum("yii->yi", both)
        if tree:
            gain = np.zeros((m, m))
            for y in (0, 1):
                n = mass[y] + 4 * PRIOR
                cells = np.stack([both[y], single[y][:, None] - both[y], single[y][None] - both[y], mass[y] - single[y][:, None] - single[y][None] + both[y]]) + PRIOR
                a, b = (single[y] + 2 * PRIOR)[:, None], (single[y] + 2 * PRIOR)[None]
                for cell, left, right in zip(cells, (a, a, n - a, n - a), (b, n - b, b, n - b), strict=True):
                    gain += cell * np.log(np.maximum(cell, 1e-9) * n / (left * right))
            self.parent[:] = -1
            inside, link = np.zeros(m, bool), gain[0].copy()
            inside[0], source = True, np.zeros(m, np.int64)
            for _ in range(m - 1):
                new = int(np.where(inside, -np.inf, link).argmax())
                inside[new], self.parent[new] = True, source[new]
                closer = gain[new] > link
                link[closer], source[closer] = gain[new][closer], new
        for i, p in enumerate(self.parent):
            for y in (0, 1):
                if p < 0:
                    self.table[i, y] = (single[y, i] + PRIOR * 0.5) / (mass[y] + PRIOR)
                    continue
                fired = single[y, p]
                self.table[i, y, 1] = (both[y, i, p] + PRIOR * 0.5) / (fired + PRIOR)
                self.table[i, y, 0] = (single[y, i] - both[y, i, p] + PRIOR * 0.5) / (mass[y] - fired + PRIOR)
        self.table = np.clip(self.table, 1e-6, 1 - 1e-6)


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS))) & 1


def label_model(patterns: pa.Table) -> LabelModel:
    """Expectation maximisation over patterns: votes, given (0, 1, -1: none), weight."""
    votes, given, weight = (patterns.column(c).to_numpy() for c in ("votes", "given", "weight"))
    order = np.lexsort((given, votes))
    votes, given, weight = bits(votes[order]), given[order], weight[order].astype(float)
    labelled = weight[given >= 0].sum()
    share = float(weight[given == 1].sum() / labelled) if labelled else 0.1
    model = LabelModel(float(np.clip(share, 1e-3, 0.9)))
    # to begin with, labelled texts are what they are said to be, others toxic if insults are heard
    q = np.where(given >= 0, 0.04 + 0.92 * given, np.where(votes[:, VOTERS.index("insult")] > 0, 0.8, 0.05)) if len(votes) else np.zeros(0)
    if labelled:
        model.learn(votes, given, weight * (given >= 0), q, True)
        q = model.posterior(votes, given)
    for k in range(ROUNDS if len(votes) else 0):
        # without labels the voters are independent at first: a tree would explain all their agreement, and leave the label nothing
        model.learn(votes, given, weight, q, (0 if labelled else 5) <= k < 8)
        before, q = q, model.posterior(votes, given)
        if k > 8 and np.abs(q - before).max() < 1e-4:
            break
    return model


def fit(rows: DataFrame, prior: float, size: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression. rows: features (numbers of what a text has, below size), yes, no (weights of both labels)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    both = rows.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    if not size or not both.yes or not both.no:
        return float(np.log(prior / (1 - prior))), np.zeros(size)
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(size)], inputCol="names", outputCol="features", minTF=1.0)
    twice = rows.select(F.col("features").cast("array<string>").alias("names"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))).alias("x"))
    train = vectors.transform(twice.select("names", "x.label", "x.weight").where("weight > 0")).select("features", "label", "weight")
    model = LogisticRegression(maxIter=60, regParam=1e-5, standardization=False, weightCol="weight", tol=1e-7).fit(train)
    return float(model.intercept), np.asarray(model.coefficients.toArray())


def rate(docs: DataFrame, labels: DataFrame, train: str = "true", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_texts: int = MOST_TEXTS) -> DataFrame:
    """Per row of docs: the id, score (probability of label 1), votes (bit k: VOTERS[k] fired).

    train: SQL condition on docs; only such rows, and labels of their ids, are learned from. labels: id and label (1 toxic, 0 not); null ids and labels say nothing, several labels of an id become
    their rounded mean. Stems are taken from at most about most_texts labelled texts of either label, all else from all training rows. Without labels the fixed lexicon alone orients the model. Null and empty texts get the score of a text that no voter speaks of. Repeated rows are
    rated alike; rows without an id are rated, not learned from. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.expr(train), F.lit(False)) & F.col(id_col).isNotNull()).alias("train"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label")).where("label in (0, 1)")
    known = saved(own.where("train").select("id").distinct().join(known, "id").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 11) / 2.0**53))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    stems = np.zeros(0, np.uint64)
    if len(sizes) == 2:
        # a share of all ids that leaves about as many as wanted; the texts stay where they are, the sample comes to them
        share = {k: min(1.0, most_texts / n) for k, n in sizes.items()}
        sample = known.where(F.col("h") <= F.when(F.col("label") == 1, share[1]).otherwise(share[0])).select("id", "label")
        counted = {k: max(1, round(n * share[k])) for k, n in sizes.items()}
        counts = saved(stem_counts(own.where("train").join(F.broadcast(sample), "id").select("text", "label")))
        stems = telling(counts, counted[1], counted[0], sizes[1] * counted[0] / (sizes[0] * counted[1]))
    voted = saved(vote(own, stems))
    rows = voted.where("train").join(known.select("id", "label"), "id", "left").select("votes", "stems", F.coalesce("label", F.lit(-1)).alias("given"))
    # at most three rows for each of the 2**20 patterns
    rows = saved(rows.groupBy("votes", "stems", "given").agg(F.count("*").alias("weight")))
    model = label_model(rows.groupBy("votes", "given").agg(F.sum("weight").alias("weight")).toArrow())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.posterior(bits(batch.column("votes").to_numpy()), batch.column("given").to_numpy())
            weight = batch.column("weight").to_numpy()
            yield pa.record_batch([batch.column("votes"), batch.column("stems"), pa.array(weight * q), pa.array(weight * (1 - q))], names=["votes", "stems", "yes", "no"])

    soft = rows.mapInArrow(label, "votes long, stems array<int>, yes double, no double")
    fired = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(VOTERS) - 1)), lambda k: F.when(F.expr("votes").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0, k + len(stems))), lambda k: k.isNotNull())
    size = len(stems) + len(VOTERS)
    intercept, weights = fit(saved(soft.select(F.concat("stems", fired).alias("features"), "yes", "no")), model.prior, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, own_stems = batch.column("votes").to_numpy(), batch.column("stems")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(own_stems.offsets.to_numpy()))
            total = intercept + bits(votes) @ weights[len(stems) :] + np.bincount(owner, weights[own_stems.flatten().to_numpy()], batch.num_rows)
            yield pa.record_batch([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700)))), batch.column("votes")], names=["id", "score", "votes"])

    return voted.mapInArrow(score, f"id {dict(voted.dtypes)['id']}, score double, votes long").withColumnRenamed("id", id_col)
