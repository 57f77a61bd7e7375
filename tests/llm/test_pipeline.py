"""The corpus pipeline stage by stage, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from weblens.llm import shared, simhash
from weblens.llm.shared import saved

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34", "en", "s", 5), (None, None, "en", "s", 0), (-3, "", None, None, 0)], docs.schema)
    step = docs.unionByName(odd)
    before = {r.doc_id: r for r in step.collect()}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, step, SMALL)
        kept = now.collect()
        if name != "best_fit_packing":
            assert now.columns == names
        if name == "language_id":
            assert {r.doc_id for r in kept} == {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == "simhash_near_dedup":
            exact = {}
            for r in sorted(before.values(), key=lambda r: r.doc_id):
                exact.setdefault(r.text, r.doc_id)
            left = {r.doc_id for r in kept}
            assert left <= set(exact.values()) and len(left) > 0.8 * len(exact) and len(left) == len(kept)
        elif name == "substring_dedup":
            for i, _, gone, digest in brute.substring_dedup([(r.doc_id, r.text) for r in before.values()]):
                after = next(r for r in kept if r.doc_id == i)
                assert brute.sha(b" ".join(brute.words(after.text))) == digest and (gone or after == before[i])
        elif name == "secret_scan":
            assert len(kept) == len(before)
            for r in kept:
                had = brute.secrets(before[r.doc_id].text)
                assert not any(brute.secrets(r.text)[:3]) and (any(had[:3]) or r.text == before[r.doc_id].text)
        if name != "best_fit_packing":
            step = saved(now)
            before = {r.doc_id: r for r in kept}
    assert {r.doc_id for r in kept} == set(before)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_language_stage_with_few_or_no_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    none = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), SMALL).collect()
    assert {r.doc_id for r in none} == set(truth) and {r.lang for r in none} == {None}
    some = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), SMALL).collect()
    filled = [r for r in some if r.doc_id % 3 == 0]
    assert {r.doc_id for r in some} == set(truth) and all(r.lang == truth[r.doc_id] for r in some if r.doc_id % 3)
    assert sum(r.lang == truth[r.doc_id] for r in filled) > 0.9 * len(filled) > 0
    one = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit("und")), SMALL)
    assert one.count() == len(truth)


def test_stages_bear_columns_named_as_their_own(spark):
    names = ["score", "lang_pred", "spans", "n_words", "n_removed", "kept_text", "redacted_text", "component_id", "__a", "__b", "__text", "__id", "__kept_0", "id", "least", "count", "node", "a.b"]
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    wide = plain.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    step = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, wide, SMALL)
        assert now.columns == wide.columns
        got = now.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        assert sorted(r[:5] for r in got) == sorted(tuple(r) for r in stage(spark, step, SMALL).collect())
        wide, step = saved(now), saved(now.select(plain.columns))


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    texts = {k: " ".join(f"t{k // 2}w{j}" for j in range(400)) + (" more" if k % 2 else "") for k in range(20)}
    spam = " ".join(["buy now get one for free today"] * 200)
    texts |= {20: spam + " " + " ".join(f"a{j}" for j in range(40)), 21: spam + " " + " ".join(f"b{j}" for j in range(40))}  # near fingerprints, other texts
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "candidates", lambda nodes, known: none)  # no help from shingles
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()}
    prints = {r.id: r.bits[0] for r in simhash.fingerprints(docs, 5).collect()}
    near = {k for k in range(1, 20, 2) if ((prints[k] ^ prints[k - 1]) & (1 << 64) - 1).bit_count() <= 4}
    assert len(near) > 5 and kept == set(texts) - near
    assert ((prints[20] ^ prints[21]) & (1 << 64) - 1).bit_count() <= 4
    monkeypatch.undo()
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()} == {*range(0, 20, 2), 20, 21}


def test_of_rows_with_one_id_the_least_text_stays(spark):
    texts = ["b " * 30, "a one two three four five six", "c seven eight nine ten eleven"]
    for order in (texts, texts[::-1]):
        rows = [(1, t, None, "s", 3) for t in order] + [(None, "same words in a row here", None, "s", 3)] * 2
        kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, rows[-1][1])] * 2 + [(1, texts[1])]


def exchanged(rows):
    """Rows that the exchanges of a frame write when it is collected, but for those of sums and of what is broadcast."""
    rows.collect()
    total, plans = 0, [rows._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and "Aggregate" not in plan.child().getClass().getSimpleName():
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind in ("ShuffleQueryStageExec", "ResultQueryStageExec"):
            plans.append(plan.plan())
        elif not kind.startswith("Broadcast") or "Join" in kind:
            children = plan.children()
            plans += [children.apply(k) for k in range(children.size())]
    return total


def test_texts_that_no_copy_needs_are_not_moved(spark, monkeypatch):
    words = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(2000)]
    rows = [(k, words[k % 1900], None, "s", 3) for k in range(2000)] + [(None, words[0], None, "s", 3)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    near = saved(spark.range(1900, 2000).selectExpr("id AS node", "id - 1900 AS component").union(spark.range(100).selectExpr("id", "id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, docs, SMALL)
        moved = exchanged(out)
        assert 0 < moved < 700  # the hundred ids that go, their rows and few others
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [*((False, k) for k in range(1900)), (True, 0)]
        monkeypatch.setattr(simhash, "saved", lambda df: df)
        monkeypatch.setattr(simhash, "connecting", lambda rows, *_: rows)
        texts = simhash.similar(docs.selectExpr("doc_id AS node", "text"), near, 5, 0.8)
        moved = exchanged(texts)
        assert 0 < moved < 1000
        assert {r.node for r in texts.collect()} == {*range(100), *range(1900, 2000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sifted_loses_no_sought_row(spark, monkeypatch):
    for bits in (1 << 26, 1 << 15):  # with few bits others pass too
        monkeypatch.setattr(shared, "MOST_BITS", bits)
        rows = spark.range(-20_000, 20_000).selectExpr("CAST(id AS int) AS k", "id % 7 AS v").union(spark.createDataFrame([(None, 1)], "k int, v long"))
        for ids in (spark.range(-20_000, 20_000, 40), spark.range(0), spark.createDataFrame([(5,), (5,), (None,)], "k long")):
            some, rest = shared.sifted(rows, "k", ids)
            got, left, sought = some.collect(), rest.collect(), {r[0] for r in ids.collect()} - {None}
            assert sorted(got + left, key=repr) == sorted(rows.collect(), key=repr)
            assert sought <= {r.k for r in got} and None in {r.k for r in left}
            assert len(got) <= len(sought) + (2500 if bits > 1 << 15 else 5000)
