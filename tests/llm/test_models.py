import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomlab.llm import decontamination, shared, toxicity
from fathomlab.llm.decontamination import contamination_report, drop_contaminated, lcs_length
from fathomlab.llm.language_id import identify_languages
from fathomlab.llm import quality_classifier
from fathomlab.llm.quality_classifier import score as quality_score, train as quality_train
from fathomlab.llm.quality_rules import apply_quality_rules, quality_report
from fathomlab.llm.toxicity import score, train

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), rng.normal(0, 1, (2, 2)))
    sizes = [1, 5, 0, 9, 70, 130]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(0, 2, ptr[-1])
    p = field.marginals(e, ptr)[0]
    m = np.exp(field.trans)
    for a, b in zip(ptr, ptr[1:]):
        n = b - a
        alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            before = m[0] if t == 0 else alpha[t - 1] @ m
            alpha[t] = before * [1, np.exp(e[a + t])]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = m @ (beta[t + 1] * [1, np.exp(e[a + t + 1])])
            beta[t] /= beta[t].sum()
        if n:
            both = alpha * beta
            assert np.allclose(p[a:b], both[:, 1] / both.sum(axis=1), atol=1e-9)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])  # 37 and about 400 toxic documents to learn from
def test_toxicity_held_out(spark, odd, none, size):
    folder = f"/root/testdata/{size}"  # about one label in twenty is noise
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    field = train(docs, labels.filter(~part))
    rows = score(docs.join(labels.filter(part).select("doc_id"), "doc_id", "left_semi"), field).join(labels.filter(part), "doc_id").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits >= 0.9 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.03 * sum(not r["toxic"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert score(odd, field).count() == odd.count() and score(none, field).count() == 0
    assert score(odd, train(odd, labels.limit(0))).filter("score > 0").count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: f"{rng.choice('klmnoprst')}{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.choice((5, 7, 15, 20, 30, 60)))] for _ in range(300)]
    rows = []
    for k in range(600):
        w = [word() for _ in range(rng.randrange(60, 200))]
        at = rng.randrange(len(w))
        if k % 3 == 0:  # one passage in a third of the documents
            w[at:at] = items[3]
        elif k % 3 == 1:
            own = [x if len(items[k % 300]) < 8 or rng.random() > 0.3 else word() for x in items[k % 300]]
            w[at:at] = own
        rows.append((k, w))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: set(r["items"]) for r in contamination_report(docs, bench).collect()}
    assert all(3 in got[k] for k in range(0, 600, 3))
    idf = decontamination.document_weights(docs)
    names = lambda texts: decontamination.tokens(pa.array(texts))[0]
    checks = []
    for own in items:
        n = names([" ".join(own)])
        rank = idf[(n >> np.uint64(48)).astype(np.int64)]
        checks.append((n.tolist(), [n.tolist()[i] for i in np.argsort(-rank, kind="stable")[:5]]))
    for k, w in rows:
        near, want = names([" ".join(w)]).tolist(), set()
        for j, (n, rare) in enumerate(checks):
            length, there = lcs_length(n, near)
            if length / len(n) >= (0.6 if len(n) >= 8 else 1.0) and sum(x in there for x in rare) / len(rare) >= 0.6:
                want.add(j)
        assert got[k] >= want and (k % 3 != 2 or got[k] == want), k


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = identify_languages(docs, docs.filter(~part)).join(docs.filter(part).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    found = {r["doc_id"]: r["lang_pred"] for r in identify_languages(odd, docs).collect()}
    assert found[1] == found[2] == found[5] == "und" and found[3] != "und"
    assert identify_languages(odd, none).filter("lang_pred <> 'und'").isEmpty() and identify_languages(none, docs).isEmpty()


def test_quality_held_out(spark, odd, none):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality_train(docs, labels.filter(~part))
    rows = quality_score(docs, model).join(labels.filter(part), "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) / len(rows) > 0.9
    assert quality_score(odd, model).count() == odd.count() and quality_score(none, quality_train(none, labels)).isEmpty()


def test_quality_rules(spark, odd, none):
    rows = {r["doc_id"]: r for r in quality_report(odd).collect() if r["doc_id"] is not None}
    assert rows[1]["n_words"] == 0 and not rows[1]["kept"] and rows[3]["n_words"] == 60_000
    assert rows[4]["n_repeat_words"] == 0 and rows[6]["word_chars"] == 22
    host = spark.createDataFrame([(k, f"w{k} " * 3 if k % 10 else "some words of a long enough text that nobody would ever reject here", "bad", k) for k in range(40)] + [(100 + k, "some words of a long enough text that nobody would ever reject here", f"good{k % 5}", k) for k in range(60)], "doc_id long, text string, source string, n_words long")
    kept = apply_quality_rules(host)
    assert kept.columns == host.columns and {r["source"] for r in kept.collect()} == {f"good{k}" for k in range(5)}
    assert apply_quality_rules(none).isEmpty() and quality_report(none).isEmpty()


def test_decontamination_finds_copies_and_paraphrases(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    common = [word() for _ in range(40)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.6 else word() for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(16, 60)))) for k in range(60)]
    rows, want = [], set()
    for k in range(300):
        body = say(rng.randrange(20, 300))
        if k % 3 == 0:
            item, text = items[rng.randrange(60)]
            w = text.split()
            for _ in range(len(w) // 10 if k % 2 else 0):  # words replaced
                w[rng.randrange(len(w))] = word()
            at = rng.randrange(len(body))
            body = body[:at] + ([x.upper() for x in w] if k % 9 == 0 else w) + body[at:]
            want.add((k, item))
        rows.append((k, " ".join(body)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], i) for r in contamination_report(docs, bench).collect() for i in r["items"]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 1
    assert drop_contaminated(docs, bench).count() == 300 - len({d for d, _ in got})
    assert contamination_report(odd, bench).filter("contaminated").isEmpty() and contamination_report(none, bench).isEmpty()
    assert contamination_report(docs, bench.limit(0)).filter("contaminated").isEmpty()
    assert lcs_length([1, 2, 3, 4], [9, 1, 3, 9, 4])[0] == 3


def test_leaks_take_no_python_rows(spark, none):
    """Rows of createDataFrame come from Python workers of their own, which then stay beside those of the search."""
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some words of a text that is like no other one here").alias("text"))
    bench = spark.range(2).select(F.col("id").alias("item_id"), F.lit("some words of a text that is like no other one here").alias("text"))
    found = decontamination.leaks(docs, bench)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 6
    empty = decontamination.leaks(docs, bench.limit(0))
    assert empty.dtypes == found.dtypes and empty.isEmpty()


def test_quality_reads_the_texts_once(spark, odd, none):
    """All rounds and the scoring share one pass, and give what training and scoring one after the other give."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    model = quality_train(docs.mapInArrow(counted, docs.schema), labels)
    assert seen.value == docs.count()
    every = docs.unionByName(odd.select(*docs.columns))
    made = quality_classifier.features(every)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(quality_classifier._scored(made, model, 0.5, iter)) == rows(quality_score(every, model))
    assert quality_classifier.classify(odd, labels).count() == odd.count() and quality_classifier.classify(none, labels).isEmpty()


@pytest.mark.parametrize("unique", [False, True])
def test_a_side_with_too_many_rows_is_never_broadcast(spark, monkeypatch, unique):
    """Spark takes the salted copies for as small as the side itself, far below its own limit of a broadcast."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    large, small = spark.range(1000).withColumnRenamed("id", "k"), shared.settle(spark.range(0, 1000, 3).withColumnRenamed("id", "k"))
    found = shared.join_counted(large, small, "k", "left_anti", **({"unique": True} if unique else {}))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in found.collect()) == [k for k in range(1000) if k % 3]
