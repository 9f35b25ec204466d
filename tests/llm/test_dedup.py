import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomlab.llm import near_dedup, substring_dedup
from fathomlab.llm.near_dedup import drop_near_duplicates, near_duplicate_groups
from fathomlab.llm.substring_dedup import WINDOW, dedup_substrings


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


def removed_by_windows(rows):
    first, own = {}, {}
    for i, text in rows:
        w = (text or "").encode().split()
        own[i] = w
        for k in range(len(w) - WINDOW + 1):
            g = tuple(w[k : k + WINDOW])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if first[tuple(w[k : k + WINDOW])] < i:
                gone |= set(range(k, k + WINDOW))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    passages = [words(rng, n) for n in (50, 51, 60, 120, 400, 900)]
    passages += [["run"] * 70, ["a", "b"] * 45, ["x"] * 30 + words(rng, 40)]
    rows = []
    for k in range(120):
        body = words(rng, rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            body += p[a:] + words(rng, rng.randrange(0, 30))
        rows.append((k, " ".join(body)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, ""), (204, " ".join(["run"] * 500)), (205, " ".join(["a", "b"] * 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(docs).collect()}
    assert got == removed_by_windows(rows)


def test_anchor_is_common_to_equal_windows():
    rng = random.Random(2)
    for _ in range(40):
        shared = words(rng, WINDOW)
        a, b = (" ".join(words(rng, rng.randrange(0, 60)) + shared + words(rng, rng.randrange(0, 60))) for _ in range(2))
        found = substring_dedup.symbols(pa.array([a, b]))
        per = defaultdict(set)
        for s, r, span in zip(found["sym"].tolist(), found["row"].tolist(), found["span"].tolist()):
            if span == 0:
                per[r].add(s)
        assert per[0] & per[1]


def test_substring_dedup_on_odd_rows(spark, odd, none):
    rows = dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 3)
    assert dedup_substrings(none).count() == 0


def test_near_duplicate_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, rng.randrange(6, 300)) for _ in range(25)]
    boiler = words(rng, 12)
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 7)):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(boiler + w if rng.random() < 0.3 else w)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "two words"), (504, "two words"), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()}
    idf = near_dedup.document_weights(docs)
    own = [r for r in rows if r[0] is not None]
    parent = {i: i for i, _ in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :] if a[1] and b[1]]
    near = near_dedup.similarities(pa.array([a[1] for a, _ in pairs]), pa.array([b[1] for _, b in pairs]), idf)
    for (a, b), s in zip(pairs, near):
        if s >= near_dedup.THRESHOLD:
            x, y = root(a[0]), root(b[0])
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i, _ in own} | {None: None}
    kept = [r["doc_id"] for r in drop_near_duplicates(docs.withColumn("class_id", F.lit("mine"))).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({root(i) for i, _ in own}) and kept.count(None) == 1


def test_large_group_of_edits_stays_together(spark):
    rng = random.Random(6)
    base = words(rng, 100)
    texts = [" ".join(words(rng, 100)) for _ in range(80)]
    for k in range(40):  # a third of all rows, each with another word edited
        texts.append(" ".join([*base[: 2 * k + 5], f"edit{k}", *base[2 * k + 6 :]]))
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(96)} for t in texts]  # no shingle repeats in a text
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both / (192 - both) >= 0.8 and want[a] != want[b]:
                x, y = sorted((want[a], want[b]))
                want = [x if w == y else w for w in want]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()}
    assert want.count(80) == 40 and got == dict(enumerate(want))
    copies = docs.unionByName(spark.range(1000, 1060).select(F.col("id").alias("doc_id"), F.lit(texts[80]).alias("text")))
    assert (near_dedup.document_weights(copies) == near_dedup.document_weights(docs)).all()


def test_near_duplicates_on_odd_rows(spark, odd, none):
    assert near_duplicate_groups(odd).count() == odd.count()
    assert drop_near_duplicates(odd).filter("doc_id = 4").count() == 1
    assert near_duplicate_groups(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_edits_of_one_text_among_others_form_one_group(spark):
    rng = random.Random(16)
    base = words(rng, 200)
    texts = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(0, 200, 2)]
    texts += [" ".join(words(rng, 200)) for _ in range(200)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 100 else k for k in range(300)}


def test_recall_of_plain_similarity_by_size(spark):
    """Pairs at 0.8 to 0.9 of plain Jaccard similarity, short and long, among unrelated texts."""
    rng = random.Random(26)
    texts = []
    for size in (12, 40, 150, 260, 300, 450, 700, 2500):
        for _ in range(12):
            a = words(rng, size)
            b = list(a)
            edits = max(1, round(size * 0.019)) if size > 40 else 0
            for k in range(edits):
                b[(k + 1) * size // (edits + 1)] = f"edit{rng.randrange(10**6)}"
            texts += [a, b if edits else [*a, "more"]]
    texts += [words(rng, 120) for _ in range(100)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()}
    sets = [Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in texts]
    near = [k for k in range(0, 192, 2) if (sets[k] & sets[k + 1]).total() / (sets[k] | sets[k + 1]).total() >= 0.8]
    assert len(near) >= 80
    assert sum(got[k] == got[k + 1] for k in near) >= 0.98 * len(near)


def test_rows_that_share_a_doc_id_keep_their_own_texts(spark):
    rng = random.Random(36)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    near = " ".join([*a.split()[:-1], "edit"])
    rows = [(1, a), (1, b), (2, c), (2, c), (3, near), (4, None), (4, None), (4, b), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(7))
    kept = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, c), (4, None), (4, None), (5, "")], key=str)
    assert all(r["node"] == 7 for r in drop_near_duplicates(docs).collect())
    assert near_duplicate_groups(docs).count() == len(rows)


def test_substring_dedup_cuts_rows_that_share_a_doc_id_by_their_own_text(spark):
    rng = random.Random(46)
    long, other = words(rng, 360), words(rng, 80)
    rows = [(1, long), (2, long), (2, words(rng, 20)), (2, other + long[100:170]), (3, other), (2, other + long[100:170])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_substrings(docs).collect())
    assert got == [(1, 360, 0), (2, 20, 0), (2, 150, 70), (2, 150, 70), (2, 360, 360), (3, 80, 80)]


def test_crowded_buckets_lose_no_link(spark):
    """Copies of one text with one to nine edits: most are near a few others only. Equal to the closure of all pairs."""
    rng = random.Random(56)
    base = words(rng, 200)
    texts = [" ".join(words(rng, 200)) for _ in range(60)]
    for k in range(240):
        w = list(base)
        for _ in range(rng.randrange(1, 10)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [f"edit{k}x{at}"], [w[at], f"more{k}x{at}"]))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.document_weights(docs)
    a, b = (x + 60 for x in np.triu_indices(240, 1))
    column = np.array(texts, object)
    want = list(range(300))
    for k in range(0, len(a), 2000):
        near = near_dedup.similarities(pa.array(column[a[k : k + 2000]]), pa.array(column[b[k : k + 2000]]), idf) >= near_dedup.THRESHOLD
        for x, y in zip(a[k : k + 2000][near], b[k : k + 2000][near]):
            if want[x] != want[y]:
                low, high = sorted((want[x], want[y]))
                want = [low if w == high else w for w in want]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()}
    assert got == dict(enumerate(want))
    assert 62 < len(set(want)) < 260


def test_no_two_python_operators_behind_each_other(spark, monkeypatch):
    """Each would have a worker of its own in every task, and workers stay: twice the memory of Python."""
    plans = []
    settle = near_dedup.settle
    monkeypatch.setattr(near_dedup, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"x{k}" if rng.random() < 0.03 else w for k, w in enumerate(base)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drop_near_duplicates(docs).collect()
    assert sum("w#" in plan and "bits#" in plan for plan in plans), "no bitmaps were made"
    for plan in plans:
        steps = re.findall(r"MapInArrow|Exchange|Join", plan)
        assert ("MapInArrow", "MapInArrow") not in zip(steps, steps[1:]), plan
