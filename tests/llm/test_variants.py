import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fathomlab.llm.spelling_variants import near_words, roots, spelling_variants


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def damaged(rows):
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                yield w


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(rows, pairs=None):
    counts = {w: n for w, n in Counter(damaged(rows)).items() if n >= 3}
    around = defaultdict(set)
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    for w in counts:
        for size in (len(w), len(w) + 1):
            for v in by_size[size]:
                if near(w, v):
                    around[w].add(v)
                    around[v].add(w)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-counts[v], v))
        if counts[best] >= 2 * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(around[w]), counts[form[w]] if w in form else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "àéîõü"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            k = rng.randrange(len(w) + 1)
            w = rng.choice((w[:k] + rng.choice("abcéZ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÉ") + w[k + 1 :]))
        return w.upper() if rng.random() < 0.1 else w

    rows = [(k, rng.choice((" ", "-", "7", ". ")).join(word() for _ in range(rng.randrange(0, 90)))) for k in range(120)]
    rows += [(None, "aaaaa bbbbb aaaab"), (500, None), (501, ""), (502, "×÷abcde " * 5), (3, rows[3][1]), (3, rows[3][1]), (503, "word" + "y" * 40_000 + " abcab" * 2_000), (506, "chainaa " * 20 + "chainab " * 8 + "chainbb " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = result(spelling_variants(docs))
    assert got == by_hand(rows)
    assert sum(v[0] is not None for v in got.values()) > 20 and got["chainbb"][:2] == ("chainab", "chainaa")


def test_indels_in_runs_count_once(spark):
    words = spark.createDataFrame([("aaaaa", 9), ("aaaaaa", 4), ("aabaa", 5), ("aaaba", 7)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in near_words(words).collect()}
    # aabaa and aaaba differ in two places
    assert got == {"aaaaa": (3, "aaaba"), "aaaaaa": (1, "aaaaa"), "aabaa": (1, "aaaaa"), "aaaba": (1, "aaaaa")}


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(37)], "word string, form string")
    assert {r["root"] for r in roots(chain).collect()} == {"w37"}


def test_no_words(spark, none, odd):
    assert spelling_variants(none).collect() == []
    assert spelling_variants(odd).filter("n < 3").collect() == []
