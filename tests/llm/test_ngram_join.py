import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomlab.llm import ngram_join
from fathomlab.llm.ngram_join import bitmaps, jaccard_components, shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def by_hand(rows):
    nodes = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(nodes)):
        for y in range(x):
            a, b = nodes[x][1], nodes[y][1]
            if a and b and nodes[x][0] is not None and nodes[y][0] is not None and 100 * len(a & b) >= 90 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for k, (i, s) in enumerate(nodes):
        if s and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least[find(k)] if s and i is not None else i) for k, (i, s) in enumerate(nodes)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        if not words:
            break
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], ["new%d" % rng.randrange(10**6)], [words[k], "more%d" % rng.randrange(10**6)]))
    return words


def planted(seed, groups, copies):
    rng = random.Random(seed)
    shared = ["s%d" % rng.randrange(99) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = ["%s%d" % (rng.choice("abcABC"), rng.randrange(3000)) for _ in range(rng.choice((3, 9, 12, 40, 120, 300)))]
        base += shared if rng.random() < 0.4 else []
        chain = base
        for _ in range(rng.randrange(1, copies)):
            chain = edited(rng, rng.choice((base, chain)), rng.randrange(0, 1 + max(1, len(base) // 30)))
            rows.append(" ".join(chain))
    rng.shuffle(rows)
    return list(enumerate(rows, start=1))


def test_components_equal_all_pairs(spark):
    rows = planted(4, 60, 9)
    rows += [(900, "one"), (901, "One"), (902, "one two"), (903, "ONE\tTWO "), (904, None), (905, ""), (None, rows[0][1]), (906, " \n "), (7, "other words under an id that is used"), (7, rows[20][1]), (907, "É a b"), (908, "é a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("node", F.lit("clash"))
    got = result(jaccard_components(docs))
    assert got == by_hand(rows)
    assert len({c for _, _, c in got}) < len(got) - 80


def test_crowded_group_loses_no_link(spark, monkeypatch):
    """Many edited copies of one text, of which most are not near the first: tiles of small blocks, several rounds."""
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    monkeypatch.setattr(ngram_join, "FIRST", 1)
    monkeypatch.setattr(ngram_join, "GROWTH", 8)
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(900) for _ in range(200)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(1, 8)))) for k in range(150)]
    chains = [edited(rng, base, 12) for _ in range(12)]
    for k in range(70):
        at = rng.randrange(12)
        chains[at] = edited(rng, chains[at], rng.randrange(1, 4))
        rows.append((1000 + k, " ".join(chains[at])))
    got = result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == by_hand(rows)
    assert 20 < len({c for _, _, c in got}) < 215


def test_bitmaps_bound_the_difference():
    rng = random.Random(1)
    for _ in range(30):
        base = ["w%d" % rng.randrange(500) for _ in range(rng.choice((5, 80, 700)))]
        texts = [" ".join(base), " ".join(edited(rng, base, rng.randrange(0, 30))) or "x"]
        row, named, size = shingle_sets(pa.array(texts))
        packed, at = bitmaps(row, named, size)
        maps = [packed[at[k] : at[k + 1]].tobytes() for k in range(2)]
        words = min(map(len, maps)) // 8
        two = ngram_join._words(maps, words)
        a, b = (set(named[row == k].tolist()) for k in range(2))
        assert int(np.bitwise_count(two[0][0] ^ two[0][1]).sum()) <= len(a ^ b)
        assert [len(a), len(b)] == size.tolist() == [len(shingles(t)) for t in texts]
        if 100 * len(a & b) >= 90 * len(a | b):
            assert ngram_join.may_link(size[:1], size[1:], np.array([len(a ^ b)]))[0]


def test_odd_rows_and_no_rows(spark, odd, none):
    assert jaccard_components(none).collect() == []
    assert result(jaccard_components(odd)) == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])
