"""Groups of spelling variants: words that differ by one code point, found by sorted rotations.

A word is marked with a terminator and written in all its rotations (a permuterm index). Take the code
point at place i out of a word: the rest, read from behind the gap round to before it, is the prefix
``w[i+1:] $ w[:i]`` of the rotation that ends in the code point taken out. So

* two words with the same prefix and other last code points differ by a replacement at that place;
* a word whose whole rotation is the prefix (nothing was taken out) is the other one with that code
  point deleted.

All rotations are sorted by prefix, and each group of equal prefixes is scanned once. A group has at most
one word without a gap and one word for each letter of the alphabet (26 + 64), whatever the corpus, so
groups cannot become hot; a member emits the number of its neighbours and the best of them, not pairs. A pair
that differs by an insertion into a run of equal letters would meet in several groups; it counts only in
that of the run's first place. Words are counted with partial sums before they are shuffled.

Forms are followed by pointer jumping. A form is at least twice as frequent as its word, so a chain is no
longer than the logarithm of the greatest count, and the rounds are the logarithm of that.

Defined results: null texts have no words; a null doc_id is written as nothing before the colon; repeated
rows count each; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import settle

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run whose name (crc32 of doc_id and run) this divides loses one code point.
DAMAGE = 97
#: A near word is a form if it is so many times as frequent.
FORM_RATIO = 2
END = "$"  # no letter


def _ascii_lower(word: Column) -> Column:
    """A-Z alone are lowered; texts of ASCII take the fast path."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def word_counts(docs: DataFrame, damage: int | None = DAMAGE) -> DataFrame:
    """word, n: runs of letters of all texts that have LEAST_LENGTH code points and LEAST_COUNT
    occurrences. With ``damage``, a run loses one code point where crc32(doc_id:run) is a multiple."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("raw"))
    runs = runs.filter(F.char_length("raw") >= LEAST_LENGTH).select("doc_id", _ascii_lower(F.col("raw")).alias("word"))
    if damage:
        name = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word").cast("binary"))
        runs = runs.select("word", name.alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.char_length("word") >= LEAST_LENGTH)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, last, n, opens: of each word all rotations. ``last`` is the code point that was taken out,
    empty for whole rotations; ``opens`` tells that it is the first of a run of equal ones."""
    length = F.char_length("word")
    part = lambda begin, size: F.substring("word", begin, size)
    gap = F.explode(F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(
        F.concat(part(i + 1, length), F.lit(END), part(F.lit(1), i - 1)).alias("prefix"),
        part(i, F.lit(1)).alias("last"),
        ((i == 1) | (part(i - 1, F.lit(1)) != part(i, F.lit(1)))).alias("opens"),
    )))
    whole = F.explode(F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.concat(part(i + 1, length), F.lit(END), part(F.lit(1), i)).alias("prefix"), F.lit("").alias("last"), F.lit(True).alias("opens"),
    )))
    return words.select("n", gap.alias("r")).union(words.select("n", whole.alias("r"))).select("r.*", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word): of each word that has near words their number and the
    most frequent one, ties by code points."""
    by_prefix = Window.partitionBy("prefix")
    group = rotations(words).withColumn("size", F.count("*").over(by_prefix)).filter("size > 1")
    word = F.concat(F.substring_index("prefix", END, -1), "last", F.substring_index("prefix", END, 1))
    members = group.select("prefix", F.struct((-F.col("n")).alias("less"), word.alias("word"), F.col("last") != "", "opens").alias("m"))
    members = members.select("prefix", F.col("m").cast("struct<less:bigint,word:string,gap:boolean,opens:boolean>").alias("m"))
    scanned = members.groupBy("prefix").agg(F.sort_array(F.collect_list("m")).alias("all"))  # 91 members at most
    scanned = scanned.select(
        "all", F.filter("all", lambda m: m["gap"]).alias("gaps"), F.filter("all", lambda m: m["gap"] & m["opens"]).alias("grown"), F.filter("all", lambda m: ~m["gap"]).alias("whole")
    )
    each = scanned.select(F.explode("all").alias("m"), "gaps", "grown", "whole")
    others = F.filter(F.slice("gaps", 1, 2), lambda m: m["word"] != F.col("m.word"))  # of the two best one is not the word itself
    shorter = F.when(F.col("m.opens"), F.col("whole")).otherwise(F.slice("whole", 1, 0))
    near = F.when(F.col("m.gap"), F.concat(others, shorter)).otherwise(F.slice("grown", 1, 1))
    count = F.when(F.col("m.gap"), F.size("gaps") - 1 + F.size(shorter)).otherwise(F.size("grown"))
    best = F.array_min(F.transform(near, lambda m: F.struct(m["less"].alias("less"), m["word"].alias("word"))))
    return (
        each.select(F.col("m.word").alias("word"), count.cast("long").alias("n_near"), best.alias("best"))
        .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
        .filter("n_near > 0")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the last."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = settle(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, damage: int | None = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = settle(word_counts(docs.select("doc_id", "text"), damage))
    found = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    found = settle(found.select("word", F.col("best.word").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
