import random

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F


def words(rng, n):
    return [rng.choice("abcdefgh") + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def tables(spark, folder, docs, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    clean = [" ".join(words(rng, 120)) for _ in range(60)]
    item = words(rng, 40)
    near = clean[0].split()
    near[60] = "edited"
    rows = [(k, t, "en", f"host{k % 6}", len(t)) for k, t in enumerate(clean)]
    rows += [(100, " ".join(near), "en", "host0", 1), (101, clean[1], "en", "host1", 1), (102, "too short", "en", "host2", 9), (103, None, None, None, None), (104, "again and again my words " * 30, "en", "host3", 1)]
    rows += [(105, " ".join(words(rng, 50) + item + words(rng, 50)), "en", "host4", 1), (106, " ".join(words(rng, 60) + ["write", "to", "ann.b@mail.example.org"] + words(rng, 40)), "en", "host5", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(3)).withColumn("items", F.lit("x"))
    folder = tables(spark, tmp_path, docs, [(1, " ".join(item)), (2, None)])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(60), 106}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert "<EMAIL>" in out[106]["text"] and "@" not in out[106]["text"]
    assert all(list(r["ids"]) == sp.encode(r["text"]) and r["decoded"] == sp.decode(r["ids"]) and r["node"] == 3 and r["items"] == "x" for r in out.values())
    by_hand = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        by_hand = stage(spark, by_hand, folder)
        assert by_hand.columns == docs.columns
    assert {r["doc_id"] for r in by_hand.select("doc_id").collect()} == set(out)


def test_an_empty_table(spark, none, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, none, [(1, "a question with some words that nobody asked")])).isEmpty()
