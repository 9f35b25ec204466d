import random
import re

from pyspark.sql import functions as F

from fathomlab.llm.pii import BASE, _luhn, base_spans, expectation_maximisation, find_pii, mask_pii, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and _luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15,
        }[kind]()

    return [(k, *m.span()) for k in BASE for m in re.finditer(PATTERNS[k], text) if fine(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "x@y.z", "1", "25", "256", "1.2.3.4", "+1", "+49 (30) 123-456", " ", "-", "(", ")", "4539578763621486", "4111 1111 1111 1111", "é", "%", "\n", "_"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == brute(text), text
    assert base_spans("9" * 200_000 + " a" * 10)[:1] == []
    assert base_spans("a" * 200_000) == []


def test_em_trusts_agreeing_labelers():
    belief = expectation_maximisation([("secret", (1, 1, 1, 1, 1), 50), ("secret", (1, 2, 0, 2, 2), 30), ("secret", (0, 0, 0, 1, 0), 5)])
    assert belief["secret", (1, 1, 1, 1, 1)] > 0.9 > 0.1 > belief["secret", (1, 2, 0, 2, 2)]


def test_spans_and_masks(spark, odd, none):
    rows = [(k, f"call me at (706) 555-31{k:02d} or me{k}@mail.example.com, password=8c95f79ef43c2{k} é") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    model = train(docs)
    for r in find_pii(docs, model).collect():
        text = rows[r["doc_id"] - 10][1]
        found = {s["kind"]: text[s["start"] : s["end"]] for s in r["spans"]}
        assert found["email"] == f"me{r['doc_id']}@mail.example.com" and found["secret"].startswith("password=") and found["phone"].startswith("(706)")
        assert [s["kind"] for s in r["base"]] == ["email"]
    for r in mask_pii(docs, model).collect():
        assert "<EMAIL>" in r["text"] and "<SECRET>" in r["text"] and "555" not in r["text"] and r["n_chars"] == len(r["text"])
    assert find_pii(odd).count() == odd.count() and find_pii(none).count() == 0
    masked = mask_pii(odd)
    assert masked.columns == odd.columns and masked.exceptAll(odd.withColumn("n_chars", F.col("n_chars"))).isEmpty()
