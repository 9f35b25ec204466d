import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomlab.llm import token_files
from fathomlab.llm.sentencepiece_codec import MergeCodec, decode_ids, encode_decode
from fathomlab.llm.token_files import Reader, WordEncoder, pack, read_token_files, unpack, write_token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "☃", "in", "ing", "tion", "0", "123", ".", ",", "\t", "<s>", "<0x0A>", "梦", "\U0001f600", "   ", "aaaa", "ﬁ", "====", "\r\n"]


def test_encoding_equals_the_library():
    own, sp, rng = MergeCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        ids = sp.encode(text)
        assert own.encode(text) == ids, text
        assert own.round_trip(text)[1] == sp.decode(ids), text
        some = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(8)]
        assert own.decode(some) == sp.decode(some)


def test_encode_decode_on_odd_rows(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = encode_decode(odd, MODEL).collect()
    assert len(rows) == odd.count() and "score" in rows[0].asDict()
    for r in rows:
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
    assert [r["decoded"] for r in decode_ids(encode_decode(odd, MODEL), MODEL).collect()] == [r["decoded"] for r in rows]
    assert encode_decode(none, MODEL).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and np.array_equal(unpack(raw, bits, 1001), ids)


def test_word_shortcut_on_other_white_space():
    file = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(file), WordEncoder(file)
    texts = ["a\tb  c", "a\tb ", " a\u00a0b", "a\u00a0b  c", "prix : 5\u00a0% ", "one\ttwo\n\nthree", "x\x1cy \n", "a\u3000b\n", "a b", "a\tb c", " a", "a\r\nb"]
    rng = random.Random(3)
    texts += ["", None, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(800))]
    for end in (None, 2):
        ids, sizes = own.encode(pa.array(texts), end)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for k, text in enumerate(texts):
            want = library.encode(text or "", add_special_tokens=False).ids + ([end] if end else [])
            assert ids[cuts[k] : cuts[k + 1]].tolist() == want, repr(text)


def test_token_files_roll_over_and_keep_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    monkeypatch.setattr(token_files, "GROUP", 3)
    docs = spark.range(0, 300).select((300 - F.col("id")).alias("doc_id"), F.repeat(F.lit("some words here "), (F.col("id") % 7).cast("int")).alias("text"))
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, folder=str(tmp_path / "many"))
    assert files.count() > 6
    rows = sorted(read_token_files(spark, files).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(1, 301))
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()


def test_token_files(spark, odd, none, tmp_path):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    docs = odd.unionByName(spark.range(10, 400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Some words,"), F.hex("id"), F.lit("and more\nof them")).alias("text")), allowMissingColumns=True)
    files = write_token_files(docs, file, end_id=2, folder=str(tmp_path / "tokens"))
    rows = sorted(read_token_files(spark, files).collect(), key=lambda r: r["start"])
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]
    start = 0
    for r, w in zip(rows, want):
        ids = np.array([*library.encode(w["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(bytes(r["ids_le"])) == zlib.crc32(ids.tobytes())
        start += len(ids)
    path = sorted((tmp_path / "tokens").glob("*.ftok"))[0]
    reader = Reader(path.read_bytes())
    whole = np.concatenate([reader.document(k) for k in range(len(reader.docs))])
    assert np.array_equal(reader.ids(5000, 9000), whole[5000:9000])
    assert read_token_files(spark, write_token_files(none, file, end_id=2)).count() == 0
