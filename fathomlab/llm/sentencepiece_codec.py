"""SentencePiece (merge type) encoding by backtracking, and decoding.

A sequence of pieces is the model's encoding of a text exactly if every two neighbours are: merging
the characters of ``a + b`` from scratch, best score first, must end in ``[a, b]`` again. So pieces
are chosen left to right, longest Aho-Corasick match first; a choice that no neighbour accepts is
undone, and a field of failed positions keeps any position from being tried twice. Pair checks are
kept, and so are the encodings of frequent words: no piece reaches across a space that follows
another character, so words are encoded one by one.

Results are those of the sentencepiece library's ``encode`` and ``decode`` for models whose
normaliser is the identity with a dummy prefix (checked when a model is loaded). Null texts count
as empty (no ids, empty decoded text); texts of any length are handled whole; rows are independent,
so repeated rows repeat; empty tables give empty results. Output columns replace input columns of
the same name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .textops import slices

#: Words whose encoding each Python worker keeps in each of two generations.
CACHED_WORDS = 300_000
#: Pair checks that are kept.
CACHED_PAIRS = 300_000
SPACE = "▁"


class MergeCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("  a  ﬁ\t") != SPACE * 3 + "a" + SPACE * 2 + "ﬁ\t":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [sp.unk_id()] * 256
        self.shown: list[str | int] = []  # text of each id; a byte's value for byte pieces
        matcher = ahocorasick.Automaton()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.shown.append(int(piece[3:5], 16))
            elif sp.is_control(i):
                self.shown.append("")
            elif sp.is_unknown(i):
                self.shown.append(" ⁇ ")
            else:
                self.pieces[piece], self.score[piece] = i, sp.get_score(i)
                self.shown.append(piece.replace(SPACE, " "))
                if len(piece) > 1:
                    matcher.add_word(piece, piece)
        matcher.make_automaton()
        self.matcher = matcher
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.chunk = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.by_word = not inner and not any("\n" in p for p in self.pieces)
        self.fits: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)

    def remerge(self, text: str) -> list[str]:
        """Merging from single characters: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_fits(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.remerge(a + b) == ([a, b] if a else [b])
        return known

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of one chunk; characters outside the vocabulary stand alone."""
        size, fits, options = len(text), self.fits.get, [[c] for c in text]
        for end, piece in self.matcher.iter(text):
            options[end - len(piece) + 1].append(piece)
        failed = bytearray(size + 1)
        chosen: list[str] = []
        pos, last = 0, ""
        while pos < size:
            tries = options[pos]  # shorter ones remain for a later return to this position
            while tries:
                piece = tries.pop()
                end = pos + len(piece)
                if not failed[end]:
                    fit = fits((last, piece))
                    if fit or (fit is None and self.pair_fits(last, piece)):
                        chosen.append(piece)
                        pos, last = end, piece
                        break
            else:
                failed[pos] = 1
                pos -= len(chosen.pop())
                last = chosen[-1] if chosen else ""
        return chosen

    def ids_of(self, chunk: str) -> list[int]:
        chosen = self.pieces_of(chunk)
        try:
            return [self.pieces[x] for x in chosen]
        except KeyError:  # characters outside the vocabulary
            pass
        ids: list[int] = []
        for piece in chosen:
            i = self.pieces.get(piece)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
        return ids

    def text_of(self, ids: list[int]) -> str:
        """Pieces' text; runs of byte pieces read as UTF-8, each wrong byte as U+FFFD."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # byte pieces
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            shown = self.shown[i]
            if type(shown) is int:
                run.append(shown)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(shown)
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        first = ids[0] if ids else -1
        return text[1:] if ids and isinstance(self.shown[first], str) and self.shown[first].startswith(" ") and first in self._spaced else text

    @property
    def _spaced(self) -> set[int]:
        if not hasattr(self, "_spaced_ids"):
            self._spaced_ids = {i for p, i in self.pieces.items() if p.startswith(SPACE)}
        return self._spaced_ids

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text decoded from them."""
        if not text:
            return b"", ""
        if self.by_word and SPACE not in text:
            units = text.replace("\n", " \n").split(" ")
            if "" not in units:
                ids = b"".join(map(self.words.__getitem__, units))
                odd = self.words.odd
                if odd.keys().isdisjoint(units):  # every word decodes to itself
                    return ids, text
                return ids, "".join([odd[w] if w in odd else w if w[0] == "\n" else " " + w for w in units])[1:]
        ids: list[int] = []
        for chunk in self.chunk.findall(SPACE + text.replace(" ", SPACE)):
            ids += self.ids_of(chunk)
        return np.array(ids, "<i4").tobytes(), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.round_trip(text)[0], "<i4").tolist()


class _Words(dict):
    """Ids by word: a word stands for itself after a space; with a newline before it, for itself after
    that newline. The last generation is kept until the next is full. ``odd`` has the decoded text of words
    that do not decode to themselves."""

    def __init__(self, codec: MergeCodec):
        self.codec, self.old, self.odd = codec, {}, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            unit = word if word[0] == "\n" else " " + word
            ids = self.codec.ids_of(word if word[0] == "\n" else SPACE + word)
            found, shown = array("i", ids).tobytes(), self.codec.text_of(ids)
            if shown != unit:
                self.odd[word] = shown
        if len(word) < 40 and word not in self.odd:
            self[word] = found
        return found

    def trim(self) -> None:
        """Between texts: forget the oldest words if there are many."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self.odd.clear()


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[k : k + n]).decode("utf-8"))
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> MergeCodec:
    return MergeCodec(model)


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) of each whole text and ``decoded``, the text that these
    ids stand for. One pass without a shuffle."""
    keep = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, text):
            pairs = [own.round_trip(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            sizes = np.array([len(a) // 4 for a, _ in pairs], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join([a for a, _ in pairs]), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), ids, pa.array([b for _, b in pairs], pa.string())], [*keep, "ids", "decoded"])
            own.words.trim()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode_ids(frame: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``, the text of each row's ids (null ids: empty)."""
    keep = [c for c in frame.columns if c.lower() != "decoded"]
    schema = T.StructType([*(frame.schema[c] for c in keep), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return frame.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
