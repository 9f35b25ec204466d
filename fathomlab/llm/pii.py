"""Personal data by weak supervision.

Base spans (e-mail, IP, card, phone) are exact patterns with validity checks; they always stay. The
method adds spans: wider patterns propose candidates (also of secrets and identity numbers), and
labelers vote on each - shape, validity, a gazetteer of cue words before it, its surroundings, and the
mix of its characters. Expectation-maximisation over the vote patterns of all documents (counted in
Spark: at most a few thousand patterns) estimates how reliable each labeler is per kind, without
labels; its posteriors train the final span classifier, a logistic regression on votes and context.
Candidates of equal kind, votes and context are one row, weighted by their number, and of each kind at most
about SAMPLE such rows are drawn, by a hash of the row itself, so the model does not depend on how the
table is partitioned. Candidates that it accepts and that touch no base span are
added.

Offsets are code points, ends exclusive. Matching is linear in the length of a text. Null and empty
texts have no spans; rows are independent of each other, so repeated rows and null ids need no rule;
with no candidates at all only base spans are given. Only doc_id and text are read;
:func:`mask_pii` passes other columns through and recounts ``n_chars`` where it is present.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .models import Bags, logistic, sigmoid
from .shared import settle
from .textops import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id_number")
#: Different (kind, votes, context) rows of each kind that the span classifier learns from.
SAMPLE = 4_000
EM_ROUNDS = 50
#: Votes of the labelers: abstain, yes, no.
LABELERS = ("shape", "validity", "gazetteer", "surroundings", "mix")
CELLS = 1 << 12
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WIDE = {
    "email": re.compile(r"[A-Za-z0-9_%+-]{2,40} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,40} ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z]{2,10}"),
    "phone": re.compile(r"(?<![0-9.+-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
    "secret": re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[ ]?[:=][ ]?[\"']?[A-Za-z0-9+/_.-]{8,200}"),
    "id_number": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b"),
}
#: Cue words in English, German, French and Spanish.
_CUES = {
    "email": ("mail", "contact", "reach", "write", "kontakt", "schreib", "courriel", "écri", "correo", "escrib"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "cell", "dial", "telefon", "anruf", "rufnummer", "handy", "kontakt", "tél", "appel", "portable", "móvil", "llam", "celular"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "credential", "passwort", "kennwort", "schlüssel", "geheim", "mot de passe", "clé", "contraseña", "clave"),
    "id_number": ("ssn", "social", "iban", "account", "passport", "id", "tax", "konto", "ausweis", "steuer", "compte", "sécurité", "carte", "cuenta", "documento", "pasaporte"),
}
_DUMMY = ("example", "changeme", "xxxx", "your_", "placeholder", "dummy", "sample", "redacted", "beispiel", "exemple", "ejemplo", "<", "****")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping base spans per kind, by kind and then start."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        else:
            end = max(end, a)
        at = text.find("@", max(at + 1, end if m else 0))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    end = 0
    for a, _ in runs:  # a match that fails at the start of a run of digits fails in all of it
        m = _IP.match(text, a) if a >= end else None
        if m:
            end = m.end()
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append(("ip", a, end))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...], list[int]]]:
    """Wider spans that touch no base span: kind, start, end, votes, feature cells."""
    low, out = None, []
    cover = sorted((a, b) for _, a, b in taken)
    for kind, pattern in _WIDE.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(x < b and a < y for x, y in cover):
                continue
            value = m.group()
            digits, alnum = sum(c.isdigit() for c in value), sum(c.isalnum() for c in value)
            before, after = text[max(0, a - 40) : a].lower(), text[b : b + 12].lower()
            low = value.lower()
            body = re.split(r"[:=]", low, maxsplit=1)[-1].strip(" \"'") if kind == "secret" else low
            shape = 1 if kind == "secret" or (kind == "id_number" and "-" in value) or (kind == "phone" and value.startswith("(")) or kind == "email" else 0
            if kind == "phone":
                validity = 1 if digits in (10, 11) else 2
            elif kind == "id_number":
                validity = 2 if value[:3] in ("000", "666") or value.startswith("9") else 1
            elif kind == "secret":
                validity = 1 if any(c.isdigit() for c in body) and any(c.isalpha() for c in body) else 2
            else:
                validity = 0
            cue = 1 if any(c in before or (kind == "secret" and c in low) for c in _CUES[kind]) else 0
            near = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
            around = 2 if near[0].isalnum() or near[1].isalnum() else 1
            mix = 2 if any(d in body for d in _DUMMY) or len(set(body)) <= max(2, len(body) // 6) else (1 if alnum >= 8 else 0)
            words = re.findall(r"[^\W\d_]+", before)[-1:] + re.findall(r"[^\W\d_]+", after)[:1]
            cells = [zlib.crc32(f"{kind}:{k}:{v}".encode()) % CELLS for k, v in enumerate((shape, validity, cue, around, mix))]
            cells += [zlib.crc32(f"{kind}:w:{w}".encode()) % CELLS for w in words]
            cells += [zlib.crc32(f"{kind}:n:{min(b - a, 60) // 4}:{min(digits, 20) // 2}".encode()) % CELLS, zlib.crc32(kind.encode()) % CELLS]
            out.append((kind, a, b, (shape, validity, cue, around, mix), cells))
            cover.append((a, b))
    return out


def _texts(column: pa.Array) -> list[str | None]:
    """Texts that may hold a span (a digit, an @ or a bracketed word), None for all others."""
    maybe = pc.fill_null(pc.match_substring_regex(column, r"[0-9@]|[\[(] ?at ?[\])]|(?i:password|passwd|pwd|secret|token|key) ?[:=]"), False).to_pylist()
    return [column[k].as_py() if ok else None for k, ok in enumerate(maybe)]


class SpanModel:
    """Accepts or rejects candidates."""

    def __init__(self, w: np.ndarray | None, b: float = 0.0):
        self.w, self.b = w, b

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans, each by kind and start."""
        if text is None:
            return [], []
        base = base_spans(text)
        more = []
        if self.w is not None:
            more = [(k, a, b) for k, a, b, _, cells in candidates(text, base) if sigmoid(np.array(self.w[cells].sum() + self.b)) >= ACCEPT]
        return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(personal) of each (kind, votes) pattern. Two classes per kind; each labeler has its own
    reliabilities, started from voting right four times in five and smoothed by one vote."""
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in {p[0] for p in patterns}:
        votes = np.array([p[1] for p in patterns if p[0] == kind])
        n = np.array([p[2] for p in patterns if p[0] == kind], float)
        yes, no = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
        q = sigmoid((yes - no) * np.log(4.0) - np.log(4.0))
        for _ in range(EM_ROUNDS):
            prior = ((n * q).sum() + 1) / (n.sum() + 2)
            logit = np.full(len(n), np.log(prior / (1 - prior)))
            for k in range(votes.shape[1]):
                for v in range(3):
                    hit = votes[:, k] == v
                    start = {0: (0.2, 0.2), 1: (0.64, 0.16), 2: (0.16, 0.64)}[v]
                    a = ((n * q)[hit].sum() + 5 * start[0]) / ((n * q).sum() + 5)
                    b = ((n * (1 - q))[hit].sum() + 5 * start[1]) / ((n * (1 - q)).sum() + 5)
                    logit[hit] += np.log(a / b)
            q = sigmoid(logit)
        out |= {(kind, tuple(v)): float(x) for v, x in zip(votes.tolist(), q)}
    return out


def train(docs: DataFrame) -> SpanModel:
    """Votes of all candidates of all documents; the classifier from a bounded sample of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [c for t in _texts(batch.column(0)) if t is not None for c in candidates(t, base_spans(t))]
            votes = pa.array([list(c[3]) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in found], pa.string()), votes, pa.array([c[4] for c in found], pa.list_(pa.int32()))], ["kind", "votes", "cells"])

    found = settle(docs.select("text").mapInArrow(run, "kind string, votes array<int>, cells array<int>"))
    patterns = [(r["kind"], tuple(r["votes"]), r["count"]) for r in found.groupBy("kind", "votes").count().collect()]
    if not patterns:
        return SpanModel(None)
    belief = expectation_maximisation(patterns)
    alike = settle(found.groupBy("kind", "votes", "cells").agg(F.count("*").alias("n")))
    kinds = {r["kind"]: r["count"] for r in alike.groupBy("kind").count().collect()}
    share = F.coalesce(*[F.when(F.col("kind") == k, F.lit(min(1.0, SAMPLE / n))) for k, n in kinds.items()])
    rows = alike.filter(F.pmod(F.xxhash64("kind", "votes", "cells"), F.lit(1_000_003)) < share * 1_000_003).collect()
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["cells"]))
    bags = Bags([(np.array(r["cells"]), np.ones(len(r["cells"]))) for r in rows])
    y = np.array([belief[r["kind"], tuple(r["votes"])] for r in rows])
    return SpanModel(*logistic(bags, y, CELLS, np.array([r["n"] for r in rows], float), steps=120))


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (arrays of kind, start, end) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.spans(t) for t in _texts(batch.column(1))]
            arrays = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[j]] for f in found], span) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def mask_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans
    become one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    columns, at = docs.columns, docs.columns.index("text")
    size = columns.index("n_chars") if "n_chars" in columns else None
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masked: dict[int, str] = {}
            for k, text in enumerate(_texts(batch.column(at))):
                spans = sorted(shared.value.spans(text)[1], key=lambda s: (s[1], -s[2]))
                if not spans:
                    continue
                out, end = [], 0
                for kind, a, b in spans:
                    if a >= end:
                        out += [text[end:a], f"<{kind.upper()}>"]
                    end = max(end, b)
                masked[k] = "".join([*out, text[end:]])
            arrays = list(batch.columns)
            if masked:
                texts = batch.column(at).to_pylist()
                sizes = batch.column(size).to_pylist() if size is not None else None
                for k, text in masked.items():
                    texts[k] = text
                    if sizes is not None:
                        sizes[k] = len(text)
                arrays[at] = pa.array(texts, pa.string())
                if size is not None:
                    arrays[size] = pa.array(sizes, pa.int64())
            if size is not None:
                arrays[size] = arrays[size].cast(pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, schema)
