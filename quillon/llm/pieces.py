"""SentencePiece BPE encoding and decoding by a prefix table.

A text is normalised (dummy prefix, spaces to U+2581) and cut into chunks that no piece crosses.
Within a chunk, the table holds for every prefix the last token of that prefix's encoding. There is
exactly one: among the vocabulary pieces that end there (found by an Aho-Corasick automaton), the one
that is compatible with the last token of the remaining prefix, where two tokens are compatible if
encoding their concatenation gives just these two. Ids are then read off backwards. The work is
linear in the text, whatever the length of its longest chunk.

Defined results: null and empty texts have no ids and decode to ''; long texts are encoded whole; repeated
rows are encoded once each; an empty table gives no rows; a prefix has one last token, so that nothing ties.
Other columns pass through; one with a result's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, claim, fresh, quoted, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Most chunks (twice) and token pairs that one Python worker remembers.
REMEMBERED, REMEMBERED_PAIRS = 120_000, 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A BPE model file with byte fallback, identity normalisation and no user-defined pieces."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, squeeze, escape, charsmap, model_type = True, True, True, b"", 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
                    elif n == 5:
                        escape = bool(v)
        if model_type != 2 or squeeze or not escape or charsmap or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only plain BPE models with identity normalisation are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.id_text = [str(i) for i in range(len(self.pieces))]
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.lengths = [len(p) for p in self.pieces]
        self.alphabet = {c for p in self.ids for c in p}
        # A piece that its own encoding splits is never the result of one.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # No piece crosses a space that follows another character, nor a character outside the alphabet.
        inside = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alien = "".join(c for c in "\n\r\t" if c not in self.alphabet)
        # Nor does one cross from a letter to a mark that follows no letter in any piece.
        joined = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = re.escape("".join(c for c in ".,;:!?%*#$&|()[]{}\"'-" if c not in joined))
        self.chunk = None if inside else re.compile(rf"{SPACE}*[^\W\d_]++(?![^{marks}{SPACE}{alien}])|{SPACE}+[^{SPACE}{alien}]*|[^{SPACE}{alien}]+" + (f"|[{alien}]" if alien else ""))
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return bytes([int(self.pieces[i][3:5], 16)]) if kind == BYTE else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' concatenation gives just these two."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        a, b = self.pieces[left], self.pieces[right]
        known = self.pairs[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def _run(self, text: str) -> list[int] | None:
        """Ids of a stretch of characters of the alphabet, by the prefix table; else None."""
        last = [-1] * (len(text) + 1)
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - length:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 20 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        ids, at, lengths = [], len(text), self.lengths
        while at:
            token = last[at]
            if token < 0:
                return None
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk) or self._run(chunk)
        if ids is None:
            ids, run = [], []
            for c in chunk:
                if c in self.alphabet:
                    run.append(c)
                    continue
                if run:
                    ids += self._run("".join(run))
                    run = []
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
            if run:
                ids += self._run("".join(run))
        ids = tuple(ids)
        if len(chunk) <= 64:
            if len(self.chunks) >= REMEMBERED:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        known, new = self.chunks.get, self._chunk
        return list(chain.from_iterable([known(c) or new(c) for c in (self.chunk.findall(text) if self.chunk else [text])]))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes are put together again, the dummy prefix goes, control ids are silent."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            first = next((i for i in ids if self.surface[i]), None)
            if self.kinds[first] == NORMAL:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._lenient(data)

    @staticmethod
    def _lenient(data: bytes) -> str:
        """Each byte that starts no valid character becomes U+FFFD."""
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[bytes, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """The model of a file's bytes, built once in each Python worker."""
    claim("pieces", _models.clear)
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


#: Columns that encode() can return.
RESULTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "pieces": T.ArrayType(T.StringType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(df: DataFrame, model_file: str, text: str = "text", keep: Iterable[str] = (), results: Iterable[str] = ("ids",)) -> DataFrame:
    """Encode a text column, and decode the ids again where a result asks for it.

    keep names the columns that pass through, results those of RESULTS that are added; a result takes the
    place of a column of its name. The model file is read on the driver and travels with the tasks.
    """
    with open(model_file, "rb") as f:
        data = f.read()
    keep, results = list(keep), list(results)
    keep = [c for c in keep if c.lower() not in results]
    body = fresh(df, "_text")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, RESULTS[c]) for c in results])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch in slices(batches):
            rows: dict[str, list] = {c: [] for c in results}
            for value in batch.column(body).cast(pa.string()).to_pylist():
                ids = model.encode(value)
                decoded = model.decode(ids) if "decoded" in rows or "decoded_sha256" in rows else ""
                for c, got in rows.items():
                    got.append(
                        ids if c == "ids"
                        else [model.pieces[i] for i in ids] if c == "pieces"
                        else decoded if c == "decoded"
                        else len(ids) if c == "n_tokens"
                        else sha(",".join(map(model.id_text.__getitem__, ids)).encode()) if c == "ids_sha256"
                        else sha(decoded.encode())
                    )
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out.field(c).type) for c in keep] + [pa.array(rows[c], out.field(c).type) for c in results], schema=out)

    return df.select(*quoted(keep), F.col(text).alias(body)).mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: Iterable[str] = (), result: str = "decoded") -> DataFrame:
    """Decode a column of id arrays; a null array decodes to ''."""
    with open(model_file, "rb") as f:
        data = f.read()
    keep = list(keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(result, T.StringType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in slices(batches):
            texts = [model.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out.field(c).type) for c in keep] + [pa.array(texts, pa.string())], schema=out)

    return df.select(*keep, df[ids].alias("_ids")).mapInArrow(run, schema)
