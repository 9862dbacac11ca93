"""Byte-level BPE through a sentencepiece model written from the rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import arrow

#: A byte b is written as the character U+0100 + b, so that no byte of a
#: pre-token is white space or a control character to the library.
_MAP = {b: 0x100 + b for b in range(256)}
#: Characters that a worker's memo of pre-tokens may hold (in entries of MEMO_ENTRY
#: characters at least) before it starts afresh. A memo lives as long as a task.
MEMO, MEMO_ENTRY = 2_000_000, 10
#: Characters encoded in one go; beyond it a text goes by itself, in parts of CHUNK pre-tokens.
LONG, CHUNK = 500_000, 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n & (1 << 64) - 1)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: one normal piece per token at the
    position of its rank, scored by the negative rank, then the unknown piece;
    identity normalisation, no dummy prefix, white space kept."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = b"".join(
        _field(1, _field(1, t.decode("latin-1").translate(_MAP).encode()) + b"\x15" + struct.pack("<f", -float(i)) + _number(3, 1)) for i, t in enumerate(order)
    )
    unknown = _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order)) + b"".join(_number(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_number(n, 0) for n in (3, 4, 5))
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


#: The pattern for which texts may be cut at single spaces and line ends (see Codec).
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encodes and decodes texts.

    Pre-tokens are memoised. Under the pattern SPACED no match goes on past a
    space or line end between two characters that aren't white space: a space
    begins a match, a line end is one by itself. So a text in which all spaces
    and line ends stand alone is cut there, and the memo holds the ids of whole
    chunks; the matches within a chunk are still found by the pattern and encoded
    one by one. Other texts are cut by the pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.get)
        self.numbers = list(range(len(self.tokens)))  # one object per id for all memos
        self.names = [str(i) for i in self.numbers]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == SPACED
        self.forget()

    def forget(self) -> None:
        """Empties the memos."""
        self.memo: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...] | None] = {}
        self.held = {"memo": 0, "chunks": 0}

    def _room(self, which: str, some: set[str]) -> list[str]:
        """What of ``some`` a memo doesn't hold; it starts afresh where it would overflow."""
        memo = getattr(self, which)
        new = [p for p in some if p not in memo]
        size = sum(max(MEMO_ENTRY, len(p)) for p in new)
        if self.held[which] + size > MEMO:
            memo.clear()
            new, self.held[which], size = list(some), 0, sum(max(MEMO_ENTRY, len(p)) for p in some)
        self.held[which] += size
        return new

    def _pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: of a token as it is, else by the model."""
        raws = [p.encode() for p in pieces]
        out = [(r,) if (r := self.ranks.get(raw)) is not None else None for raw in raws]
        ask = [i for i, x in enumerate(out) if x is None]
        if ask:
            found = self.model.encode([raws[i].decode("latin-1").translate(_MAP) for i in ask], num_threads=1)
            for i, ids in zip(ask, found, strict=True):
                out[i] = tuple(map(self.numbers.__getitem__, ids))
        return out

    def _learn(self, some: set[str]) -> None:
        """Memoises the pre-tokens ``some``."""
        new = self._room("memo", some)
        self.memo.update(zip(new, self._pieces(new), strict=True))

    def _learn_chunks(self, some: set[str]) -> None:
        """As above for chunks. None: white space next to the cut."""
        new = self._room("chunks", some)
        pieces: list[str] = []
        sizes: list[int] = []
        for c in new:
            bare = c.removeprefix("\n")
            if not bare or bare != bare.strip():
                sizes.append(-1)
                continue
            found = self.pattern.findall(c if c[0] == "\n" else " " + c)
            pieces += found
            sizes.append(len(found))
        ids = iter(self._pieces(pieces))
        for c, n in zip(new, sizes, strict=True):
            self.chunks[c] = None if n < 0 else tuple(chain.from_iterable(islice(ids, n)))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. What is unknown in all texts is learnt at once."""
        out: list[list[int] | None] = [None] * len(texts)
        if self.spaced:
            cut = {i: ("\n" + t).replace("\n", " \n").split(" ")[1:] for i, t in enumerate(texts) if len(t) <= LONG}
            waiting = []
            for i, chunks in cut.items():
                try:
                    out[i] = list(chain.from_iterable(map(self.chunks.__getitem__, chunks)))[1:]
                except KeyError:
                    waiting.append(i)
                except TypeError:
                    pass
            if waiting:
                self._learn_chunks(set().union(*(cut[i] for i in waiting)))
                for i in waiting:
                    try:
                        out[i] = list(chain.from_iterable(map(self.chunks.__getitem__, cut[i])))[1:]
                    except TypeError:
                        pass
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self._by_pattern(t)
        return out

    def _by_pattern(self, text: str) -> list[int]:
        if len(text) <= LONG:
            pieces = self.pattern.findall(text)
            self._learn(set(pieces))
            return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))
        out: list[int] = []
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, CHUNK)):
            self._learn(set(part))
            out.extend(chain.from_iterable(map(self.memo.__getitem__, part)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most LONG characters (or one text), with their start."""
    first, some, held = 0, [], 0
    for i, t in enumerate(texts):
        if some and held + len(t or "") > LONG:
            yield first, some
            first, some, held = i, [], 0
        some.append(t or "")
        held += len(some[-1])
    if some:
        yield first, some


def _ids(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Codec, pa.Array, list[list[int]]]]:
    """The codec, the document ids and the token ids of some texts after others."""
    c = codec(path, pattern)
    try:
        for b in batches:
            for first, some in _groups(b.column(1).to_pylist()):
                yield c, b.column(0).slice(first, len(some)), c.encode_many(some)
    finally:
        c.forget()


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, ids in _ids(path, pattern, batches):
            yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            back = pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), back], names=["doc_id", "ids", "decoded"])

    return run


def _round_tripper(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, docs, ids in _ids(path, pattern, batches):
            n = pa.array(map(len, ids), pa.int64())
            told = pa.array([hashlib.sha256(",".join(map(c.names.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string())
            back = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())
            cols = [docs, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), n, told, back]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row: the token ids of the whole text,
    each match of ``pattern`` encoded by itself, no special tokens. One narrow
    stage, no shuffle; workers memoise pre-tokens within a bound.

    Null and empty texts give an empty array, a null id stays null, repeated rows
    are encoded each (there are no ties), an empty table gives no rows. A text of
    more than LONG characters goes by itself, by CHUNK pre-tokens. Only the two
    columns named are read, so other columns may have any name."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.transform(arrow, _encoder(path, pattern), _schema(own, "doc_id", "ids array<int>"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded binary``, the bytes of ``ids`` (null: none), to
    ``(doc_id, ids)``."""
    return encoded.select("doc_id", "ids").transform(arrow, _decoder(path, pattern), _schema(encoded, "doc_id", "ids array<int>, decoded binary"))


def _schema(df: DataFrame, id_col: str, rest: str) -> str:
    return f"doc_id {df.schema[id_col].dataType.simpleString()}, {rest}"


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` per document, odd rows
    as in ``encode``: encode, then decode, in one pass through the workers, which
    make the digests, so that decoded bytes never leave them."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rest = "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.transform(arrow, _round_tripper(path, pattern, with_ids), _schema(own, "doc_id", rest))


def op2_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The query's columns; odd rows as in ``encode``."""
    return round_trip(docs, path, pattern, with_ids=False)
