"""Operator 12: SentencePiece encoding and decoding of merge-type vocabularies.

A text becomes its normal form (a space mark in front, every space a mark), one
symbol per character. An agenda holds the adjacent pairs whose joined piece is
in the vocabulary, best score first, leftmost on ties; the best pair is joined
and the pairs with its new neighbours enter the agenda, until it is empty. What
is then no piece is written as byte pieces.

Where no piece of the vocabulary holds a space mark after another character
(checked when it is loaded), no pair crosses from a character to a following
mark, so a text is cut there and equal parts are encoded once per task while
they are remembered (``MEMO`` parts; then the memory starts anew).

In every Arrow slice the sentencepiece library encodes the parts that are new
and decodes every text's ids: ``agrees`` says that both are ours. Python holds
one slice of about 4 MB of text (or one longer text) at a time; nothing is
shuffled."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import add

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tessera.llm.common import list_column, slices_by_bytes, text_of

MARK = "▁"
MEMO = 500_000           # remembered parts of a task, before they start anew
SHORT_PART = 64          # characters up to which a list is faster than a heap
NONE = 1 << 30           # no piece
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6   # fixed values: piece types of the model format


@dataclass(frozen=True)
class PieceModel:
    """A merge vocabulary: pieces, scores and types by id, and the file's bytes
    (at most a few megabytes) for the library."""
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    blob: bytes


def load_model(path: str) -> PieceModel:
    """Read a merge-type model file. Raises ValueError for one that this
    operator doesn't cover: another type, a normaliser that changes
    characters, no dummy prefix, no byte pieces, or user-defined pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(path, "rb") as f:
        blob = f.read()
    m = pb.ModelProto()
    m.ParseFromString(blob)
    rule = m.normalizer_spec
    if m.trainer_spec.model_type != 2:
        raise ValueError("not a merge-type model")
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not (rule.add_dummy_prefix and rule.escape_whitespaces):
        raise ValueError("the normaliser must only mark spaces and add one in front")
    kinds = tuple(p.type for p in m.pieces)
    if kinds.count(BYTE) != 256 or not m.trainer_spec.byte_fallback:
        raise ValueError("byte pieces are needed")
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined or unused pieces are not covered")
    return PieceModel(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds, blob)


class Coder:
    """Encoder and decoder of one task."""

    def __init__(self, model: PieceModel):
        normal = [(p, s, i) for i, (p, s, k) in enumerate(zip(model.pieces, model.scores, model.kinds)) if k == NORMAL]
        place = {s: n for n, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        self.order = {p: place[s] for p, s, _ in normal}    # equal scores share their place
        self.id_of = {p: i for p, _, i in normal}
        self.byte_ids = [0] * 256
        self.surface = []          # bytes of every id, a space for a mark
        self.byte_of = {}
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                b = int(p[3:5], 16)
                self.byte_ids[b], self.byte_of[i] = i, b
                self.surface.append(bytes([b]))
            elif k == NORMAL:
                self.surface.append(p.replace(MARK, " ").encode())
            else:
                self.surface.append(" ⁇ ".encode() if k == UNKNOWN else b"")
        self.starts_marked = [k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)]
        apart = all(MARK not in p.lstrip(MARK) for p in self.order)
        self.parts = re.compile(f"{MARK}+[^{MARK}]*" if apart else "(?s).+").findall
        self.silent = {i for i, k in enumerate(model.kinds) if k in (UNKNOWN, CONTROL)}
        self.wrong: set[str] = set()
        self.memo: dict[str, bytes] = {}    # part -> its ids, four bytes each

    def split(self, text: str) -> list[str]:
        """The parts of a text's normal form that no piece crosses."""
        return self.parts(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, texts_parts) -> list[str]:
        """Encode the parts that are not remembered; returns them."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list(set().union(*texts_parts).difference(self.memo))
        for part in fresh:
            ids = self.merge(part) if len(part) <= SHORT_PART else self.merge_long(part)
            self.memo[part] = array("i", ids).tobytes()
        return fresh

    def encode(self, text: str) -> list[int]:
        return self.encode_normal(MARK + text.replace(" ", MARK)) if text else []

    def encode_normal(self, normal: str) -> list[int]:
        """Ids of a text that is in its normal form already."""
        parts = self.parts(normal)
        self.learn([parts])
        return self.join(parts).tolist()

    def join(self, parts: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), np.int32)

    def merge(self, part: str) -> list[int]:
        """The agenda of a short part is a list beside its symbols: the least
        entry is the best score, the first of them the leftmost."""
        order, syms = self.order.get, list(part)
        agenda = [order(p, NONE) for p in map(add, syms, syms[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            syms[i] += syms.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(syms[i] + syms[i + 1], NONE)
            if i:
                agenda[i - 1] = order(syms[i - 1] + syms[i], NONE)
        return self.ids_of(syms)

    def ids_of(self, syms) -> list[int]:
        """Ids of the symbols; bytes for those that are no pieces."""
        ids, id_of = [], self.id_of.get
        for s in syms:
            got = id_of(s)
            if got is not None:
                ids.append(got)
            else:
                ids += [self.byte_ids[b] for b in s.encode("utf-8")]
        return ids

    def merge_long(self, part: str) -> list[int]:
        """The same agenda as a heap over linked symbols, n log n steps: entries
        (order of the score, place, joined piece)."""
        order, syms = self.order.get, list(part)
        n = len(syms)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i, pair in enumerate(map(add, syms, syms[1:])):
            got = order(pair)
            if got is not None:
                agenda.append((got, i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = syms[i], after[i]
            # out of date: a side is gone or has grown since
            if left is None or j >= n or len(left) + len(syms[j]) != len(pair):
                continue
            syms[i], syms[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                joined = pair + syms[k]
                got = order(joined)
                if got is not None:
                    heappush(agenda, (got, i, joined))
            h = before[i]
            if h >= 0:
                joined = syms[h] + pair
                got = order(joined)
                if got is not None:
                    heappush(agenda, (got, h, joined))
        return self.ids_of([s for s in syms if s is not None])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the first piece loses its front mark, control
        pieces are silent, and of a run of byte pieces that is no UTF-8 every
        wrong byte gives U+FFFD."""
        surface, silent = self.surface, self.silent
        first = next((i for i in ids if surface[i]), None)
        skip = 1 if first is not None and self.starts_marked[first] else 0
        if silent.isdisjoint(ids):
            try:
                return b"".join([surface[i] for i in ids])[skip:].decode("utf-8")
            except UnicodeDecodeError:
                pass
        runs = groupby(ids, lambda i: i if i in silent else -1 if i in self.byte_of else -2)
        return "".join(_decode_each(b"".join(surface[i] for i in run)) for _, run in runs)[skip:]


def _decode_each(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def coder_of(model: PieceModel) -> Coder:
    """A worker's coder: its remembered parts serve the tasks that follow."""
    return Coder(model)


def _encode_slices(shared, keys):
    def run(batches):
        import pyarrow as pa
        import sentencepiece

        model = shared.value
        own = coder_of(model)
        library = sentencepiece.SentencePieceProcessor(model_proto=model.blob)
        wrong = own.wrong        # parts of this worker that the library encodes otherwise
        for b in slices_by_bytes(batches, "text"):
            parts = [own.split(t) for t in b.column("text").to_pylist()]
            fresh = own.learn(parts)
            # the library puts the first mark in front itself
            theirs = [ids or [library.piece_to_id(MARK)]    # a lone mark is an empty text to it
                      for ids in library.encode([p[1:].replace(MARK, " ") for p in fresh], num_threads=1)]
            wrong.update(p for p, ids in zip(fresh, theirs) if array("i", ids).tobytes() != own.memo[p])
            ids = [own.join(p) for p in parts]
            lists = [i.tolist() for i in ids]
            decoded = [own.decode(i) for i in lists]
            agrees = [wrong.isdisjoint(p) and d == t for p, d, t in zip(parts, decoded, library.decode(lists))]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keys] + [list_column(ids), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                names=[*keys, "ids", "decoded", "agrees"])
    return run


def encode_pieces(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, ids, decoded, agrees)``, one row per row of ``docs``.

    A null or empty text has no ids and decodes to the empty text. Repeated
    rows and null keys each keep their row; other columns are left out, so
    their names can't clash. An empty table gives no rows. A text of any
    length is encoded whole."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    kept = docs.select(*keys, text_of().alias("text"))
    schema = StructType([docs.schema[k] for k in keys] + [
        StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()), StructField("agrees", BooleanType())])
    return kept.mapInArrow(_encode_slices(shared, keys), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from the operator's ids and decoded texts."""
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
