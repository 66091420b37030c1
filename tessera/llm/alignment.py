"""Operator 11: alignment of two tokenizers by whitespace-token anchors.

Every text is fully tokenised by a byte-level vocabulary (A, a space put in
front) and by a merge-type piece vocabulary (B, which puts it in front itself).
The byte offsets at which a space-marked token starts on both sides are the
anchors: there a token of A and one of B end together. They cut the two id
sequences into windows of a few ids. A window's alignment (its groups, between
offsets where both sides end, and its links, the pairs that end together) depends
on the ids alone and is remembered by the two id tuples.

Spark counts the links of every id pair over all rows: tasks sum what they hold,
one shuffle adds it up, and the highest count of every B id follows by a second
aggregate over pairs. Documents then look their pairs up in a broadcast of the
most frequent pairs, at most ``HOT_PAIRS``; where there are more pairs, the rest
is joined by a shuffle on the pair, and as all frequent ones are in the
broadcast, no key of that join is hot. Both give the same rows."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import list_column, slices_by_bytes, store, text_of
from tessera.llm.pieces import MARK, PieceModel, coder_of, load_model

MEMO = 300_000            # remembered parts of texts, and windows, of a task
HOT_PAIRS = 1 << 21       # pairs of the broadcast: about 40 MB
# A text is cut before a space that follows a character which is no white
# space: a token of either vocabulary never crosses such a place.
PARTS = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+").findall


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 characters stand for
    themselves, the others for the code points from 256 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_characters() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


_BYTE_OF = _byte_characters()


class Side:
    """Byte lengths of a vocabulary's tokens, and which start with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.marked = np.array([t[:1] == b" " for t in tokens])


class Aligner:
    """Tokenisers, remembered parts and remembered windows of one worker."""

    def __init__(self, byte_json: str, pieces: PieceModel):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.library_a = Tokenizer.from_str(byte_json)
        self.library_a.encode_special_tokens = True
        self.library_b = sentencepiece.SentencePieceProcessor(model_proto=pieces.blob)
        self.coder = coder_of(pieces)
        special = set(self.library_a.get_added_tokens_decoder())
        self.a = Side([b"" if i in special else byte_level_bytes(self.library_a.id_to_token(i)) for i in range(self.library_a.get_vocab_size())])
        self.b = Side(self.coder.surface)
        # ids as text, inside a group's side and at its end
        self.written = np.array([f"{i}{c}" for n, marks in ((len(self.a.tokens), ",|"), (len(self.b.tokens), ",;")) for i in range(n) for c in marks], object)
        self.written_chars = np.array([len(w) for w in self.written], np.int64)
        self.forget_parts()
        self.forget_windows()

    def forget_parts(self) -> None:
        self.parts: dict[str, int] = {}
        self.ids_a, self.ids_b = Lists(), Lists()
        self.unlike = np.zeros(0, bool)     # parts whose token bytes differ from their own

    def forget_windows(self) -> None:
        self.windows: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.links = Lists()

    # -- tokens
    def learn(self, fresh: list[str]) -> None:
        """Tokenise parts that are not remembered: joined to long texts, as no
        token crosses from a part to the next, but those that end in white
        space or hold the space mark alone."""
        alone = [p for p in fresh if p[-1].isspace() or MARK in p]
        if alone:
            odd = set(alone)
            fresh = [p for p in fresh if p not in odd]
        for texts, split in ((_joined(fresh), True), ([[p] for p in alone], False)):
            parts = [p for t in texts for p in t]
            if not parts:
                continue
            whole = ["".join(t) for t in texts]
            a = [e.ids for e in self.library_a.encode_batch_fast(whole, add_special_tokens=False)]
            if split:
                b = self.library_b.encode([t[1:] for t in whole], num_threads=1)
            else:
                b = [self.coder.encode_normal(t.replace(" ", MARK)) for t in whole]
            unlike = np.zeros(len(parts), bool)
            ends = np.cumsum([len(p.encode("utf-8")) for p in parts])
            for ids, lists, side in ((a, self.ids_a, self.a), (b, self.ids_b, self.b)):
                flat = np.array(list(chain.from_iterable(ids)), np.int32)
                if split:
                    token_ends = np.cumsum(side.length[flat])
                    cuts = np.searchsorted(token_ends, ends) + 1
                    if len(flat) < cuts[-1] or (token_ends[cuts - 1] != ends).any():
                        raise ValueError("a token crosses from a part of a text to the next")
                    lists.add(flat, np.diff(cuts, prepend=0))
                else:
                    lists.add(flat, np.array([len(i) for i in ids]))
                    unlike |= [b"".join([side.tokens[i] for i in x]) != p.encode("utf-8") for x, p in zip(ids, parts)]
                if split and any(b"".join([side.tokens[i] for i in x]) != t.encode("utf-8") for x, t in zip(ids, whole)):
                    raise ValueError("tokens do not give their text back")
            self.unlike = np.concatenate((self.unlike, unlike))
            for part in parts:
                self.parts[part] = len(self.parts)

    def tokens(self, texts: list[str | None]):
        """Ids of both sides, all texts in a row, and the number of each text's
        tokens. A text whose joined bytes aren't a space and the text has none."""
        split = [PARTS(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        numbers = list(map(self.parts.get, every))
        if None in numbers:
            self.learn(list({p for p, n in zip(every, numbers) if n is None}))
            numbers = list(map(self.parts.__getitem__, every))
        numbers = np.array(numbers, np.int64)
        text_of_part = np.repeat(np.arange(len(texts)), [len(p) for p in split])
        wrong = {t for t in text_of_part[self.unlike[numbers]].tolist() if not self._same_bytes(texts[t], split[t])}
        if wrong:
            right = ~np.isin(text_of_part, list(wrong))
            numbers, text_of_part = numbers[right], text_of_part[right]
        out = []
        for lists in (self.ids_a, self.ids_b):
            ids, sizes = lists.take(numbers)
            out.append((ids, np.bincount(text_of_part, sizes, len(texts)).astype(np.int64)))
        return out

    def _same_bytes(self, text: str, parts: list[str]) -> bool:
        """Of a text with an unlike part: the joined bytes, in full."""
        raw = (" " + text).encode("utf-8")
        numbers = np.array([self.parts[p] for p in parts])
        return all(b"".join([side.tokens[i] for i in lists.take(numbers)[0].tolist()]) == raw
                   for lists, side in ((self.ids_a, self.a), (self.ids_b, self.b)))

    # -- windows
    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token places, in both sequences, at which a window starts (and both
        ends): the same byte offset, a space-marked token after it on each side."""
        la, lb = self.a.length[a], self.b.length[b]
        off_a, off_b = np.cumsum(la) - la, np.cumsum(lb) - lb
        at_a, at_b = np.flatnonzero(self.a.marked[a]), np.flatnonzero(self.b.marked[b])
        place = np.searchsorted(off_b[at_b], off_a[at_a])
        shared = np.append(off_b[at_b], -1)[place] == off_a[at_a]
        return np.append(at_a[shared], len(a)), np.append(at_b[place[shared]], len(b))

    def numbered(self, a, b, cut_a, cut_b) -> np.ndarray:
        """The number of every window. Equal windows of the slice are found by
        hashes and compared in full; of each, one is looked up by its ids."""
        hashes = _window_hashes(a, cut_a, 1) + _window_hashes(b, cut_b, 2)
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if not (_same_windows(a, cut_a, first[of]) and _same_windows(b, cut_b, first[of])):
            first = of = np.arange(len(hashes))      # a hash that two windows share
        # the ids of a window's key: those of A, -1, those of B
        n_a, n_b = (cut_a[first + 1] - cut_a[first]), (cut_b[first + 1] - cut_b[first])
        ends = np.cumsum(n_a + n_b + 1)
        starts = ends - (n_a + n_b + 1)
        ids = np.full(int(ends[-1]), -1, np.int32)
        ids[_spread(starts, n_a)] = a[_spread(cut_a[first], n_a)]
        ids[_spread(starts + n_a + 1, n_b)] = b[_spread(cut_b[first], n_b)]
        raw = ids.tobytes()
        keys = [raw[i:j] for i, j in zip((4 * starts).tolist(), (4 * ends).tolist())]
        numbers = list(map(self.windows.get, keys))
        if None in numbers:
            self.align_windows(list({k for k, n in zip(keys, numbers) if n is None}))
            numbers = list(map(self.windows.__getitem__, keys))
        return np.array(numbers, np.int64)[of]

    def align_windows(self, fresh: list[bytes]) -> None:
        """Align windows that are seen first: a group ends where both sides do;
        its last tokens are linked."""
        ids = np.frombuffer(b"".join(fresh), np.int32)
        ends = np.cumsum([len(k) // 4 for k in fresh])
        middle = np.flatnonzero(ids < 0)                       # one in each window
        side_b = np.repeat(np.tile([False, True], len(fresh)), np.diff(np.sort(np.concatenate(([0], middle, ends)))))
        a, b = ids[~side_b], ids[side_b & (ids >= 0)]
        window_ends = np.cumsum(middle - np.concatenate(([0], ends[:-1])))
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        place = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(np.append(end_b, -1)[place] == end_a)
        last_a, last_b = both + 1, place[both] + 1            # ends of the groups, as token places
        groups_to = np.searchsorted(last_a, window_ends) + 1  # every window ends with a group
        self.links.add(a[last_a - 1].astype(np.int64) * len(self.b.tokens) + b[last_b - 1], np.diff(groups_to, prepend=0))
        # the groups as text: A's tokens of a group, then B's, each with its separator
        from_b, out = np.concatenate(([0], last_b[:-1])), np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        group_a, group_b = np.searchsorted(last_a, at_a, "right"), np.searchsorted(last_b, at_b, "right")
        out[at_a + from_b[group_a]] = 2 * a.astype(np.int64) + (at_a + 1 == last_a[group_a])
        out[at_b + last_a[group_b]] = 2 * (len(self.a.tokens) + b.astype(np.int64)) + (at_b + 1 == last_b[group_b])
        text = "".join(self.written[out].tolist())
        chars = np.cumsum(self.written_chars[out])
        tokens_to = last_a[groups_to - 1] + last_b[groups_to - 1]
        cuts = np.concatenate(([0], chars[tokens_to - 1])).tolist()
        first = len(self.groups)
        self.groups += [text[i:j - 1] for i, j in zip(cuts, cuts[1:])]
        self.windows.update(zip(fresh, range(first, len(self.groups))))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, list[str], np.ndarray]]:
        """Per text: tokens of A and of B, the groups of its windows as text,
        and its links as a * (size of B) + b."""
        if len(self.parts) > MEMO:
            self.forget_parts()
        if len(self.windows) > MEMO:
            self.forget_windows()
        (a, n_a), (b, n_b) = self.tokens(texts)
        if not len(a):
            return [(0, 0, [], np.zeros(0, np.int64)) for _ in texts]
        cut_a, cut_b = self.anchors(a, b)
        numbers = self.numbered(a, b, cut_a, cut_b)
        links, sizes = self.links.take(numbers)
        # every text with tokens starts at an anchor, as its first token is marked
        at = np.searchsorted(cut_a, np.concatenate(([0], np.cumsum(n_a))))
        links_at = np.concatenate(([0], np.cumsum(sizes)))[at]
        groups = list(map(self.groups.__getitem__, numbers.tolist()))
        return [(int(n_a[i]), int(n_b[i]), groups[at[i]:at[i + 1]], links[links_at[i]:links_at[i + 1]]) for i in range(len(texts))]


class Lists:
    """Numbered lists of integers, end to end in one array."""

    def __init__(self):
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate((self.flat, flat)) if len(self.flat) else flat
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers end to end, and their sizes."""
        sizes = self.at[numbers + 1] - self.at[numbers]
        return self.flat[_spread(self.at[numbers], sizes)], sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for every i, sizes[i] of them."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _joined(parts: list[str], limit: int = 1 << 16) -> list[list[str]]:
    """Parts in lists of about ``limit`` characters."""
    out, held, size = [], [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= limit:
            out.append(held)
            held, size = [], 0
    return out + [held] if held else out


def _window_hashes(ids: np.ndarray, cuts: np.ndarray, side: int) -> np.ndarray:
    sizes = np.diff(cuts)
    place = np.arange(len(ids)) - np.repeat(cuts[:-1], sizes)
    x = ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(side << 62)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):   # fixed values: a published 64-bit mixer
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.add.reduceat(x ^ (x >> np.uint64(31)), cuts[:-1])


def _same_windows(ids: np.ndarray, cuts: np.ndarray, like: np.ndarray) -> bool:
    """Whether every window has the ids of window ``like`` of it."""
    sizes = np.diff(cuts)
    return bool((sizes == sizes[like]).all()) and bool((ids == ids[_spread(cuts[like], sizes)]).all())


@lru_cache(maxsize=1)
def _aligner(byte_json: str, pieces: PieceModel) -> Aligner:
    return Aligner(byte_json, pieces)


def _align_batches(shared, keys: list[str], with_groups: bool):
    def run(batches):
        import pyarrow as pa

        aligner = _aligner(*shared.value)
        for b in slices_by_bytes(batches, "text"):
            aligned = aligner.align(b.column("text").to_pylist())
            digests, texts, pairs, times = [], [], [], []
            for _, _, groups, links in aligned:
                text = ";".join(groups)
                digests.append(hashlib.sha256(text.encode()).hexdigest() if groups else "")
                texts.append(text if with_groups else None)
                p, t = np.unique(links, return_counts=True)
                pairs.append(p)
                times.append(t.astype(np.int32))
            offsets = pa.array(np.cumsum([0] + [len(p) for p in pairs]).astype(np.int32))
            columns = [b.column(k) for k in keys] + [
                pa.array([x[0] for x in aligned], pa.int64()), pa.array([x[1] for x in aligned], pa.int64()),
                pa.array([len(x[3]) for x in aligned], pa.int64()), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs))), list_column(times)]
            names = [*keys, "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
            if with_groups:
                columns.append(pa.array(texts, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, keys: tuple[str, ...] = ("doc_id",),
                    with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``(*keys, n_a, n_b, n_groups, groups_sha256,
    pairs, times)``: the id pairs a * (size of B) + b that are linked in the
    text, and how often; with ``with_groups`` also the groups as text.

    A null or empty text, and one whose token bytes differ from a space and the
    text (it holds the space mark itself), has no tokens: zeros, empty lists and
    an empty digest. Repeated rows and null keys keep their rows; other columns
    are left out, so their names can't clash."""
    with open(byte_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), load_model(piece_path)))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>" + (", groups string" if with_groups else "")
    return docs.select(*keys, text_of().alias("text")).mapInArrow(_align_batches(shared, list(keys), with_groups), schema)


def _sum_pairs(batches):
    """Links per pair, summed over what a batch holds."""
    import pyarrow as pa

    for b in batches:
        pairs, times = b.column("pairs").flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False)
        p, at = np.unique(pairs, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.bincount(at, times, len(p)).astype(np.int64))], names=["pair", "c"])


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(pair, c, best)``: links of every id pair over all rows, and whether no
    pair of the same B id has more."""
    counts = aligned.select("pairs", "times").mapInArrow(_sum_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    counts = store(counts, "alignment-pairs")
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("c").alias("most"))
    return counts.join(most, F.col("pair") % size_b == F.col("b")).select("pair", "c", (F.col("c") == F.col("most")).alias("best"))


def _look_up(shared, kept: list[str]):
    """Sums over the links whose pair is in the broadcast; the others as they are."""
    def run(batches):
        import pyarrow as pa

        pair, c, best = shared.value
        for b in batches:
            own, times = b.column("pairs"), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = own.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            n_best, count_sum = np.where(hit, times, 0), np.where(hit, times, 0)
            if len(pair):
                n_best, count_sum = n_best * best[at], count_sum * c[at]
            row = np.searchsorted(ends, np.arange(len(flat)), "right")

            def per_row(x):
                total = np.concatenate(([0], np.cumsum(x)))
                return np.diff(np.concatenate(([0], total[ends])))

            left = np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=b.num_rows)))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(flat[~hit]), pa.array(times[~hit])], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in kept] + [pa.array(per_row(n_best)), pa.array(per_row(count_sum)), pa.ListArray.from_arrays(pa.array(left), rest)],
                names=[*kept, "n_best", "count_sum", "rest"])
    return run


def _hot_threshold(counts: DataFrame, hot_pairs: int) -> tuple[int, bool]:
    """The least count whose pairs, with all above, are no more than
    ``hot_pairs`` (in powers of two), and whether pairs are left below it."""
    rows = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().collect()
    total, least = 0, None
    for p, n in sorted(((r["p"], r["count"]) for r in rows), reverse=True):
        if total + n > hot_pairs:
            return (1 << 62 if least is None else least), True
        total, least = total + n, 1 << p
    return 0, False


def link_strength(docs: DataFrame, byte_path: str, piece_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``align_documents`` with ``n_links``, ``n_best`` and ``count_sum``: the
    text's links, those whose pair has the highest count of its B id over all
    rows (ties included), and the sum of the pairs' counts over the links.
    An empty table gives no rows."""
    keyed = docs.select("doc_id", "text").withColumn("rk", F.monotonically_increasing_id())
    aligned = store(align_documents(keyed, byte_path, piece_path, ("doc_id", "rk")), "alignment")
    size_b = len(load_model(piece_path).pieces)
    counts = store(pair_counts(aligned, size_b), "alignment-counts")
    least, more = _hot_threshold(counts, hot_pairs)
    hot = counts.where(F.col("c") >= least).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(k).to_numpy() for k in ("pair", "c", "best")))
    kept = ["doc_id", "rk", "n_a", "n_b", "n_groups", "groups_sha256"]
    kinds = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in kept)
    rows = aligned.mapInArrow(_look_up(shared, kept), f"{kinds}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    best, total = F.col("n_best"), F.col("count_sum")
    if more:
        cold = (rows.select("rk", F.explode("rest").alias("x")).select("rk", "x.pair", "x.times")
                .join(counts.where(F.col("c") < least), "pair").groupBy("rk")
                .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("c")).alias("_sum")))
        rows = rows.drop("rest").join(cold, "rk", "left")
        best, total = best + F.coalesce("_best", F.lit(0)), total + F.coalesce("_sum", F.lit(0))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), best.alias("n_best"), total.alias("count_sum"), "groups_sha256")
