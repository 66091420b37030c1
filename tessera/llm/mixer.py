"""Language-model scoring by online logistic context mixing.

A text is read as lower-cased words and an end mark. Words of the dictionary
(the most frequent ``DICTIONARY`` of the training rows) are one symbol, other
words are spelled byte by byte and closed by a blank, so every text has a
probability. Symbols are coded by a Huffman tree: each step down the tree is a
bit. ``CONTEXTS`` predictors give each bit's odds from hashed contexts (the
tree node alone; with the word before, or the two letters before while
spelling; with the two words before, or the four letters before), from counts
over all training rows. Their stretched odds are combined by weights
gated by the state (spelling or not); the weights learn online, every
``BLOCK`` bits, along lanes of ``LANE`` bits of a text, and a table of final
probabilities refines the result. The cost of all bits is the score.

Training rows are those whose crc32(doc_id as text) mod 7 is not 2. Word and
bit counts cover all of them, and so do the start weights (the mean of all
lanes' last ones) and the refinement (one pass each, in whole numbers, so that
the dealing of rows doesn't matter); both read each text without its own counts. The tables' slots follow the number of training tokens,
from ``SLOTS`` to ``MOST_SLOTS``, a bound of their broadcast; tasks send their
counts in blocks.

The base score needs the count of every word: the ``TOP`` most frequent go to
the tasks, the others are joined by shuffle.

Defined results: null and empty texts are the end mark alone; long texts are
scored whole; without training rows all counts are zero; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import doc_crc, grouped_by_bytes, row_hash, small_batches, store, text_of

DICTIONARY = 65_536      # words that are one symbol, at most
DICTIONARY_COUNT = 16    # and seen at least so often; rarer ones teach spelling
TOP = 200_000            # word counts that tasks hold
WORD_BYTES = 64          # longest word of those two tables
SLOTS, MOST_SLOTS = 1 << 19, 1 << 21   # slots of a hashed context, by the number of training tokens
CONTEXTS = 3
LANE, BLOCK = 1024, 16
FIXED = 1 << 24          # weights are summed in steps of 1 / FIXED
RATE = 0.02
TOP_ODDS, STEP = 15, 64  # mixed odds are clipped to +- TOP_ODDS and read in steps of 1 / STEP
CHUNK = 1 << 19          # bytes of text coded at once
FINE = 8                 # steps of a table's odds
EVENTS = 6 << 20         # bits that are held before they are counted
PIECE = 1 << 15          # bits whose odds are computed at once, while they are in the processor's cache
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
SPELL, END = 256, 256    # symbols 0..255 are bytes, 256 the end mark, the dictionary follows


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _count_words(batches):
    """Words of the training rows and their counts, combined per chunk; the end
    mark is the empty word."""
    from collections import Counter

    import pyarrow as pa
    counts: Counter = Counter()
    for table in grouped_by_bytes(batches, "text", 8 << 20):
        texts = table.column("text").to_pylist()
        for t in texts:
            counts.update(tokens_of(t))
        counts[b""] += len(texts)
        if len(counts) > 500_000:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})
            counts = Counter()
    if counts:
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})


def _spelling(words: frozenset):
    """Counts of the bytes that spell the words outside the dictionary."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(256)
        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()):
                if w and w not in words:
                    total += c * np.bincount(np.frombuffer(w + b" ", np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": pa.array(np.arange(256)), "c": pa.array(total.astype(np.int64))})
    return run


class Coder:
    """The dictionary and its Huffman tree."""

    def __init__(self, words: list[bytes], counts: np.ndarray, slots: int = SLOTS):
        """``counts`` of the 256 bytes, the end mark and the words, in order."""
        self.n, self.slots = 257 + len(words), slots
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up = np.zeros(2 * self.n - 1, np.int64)
        right = np.zeros(2 * self.n - 1, np.int64)
        node = self.n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = node
            right[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        depth = np.zeros(2 * self.n - 1, np.int64)
        for i in range(node - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        self.length = depth[:self.n].astype(np.int32)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int64)
        self.nodes = np.zeros(int(self.length.sum()), np.int32)    # inner nodes on the way, as 0..n-2
        self.first32 = self.first.astype(np.int32)
        self.bits = np.zeros(len(self.nodes), np.uint8)
        at, left = np.arange(self.n), self.length.astype(np.int64).copy()
        while (live := np.flatnonzero(left > 0)).size:
            left[live] -= 1
            k = self.first[live] + left[live]
            self.bits[k] = right[at[live]]
            at[live] = up[at[live]]
            self.nodes[k] = at[live] - self.n
        self.spread = (self.nodes.astype(np.uint32) + np.uint32(1)) * _M[1]

    def encode(self, words: list[list[bytes]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, and how many each has. ``ids`` numbers all the
        words by frequency; those from the dictionary's size on are spelled."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        known = (ids >= 0) & (ids < self.n - 257)
        spelled = [w for ws, a in zip(words, np.split(known, np.cumsum(count)[:-1])) for w, k in zip(ws, a.tolist()) if not k]
        size = np.ones(len(ids), np.int64)
        size[~known] = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        total = np.append(0, np.cumsum(size))
        end = np.cumsum(count)
        sizes = total[end] - total[end - count] + 1                     # with the end mark
        owner = np.repeat(np.arange(len(words)), count)
        out = np.full(int(sizes.sum()), -1, np.int32)
        begin = total[:-1] + owner                                      # one end mark for each text before
        out[begin[known]] = ids[known] + 257
        out[np.cumsum(sizes) - 1] = END
        out[out < 0] = np.frombuffer(b" ".join(spelled) + b" " if spelled else b"", np.uint8)
        return out, sizes

    def expand(self, symbols: np.ndarray, sizes: np.ndarray, align: int = 1):
        """Bits of the symbols: (slots of each context, bits, spelling state,
        bits of each text, first bit of each text). Texts start at multiples of
        ``align``; the places between them repeat the last bit."""
        ends = np.cumsum(sizes)
        at = np.arange(len(symbols), dtype=np.int32) - np.repeat((ends - sizes).astype(np.int32), sizes)
        inside = np.ones(len(symbols), bool)           # still in the word that is being spelled
        c2 = c4 = last = spelling = two = None
        for d in range(1, 5):
            s = np.full(len(symbols), self.n, np.uint32)
            s[d:] = symbols[:-d]
            s[at < d] = self.n                         # before the text's first symbol
            inside = inside & (s < SPELL) & (s != 32)
            part = np.where(inside, s + np.uint32(1), np.uint32(0))
            c4 = part if d == 1 else c4 * _M[1] + part
            if d == 1:
                last, spelling = s, inside
            elif d == 2:
                c2 = np.where(spelling, c4, last + np.uint32(1))
                two = (last + np.uint32(1)) * _M[1] + s + np.uint32(7)
        c4 = np.where(spelling, c4, two)
        n = self.length[symbols]
        per_text = np.add.reduceat(n, ends - sizes).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        room = -(-per_text // align) * align
        n = n.copy()
        n[ends - 1] += (room - per_text).astype(np.int32)
        start = np.cumsum(n, dtype=np.int64) - n
        where = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((self.first[symbols] - start).astype(np.int32), n)
        first = np.cumsum(room) - room
        if align > 1:
            np.minimum(where, len(self.nodes) - 1, out=where)
        state = np.repeat(spelling, n)
        # spelling and whole words use a half of the slots each
        shift = np.uint32(32 - (self.slots.bit_length() - 2))
        spread = self.spread.take(where)
        slots = [self.nodes.take(where)]
        for c in (c2, c4):
            h = np.repeat((c * _M[2]) ^ (c >> np.uint32(15)), n) ^ spread
            h *= _M[0]
            h >>= shift
            h += state * np.uint32(self.slots // 2)
            slots.append(h.view(np.int32))
        return slots, self.bits.take(where), state, per_text, first


class Numbers:
    """Words of texts and their numbers by frequency (-1: beyond the table)."""

    def __init__(self, top: list[bytes]):
        self.get = {w: i for i, w in enumerate(top)}.get

    def __call__(self, texts: list[str]) -> tuple[list[list[bytes]], np.ndarray]:
        words = [tokens_of(t) for t in texts]
        return words, np.array(list(map(self.get, chain.from_iterable(words), repeat(-1))), np.int32)


def _count_bits(held):
    """Per task: zeros and ones of every slot, in blocks of one context."""
    def run(batches):
        import pyarrow as pa
        coder, top = held.value
        numbers = Numbers(top)
        size = [coder.n, coder.slots, coder.slots]
        total = [np.zeros(2 * s, np.int32) for s in size]
        some, waiting, events = False, [[] for _ in size], 0

        def add():
            for k, parts in enumerate(waiting):
                if parts:
                    total[k] += np.bincount(np.concatenate(parts), minlength=2 * size[k]).astype(np.int32)
                    parts.clear()

        with np.errstate(over="ignore"):
            for table in grouped_by_bytes(batches, "text", CHUNK):
                slots, bits, _, _, _ = coder.expand(*coder.encode(*numbers(table.column("text").to_pylist())))
                for k in range(CONTEXTS):
                    waiting[k].append(slots[k] * 2 + bits)
                some, events = True, events + len(bits)
                if events >= EVENTS:
                    add()
                    events = 0
            add()
        step = 1 << 15
        for k in range(CONTEXTS if some else 0):
            for a in range(0, 2 * size[k], step):
                yield pa.RecordBatch.from_pydict({"context": pa.array([k], pa.int32()), "block": pa.array([a // step], pa.int32()),
                                                  "counts": pa.array([total[k][a:a + step].tobytes()], pa.binary())})
    return run


def _sum_blocks(key, table):
    import pyarrow as pa
    total = None
    for c in table.column("counts"):
        x = np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
        total = x if total is None else total + x
    return pa.table({"context": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                     "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched odds of counts, in steps of 1 / FINE; few sightings say little."""
    n = zeros + ones
    x = ones + np.float32(0.4)
    x /= zeros + np.float32(0.4)
    np.log(x, out=x)
    n /= n + np.float32(1.5)
    x *= n
    np.clip(x, -12, 12, out=x)
    x *= FINE
    return np.rint(x, out=x).astype(np.int8)


def _odds_without_own(slots, bits, counts: np.ndarray, own: np.ndarray, per_text, first) -> np.ndarray:
    """Odds of bits from ``counts`` (zeros and ones of every slot in turn) less
    those of the bit's own text. ``own`` has a zero for each slot, before and
    after; it holds a text's zeros in the low half of a number, ones in the high."""
    at = slots.astype(np.intp)
    one = np.array([1, 1 << 32]).take(bits)
    mine = np.zeros(len(at), np.int64)
    for a, n in zip(first.tolist(), per_text.tolist()):
        # whole-word indices and addends of one type: add.at is slow with others
        here = at[a:a + n]
        np.add.at(own, here, one[a:a + n])
        mine[a:a + n] = own.take(here)
        own[here] = 0
    pairs = counts.view(np.int64)                       # a slot's zeros and ones are read together
    out = np.empty(len(at), np.int8)
    for a in range(0, len(at), PIECE):
        left = pairs.take(at[a:a + PIECE]).view(np.float32)
        left -= mine[a:a + PIECE].view(np.int32)
        np.maximum(left, np.float32(0), out=left)
        out[a:a + PIECE] = _odds(left[0::2], left[1::2])
    return out


class Mixer:
    """Coder, odds tables, start weights and refinement."""

    def __init__(self, coder: Coder, counts: list[np.ndarray]):
        """``counts``: zeros and ones of every slot in turn, by context."""
        self.coder, self.odds = coder, [_odds(c[0::2], c[1::2]) for c in counts]
        self.own = None                                # see inputs
        self.weights = np.full((2, CONTEXTS), 0.4, np.float32)
        # stretched probabilities come in steps of 1 / STEP
        self.grid = (np.arange(2 * TOP_ODDS * STEP + 1) / STEP - TOP_ODDS).astype(np.float32)
        self.chance = (1 / (1 + np.exp(-self.grid))).astype(np.float32)
        self.refine(np.zeros((2, len(self.grid)), np.float32))

    def refine(self, move: np.ndarray):
        """Cost in bits of (state, bit, step) after moving the odds."""
        z = np.clip(self.grid + move, -20, 20)
        self.cost = np.stack([np.log1p(np.exp(z)), np.log1p(np.exp(-z))], axis=1).astype(np.float32).ravel() / np.float32(np.log(2))

    def inputs(self, words, ids, counts: list[np.ndarray] | None = None):
        """The predictors' odds of all bits. With ``counts`` the texts are among
        those counted, and each is read without its own sightings."""
        slots, bits, state, per_text, first = self.coder.expand(*self.coder.encode(words, ids), align=BLOCK)
        if counts is None:
            x = [o.take(s) for o, s in zip(self.odds, slots)]
        else:
            if self.own is None:
                self.own = np.zeros(max(map(len, counts)) // 2, np.int64)
            x = [_odds_without_own(s, bits, c, self.own, per_text, first) for s, c in zip(slots, counts)]
        x = [o.reshape(-1, BLOCK) for o in x]
        # places after a text's last bit say nothing and teach nothing
        tail = np.flatnonzero(per_text % BLOCK)
        for i, rest in zip((first + per_text)[tail] // BLOCK, per_text[tail] % BLOCK):
            for k in x:
                k[i, rest:] = 0
        return x, bits.reshape(-1, BLOCK), state.reshape(-1, BLOCK), per_text, first

    def run(self, x, bits, state, per_text, first, learn=None):
        """Mixed odds of all bits, as steps. Lanes advance together, BLOCK bits
        a time; the weights of a lane learn from each block before the next."""
        lanes_of = -(-per_text // LANE)
        owner = np.repeat(np.arange(len(per_text)), lanes_of)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        start = first[owner] // BLOCK + part * (LANE // BLOCK)
        size = -(-np.minimum(LANE, per_text[owner] - part * LANE) // BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        w = np.repeat(self.weights[None], len(start), axis=0)
        steps = np.zeros(bits.shape, np.int16)
        for t in range(LANE // BLOCK):
            live = int(np.searchsorted(-size, -t, side="left"))     # lanes longer than t blocks
            if not live:
                break
            at = start[:live] + t
            xb = [k.take(at, axis=0) * np.float32(1 / FINE) for k in x]
            sb, bb = state.take(at, axis=0), bits.take(at, axis=0)
            d = None
            for k in range(CONTEXTS):
                y = xb[k] * np.where(sb, w[:live, 1, k, None], w[:live, 0, k, None])
                d = y if d is None else np.add(d, y, out=d)
            d *= STEP
            d += TOP_ODDS * STEP + 0.5
            np.clip(d, 0, len(self.grid) - 1, out=d)
            q = d.astype(np.int16)
            steps[at] = q
            e = bb - self.chance.take(q)
            spell = e * sb
            e -= spell
            for k in range(CONTEXTS):
                w[:live, 0, k] += RATE * np.einsum("ij,ij->i", e, xb[k])
                w[:live, 1, k] += RATE * np.einsum("ij,ij->i", spell, xb[k])
        if learn is not None:
            learn.append((np.rint(w.astype(np.float64) * FIXED).astype(np.int64).sum(0).ravel(), len(w)))
        return steps

    def last_weights(self, words, ids, counts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Sum of the lanes' last weights (in steps of 1 / FIXED) and the number
        of lanes of counted texts, each read without its own counts."""
        learned: list = []
        self.run(*self.inputs(words, ids, counts), learn=learned)
        return learned[0]

    def start(self, total: np.ndarray, lanes: int) -> None:
        """Begin with the mean of the lanes' last weights."""
        if lanes:
            self.weights = (total / (lanes * FIXED)).reshape(2, CONTEXTS).astype(np.float32)

    def sightings(self, words, ids, counts: list[np.ndarray]) -> np.ndarray:
        """How often each (state, step) of the mixed odds met each bit, over
        counted texts, each read without its own counts."""
        x, bits, state, per_text, first = self.inputs(words, ids, counts)
        which = self.run(x, bits, state, per_text, first).astype(np.int32).ravel()
        which += (state.view(np.int8).astype(np.int32) * 2 + bits).ravel() * np.int32(len(self.grid))
        fill = -per_text % BLOCK                                       # places after each text's last bit
        beyond = np.repeat(first + per_text - (np.cumsum(fill) - fill), fill) + np.arange(int(fill.sum()))
        n = 4 * len(self.grid)
        return np.bincount(which, minlength=n) - np.bincount(which[beyond], minlength=n)

    def calibrate(self, sightings: np.ndarray) -> None:
        """The refinement, by buckets of steps that were met often enough."""
        met = sightings.reshape(2, 2, len(self.grid)).astype(np.float64)
        width = STEP // 2                                              # steps of one refinement bucket
        move = np.zeros((2, len(self.grid)), np.float32)
        bucket = np.arange(len(self.grid)) // width
        for g in (0, 1):
            n, ones, said = (np.bincount(bucket, weights=v) for v in (met[g].sum(0), met[g, 1], met[g].sum(0) * self.chance))
            logit = lambda q: np.log((q + 0.5) / (n - q + 0.5))
            move[g] = np.where(n >= 100, logit(ones) - logit(said), 0)[bucket]
        self.refine(move)

    def fit(self, words, ids, counts: list[np.ndarray]):
        """Start weights and refinement from counted texts held here."""
        if words:
            self.start(*self.last_weights(words, ids, counts))
            self.calibrate(self.sightings(words, ids, counts))
        return self

    def score(self, words, ids) -> np.ndarray:
        """Bits of each text."""
        x, bits, state, per_text, first = self.inputs(words, ids)
        steps = self.run(x, bits, state, per_text, first)
        which = steps.astype(np.int32).ravel()
        which += (state.view(np.int8).astype(np.int32) * 2 + bits).ravel() * np.int32(len(self.grid))
        total = np.append(0, np.cumsum(self.cost.take(which), dtype=np.float64))
        return total[first + per_text] - total[first]


def _summed(held, what: str):
    """Per task: the sums of ``Mixer.last_weights`` (the lanes after them) or of
    ``Mixer.sightings`` over its texts, by place."""
    def run(batches):
        import pyarrow as pa
        mixer, seen, words = held.value
        numbers = Numbers(words)
        total = None
        with np.errstate(over="ignore"):
            for table in grouped_by_bytes(batches, "text", CHUNK // 2):
                found = getattr(mixer, what)(*numbers(table.column("text").to_pylist()), seen)
                part = np.append(*found) if what == "last_weights" else found
                total = part if total is None else total + part
        if total is not None:
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"place": pa.array(place.astype(np.int32)), "c": pa.array(total[place])})
    return run


def learn(mixer: Mixer, seen: list[np.ndarray], words: list[bytes], texts: DataFrame) -> Mixer:
    """Start weights, then refinement, over all training texts; a few thousand
    sums reach the driver."""
    def sums(what: str, size: int) -> np.ndarray:
        held = texts.sparkSession.sparkContext.broadcast((mixer, seen, words))
        out = np.zeros(size, np.int64)
        for r in texts.mapInArrow(_summed(held, what), "place int, c long").groupBy("place").agg(F.sum("c").alias("c")).collect():
            out[r["place"]] = r["c"]
        held.destroy()
        return out

    total = sums("last_weights", 2 * CONTEXTS + 1)
    mixer.start(total[:-1], int(total[-1]))
    mixer.calibrate(sums("sightings", 4 * len(mixer.grid)))
    return mixer


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(doc_crc() % 7 != 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored: word (bytes; the end mark is empty), c."""
    texts = training_rows(docs.select("doc_id", text_of().alias("text"))).select("text")
    return store(texts.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def fit(docs: DataFrame, counts: DataFrame, top: list[tuple[bytes, int]], ends: int) -> Mixer:
    """Count all bits of the training rows; tables of fixed size reach the driver."""
    spark = docs.sparkSession
    words = [w for w, c in top if c >= DICTIONARY_COUNT][:DICTIONARY]
    spelled = counts.mapInArrow(_spelling(frozenset(words)), "byte long, c long").groupBy("byte").agg(F.sum("c").alias("c")).collect()
    by_byte = np.zeros(256)
    for r in spelled:
        by_byte[r["byte"]] = r["c"]
    known = dict(top)
    tokens = sum(known.values())
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (tokens // 8).bit_length()))
    coder = Coder(words, np.concatenate([by_byte, [ends], [known[w] for w in words]]), slots)
    texts = training_rows(docs.select("doc_id", text_of().alias("text"))).select("text")
    tables = texts.mapInArrow(_count_bits(spark.sparkContext.broadcast((coder, words))), "context int, block int, counts binary") \
        .groupBy("context", "block").applyInArrow(_sum_blocks, "context int, block int, counts binary").collect()
    seen = [np.zeros(2 * n, np.float32) for n in (coder.n, coder.slots, coder.slots)]
    for r in tables:
        a = r["block"] << 15
        part = np.frombuffer(r["counts"], np.float32)
        seen[r["context"]][a:a + len(part)] = part
    return learn(Mixer(coder, seen), seen, words, texts)


def _score(held, top_held):
    def run(batches):
        import pyarrow as pa
        from collections import Counter
        mixer, (top, logs, end_log) = held.value, top_held.value
        numbers = Numbers(top)
        logs = np.append(logs, 0.0)                                    # the last for words beyond the table
        with np.errstate(over="ignore"):
            for table in grouped_by_bytes(batches, "text", CHUNK):
                words, ids = numbers(table.column("text").to_pylist())
                bits = mixer.score(words, ids)
                n, known, base, size, rare, at = [], [], [], [], [], 0
                for ws in words:
                    mine = ids[at:at + len(ws)]
                    at += len(ws)
                    beyond = np.flatnonzero(mine < 0).tolist()
                    n.append(len(ws) + 1)
                    known.append(len(ws) - len(beyond) + (end_log > 0))
                    base.append(float(logs[mine].sum()) + end_log)
                    size.append(sum(map(len, ws)) + len(ws))
                    rare.append(list(Counter(ws[i] for i in beyond).items()))
                kind = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [table.column("doc_id").combine_chunks(), table.column("rk").combine_chunks(), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(bits, pa.float64()), pa.array(size, pa.int64()),
                     pa.array([[{"word": w, "tf": c} for w, c in r] for r in rare], kind)],
                    names=["doc_id", "rk", "n_tokens", "known", "base", "bits", "n_bytes", "rare"])
    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """The digest of op9, with the bits per byte of the folded text."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = word_counts(docs)
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, n_kinds = total["n"] or 0, total["v"]
    # the most frequent words: all above the least count that leaves at most TOP of them
    short = counts.where(F.length("word").between(1, WORD_BYTES))
    kinds, least = 0, 1
    for r in short.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():
        if kinds + r["k"] > TOP:
            break
        kinds, least = kinds + r["k"], r["c"]
    top = sorted(((bytes(r["word"]), r["c"]) for r in short.where(F.col("c") >= least).collect()) if kinds else [], key=lambda x: (-x[1], x[0]))
    ends = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    mixer = spark.sparkContext.broadcast(fit(docs, counts, top, ends))
    logs = spark.sparkContext.broadcast(([w for w, _ in top], np.log10(np.array([c + 1.0 for _, c in top])), float(np.log10(ends + 1))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", row_hash("doc_id", "text", seed=9).alias("rk"), text_of().alias("text"))
    scored = store(texts.mapInArrow(_score(mixer, logs), f"doc_id {kind}, rk long, n_tokens long, known long, base double, bits double, n_bytes long, "
                                                         "rare array<struct<word:binary,tf:bigint>>"), "mixed")
    rare = scored.where(F.size("rare") > 0).dropDuplicates(["rk"]).select("rk", F.explode("rare").alias("r")).select("rk", "r.word", "r.tf")
    found = rare.join(counts, "word").groupBy("rk").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("logs"))
    out = scored.drop("rare").join(found, "rk", "left")
    each = float(np.log10(n_all + n_kinds + 1))
    return out.select(
        "doc_id", (doc_crc() % 7 == 2).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"))
