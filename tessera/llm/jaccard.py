"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - J).

All pairs of documents whose sets of five-word shingles have a similarity of
0.8 or more are found exactly:

1. Equal sets are one class. Shingles are 63-bit hashes.
2. A class can have a partner only if at most a fifth of its shingles occur in
   no other class. That is tested on the shingles whose hash lies below a fixed
   bound (``RATE`` of all); most classes end here. Tasks combine their own
   documents first, so a shingle that a third of all documents share sends one
   row per task chunk.
3. Pivots: the shingles have one order for all sets: first those below the
   bound, rare ones before frequent ones, then the others by hash. In each group
   of classes that share one of the first n/5 + 1 shingles (partners always
   do), the class of least seeded hash is the pivot. A class belongs to the
   regions of all pivots of its groups, so partners always meet in a region. A
   region all of whose classes also lie in the region of one earlier pivot is
   left out (looked for among the ``LEAST`` first pivots of each class).
4. A region of more than ``REGION`` classes is cut into rings of width 0.2 by
   distance to its pivot; by the triangle inequality partners lie in the same
   or in neighbouring rings, so each class is replicated to the next ring only.
   A ring that is still larger is cut into block pairs.
5. Inside a task, regions split again into Voronoi cells of a few pivots; a
   class is replicated to each cell whose pivot is at most 2 * 0.2 farther than
   its own. Cells recurse until they are small or no longer shrink, then exact
   intersections decide. A pair counts in the region of its least common pivot.

Tasks return per class its number of links and its parent in a spanning forest,
not the pairs; components are joined by alternating stars.

Defined results: A-Z are lower-cased and words are runs of anything but ASCII
white space; a text of 1 to 4 words is one shingle; null and empty texts have no
shingles and are linked with nothing, so their component is their own doc_id;
repeated rows are copies (linked); a null doc_id counts only if its component
has no other; long texts enter whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import grouped_by_bytes, row_hash, small_batches, store, text_of
from tessera.llm.components import components

WORDS = 5                     # words of a shingle
NUM, DEN = 80, 100            # similarity as a fraction
RADIUS = 1 - NUM / DEN        # distance of partners
RATE = 0.3                    # share of the shingle hashes that step 2 looks at
BOUND = int(RATE * 2 ** 63)
CHUNK_TOKENS = 2_000_000      # shingles that a task combines at once in step 2
LEAST = 4                     # earlier pivots of a class that may make a region superfluous
REGION = 2048                 # classes of a region that one task compares
SEND_ROWS = 2_000_000         # survivors up to this many are broadcast (8 bytes each), else joined by shuffle
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)) >> np.uint64(1)


def shingle_sets(texts, memo: _WordHash) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64, not negative) of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((h for ws in split for h in map(memo.__getitem__, ws)), np.uint64, int(lengths.sum()))
    out, at = [], 0
    n = len(words) - WORDS + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        h = h * _P + words[k:k + n]
    h = _mix(h).astype(np.int64)
    for size in lengths:
        if size >= WORDS:
            out.append(np.unique(h[at:at + size - WORDS + 1]))
        elif size:
            short = np.uint64(size)
            for w in words[at:at + size]:
                short = np.array([short * _P + w]).sum()
            out.append(_mix(np.array([short], np.uint64)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += size
    return out


def class_of(s: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def _profiles(batches):
    """row key -> class, size, shingles below the bound."""
    import pyarrow as pa
    memo = _WordHash()
    with np.errstate(over="ignore"):
        for table in grouped_by_bytes(batches, "text", 4 << 20):
            sets = shingle_sets(table.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("rk").combine_chunks(),
                 pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([int(np.searchsorted(s, BOUND)) for s in sets], pa.int64())],
                names=["doc_id", "rk", "cid", "n", "e"])


def _chunk_rows(sets: dict[int, np.ndarray]):
    """Step 2 inside a task: one row per shingle, (token, class) where one class
    of the chunk has it, (token, -1) where several have, and (-1 - class, class,
    own count) with the number of a class's shingles of the second kind."""
    import pyarrow as pa
    ids = np.fromiter(sets, np.int64, len(sets))
    tokens = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(ids)), [len(s) for s in sets.values()])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(tokens)))
    shared = size > 1
    cid = np.where(shared, -1, ids[owner[start]]) if len(start) else np.zeros(0, np.int64)
    live = np.bincount(owner[np.repeat(shared, size)], minlength=len(ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([tokens[start], -1 - ids])), pa.array(np.concatenate([cid, ids])),
         pa.array(np.concatenate([np.zeros(len(start), np.int64), live.astype(np.int64)]))], names=["token", "cid", "own"])


def _tokens(batches):
    memo, held, size = _WordHash(), {}, 0
    with np.errstate(over="ignore"):
        for table in grouped_by_bytes(batches, "text", 4 << 20):
            for s in shingle_sets(table.column("text").to_pylist(), memo):
                c = class_of(s)
                if len(s) and c not in held:
                    held[c] = s[:np.searchsorted(s, BOUND)].copy()
                    size += len(held[c])
            if size >= CHUNK_TOKENS:
                yield _chunk_rows(held)
                held, size = {}, 0
        if held:
            yield _chunk_rows(held)


def _sets(batches):
    import pyarrow as pa
    memo = _WordHash()
    with np.errstate(over="ignore"):
        for table in grouped_by_bytes(batches, "text", 4 << 20):
            sets = shingle_sets(table.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()),
                                              pa.array(sets, pa.list_(pa.int64()))], names=["cid", "tokens"])


def linked(common: int, a: int, b: int) -> bool:
    return DEN * common >= NUM * (a + b - common)


class Region:
    """Exact search among the sets of one region."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        # shingles of one member only can't be common
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        number = np.cumsum(counts > 1) - 1
        self.owner, self.token = owner[keep], number[inverse[keep]]
        self.width = int((counts > 1).sum())
        self.begin = np.searchsorted(self.owner, np.arange(len(sets) + 1))

    def common(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Intersection sizes of members ``rows`` with members ``cols``."""
        total = np.zeros((len(rows), len(cols)), np.float32)
        step = max(256, (4 << 20) // max(1, len(rows) + len(cols)))
        parts = [self._entries(rows), self._entries(cols)]
        for a in range(0, self.width, step):
            dense = []
            for (who, what), n in zip(parts, (len(rows), len(cols))):
                inside = (what >= a) & (what < a + step)
                m = np.zeros((n, min(step, self.width - a)), np.float32)
                m[who[inside], what[inside] - a] = 1
                dense.append(m)
            total += dense[0] @ dense[1].T
        return np.rint(total).astype(np.int64)

    def _entries(self, members: np.ndarray):
        n = self.begin[members + 1] - self.begin[members]
        at = np.repeat(self.begin[members] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(members)), n), self.token[at]

    def direct(self, members: np.ndarray) -> np.ndarray:
        c = self.common(members, members)
        n = self.sizes[members]
        hit = np.triu(DEN * c >= NUM * (n[:, None] + n[None, :] - c), 1)
        i, j = np.nonzero(hit)
        return np.stack([members[i], members[j]], axis=1)

    def pairs(self, members: np.ndarray, small: int = 48, cells: int = 8, depth: int = 0) -> np.ndarray:
        """All linked pairs among members, by recursive Voronoi cells."""
        if len(members) <= small or depth > 8:
            return self.direct(members)
        pivots = members[np.linspace(0, len(members) - 1, cells).astype(int)]
        c = self.common(members, pivots)
        d = 1 - c / (self.sizes[members][:, None] + self.sizes[pivots][None, :] - c)
        home = d.min(1)
        inside = d <= home[:, None] + 2 * RADIUS + 1e-9
        inside |= d == home[:, None]
        if (inside.sum(0) ** 2).sum() > 0.7 * len(members) ** 2 or inside.sum(0).max() == len(members):
            return self.direct(members)
        found = [self.pairs(members[inside[:, k]], small, cells, depth + 1) for k in range(cells) if inside[:, k].sum() > 1]
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        found.sort(axis=1)
        return np.unique(found, axis=0)


def _search(key, table):
    """One region (or ring, or block pair): links of each class and its parent."""
    import pyarrow as pa
    # repeated rows carry equal sets; the sets stay in Arrow's memory
    rows = {r["cid"]: r | {"at": n} for n, r in enumerate(table.drop_columns(["tokens"]).to_pylist())}
    ids = sorted(rows)
    pivot, _, block_i, block_j = (k.as_py() for k in key)
    lists = table.column("tokens").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    sets = [flat[(ends[rows[i]["at"] - 1] if rows[i]["at"] else 0):ends[rows[i]["at"]]] for i in ids]
    block, guest = [rows[i]["b"] for i in ids], [rows[i]["guest"] for i in ids]
    parent, links = list(range(len(ids))), [0] * len(ids)

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = Region(sets).pairs(np.arange(len(ids))) if len(ids) > 1 else []
    for i, j in found:
        a, b = rows[ids[i]], rows[ids[j]]
        if (guest[i] and guest[j]) or (block_i != block_j and block[i] == block[j]):
            continue                                           # both belong to another block pair or ring
        if min(set(a["pivots"]) & set(b["pivots"])) != pivot:
            continue                                           # counted in another region
        links[i] += b["weight"]
        links[j] += a["weight"]
        x, y = top(i), top(j)
        parent[max(x, y)] = min(x, y)
    return pa.table({"cid": pa.array(ids, pa.int64()), "up": pa.array([ids[top(i)] for i in range(len(ids))], pa.int64()),
                     "links": pa.array(links, pa.int64())})


def profiles(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, rk (row key), cid, n, e for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", row_hash("doc_id", "text", seed=3).alias("rk"), text_of().alias("text"))
    return store(base.mapInArrow(_profiles, f"doc_id {kind}, rk long, cid long, n long, e long"), "profiles")


def survivors(docs: DataFrame, prof: DataFrame) -> DataFrame:
    """Stored: classes that may have partners: cid, rk (of one row), weight, n, e."""
    rows = docs.select(text_of().alias("text")).mapInArrow(_tokens, "token long, cid long, own long")
    same = Window.partitionBy("token")
    live = rows.withColumn("live", F.when(F.col("token") < 0, F.col("own")).otherwise(
        (F.min("cid").over(same) != F.max("cid").over(same)).cast("long"))) \
        .where("(token < 0 or live > 0) and cid >= 0") \
        .groupBy("cid").agg((F.sum("live") / F.sum((F.col("token") < 0).cast("long"))).alias("live"))
    classes = prof.where("n > 0").groupBy("cid").agg(F.min("rk").alias("rk"), F.count("*").alias("weight"), F.max("n").alias("n"), F.max("e").alias("e"))
    may = classes.join(live, "cid").where(F.col("live") >= F.col("e") - F.floor(F.col("n") * (DEN - NUM) / DEN))
    return store(may.select("cid", "rk", "weight", "n", "e"), "survivors")


def members(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """Stored sets of the surviving classes: cid, tokens. Rows that repeat both
    doc_id and text repeat here; the search takes each class once."""
    few = alive.count() <= SEND_ROWS
    keys = F.broadcast(alive.select("rk")) if few else alive.select("rk")
    texts = docs.select(row_hash("doc_id", "text", seed=3).alias("rk"), text_of().alias("text")).join(keys, "rk", "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "cid long, tokens array<long>")
    return store(sets, "sets")


def regions(sets: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per region and class: cid, tokens, weight, pivots, pivot, k; and
    stored, one row per region: pivot, k."""
    before = F.size(F.filter("tokens", lambda t: t < BOUND))                  # shingles below the bound come first
    first = (F.floor(F.size("tokens") * (DEN - NUM) / DEN) + 1).cast("int")
    offers = sets.select("cid", F.explode(F.slice("tokens", 1, F.greatest(before, first))).alias("token"))
    seeded = F.struct(F.xxhash64("cid").alias("h"), F.col("cid").alias("pivot"))
    pivots = offers.groupBy("token").agg(F.min(seeded).alias("p"), F.count("*").alias("often"), F.min("cid").alias("a"), F.max("cid").alias("b")) \
        .where("a <> b").select("token", F.when(F.col("token") < BOUND, F.col("often")).otherwise(2 ** 62).alias("often"), "p.pivot")
    found = offers.join(store(pivots, "pivots"), "token").groupBy("cid").agg(F.sort_array(F.collect_set(F.struct("often", "token", "pivot"))).alias("found"))
    # shingles of one class only come first in the order; they take places but form no group
    low = F.size(F.filter("found", lambda x: x["token"] < BOUND))
    need = (F.floor(F.col("n") * (DEN - NUM) / DEN) + 1 - F.col("e") + low).cast("int")
    order = lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("pivot"))
    mine = found.join(alive.select("cid", "weight", "n", "e"), "cid").withColumn("taken", F.slice("found", 1, F.greatest(need, F.lit(0)))) \
        .select("cid", "weight", F.sort_array(F.array_distinct(F.transform("taken", lambda x: order(x["pivot"])))).alias("order"))
    mine = store(mine, "regions")
    each = mine.select("cid", "weight", F.explode("order").alias("o"), F.slice("order", 1, LEAST).alias("least"))
    size = each.groupBy("o").agg(F.count("*").alias("k")).where("k > 1")
    # a region all of whose classes meet in one of an earlier pivot has nothing to add
    shared = each.select("o", F.explode("least").alias("other")).where("other < o").groupBy("o", "other").agg(F.count("*").alias("shared"))
    covered = shared.join(size, "o").where("shared = k").select("o").distinct()
    open_ = store(size.join(covered, "o", "left_anti").select("o.pivot", "k"), "pivots")
    own = each.select("cid", "weight", "o.pivot").join(open_, "pivot").groupBy("cid") \
        .agg(F.max("weight").alias("weight"), F.collect_list(F.struct("pivot", "k")).alias("in")).withColumn("pivots", F.col("in.pivot"))
    # the set travels once to its class, then once to each of its regions
    inside = sets.join(own, "cid").select("cid", "tokens", "weight", "pivots", F.explode("in").alias("r")) \
        .select("cid", "tokens", "weight", "pivots", "r.pivot", "r.k")
    return inside, open_


def pieces(inside: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Cut large regions into rings and block pairs. ``b`` is a row's block and
    ``guest`` tells rows of the ring below: two guests don't compare, nor do rows
    of one block in a pair of different blocks."""
    cols = ["pivot", "cid", "weight", "tokens", "pivots"]
    small = inside.where(F.col("k") <= REGION).select(*cols, *[F.lit(0).alias(x) for x in ("ring", "i", "j", "b")], F.lit(False).alias("guest"))
    large = inside.where(F.col("k") > REGION)
    centre = sets.join(sizes.where(F.col("k") > REGION).select(F.col("pivot").alias("cid")), "cid", "left_semi").dropDuplicates(["cid"]) \
        .select(F.col("cid").alias("pivot"), F.col("tokens").alias("centre"))
    same = F.size(F.array_intersect("tokens", "centre"))
    d = 1 - same / (F.size("tokens") + F.size("centre") - same)
    ringed = large.join(centre, "pivot").withColumn("own", F.floor(d / RADIUS + 1e-9).cast("int")).drop("centre")
    ringed = ringed.withColumn("ring", F.explode(F.array("own", F.col("own") + 1)))          # the next ring sees them too
    # a ring without classes of its own has nothing to compare its guests with
    count = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / REGION).cast("int").alias("blocks"), F.max("own").alias("most")) \
        .where("most = ring").drop("most")
    ringed = ringed.join(count, ["pivot", "ring"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    cut = ringed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("i", F.least("b", "other")).withColumn("j", F.greatest("b", "other"))
    # a pair of guests belongs to the ring below; a pair of one block to (b, b)
    cut = cut.select(*cols, "ring", "i", "j", "b", (F.col("own") < F.col("ring")).alias("guest"))
    return small.unionByName(cut)


def link_classes(docs: DataFrame, prof: DataFrame) -> DataFrame:
    """Stored: cid, up, links, one row per class and region with a partner."""
    alive = survivors(docs, prof)
    sets = members(docs, alive)
    cut = pieces(*regions(sets, alive), sets)
    return store(cut.groupBy("pivot", "ring", "i", "j").applyInArrow(_search, "cid long, up long, links long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (other
    documents linked with it, copies included), class_id, root (class that names
    the component), rk (row key)."""
    prof = profiles(docs)
    links = link_classes(docs, prof)
    roots = components(links, "cid", "up")
    classes = prof.where("n > 0").groupBy("cid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")) \
        .join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left") \
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select("cid", "component_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = prof.join(classes, "cid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
                         F.col("cid").alias("class_id"), "root", "rk")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: the one of smallest
    doc_id stays. Rows without shingles stay."""
    marks = near_duplicates(docs)
    keep = marks.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .select(F.col("rk").alias("dedup_key"), F.coalesce("root", "rk").alias("dedup_group"), (F.col("n_shingles") == 0).alias("dedup_empty")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(row_hash("doc_id", "text", seed=3).alias("dedup_key"), whole).join(keep, "dedup_key")
    # repeated rows, and equal doc_ids inside one component: the first stays
    order = Window.partitionBy("dedup_group").orderBy("dedup_key")
    kept = rows.withColumn("at", F.row_number().over(order))
    return kept.where("dedup_empty or at = 1").select("doc.*")
