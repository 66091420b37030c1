"""The training loss as training sees it, before each update.

Batches arrive in the order of the epoch plan. A step is scored by the model as
it stands, which holds the pairs of every batch up to the last update; then its
own pairs join. So each pair needs the count ``c`` that it had reached at a point
of the plan, and each context its total ``C``: running sums by update number, as
of the updates before.

A pair costs ``ln(C + alpha V) - ln(c + alpha)``, so pairs and contexts are
followed apart: no join, and a context is summed over its pairs first. A block's
counts of both (``_entries``) are made once, dealt by pair and by context as
packed arrays, and each task replays all epochs on its share
(``_terms``): the step of a block in every epoch is a broadcast of four bytes.
No occurrence becomes a row, and none is copied for an epoch. A pair or a context
has an entry a block, so no key holds more than the blocks are many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.config import Params

PART_ENTRIES = 1 << 20   # entries that a part should have: a task holds one part at a time
HELD_ENTRIES = 1 << 21   # entries that a task holds before it deals them
SLICE = 1 << 17          # entries that are replayed together
STEPS_A_ROW = 1 << 16    # steps whose sums travel in one row


def running_before(rows: DataFrame, keys: list[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """``rows`` with ``out`` = sum of ``value`` over the rows of the same
    ``keys`` with a smaller ``order`` (a whole number from 0). Ranges of
    ``width`` order values are summed first, then each is scanned alone."""
    part = F.floor(F.col(order) / width)
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return (rows.join(sums, [*keys, "_part"])
            .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("bigint"))
            .drop("_part", "_base"))


def _plan_arrays(plan: DataFrame, epochs: int, last: int):
    """``(blocks, steps)``: the blocks of the plan in order, and the step of each
    in every epoch, 0 where it is left out. A block that an epoch holds more than
    once has further rows: ``steps`` is (times, epochs, blocks), four bytes each."""
    import numpy as np

    width = last + 1
    kind = "int" if epochs * width < 1 << 31 else "bigint"
    placed = (F.col("epoch") * F.lit(width).cast("bigint") + F.col("step")).cast(kind)
    rows = (plan.where(F.col("block_id").isNotNull()).groupBy(F.col("block_id").cast("bigint").alias("block_id"))
            .agg(F.collect_list(placed).alias("at")).toArrow().combine_chunks())
    ids, lists = rows.column("block_id").to_numpy(), rows.column("at").combine_chunks()
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    at = lists.flatten().to_numpy().astype(np.int64)
    block = np.repeat(place, lists.value_lengths().to_numpy())
    slot = at // width * len(ids) + block
    by_slot = np.argsort(slot, kind="stable")
    first = np.maximum.accumulate(np.where(np.append(True, np.diff(slot[by_slot]) != 0), np.arange(len(slot)), 0))
    time = np.arange(len(slot)) - first
    steps = np.zeros((int(time.max()) + 1, epochs, len(ids)), np.int32)
    steps.reshape(len(steps), -1)[time, slot[by_slot]] = at[by_slot] % width
    return ids[order], steps


def _entries(blocks: DataFrame, shared, parts: int) -> DataFrame:
    """``(part, kind, entries)``: how often each block holds each pair (kind 0) and
    each context (kind 1), as packed arrays of (key, block, count). Keys are dealt
    to ``parts`` parts of each kind by a hash."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, times = shared.value[0], len(shared.value[1])

        def counted(key, block):
            order = np.lexsort((key, block))
            key, block = key[order], block[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            return key[first], block[first], np.diff(np.append(first, len(key)))

        def dealt(held, kind):
            key, block, m = map(np.concatenate, zip(*held))
            part = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.int32), kind="stable")
            packed = np.empty(len(key), ENTRY)
            packed["key"], packed["block"], packed["m"] = key[order], block[order], m[order]
            part = part[order].astype(np.int32)
            ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
            starts = np.append(0, ends[:-1])
            offsets = np.append(0, ends * packed.itemsize).astype(np.int32)
            rows = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(part[starts] + kind * parts), pa.array(np.full(len(ends), kind, np.int32)), rows],
                                              names=["part", "kind", "entries"])

        held, size = ([], []), [0, 0]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                number = part.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, number), len(ids) - 1)
                lists = part.column(1)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = np.repeat(ids[at] == number, n)
                row = np.repeat(np.arange(len(n)), n)
                pair = np.flatnonzero((row[1:] == row[:-1]) & known[1:])
                if not len(pair):
                    continue
                block = at[row[pair]]
                for kind, key in enumerate((tokens[pair] << 32 | tokens[pair + 1], tokens[pair])):
                    key, of, m = counted(key, block)
                    for t in range(times):   # more than one where an epoch holds a block twice
                        held[kind].append((key, of + t * len(ids), m))
                        size[kind] += len(key)
                    if size[kind] >= HELD_ENTRIES:
                        yield dealt(held[kind], kind)
                        held[kind].clear()
                        size[kind] = 0
        for kind in (0, 1):
            if size[kind]:
                yield dealt(held[kind], kind)

    rows = blocks.select(F.col("block_id").cast("bigint"), F.col("tokens").cast("array<bigint>")).where(F.col("block_id").isNotNull())
    return rows.mapInArrow(run, "part int, kind int, entries binary")


#: A key's count in one block.
ENTRY = [("key", "<i8"), ("block", "<i4"), ("m", "<i4")]


def _replayed(group, block, m, steps, per_epoch: int, accum: int, sums, cost) -> None:
    """Add to ``sums`` (epochs, steps) what the entries cost at every step: ``cost``
    of the count that their key, of number ``group``, has reached before.

    An epoch's updates are numbered 1 to ``per_epoch``; batches left over at its
    end are taken in by the next one's first update, number ``per_epoch`` + 1 of
    their own. ``base`` has the counts of all updates up to the epoch's begin,
    ``carry`` those left over."""
    import numpy as np

    n_groups = int(group[-1]) + 1
    base, carry = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
    step_bits, m_bits = int(sums.shape[1] - 1).bit_length(), int(m.max()).bit_length()
    short = n_groups.bit_length() + step_bits + m_bits < 63
    high = group.astype(np.int64) << (step_bits + m_bits) | m if short else None
    for e in range(len(sums)):
        step = steps[e][block]
        inside = step > 0
        whole = inside.all()
        # in the order of key, then step
        if short:
            code = high | step.astype(np.int64) << m_bits
            code = np.sort(code if whole else code[inside])
            g, s, k = code >> (step_bits + m_bits), code >> m_bits & ((1 << step_bits) - 1), code & ((1 << m_bits) - 1)
        else:
            at = np.flatnonzero(inside)
            at = at[np.lexsort((step[at], group[at]))]
            g, s, k = group[at].astype(np.int64), step[at].astype(np.int64), m[at].astype(np.int64)
        if not len(g):
            continue
        u = (s + (accum - 1)) // accum
        new_group = np.append(True, g[1:] != g[:-1])
        new_update = new_group.copy()
        new_update[1:] |= u[1:] != u[:-1]
        before = np.cumsum(k) - k
        begins, groups = np.flatnonzero(new_update), np.flatnonzero(new_group)
        run = np.diff(np.append(begins, len(g)))
        of = np.diff(np.append(groups, len(g)))
        first = g[groups]
        c = np.repeat(before[begins], run) - np.repeat(before[groups] - base[first], of)
        if carry.any():
            c += np.where(u > 1, carry[g], 0)
        sums[e] += np.bincount(s, k * cost(c), minlength=sums.shape[1])
        if per_epoch:
            left = u > per_epoch
            base += carry
            base[first] += np.add.reduceat(k, groups)
            carry[:] = 0
            if left.any():
                carry += np.bincount(g[left], k[left], minlength=n_groups).astype(np.int64)
                base -= carry


def _terms(entries: DataFrame, shared, tasks: int, last: int, params: Params) -> DataFrame:
    """``(epoch, at, sums)``: what all pairs and contexts cost in the steps from
    ``at`` on, summed over a task's parts."""
    accum = params.grad_accum_steps
    alpha, smoothing = float(params.alpha), float(params.alpha * params.n_ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        steps = shared.value[1]
        steps = np.concatenate(list(steps), 1) if len(steps) > 1 else steps[0]
        sums = np.zeros((len(steps), last + 1))

        def replay(held, kind):
            x = np.frombuffer(b"".join(held), ENTRY)
            order = np.argsort(x["key"], kind="stable")
            key, block, m = x["key"][order], x["block"][order], x["m"][order].astype(np.int64)
            number = np.cumsum(np.append(False, key[1:] != key[:-1]))
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            del x, key, order
            at = 0
            while at < len(number):      # whole keys: about SLICE entries, or one key
                i = np.searchsorted(begins, at + SLICE, "right") - 1
                end = int(begins[i]) if begins[i] > at else int(begins[i + 1]) if i + 1 < len(begins) else len(number)
                end = len(number) if len(number) - at <= SLICE else end
                _replayed(number[at:end] - number[at], block[at:end], m[at:end], steps, last // accum, accum, sums,
                          (lambda c: np.log(c + smoothing)) if kind else (lambda c: -np.log(c + alpha)))
                at = end

        now, kind, held = None, 0, []
        for b in batches:
            for part, of, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now and held:
                    replay(held, kind)
                    held = []
                now, kind = part, of
                held.append(data.as_buffer().to_pybytes())
        if held:
            replay(held, kind)
        for e in range(len(sums)):
            if not sums[e].any():
                continue
            for at in range(0, last + 1, STEPS_A_ROW):
                yield pa.RecordBatch.from_arrays([pa.array([e], pa.int32()), pa.array([at], pa.int64()), pa.array([sums[e, at:at + STEPS_A_ROW]], pa.list_(pa.float64()))],
                                                 names=["epoch", "at", "sums"])

    return (entries.repartition(tasks, "part").sortWithinPartitions("part")
            .mapInArrow(run, "epoch int, at long, sums array<double>"))


def _summed(key, rows):
    """One row a step: the sums of all tasks, added up."""
    import numpy as np
    import pyarrow as pa

    total = sum(np.asarray(x.values) for x in rows.column("sums").combine_chunks())
    at = np.arange(len(total)) + key[1].as_py()
    return pa.table({"epoch": pa.array(np.full(len(at), key[0].as_py(), np.int32)), "step": pa.array(at), "nll": pa.array(total)})


def training_steps(blocks: DataFrame, plan: DataFrame, params: Params = Params(), split: str = "train") -> DataFrame:
    """``(epoch, step, loss)``: the mean loss of every step's batch under the
    counts of all updates before it. An update takes in ``grad_accum_steps``
    batches; those left over at an epoch's end go into the next one's first."""
    spark = plan.sparkSession
    last = plan.where(F.col("epoch") == 0).agg(F.max("step")).first()[0]
    if last is None:
        return spark.createDataFrame([], "epoch int, step bigint, loss double")
    epochs, last = (int(x) for x in plan.agg(F.max("epoch") + 1, F.max("step")).first())
    blocks = blocks.where(F.col("split") == split)
    sizes = blocks.select("block_id", F.greatest(F.size("tokens") - 1, F.lit(0)).alias("n_pred"))
    shared = spark.sparkContext.broadcast(_plan_arrays(plan, epochs, last))
    most = sizes.agg(F.sum("n_pred")).first()[0] or 0
    tasks = 2 * spark.sparkContext.defaultParallelism
    parts = max(8 * tasks, -(-most // PART_ENTRIES))
    terms = _terms(_entries(blocks, shared, parts), shared, tasks, last, params)
    nll = terms.groupBy("epoch", "at").applyInArrow(_summed, "epoch int, step long, nll double")
    n_pred = (plan.select("epoch", "step", "block_id").join(sizes, "block_id").groupBy("epoch", "step")
              .agg(F.sum("n_pred").alias("n_pred")).where(F.col("n_pred") > 0))
    return nll.join(n_pred, ["epoch", "step"]).select("epoch", F.col("step").cast("bigint").alias("step"), (F.col("nll") / F.col("n_pred")).alias("loss"))


def training_loss(steps: DataFrame) -> DataFrame:
    """A8 + A9: per epoch the mean over the steps' losses, and its perplexity."""
    return (steps.groupBy("epoch").agg(F.count(F.lit(1)).cast("bigint").alias("n_steps"), F.avg("loss").alias("loss"))
            .withColumn("perplexity", F.exp("loss")))
