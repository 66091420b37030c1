"""F4 on Arrow batches: the pre-tokens of :func:`tessera.functions.text.pretokenize`
by array operations over all characters of a batch.

What is a letter, a number or a space is asked of Spark's own expressions once per
code point, so both forms agree on every character."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession, functions as F

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)   # BLANK: white space but for U+0020
CODE_POINTS = 0x110000


@cache
def _class_table() -> bytes:
    spark = SparkSession.getActiveSession()
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    kind = (F.when(F.col("id") == 32, SPACE).when(char.rlike(r"(?U)^\s$"), BLANK).when(char.rlike(r"^\p{L}$"), LETTER)
            .when(char.rlike(r"^\p{N}$"), NUMBER).otherwise(OTHER).cast("byte"))
    no_surrogate = ~F.col("id").between(0xD800, 0xDFFF)
    return _placed(spark.range(CODE_POINTS).where(no_surrogate).select("id", kind.alias("kind")).toArrow())


def _placed(rows) -> bytes:
    import numpy as np
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    table[rows.column("id").to_numpy()] = rows.column("kind").to_numpy()
    return table.tobytes()


def shared_classes(spark: SparkSession):
    """A broadcast of one byte per code point, its class."""
    return spark.sparkContext.broadcast(_class_table())


def pretokens(texts, classes: bytes):
    """``(words, sizes)``: the pre-tokens of all texts of an Arrow string array
    without nulls one after the other, and how many each text has."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[:at[-1]] if data is not None else np.zeros(0, np.uint8)
    table = np.frombuffer(classes, np.uint8)
    base = int(at[0])
    raw = raw[base:]
    if raw.size and raw.max() >= 128:
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        char = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = np.searchsorted(place, at[:-1] - base)
        place = place + base
    else:
        char, begin, place = raw, at[:-1] - base, np.arange(base, base + len(raw))
    n = len(char)
    kind = table[char]
    first = np.zeros(n + 1, bool)          # of a text; the end counts as one
    first[begin] = True
    first[n] = True
    white = kind >= BLANK
    start = first.copy()
    # a run of one class starts a token, unless a space before it does
    start[1:n] |= np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
    # the last of several white characters goes its own way if something follows
    start[1:n] |= white[1:] & white[:-1] & np.append(~white[2:] & ~first[2:n], False)[:max(n - 1, 0)]
    # 's 't 'm 'd 're 've 'll, where a token starts at the apostrophe
    mark = np.flatnonzero((char == 39) & start[:n])
    if len(mark):
        c = np.append(char, np.zeros(3, char.dtype))
        shut = np.append(first, np.ones(2, bool))
        a, b = c[mark + 1], c[mark + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & ~shut[mark + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~shut[mark + 1] & ~shut[mark + 2]
        start[mark[one | two] + 1] = False
        start[mark[one] + 2] = True
        start[mark[two] + 3] = True
    tokens = np.flatnonzero(start[:n])
    ends = np.append(place[tokens], at[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(tokens), [None, pa.py_buffer(ends), data])
    bound = np.searchsorted(tokens, np.append(begin, n))
    return words, np.diff(bound)
