"""Text column helpers: pre-tokenizer, byte symbols, list shaping.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen (or the JVM expression evaluator for higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.config import PRETOKENIZE_PATTERN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pretokenize(text) -> Column:
    """byte-level pre-tokens (GPT-2 pattern, Unicode-aware ``\\s``)."""
    return F.regexp_extract_all(_c(text), F.lit(PRETOKENIZE_PATTERN), 0)


def split_lines(text) -> Column:
    """One element per line; blank lines and a trailing empty line are kept."""
    return F.split(_c(text), "\n", -1)


def char_length(text) -> Column:
    """length in characters (code points)."""
    return F.length(_c(text))


def list_length(ids) -> Column:
    """number of elements of an array column."""
    return F.size(_c(ids))


def truncate(ids, n: int) -> Column:
    """Keep the first ``n`` elements."""
    return F.slice(_c(ids), 1, n)


def append_eos(ids, context_length: int, eos_id: int) -> Column:
    """truncate to ``context_length`` and then append the eos id, so the
    result has at most ``context_length + 1`` ids; an empty line gives ``[eos]``."""
    return F.concat(F.slice(_c(ids), 1, context_length), F.array(F.lit(eos_id)))


def attention_mask(ids) -> Column:
    """a mask of ones with the length of ``ids``."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def utf8_bytes(text) -> Column:
    """the UTF-8 bytes of a string as ``array<int>`` (0..255)."""
    hexed = F.hex(F.encode(_c(text), "UTF-8"))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def byte_symbol_id(b: Column, n_special: int = 5) -> Column:
    """Id of the byte-level alphabet symbol of byte ``b``.

    The 256 byte symbols are the printable bytes 33-126, 161-172, 174-255 as
    themselves and the other 68 bytes shifted to code points 256+n (n in byte
    order). Ids follow the code-point order of those symbols, after the
    special tokens."""
    printable_rank = (
        F.when(b.between(33, 126), b - 33)
        .when(b.between(161, 172), b - 161 + 94)
        .when(b.between(174, 255), b - 174 + 106)
    )
    shifted_rank = F.when(b <= 32, b).when(b <= 160, b - 94).otherwise(F.lit(67)) + 188
    return F.coalesce(printable_rank, shifted_rank) + n_special


def byte_symbol_codepoint(b: Column) -> Column:
    """Code point of the byte-level alphabet symbol of byte ``b``."""
    printable = b.between(33, 126) | b.between(161, 172) | b.between(174, 255)
    shifted = F.when(b <= 32, b).when(b <= 160, b - 94).otherwise(F.lit(67)) + 256
    return F.when(printable, b).otherwise(shifted)


def codepoint_string(cp: Column) -> Column:
    """One-character string of a BMP code point."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")


def hex_to_symbols(token_hex) -> Column:
    """Display form of a token given as the hex of its bytes (vocabulary files
    use the byte-level alphabet characters)."""
    pairs = F.regexp_extract_all(_c(token_hex), F.lit("(..)"), 1)
    return F.array_join(
        F.transform(pairs, lambda x: codepoint_string(byte_symbol_codepoint(F.conv(x, 16, 10).cast("int")))), "")


def hex_to_text(token_hex) -> Column:
    """Decode concatenated byte hex back to a UTF-8 string."""
    return F.decode(F.unhex(_c(token_hex)), "UTF-8")
