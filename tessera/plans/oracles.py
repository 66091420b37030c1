"""DuckDB SQL that recomputes the same results independently (oracle side).

Built as named CTEs; each query picks the CTEs it needs. The pre-tokenizer
uses the RE2-safe pattern (no look-ahead, ASCII ``\\s``); fixture text has no
runs of spaces or Unicode spaces, where the two patterns agree."""

from __future__ import annotations

from tessera.config import Params, SPECIAL_TOKENS

# RE2 form of the pre-tokenizer pattern (fixed value; see config.PRETOKENIZE_PATTERN).
RE2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def md5_int_sql(expr: str, digits: int = 7) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, {digits}))::BIGINT"


def split_sql(expr: str = "doc_id") -> str:
    b = f"({md5_int_sql(expr)} % 10)"
    return f"CASE {b} WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END"


def ctes(p: Params = Params()) -> dict[str, str]:
    L, B, eos = p.context_length, p.block_size, p.eos_id
    n_spec = len(p.special_tokens)
    specials = ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(SPECIAL_TOKENS))
    a, aV = float(p.alpha), float(p.alpha) * p.n_ids
    return {
        "docs": f"SELECT doc_id, text, {split_sql()} AS split FROM documents",
        "lines": ("SELECT split, doc_id, unnest(generate_series(0, len(parts) - 1)) AS line_no, "
                  "unnest(parts) AS text FROM (SELECT split, doc_id, string_split(text, chr(10)) AS parts FROM docs)"),
        "lw": (f"SELECT split, doc_id, line_no, text, regexp_extract_all(text, {_q(RE2_PATTERN)}) AS words, "
               f"(least(len(regexp_extract_all(text, {_q(RE2_PATTERN)})), {L}) + 1)::INT AS len FROM lines"),
        "wc": ("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(words) AS word FROM lw WHERE split = 'train') "
               "GROUP BY word"),
        "vocab": (f"SELECT token_id::INT AS token_id, token FROM (VALUES {specials}) s(token_id, token) UNION ALL "
                  f"SELECT (rk + {n_spec - 1})::INT AS token_id, word AS token FROM "
                  f"(SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rk FROM wc WHERE n >= {p.min_frequency}) "
                  f"WHERE rk <= {p.vocab_size - n_spec}"),
        "offs": ("SELECT *, coalesce(sum(len) OVER (PARTITION BY split ORDER BY doc_id, line_no "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start FROM lw"),
        "totals": "SELECT split, sum(len)::BIGINT AS n_total FROM lw GROUP BY split",
        "tw": ("SELECT split, doc_id, line_no, line_start, unnest(generate_series(0, len(tw) - 1)) AS i, "
               f"unnest(tw) AS word FROM (SELECT *, list_concat(words[1:{L}], [NULL::VARCHAR]) AS tw FROM offs)"),
        "tokens": (f"SELECT tw.split, tw.doc_id, tw.line_no, tw.i::INT AS i, "
                   f"(CASE WHEN tw.word IS NULL THEN {eos} ELSE coalesce(v.token_id, 3) END)::INT AS token_id, "
                   "(tw.line_start + tw.i)::BIGINT AS pos FROM tw LEFT JOIN vocab v ON v.token = tw.word"),
        "btok": (f"SELECT t.split, t.pos, t.token_id, (t.pos // {B})::BIGINT AS block_id FROM tokens t "
                 f"JOIN totals USING (split) WHERE (t.pos // {B}) * {B} < n_total - {B}"
                 if p.drop_rule == "reference" else
                 f"SELECT t.split, t.pos, t.token_id, (t.pos // {B})::BIGINT AS block_id FROM tokens t "
                 f"JOIN totals USING (split) WHERE (t.pos // {B}) * {B} + {B} <= n_total"),
        "blocks": "SELECT split, block_id, list(token_id ORDER BY pos) AS tokens FROM btok GROUP BY split, block_id",
        "pairs": (f"SELECT * FROM (SELECT split, block_id, pos - block_id * {B} AS t, token_id AS prev, "
                  "lead(token_id) OVER (PARTITION BY split, block_id ORDER BY pos) AS next FROM btok) "
                  "WHERE next IS NOT NULL"),
        "bigrams": "SELECT prev, next, count(*)::BIGINT AS c FROM pairs WHERE split = 'train' GROUP BY prev, next",
        "contexts": "SELECT prev, sum(c)::BIGINT AS c_total FROM bigrams GROUP BY prev",
        "ep": ("SELECT p.split, p.block_id, "
               f"-ln((coalesce(b.c, 0)::DOUBLE + {a}) / (coalesce(x.c_total, 0)::DOUBLE + {aV})) AS nll "
               "FROM pairs p LEFT JOIN bigrams b ON b.prev = p.prev AND b.next = p.next "
               "LEFT JOIN contexts x ON x.prev = p.prev WHERE p.split IN ('val', 'test')"),
        "per_block": ("SELECT split, block_id, sum(nll) AS nll_sum, count(*)::BIGINT AS n_pred, "
                      "sum(nll) / count(*) AS loss FROM ep GROUP BY split, block_id"),
        "per_batch": (f"SELECT split, block_id // {p.eval_batch_size} AS batch_id, avg(loss) AS batch_loss, "
                      "sum(nll_sum) AS nll_sum, sum(n_pred)::BIGINT AS n_pred, count(*)::BIGINT AS n_blocks "
                      "FROM per_block GROUP BY 1, 2"),
        "summary": ("SELECT split, avg(batch_loss) AS loss, sum(nll_sum) / sum(n_pred) AS token_loss, "
                    "count(*)::BIGINT AS n_batches, sum(n_blocks)::BIGINT AS n_blocks, "
                    "exp(avg(batch_loss)) AS perplexity FROM per_batch GROUP BY split"),
    }


ORDER = ["docs", "lines", "lw", "wc", "vocab", "offs", "totals", "tw", "tokens", "btok", "blocks", "pairs",
         "bigrams", "contexts", "ep", "per_block", "per_batch", "summary"]


def with_ctes(body: str, needed: list[str], p: Params = Params(), extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding every CTE up to the last one named in ``needed``
    (CTEs only reference earlier ones), then ``body``."""
    c = ctes(p)
    last = max(ORDER.index(n) for n in needed)
    parts = [f"{n} AS ({c[n]})" for n in ORDER[: last + 1]]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(parts) + "\n" + body
