"""One registered query per operator, over whole tables."""

from __future__ import annotations

from tessera.llm.collocations import ORACLE as PHRASES_ORACLE
from tessera.llm.lines import ORACLE as LINES_ORACLE
from tessera.session import ensure_checkpoint_dir, read_table


def op1_reshard(spark, sf_dir):
    from tessera.llm.sharding import shard_documents
    ensure_checkpoint_dir(spark)
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op2_lines(spark, sf_dir):
    from tessera.llm.lines import repeated_lines
    ensure_checkpoint_dir(spark)
    return repeated_lines(read_table(spark, sf_dir, "documents"))


def op3_jaccard(spark, sf_dir):
    from tessera.llm.jaccard import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("rk", "root")


def op4_toxicity(spark, sf_dir):
    from tessera.llm.toxicity import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_perplexity(spark, sf_dir):
    from tessera.llm.perplexity import check_quality
    ensure_checkpoint_dir(spark)
    return check_quality(read_table(spark, sf_dir, "documents"))


def op6_mix(spark, sf_dir):
    from tessera.llm.mixing import mix_documents
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark, sf_dir):
    from tessera.llm.licenses import scan_licenses
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    from tessera.llm.warc import archive_pages
    return archive_pages(read_table(spark, sf_dir, "pages"))


def op9_mixing_model(spark, sf_dir):
    from tessera.llm.mixer import score_documents
    ensure_checkpoint_dir(spark)
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    from tessera.llm.decontaminate import contaminated
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def tokenizer_file(name):
    """The installed public tokenizer files; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op11_alignment(spark, sf_dir):
    from tessera.llm.alignment import link_strength
    ensure_checkpoint_dir(spark)
    return link_strength(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_pieces(spark, sf_dir):
    from tessera.llm.pieces import digests, encode_pieces
    return digests(encode_pieces(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")))


def op13_phrases(spark, sf_dir):
    from tessera.llm.collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_reshard, op2_lines, op3_jaccard, op4_toxicity, op5_perplexity, op6_mix, op7_licenses, op8_warc, op9_mixing_model, op10_decontaminate, op11_alignment, op12_pieces, op13_phrases)}
# models, tokenizer libraries, graph searches: compared with brute force in tests/llm
NO_SQL = set(QUERIES) - {"op2_lines", "op13_phrases"}
ORACLES: dict[str, str] = {"op2_lines": LINES_ORACLE, "op13_phrases": PHRASES_ORACLE}
