"""Run parameters. Defaults follow the constants of the workload we match."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference workload for equal results.
# Special tokens, in id order 0..4.
SPECIAL_TOKENS = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
UNK_ID = 3
# Byte-level pre-tokenizer pattern. ``(?U)`` makes Java's ``\s`` Unicode-aware.
PRETOKENIZE_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Parameter-name substrings that are excluded from weight decay.
NO_DECAY_PATTERNS = ("bias", "LayerNorm.weight")
# Split buckets of the md5 split rule: 0-7 train, 8 val, 9 test.
SPLIT_BUCKETS = 10
VAL_BUCKET = 8
TEST_BUCKET = 9


@dataclass(frozen=True)
class Params:
    vocab_size: int = 50257
    min_frequency: int = 2
    context_length: int = 1024  # truncation length of one line before eos
    block_size: int = 1024
    batch_size: int = 8
    eval_batch_size: int = 8
    grad_accum_steps: int = 2
    epochs: int = 30
    seed: int = 123
    weight_decay: float = 0.1
    log_every: int = 300
    max_grad_norm: float = 1.0
    alpha: float = 1.0  # add-alpha smoothing of the n-gram model
    top_k: int = 100
    gen_samples: int = 10
    gen_min_length: int = 30
    gen_max_length: int = 128
    gen_seed: int = 42
    prompt_min_len: int = 2
    prompt_max_len: int = 8  # exclusive upper end
    review_min_chars: int = 200  # strict ">"
    # "reference": starts 0, B, 2B, ... strictly below N - B;  "full": every full block
    drop_rule: str = "reference"
    special_tokens: tuple = field(default=SPECIAL_TOKENS)

    @property
    def eos_id(self) -> int:
        """End-of-text id: the first id after the vocabulary."""
        return self.vocab_size

    @property
    def n_ids(self) -> int:
        """Size of the id space including eos (V in the smoothing)."""
        return self.vocab_size + 1

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
