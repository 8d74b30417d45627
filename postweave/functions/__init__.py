from postweave.functions.columns import (
    decode_label,
    display_label,
    encode_label,
    media_path,
    normalize_extension,
    seeded_hash,
    seeded_uniform,
    text_or_nan,
)
from postweave.functions.text import TOKEN_PATTERN, tokens
from postweave.functions.vectors import (
    argmax,
    array_literal,
    bind,
    cross_entropy,
    dot,
    erf,
    gelu,
    log_sum_exp,
    project,
    relu,
    softmax,
)

__all__ = [
    "TOKEN_PATTERN",
    "argmax",
    "array_literal",
    "bind",
    "cross_entropy",
    "decode_label",
    "display_label",
    "dot",
    "encode_label",
    "erf",
    "gelu",
    "log_sum_exp",
    "media_path",
    "normalize_extension",
    "project",
    "relu",
    "seeded_hash",
    "seeded_uniform",
    "softmax",
    "text_or_nan",
    "tokens",
]
