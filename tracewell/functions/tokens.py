"""Tokenizers as column expressions: words for ranking, bytes for training."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, BOS, EOS, SEP, OFFSET, VOCAB = 0, 1, 2, 3, 4, 260


def fingerprint() -> str:
    """SHA-256 of what the byte tokenizer is: its kind, its version and its special ids; fixed names."""
    value = {"type": "utf8-byte", "schema_version": 1, "special_tokens": {"pad": PAD, "bos": BOS, "eos": EOS, "separator": SEP}}
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def words(text: Column) -> Column:
    """Case-folded runs of letters, digits and underscores. lower() leaves the sharp s, so it is spelled out."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def byte_tokens(text: Column) -> Column:
    """Each UTF-8 byte plus 4."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), 0)
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int") + OFFSET)


def sft_length(prompt: Column, completion: Column) -> Column:
    """Tokens of BOS prompt SEP completion EOS."""
    return (F.octet_length(prompt) + F.octet_length(completion) + 3).cast("long")


def sft_tokens(prompt: Column, completion: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), byte_tokens(prompt), F.array(F.lit(SEP)), byte_tokens(completion), F.array(F.lit(EOS)))


def sft_weights(prompt: Column, completion: Column, weight: Column | None = None) -> Column:
    """Loss weights: none for BOS, prompt and SEP; the sample weight for completion and EOS."""
    one = F.lit(1.0) if weight is None else weight.cast("double")
    return F.concat(F.array_repeat(F.lit(0.0), (F.octet_length(prompt) + 2).cast("int")), F.array_repeat(one, (F.octet_length(completion) + 1).cast("int")))


def left_truncate(tokens: Column, most: int) -> Column:
    """The first token and the last most - 1, where there are more than most."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, 1), F.slice(tokens, -(most - 1), most - 1))).otherwise(tokens)


def truncated_count(length: Column, most: int) -> Column:
    return F.greatest(length - most, F.lit(0)).cast("long")
