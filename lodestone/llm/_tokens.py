"""A public byte-pair vocabulary as a tokenizer in Python workers; it is never trained here."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Ranks of a byte-level vocabulary; 50256 is free and ends each document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file of more bytes isn't sent to executors.
MOST_BYTES = 64 << 20

_ENCODERS: dict[bytes, tiktoken.Encoding] = {}


def ship_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The file's bytes for all executors; its size doesn't depend on the data, and is checked."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_BYTES} are sent to executors")
    return spark.sparkContext.broadcast(data)


def encoder(data: bytes) -> tiktoken.Encoding:
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encode(e: tiktoken.Encoding, text: str) -> np.ndarray:
    """Token ids; what is no valid Unicode is replaced first."""
    try:
        return e.encode_to_numpy(text)
    except UnicodeEncodeError:
        return e.encode_to_numpy(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
