"""Token ids of the byte-level vocabulary, equal to the tokenizers library's.

The library spends most of its time on offsets that nobody asks for; the same vocabulary as ranks gives the same ids
several times faster. The special token's string is split out first, as the library does with its added tokens.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def byte_encoder(path: str):
    """A function from text to an array of uint32 ids, for a byte-level BPE file of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _check(spec, path)
    as_byte = {chr(c): b for b, c in _byte_chars().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if len(special) != 1:
        raise ValueError(f"one special token is supported, {path} has {len(special)}")
    ((mark, mark_id),) = special.items()

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if mark not in text:
            return np.array(encode(text), np.uint32)
        out: list[int] = []
        for k, part in enumerate(text.split(mark)):
            if k:
                out.append(mark_id)
            out += encode(part)
        return np.array(out, np.uint32)

    return ids


def _check(spec: dict, path: str) -> None:
    """That the file is what the ranks assume: byte-level words without a normaliser or options, merges by rising id."""
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    parts = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ids = [model["vocab"]["".join(m)] for m in parts]
    if spec["normalizer"] or spec["post_processor"] or not plain or not words or any(a >= b for a, b in zip(ids, ids[1:])):
        raise ValueError(f"{path} is no plain byte-level BPE file with merges in the order of their ids")


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)
