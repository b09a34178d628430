"""Token ids by a public byte-level BPE vocabulary, for whole batches of texts."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache
from .sentencepiece_nbest import gather

#: Public vocabulary as ranks, and its free id for the end of a document.
RANKS, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a space is followed by more white space a text isn't a row of words.
_SPACES = re.compile(r" \s")


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(ranks: dict[bytes, int]):
    cache = worker_cache("tokens")
    if "encoding" not in cache:
        import tiktoken
        cache["encoding"] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["encoding"]


def encode_texts(texts: list[str | None], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all texts in a row. A token never crosses the start of a
    word, so each distinct word of a batch is encoded once; texts with runs of
    white space are encoded whole. A null text has no ids."""
    enc = _encoding(ranks)
    texts = [t or "" for t in texts]
    plain = [bool(t) and not _SPACES.search(t) for t in texts]
    split = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.string()), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    flat, off = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    n = len(words)
    # a text's first word has no space before it: extra entries, one for each text
    lists = [enc.encode_ordinary(" " + w) for w in words]
    lists += [enc.encode_ordinary(texts[k][:texts[k].find(" ")] if p and " " in texts[k] else texts[k])
              for k, p in enumerate(plain)]
    flat[off[:-1]] = n + np.arange(len(texts))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
    all_ids, starts = gather(ids, np.concatenate(([0], np.cumsum(sizes))), flat)
    return all_ids, starts[off]
