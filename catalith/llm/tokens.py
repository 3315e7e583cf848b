"""Token counts of a public tokenizer, and a coordinate of each text's content.

The vocabulary is a rank file at a path that is a parameter; workers read it once each. Texts are encoded whole, in
Arrow batches, and only counts and coordinates leave the Python workers, never the texts. Special tokens have no
meaning inside a text. Defined cases: null counts as empty, and an empty text has no token.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import spread

#: Rank file of the default tokenizer, and the published pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AXES = 3


@functools.lru_cache(maxsize=2)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@functools.lru_cache(maxsize=2)
def directions(size: int, axes: int = AXES) -> np.ndarray:
    """A fixed random direction per token id: what a hashed bag of tokens is projected on."""
    return np.random.default_rng(8).standard_normal((size, axes)).astype(np.float32)


def encode(text: str, ranks: str = RANKS) -> list[int]:
    """The token ids of a whole text. The library's own splitter runs out of stack on very long runs of white space; such a text
    is split by the same pattern here and merged piece by piece, with the same ids."""
    enc = encoding(ranks)
    try:
        return enc.encode_ordinary(text)
    except (KeyboardInterrupt, SystemExit, MemoryError):
        raise
    except BaseException:  # noqa: BLE001 - the library panics with a class of its own
        import regex

        return [t for m in regex.finditer(PATTERN, text) for t in enc._encode_single_piece(m.group())]


def counted(documents: DataFrame, keep: list[str], ranks: str = RANKS, coordinates: bool = False) -> DataFrame:
    """The columns ``keep`` with n_tokens and the SHA-256 of the text (text_key), and with ``coordinates`` x0, x1, x2: the
    text's tokens, weighted down if they are frequent in it, projected on :data:`AXES` fixed random directions."""
    axes = [f"x{i}" for i in range(AXES)] if coordinates else []
    slim = documents.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__text"))
    schema = slim.drop("__text").schema
    for name, kind in [("n_tokens", "long"), ("text_key", "binary"), *((a, "float") for a in axes)]:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        table = directions(enc.n_vocab) if coordinates else None
        for batch in batches:
            sizes, keys, points = [], [], []
            for text in batch.column(len(keep)).to_pylist():
                ids = encode(text, ranks)
                sizes.append(len(ids))
                keys.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
                if table is not None:
                    own, times = np.unique(np.asarray(ids, np.int64), return_counts=True) if ids else (np.zeros(0, np.int64), np.zeros(0))
                    weight = np.sqrt(times)
                    points.append((weight @ table[own]) / max(float(np.sqrt((weight**2).sum())), 1e-9) if len(own) else np.zeros(AXES, np.float32))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            if table is not None:
                matrix = np.asarray(points, np.float32).reshape(-1, AXES)
                columns += [pa.array(matrix[:, i]) for i in range(AXES)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(slim).mapInArrow(run, schema)
