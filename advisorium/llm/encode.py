"""Encoding of a corpus with a public tokenizer, in Arrow batches, and decoding back to the exact text.

The tokenizer file's path is a parameter; the file is loaded once per Python worker. Byte-level vocabularies spell
every byte as one printable character; ``byte_table`` gives that mapping and decoding reverses it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from advisorium.session import ship_package

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts are handed to the tokenizer in slices of about so many characters, to bound a worker's memory.
SLICE_CHARS = 2_000_000


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer at ``path``, with strings that look like special tokens read as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable character of each byte, as character to byte.

    By rule: bytes that print keep their own character; the others take the characters from 256 upwards in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes | None]:
    """Bytes of each token id; None for ids that are no token."""
    t, table = load(path), byte_table()
    out: list[bytes | None] = [None] * (max(t.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, null as the empty text, in runs of bounded length; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > SLICE_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encoded(texts: list[str | None], path: str, offsets: bool = False) -> Iterator:
    """The library's encodings of the texts, one by one. Null and empty texts have no ids. Without ``offsets`` the
    library does not track where tokens lie in the text, which saves time."""
    t = load(path)
    batch = t.encode_batch if offsets else getattr(t, "encode_batch_fast", t.encode_batch)
    for run in slices(texts):
        yield from batch(run, add_special_tokens=False)


def _id_lists(batch_ids: list[list[int]]) -> pa.Array:
    return pa.array(batch_ids, pa.list_(pa.int32()))


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Token ids of every text: key, ids (array of int). Null and empty texts give an empty list, never null.

    One narrow pass: only the key and the text reach Python, no row is dropped and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists([e.ids for e in encoded(b.column(1).to_pylist(), path)])], [key, "ids"])

    ship_package(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def encode_with_offsets(df: DataFrame, key: str, text: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """As ``encode``, with the span of characters each token covers: key, ids, starts, ends.

    Offsets count code points. Tokens that share one character, because it was split between them, all carry that
    character's span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for e in encoded(b.column(1).to_pylist(), path, offsets=True):
                ids.append(e.ids)
                starts.append([o[0] for o in e.offsets])
                ends.append([o[1] for o in e.offsets])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(_id_lists, (ids, starts, ends))], [key, "ids", "starts", "ends"])

    ship_package(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = DEFAULT_TOKENIZER, carried: tuple[str, ...] = ()) -> DataFrame:
    """Number of tokens of every text: key, the ``carried`` columns, n_tokens; 0 for null and empty texts."""
    others = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([len(e) for e in encoded(b.column(b.num_columns - 1).to_pylist(), path)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], [*others, "n_tokens"])

    ship_package(df.sparkSession)
    held = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, text).mapInArrow(run, f"{held}, n_tokens bigint")


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a list of ids. A character that was split between tokens is whole again, since bytes are joined
    before they are read as UTF-8; bytes that are no whole character become the replacement character."""
    table = token_bytes(path)
    return b"".join(table[i] or b"" for i in ids).decode("utf-8", errors="replace")


def decode(df: DataFrame, key: str, ids: str = "ids", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Texts of id lists: key, text; null lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x or [], path) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    ship_package(df.sparkSession)
    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
