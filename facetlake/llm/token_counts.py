"""Tokens that the logs of capture jobs cost a language model.

A text is cut into pre-tokens by the pattern of the byte-level vocabulary. Which strings of the
vocabulary encode alone as one token is proven once, before the job, by the tokenizer itself; a
pre-token on that list counts one. Only the others go through the merges, each distinct one once
per task while a bounded memory of them lasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: How byte-level vocabularies of this family cut a text.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct merged pre-tokens that a task remembers.
REMEMBERED = 200_000


def byte_of() -> dict[str, int]:
    """The byte-level alphabet: the character that stands for each byte, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(vocabulary: str) -> frozenset[str]:
    """Strings that are proven to encode alone as exactly one token.

    At most as many as the vocabulary has entries, so the list is safe to ship to every task.
    """
    tokenizer = Tokenizer.from_file(vocabulary)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte = byte_of()
    strings = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(byte[c] for c in entry).decode())
        except (KeyError, UnicodeDecodeError):  # parts of characters never are pre-tokens
            continue
    strings = [s for s in strings if s not in special]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class _Counter:
    def __init__(self, definition: str, proven: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.proven, self.merged = proven, {}

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self.special.split(t) if self.special else [t] for t in texts]
        cut = [[self.pattern.findall(p) for p in parts] for parts in pieces]
        rest = {w for parts in cut for found in parts for w in found} - self.proven
        new = [w for w in rest if w not in self.merged]
        if len(self.merged) + len(new) > REMEMBERED:
            self.merged, new = {}, list(rest)
        self.merged |= zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True)
        # Proven pre-tokens are absent from the merged ones and count one.
        get = self.merged.get
        return [len(parts) - 1 + sum(get(w, 1) for found in parts for w in found) for parts in cut]


def log_tokens(logs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole job log, as the tokenizer of ``vocabulary`` counts them.

    Args:
        logs: ``job_id`` and ``log``; further columns are left out.
        vocabulary: path of a byte-level BPE file of the ``tokenizers`` library; read by the driver
            and sent to the tasks, so executors need no such file.
        limit: ``over_limit`` is true above so many tokens.

    Returns:
        ``job_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    No begin, end or other added tokens; special strings inside a log count as one token each, as
    the library does by default; nothing is cut off. Null logs count as empty: 0 bytes, 0 tokens.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = file.read()
    shipped = logs.sparkSession.sparkContext.broadcast((definition, whole_tokens(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counter = counter or _Counter(*shipped.value)
                texts = [t or "" for t in part.column("log").to_pylist()]
                tokens = counter.count(texts)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("job_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    ["job_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = logs.schema["job_id"].dataType.simpleString()
    return logs.select("job_id", "log").mapInArrow(run, f"job_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
