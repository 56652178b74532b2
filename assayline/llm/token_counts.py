"""Token counts with a public tokenizer: batch encoding that returns lengths only.

Texts are encoded inside Arrow functions. Long texts are split where no token can span the
split, the pieces of many texts are encoded in batches of about equal bytes, and only the
number of tokens leaves the function. There is no shuffle.

Null texts count as empty, an empty text has no tokens, repeated rows are counted each, and
further columns are passed through or dropped by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 16 << 10
BATCH_BYTES = 256 << 10
LIMIT = 4096


def pieces(text: str, size: int) -> list[str]:
    """Parts of a text whose sentencepiece token counts add up to that of the whole.

    A part ends before a single space that stands between two characters other than spaces.
    No piece of the vocabulary has a space after another character (``load`` checks it), so
    no merge crosses that place; the dummy prefix of the next part stands for the space.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while 0 < at < len(text) - 1 and not (
            text[at] == " " and text[at - 1] not in " ▁" and text[at + 1] not in " ▁"
        ):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at + 1
    out.append(text[start:])
    return out


def load(path: str):
    """An encoder ``texts -> lengths`` and its splitter, for .model and .json files."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        safe = not any("▁" in p.lstrip("▁") for p in vocabulary)
        return (
            lambda texts: [len(x) for x in model.encode(texts, num_threads=1)],
            pieces if safe else lambda text, size: [text],
        )
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (
        lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)],
        lambda text, size: [text],
    )


def counts(texts: list[str], encode, split, piece: int = PIECE_BYTES, batch: int = BATCH_BYTES) -> list[int]:
    """Tokens per text, encoded in batches of about ``batch`` bytes."""
    total = [0] * len(texts)
    held, owners, size = [], [], 0

    def flush():
        for owner, n in zip(owners, encode(held), strict=True):
            total[owner] += n
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in split(text, piece):
            held.append(part)
            owners.append(i)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch:
                flush()
                size = 0
    if held:
        flush()
    return total


def count_tokens(
    docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``path`` is the tokenizer file as the executors see it: ``.model`` is read by
    sentencepiece, ``.json`` by tokenizers. No special tokens are added.
    """
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = source.select(*keep).schema.add("n_tokens", "long").add("n_bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split = load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array(counts(texts, encode, split), pa.int64()))
            columns.append(pa.array([len(x.encode()) for x in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "n_bytes"])

    return source.mapInArrow(run, schema).select(
        *keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
