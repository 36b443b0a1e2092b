"""Token counts: exact lengths of whole texts under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, only, steps, text_buffers
from .encoding import encoder

#: Bytes of text encoded at once.
BATCH_BYTES = 2 << 20
CONTEXT = 1024


def token_counts(docs: DataFrame, tokenizer: str, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > context) of every row of docs(doc_id, text).

    Only lengths leave the workers.  Batches hold about BATCH_BYTES of text whatever the number of rows, and a
    long text is cut at places where no token can cross (see encoding.py), so its length never matters to the
    library.  Null and empty texts: 0 tokens.  A null doc_id stays null.  Repeated rows give repeated rows; an
    empty table gives none; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for part in steps(batches, limit=BATCH_BYTES):
            n = tool.counts(part["text"])
            size = np.diff(text_buffers(part["text"])[1])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size), pa.array(n), pa.array(n > context)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
