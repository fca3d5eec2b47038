"""Token counts by finite-state transducers compiled from a tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import machine
from tessera.llm.common import lean, slices


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens) for each row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE .json file, the same on every
    executor.  The counts are those of its library without added begin or end
    tokens; a special string inside a text is one token.  Per batch, chunk state
    maps of the splitter compose through a parallel prefix scan and the counter
    transducer emits each piece's tokens (see ``bpe``).  One narrow pass, no
    shuffle; memory is a few MB of text and bounded tables.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; a null id is returned as such; other columns are not read, whatever
    their names; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            pieces, each = m.split(texts)
            tokens = np.fromiter(map(m.counts.__getitem__, pieces), np.int64, len(pieces))
            total = np.concatenate([[0], np.cumsum(tokens)])
            edge = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
            n_tokens = total[edge[1:]] - total[edge[:-1]]
            yield pa.record_batch([batch.column("_id"), batch.column("_bytes"), pa.array(n_tokens)], names=["_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_bytes"))
    kind = docs.schema[id_column].dataType.simpleString()
    return read.mapInArrow(lean(count, tokenizer), f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_column)
