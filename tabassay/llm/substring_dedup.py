"""Substring dedup: every word inside a repeated passage of at least `size` words goes, by seed and extend."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from tabassay.llm._repeats import Shape, covered, repeated, rewrite

#: Words of a window, and of the grams from which anchors are chosen.
SIZE, GRAM = 35, 5


def _clean(batches: Iterable[pa.RecordBatch], size: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = (text or "").encode().split()
            kept = parts
            if marks:
                gone = covered(len(parts), marks, size)
                kept = [w for w, g in zip(parts, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            out.append((len(parts), len(parts) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode()))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(2), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])


def dedup(documents: DataFrame, size: int = SIZE, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_words, n_removed, kept (or its kept_sha256).

    Words are runs outside ASCII white space, unchanged. A word goes if it lies in a window of
    `size` words whose words also start anywhere else, the same text included; windows are judged
    on the input. Null, empty and shorter texts lose nothing. A repeated row is one more occurrence
    of its text, so both lose their windows. Hashes of 128 bits in all (anchor and window) stand for words.
    """
    marks = repeated(documents, Shape("words", size, gram), keep_first=False)
    name = "kept_sha256" if digest else "kept"
    return rewrite(documents, marks, partial(_clean, size=size, digest=digest), ["doc_id"], f"doc_id long, n_words long, n_removed long, {name} string")
