"""Line dedup: runs of lines that stood earlier in the corpus are deleted, by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm._repeats import Shape, covered, repeated, rewrite

#: Consecutive lines that make a run (each line is a gram of its own), and words from which a single line does.
MIN_LINES, LONG_WORDS = 3, 8


def _clean(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = [] if text is None else text.split("\n")
            kept = parts
            if marks:
                kept = [x for x, g in zip(parts, covered(len(parts), marks, size).tolist(), strict=True) if not g]
            texts.append(None if text is None else "\n".join(kept))
            counts.append(len(parts))
            removed.append(len(parts) - len(kept))
        names = [*(f"_c{i}" for i in range(batch.num_columns - 2)), "text", "n_lines", "n_removed"]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=names)


def dedup(documents: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """documents (doc_id, text and any other columns) with later repeated runs cut out of text, and n_lines, n_removed.

    Lines are the parts between line feeds, compared exactly. A window is min_lines consecutive
    lines, or one line of at least long_words words (0: no line is one by itself). It is a repeat
    if the same lines start earlier in the order of doc_id and position; every line inside a repeat
    goes, so the first occurrence in the corpus stays whole. Null texts stay
    null and have no lines, an empty text is one empty line. Rows of one doc_id and one text are
    the same document and are cut alike; a null doc_id comes before all others. An empty table
    gives an empty one; very long texts are read whole. Columns of the input named n_lines or
    n_removed are replaced, all others pass through.
    """
    others = [c for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    marks = repeated(documents, Shape("lines", min_lines, 1, long_words), keep_first=True)
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"_c{i} {kinds[c]}" for i, c in enumerate(others)), "text string, n_lines long, n_removed long"])
    out = rewrite(documents, marks, partial(_clean, size=min_lines), others, schema)
    named = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(others)}
    return out.select(*[named.get(c, F.col(c)) for c in documents.columns if c in named or c == "text"], "n_lines", "n_removed")
