"""Exact repeated windows of words or lines, by winnowed anchors that are extended both ways.

A window is `size` consecutive units of one text. Its anchor is the least hash of the runs of
`gram` units inside it; equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a text is a short list of runs of windows with one anchor. Only anchors that occur
twice are seeds. A seed's occurrences are extended over the whole span that its windows cover:
where the spans are equal, every window repeats; where they differ, the windows of each different
span are compared one by one, once for all of its occurrences. Nothing is compared in pairs, and
the number of rows follows the number of seeds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm import _text
from tabassay.llm._shared import batched, discard, table
from tabassay.llm._text import U64, column_bytes, mix, prefix_sums, slices, span_hashes

_RUNS = "doc_id long, t long, ah long, rh long, pos int, n int, self boolean"
_WINDOWS = "ah long, rh long, c long, o int, wh long"
_PLACE = ", doc_id long, t long, pos int"


@dataclass(frozen=True)
class Shape:
    """Units ('words' or 'lines'), units in a window, units in a gram that can be an anchor, and words from which a line is a window by itself (0: none is)."""

    unit: str
    size: int
    gram: int
    long: int = 0

    def units(self, data: np.ndarray, offsets: np.ndarray) -> _text.Units:
        return (_text.words if self.unit == "words" else _text.lines)(data, offsets)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for each i; positions beyond the end do not count."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step >= len(out):
            break  # no text is as long as a window
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(units: _text.Units, shape: Shape) -> dict[str, np.ndarray]:
    """Maximal runs of neighbouring windows with one anchor: row, ah, rh (hash of the span), pos, n, self (a window may repeat inside).

    A long line is a run by itself, with n = 0.
    """
    hashes = units.hashes()
    if shape.long:
        found, alone = runs(units, Shape(shape.unit, shape.size, shape.gram)), long_lines(units, shape.long)
        key = mix(hashes[alone] ^ U64(0x5851F42D4C957F2D)).view(np.int64)
        row = units.row[alone]
        own = {"row": row, "ah": key, "rh": key, "pos": alone - units.first[row], "n": np.zeros(len(alone), np.int64), "self": np.zeros(len(alone), bool)}
        return {k: np.concatenate([found[k], own[k]]) for k in found}
    sums, index = prefix_sums(hashes), np.arange(len(hashes))
    end = units.first[units.row + 1]
    grams = np.full(len(hashes), np.iinfo(np.uint64).max, U64)
    whole = np.flatnonzero(index + shape.gram <= end)
    grams[whole] = span_hashes(sums, whole, whole + shape.gram)
    starts = np.flatnonzero(index + shape.size <= end)
    anchors = _least(grams, shape.size - shape.gram + 1)[starts]
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "ah", "rh", "pos", "n", "self")}
    new = np.r_[True, (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1) | (units.row[starts[1:]] != units.row[starts[:-1]])]
    heads = np.flatnonzero(new)
    n = np.diff(np.r_[heads, len(starts)])
    first = starts[heads]
    run = np.cumsum(new) - 1
    seen = np.sort((run.astype(U64) << U64(40)) | (span_hashes(sums, starts, starts + shape.size) >> U64(24)))
    twice = np.zeros(len(heads), bool)
    twice[(seen[1:][seen[1:] == seen[:-1]] >> U64(40)).astype(np.int64)] = True
    row = units.row[first]
    return {"row": row, "ah": anchors[heads].view(np.int64), "rh": span_hashes(sums, first, first + n - 1 + shape.size).view(np.int64), "pos": first - units.first[row], "n": n, "self": twice}


def long_lines(units: _text.Units, least: int) -> np.ndarray:
    """Units of at least so many words."""
    inside = ~_text.WORD_BREAK[units.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    sums = np.r_[0, np.cumsum(begins)]
    # A word that begins before the unit, at a text's edge, counts in it as well.
    first = units.starts[units.ends > units.starts]
    entered = np.zeros(len(units.starts), np.int64)
    entered[units.ends > units.starts] = inside[first] & ~begins[first]
    return np.flatnonzero(sums[units.ends] - sums[units.starts] + entered >= least)


def _emit_runs(batches: Iterable[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(2))
        for lo, hi in slices(offsets):
            got = runs(shape.units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), shape)
            at = pa.array(got["row"] + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(got["ah"]), pa.array(got["rh"]), pa.array(got["pos"].astype(np.int32)), pa.array(got["n"].astype(np.int32)), pa.array(got["self"].astype(bool))],
                names=["doc_id", "t", "ah", "rh", "pos", "n", "self"],
            )


def _emit_windows(batches: Iterable[pa.RecordBatch], shape: Shape, place: bool) -> Iterator[pa.RecordBatch]:
    """From (text, list of runs, doc_id, t) the windows of those runs, and where they stand if place is set."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        wanted = batch.column(1).to_pylist()
        for lo, hi in slices(offsets):
            units = shape.units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sums = prefix_sums(units.hashes())
            asked = [(r, x["pos"], x["n"], x["ah"], x["rh"], x["c"]) for r in range(lo, hi) for x in wanted[r]]
            if not asked:
                continue
            row, pos, n, ah, rh, c = (np.array(x, np.int64) for x in zip(*asked, strict=True))
            run = np.repeat(np.arange(len(n)), n)
            o = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            first = (units.first[row - lo] + pos)[run] + o
            columns = {"ah": pa.array(ah[run]), "rh": pa.array(rh[run]), "c": pa.array(c[run]), "o": pa.array(o.astype(np.int32)), "wh": pa.array(span_hashes(sums, first, first + shape.size).view(np.int64))}
            if place:
                at = pa.array(row[run])
                columns |= {"doc_id": batch.column(2).take(at), "t": batch.column(3).take(at), "pos": pa.array((pos[run] + o).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def repeated(documents: DataFrame, shape: Shape, keep_first: bool) -> DataFrame:
    """Written rows (doc_id, t, marks) for the documents with repeated windows; marks lists (pos, n, offsets).

    documents: doc_id and text; t is xxhash64(text), which tells apart different texts of one id.
    A mark means the windows at pos + o for o in offsets, or for all o < n if offsets is null; n = 0 is the one unit at pos.
    Marked are all windows whose units also stand elsewhere, or with keep_first all but the first
    such window in the order of doc_id, t and position. What is grouped by a hash is written before
    it is joined, so that a passage of very many texts can be split over tasks.
    """
    keyed = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    found = keyed.transform(batched, partial(_emit_runs, shape=shape), _RUNS)
    seeds = table(found.groupBy("ah").agg(F.count("*").alias("c"), F.max("self").alias("s")).filter("c > 1 OR s").select("ah"), "anchors")
    hits = table(found.join(seeds, "ah", "left_semi"), "seeds")

    spans = hits.groupBy("ah", "rh").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "t", "pos")).alias("f"), F.first("n").alias("n"), F.max("self").alias("s"))
    spans = table(spans, "spans")
    varied = table(spans.groupBy("ah").agg(F.count("*").alias("k"), F.max("s").alias("s")).filter("k > 1 OR s").select("ah"), "varied")
    mixed = table(spans.join(varied, "ah", "left_semi"), "mixed")
    asked = mixed.select("f.doc_id", "f.t", F.struct(F.col("f.pos").alias("pos"), "n", "ah", "rh", "c").alias("x")).groupBy("doc_id", "t").agg(F.collect_list("x").alias("wanted"))
    # A repeated row sends its windows again, but its spans count twice or more in any case.
    emit = partial(_emit_windows, shape=shape, place=keep_first)
    windows = table(join_rows(keyed, asked).select("text", "wanted", "doc_id", "t").transform(batched, emit, _WINDOWS + _PLACE * keep_first), "windows")
    at = F.struct("doc_id", "t", "pos")
    totals = table(windows.groupBy("ah", "wh").agg(F.sum("c").alias("total"), *([F.min(at).alias("first")] if keep_first else [])).filter("total > 1"), "totals")
    own = windows.join(totals, ["ah", "wh"])
    if keep_first:
        own = own.filter(~at.eqNullSafe(F.col("first")))
    own = own.groupBy("ah", "rh").agg(F.collect_set("o").alias("offsets"))
    # For the first occurrence of each span its own offsets; every other occurrence repeats whole.
    state = table(spans.join(own, ["ah", "rh"], "left").filter("c > 1 OR offsets IS NOT NULL").select("ah", "rh", "f", "offsets", "c"), "state")
    here = F.struct("doc_id", "t", "pos")
    marks = hits.join(state, ["ah", "rh"])
    is_first = here.eqNullSafe(F.col("f"))
    whole = ~is_first if keep_first else (F.col("c") > 1)
    marked = marks.filter(whole | F.col("offsets").isNotNull()).select("doc_id", "t", F.struct("pos", "n", F.when(~whole, F.col("offsets")).alias("offsets")).alias("x"))
    # Repeated rows of one document have the same marks, which count once.
    out = table(marked.groupBy("doc_id", "t").agg(F.collect_set("x").alias("marks")), "marks")
    discard(seeds, hits, spans, varied, mixed, windows, totals, state)
    return out


def join_rows(keyed: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id (null equals null) and t."""
    other = other.withColumnRenamed("doc_id", "_d").withColumnRenamed("t", "_t")
    return keyed.join(other, keyed["doc_id"].eqNullSafe(other["_d"]) & keyed["t"].eqNullSafe(other["_t"]), how).drop("_d", "_t")


def covered(n_units: int, marks: list[dict], size: int) -> np.ndarray:
    """Which of a text's units lie in a marked window."""
    edge = np.zeros(n_units + 1, np.int64)
    for m in marks:
        if not m["n"]:
            edge[m["pos"]] += 1
            edge[m["pos"] + 1] -= 1
            continue
        at = m["pos"] + (np.arange(m["n"]) if m["offsets"] is None else np.array(m["offsets"]))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def rewrite(documents: DataFrame, marks: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[str], schema: str) -> DataFrame:
    """Runs make over batches of (text, marks, columns...) for every row of documents."""
    renamed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return join_rows(renamed, marks, "left").select("text", "marks", *[f"_c{i}" for i in range(len(columns))]).transform(batched, make, schema)
