"""Operator 11: removing repeated byte strings, by bucket-pointer refinement over sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. A row for each position
would be far more than the input, so positions are sampled: the window of LENGTH bytes at any place
looks at the Q-byte strings (q-grams) within it and points to the one of least hash, the leftmost of
equals. Equal windows point to the same place within them, so only positions that point to equal
q-grams can be equal, and neighbours share a place: one in about 150 positions is pointed to.

- Initial buckets are the q-grams pointed to. Buckets of one place are dropped.
- A place stands for the windows that point to it, its shifts lo to hi. Places whose windows reach over
  equal bytes with equal shifts are one class; a class of two or more places repeats as a whole, and one
  of it goes on for the others.
- Buckets are refined in rounds: the shifts of a place are cut into cells of WIDTHS[i]. A cell's bucket
  is that of its place refined by the bytes at the offsets that all of its windows cover; cells alone in
  a bucket are dropped, cells equal in all bytes that any of their windows covers repeat, and what is left
  is refined again. A cell of one shift is a window, so the last round decides exactly.

Work follows the edges of repeated passages; groups of equal cells are combined before the shuffle and
are never gathered. Windows are compared by a 64-bit hash within buckets of a 64-bit hash. Texts are
told apart by 96 bits of hash, so copies of a text are one text that repeats as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.rolling import REACH, Roller, mixed, signed, sliding_min
from kinloom.shared import bucketed, scratch, written

LENGTH = 400
Q = 100
#: Shifts in a cell, round by round.
WIDTHS = (32, 4, 1)
#: Bytes whose windows are looked at together.
BLOCK = 1 << 18
_AT = ["t1", "t2"]


def _bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch one after another, and where each begins, with the end of the last."""
    texts = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def places(data: np.ndarray, begins: np.ndarray, roller: Roller, length: int, q: int):
    """place, hash of its q-gram, least and greatest shift: of every run of windows that point to the same place.

    begins: where the texts in data begin, and the end of the last; a window lies within one text.
    """
    ends = np.repeat(begins[1:], np.diff(begins))
    mask = np.uint64(2 * REACH - 1)
    for b in range(0, len(data) - length + 1, BLOCK):
        d = data[b : b + BLOCK + length - 1]
        sums, at = roller.sums(d), np.arange(len(d) - q + 1)
        h = mixed(roller.hashes(sums, at, at + q))
        to = (sliding_min((h & ~mask) | at.astype(np.uint64), length - q + 1) & mask).astype(np.int64)
        start = np.arange(len(to))
        inside = ends[b : b + len(to)] - b - start >= length
        same = (to[1:] == to[:-1]) & inside[1:] & inside[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~same
        last[:-1] &= ~same
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        to = to[first]
        yield b + to, h[to], to - last, to - first


def _anchors(length: int, q: int):
    """t1, t2, pos (place), lo, hi (shifts), key (q-gram), u (bytes that the windows cover) of every place."""

    def run(batches):
        import xxhash

        roller, digest = Roller(11), xxhash.xxh3_64_intdigest
        for batch in batches:
            data, begins = _bytes(batch, "text")
            if len(data) < length:
                continue
            view = memoryview(data)
            for pos, key, lo, hi in places(data, begins, roller, length, q):
                row = np.searchsorted(begins, pos, "right") - 1
                u = np.fromiter((digest(view[a:e]) for a, e in zip((pos - hi).tolist(), (pos - lo + length).tolist())), np.uint64, len(pos))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("t1").take(at), batch.column("t2").take(at), pa.array(pos - begins[row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(signed(key)), pa.array(signed(u))],
                    ["t1", "t2", "pos", "lo", "hi", "key", "u"],
                )

    return run


def _cells(length: int, width: int):
    """Of each text and its open cells: t1, t2, pos, lo, hi, key, u of the cells of `width` within, and c
    (bytes that all windows of the whole cell cover)."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            columns = [[] for _ in range(8)]
            for t1, t2, text, cells in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "cells"))):
                view = memoryview(text)
                for cell in cells:
                    pos, key = cell["pos"], cell["key"]
                    for k in range(cell["lo"] // width, cell["hi"] // width + 1):
                        lo, hi = max(cell["lo"], k * width), min(cell["hi"], k * width + width - 1)
                        a = pos - k * width
                        core = digest(view[a : max(a, a - width + 1 + length)], k)
                        for c, v in zip(columns, (t1, t2, pos, lo, hi, key, digest(view[pos - hi : pos - lo + length]), core)):
                            c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(signed(np.array(c, np.uint64))) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays([arrays[0], arrays[1].cast(pa.int32()), arrays[2], arrays[3].cast(pa.int32()), arrays[4].cast(pa.int32()), *arrays[5:]], ["t1", "t2", "pos", "lo", "hi", "key", "u", "c"])

    return run


_CELL = "t1 long, t2 int, pos long, lo int, hi int, key long, u long"


def _classes(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, rest): cells of classes with two or more places, and one cell of each class."""
    where, same = F.xxhash64("t1", "t2", "pos"), ["key", "lo", "hi", "u"]
    kinds = cells.groupBy(*same).agg(F.min(where).alias("one"), F.max(where).alias("other")).where("one <> other")
    known = _beside(cells, kinds, same, "left").withColumn("where", where)
    known = written(known, "classes", tidy=True)
    repeated = known.where("one IS NOT NULL")
    return repeated, known.where("one IS NULL OR where = one").drop("one", "other", "where")


def _shared(cells: DataFrame, bucket: list[str]) -> DataFrame:
    """Cells in a bucket with others that differ from them."""
    kind = F.xxhash64("lo", "hi", "u", "t1", "t2", "pos")
    counts = cells.groupBy(*bucket).agg(F.min(kind).alias("a"), F.max(kind).alias("b")).where("a <> b").select(*bucket)
    return _beside(cells, counts, bucket, "inner")


def _beside(cells: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """cells joined with the rows of their groups. These are read from files: a join in one stage with the
    aggregation that makes them is never split, and then all cells of a common passage meet in one task."""
    return cells.join(written(groups, "groups", tidy=True).hint("merge"), keys, how)


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text, F.lit(7)).alias("t2")]


def _removed(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "spans"))):
                n = len(text)
                found = [(0, n)] if copies > 1 else sorted((s["pos"] - s["hi"], s["pos"] - s["lo"] + length) for s in spans or ())
                merged: list[list[int]] = []
                for a, b in found:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in [*merged, (n, n)]:
                    kept.update(text[at:a])
                    at = b
                out.append((merged, kept.hexdigest()))
            spans = pa.array([[{"begin": a, "end": b} for a, b in m] for m, _ in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), spans, pa.array([h for _, h in out], pa.string())], ["t1", "t2", "spans", "kept"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """t1, t2, spans, kept for texts (t1, t2, text as binary, copies; texts differ) that lose bytes:
    the merged spans (begin, end) that go, in order, and the SHA-256 of what is left."""
    if not 0 < q <= length < REACH - BLOCK:
        raise ValueError("q-grams are no longer than the strings looked for, and these are shorter than a block")
    anchors = written(texts.select(*_AT, "text").mapInArrow(_anchors(length, q), _CELL), "places", tidy=True)
    cells = written(_shared(anchors, ["key"]), "cells", tidy=True)
    found = []
    for width in (None, *WIDTHS):
        if width:
            per = cells.groupBy(*_AT).agg(F.collect_list(F.struct("pos", "lo", "hi", "key")).alias("cells"))
            cut = texts.join(per.hint("merge"), _AT).select(*_AT, "text", "cells").mapInArrow(_cells(length, width), _CELL + ", c long")
            # A cell's bucket: the bytes that all of its windows cover, at the same shifts.
            cells = written(_shared(written(cut, "cut", tidy=True), ["key", "c"]), "cells", tidy=True)
        repeated, rest = _classes(cells)
        found.append(repeated.select(*_AT, "pos", "lo", "hi"))
        if width != WIDTHS[-1]:
            bucket = ["key", "c"] if width else ["key"]
            cells = written(_shared(rest, bucket), "open", tidy=True)
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    per = spans.groupBy(*_AT).agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("spans"))
    lost = texts.join(per.hint("merge"), _AT, "left").where("copies > 1 OR spans IS NOT NULL")
    kind = "t1 long, t2 int, spans array<struct<begin: long, end: long>>, kept string"
    return lost.select(*_AT, "text", "copies", "spans").mapInArrow(_removed(length), kind)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q) -> DataFrame:
    """id (the row's), n_bytes, spans (begin, end of every removed run, in bytes, in order) and
    kept_sha256 of every row of docs.

    Texts are taken as UTF-8 bytes, a null text as the empty one, which loses nothing, as do texts
    shorter than `length`. Rows with equal texts lose them whole if they are long enough, whatever
    their ids; ids may be null or repeat. An empty table gives an empty result. Other columns of
    docs are not read, so their names do not matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_identity(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    long = docs.select(text.alias("text"), *_identity(text)).where(F.octet_length("text") >= length)
    long = long.groupBy(*_AT).agg(F.first("text").cast("binary").alias("text"), F.count("*").alias("copies"))
    with scratch(docs.sparkSession), bucketed(long, _AT, "texts") as texts:
        lost = written(repeated_spans(texts, length, q), "spans", keep=True, tidy=True)
    # By sort-merge: what is lost grows with the documents, and a text that many rows share is split.
    out = rows.join(lost.hint("merge"), _AT, "left")
    return out.select("id", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<begin: long, end: long>>")).alias("spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
