"""Passages that stand in more than one document, by sparse suffix arrays.

A suffix is kept only at minimisers: the smallest eight-word hash of every 32 consecutive ones. Two equal
passages of 50 words or more choose the same minimisers, the first within 31 words, so 19 words at least follow
it. The kept suffixes of all documents are range-partitioned and sorted by their next 19 words (four bytes of hash a word), and
neighbours are compared: where two of different documents share all 19 words, every suffix of that stretch of the array
stays. What is left open at the ends of a partition, its first and its last stretch, is settled by two rows a partition.
The suffixes that stay extend: to the right by the whole 50 words from the minimiser, to the left, where the last minimiser did
not reach, by every 50-word window that begins up to 31 words before it. A word is in a repeat exactly if
some 50-word window over it stands in another document. Windows that overlap or touch are one span.

Only minimisers with repeated suffixes meet their texts again, and windows are made where some match ends only, so
long copies cost their minimisers, not their words; counts are taken on the map side, so a passage in
a third of all documents makes no large group.

Defined cases: words are what white space leaves, ASCII letters in lower case; null, empty and shorter texts
have no repeats; a passage repeated inside one document only is none; rows with one id are one
document, with all their spans; rows without an id are not read; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.store import per_batch, stored
from frameloom.llm.words import U64, blocks, buffers, gram_hashes, mix, run_hashes, spans

MIN_WORDS = 50
GRAM = 8
REACH = 32
AHEAD = MIN_WORDS - REACH + 1


def _window(grams: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each word on, out of eight-word hashes that cover them."""
    n = len(grams) + GRAM - size
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, size, U64)
    for at in [*range(0, size - GRAM, GRAM), size - GRAM]:
        out = mix(out * U64(0x9E3779B97F4A7C15) + grams[at : at + n])
    return out


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Places of the leftmost smallest hash of every ``REACH`` consecutive ones (a power of two)."""
    if len(grams) < REACH:
        return np.zeros(0, np.int64)
    best, step = np.arange(len(grams)), 1
    while step < REACH:
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        step *= 2
    return np.unique(best)


def _hashed(column: pa.Array):
    """(row, words of a text as eight-word hashes, and one by one) for texts long enough to hold a repeat."""
    data, offsets = buffers(column)
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, at)
        words = run_hashes(part, starts, ends)
        grams = gram_hashes(words, GRAM)
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if y - x >= MIN_WORDS:
                yield a + i, grams[x : y - GRAM + 1], words[x:y]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc, place, words, whole): minimisers with the next 19 words and the hash of the next 50 (0 past the end)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, places, near, far = [], [], [], []
        for row, grams, words in _hashed(batch.column(1)):
            at = minimisers(grams)
            at = at[at <= len(words) - AHEAD]
            long = _window(grams, MIN_WORDS)
            rows.append(np.full(len(at), row))
            places.append(at)
            near.append((words >> U64(32)).astype(">u4")[at[:, None] + np.arange(AHEAD)])
            far.append(np.where(at < len(long), long[np.minimum(at, len(long) - 1)], U64(0)))
        if not rows:
            return None
        rows, near = pa.array(np.concatenate(rows)), np.ascontiguousarray(np.concatenate(near))
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AHEAD), len(near), [None, pa.py_buffer(near.tobytes())])
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(rows), pa.array(np.concatenate(places).astype(np.int32)), fixed.cast(pa.binary()),
            pa.array(_signed(np.concatenate(far))),
        ], ["doc", "place", "words", "whole"])

    return per_batch(docs, kernel, "doc long, place int, words binary, whole long")


def _stretches(batches):
    """Rows of a sorted partition whose 19 words stand in two documents; and its ends, which its neighbours settle.

    Rows of the first and the last stretch that no second document has met here carry their words in ``open``; one more
    row for each of the two (without a place) tells its words, first and last document.
    """
    names = ["doc", "place", "ahead", "whole", "open", "low", "high"]

    def told(doc, place, words, whole, is_open):
        n = len(doc)
        ahead = mix(np.add.reduce(words.astype(U64) * np.cumprod(np.full(AHEAD, 0x9E3779B97F4A7C15, U64)), axis=1))
        opened = [w.astype(">u4").tobytes() for w in words] if is_open else [None] * n
        arrays = [pa.array(doc), pa.array(place), pa.array(_signed(ahead)), pa.array(whole), pa.array(opened, pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    def end(words, low, high):
        arrays = [pa.array([None], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([words.astype(">u4").tobytes()]), pa.array([low]), pa.array([high])], names)

    waiting, words, low, high, first = [], None, None, None, True  # the stretch that may go on in the next batch
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, place, whole = (batch.column(k).to_numpy() for k in (0, 1, 3))
        key = np.frombuffer(batch.column(2).cast(pa.binary(4 * AHEAD)).buffers()[1], ">u4")
        key = key.reshape(-1, AHEAD)[batch.column(2).offset :][:n] if len(key) != n * AHEAD else key.reshape(n, AHEAD)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        new[0] = words is None or bool((key[0] != words).any())
        other = np.zeros(n, bool)
        other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        other[0] = not new[0] and doc[0] != high
        starts = np.flatnonzero(new)
        if new[0] and words is not None:  # the waiting stretch is over
            if first:
                yield end(words, low, high)
                for rows in waiting:
                    yield told(*rows, True)
            waiting, first = [], False
        heads = starts if new[0] else np.r_[0, starts]
        shared = np.logical_or.reduceat(other, heads)
        sizes = np.diff(np.r_[heads, n])
        if not new[0]:
            shared[0] |= low != high
            if shared[0]:
                for rows in waiting:
                    yield told(*rows, False)
                waiting = []
        keep = np.repeat(shared, sizes)
        undecided = np.zeros(n, bool)
        if not shared[-1]:
            undecided[heads[-1] :] = True  # the last stretch goes on
        if not shared[0] and (first or not new[0]) and len(heads) > 1:  # the first ends here, unshared
            rows = slice(0, heads[1])
            if first:
                yield end(key[0], doc[0] if new[0] else low, doc[heads[1] - 1])
                for old in waiting:
                    yield told(*old, True)
                yield told(doc[rows], place[rows], key[rows], whole[rows], True)
            waiting = []
        elif first and len(heads) > 1:
            yield end(key[0], doc[0] if new[0] else low, doc[heads[1] - 1])
        if len(heads) > 1:
            first = False
        if keep.any():
            yield told(doc[keep], place[keep], key[keep], whole[keep], False)
        if undecided.any():
            waiting.append((doc[undecided], place[undecided], key[undecided], whole[undecided]))
        if len(heads) > 1 or new[0]:
            low = doc[heads[-1]]
        words, high = key[-1], doc[-1]
    if words is not None:
        yield end(words, low, high)
        for rows in waiting:
            yield told(*rows, True)


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc, place, ahead, whole): suffixes whose 19 words are those of a neighbour from another document."""
    order = ["words", "doc", "place"]
    rows = suffixes(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(rows.mapInArrow(_stretches, "doc long, place int, ahead long, whole long, open binary, low long, high long"), "neighbours")
    ends: dict[bytes, list[int]] = {}
    for row in found.where("place IS NULL").select("open", "low", "high").collect():  # two rows a partition
        ends.setdefault(bytes(row["open"]), []).extend((row["low"], row["high"]))
    shared = [(k,) for k, d in ends.items() if min(d) < max(d)]
    kept = found.where("place IS NOT NULL AND open IS NULL")
    if shared:
        known = found.sparkSession.createDataFrame(shared, "open binary")
        kept = kept.unionAll(found.where("place IS NOT NULL").join(F.broadcast(known), "open", "left_semi").select(*found.columns))
    return kept.select("doc", "place", "ahead", F.when(F.col("whole") != 0, F.col("whole")).alias("whole"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two documents or more, with the first and the last of them."""
    return rows.groupBy(key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")


def _edges(met: DataFrame) -> DataFrame:
    """(doc, start, whole) of the windows that begin up to 31 words before the given minimisers."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, starts, hashes = [], [], []
        places = batch.column(2)
        for row, grams, _ in _hashed(batch.column(1)):
            long = _window(grams, MIN_WORDS)
            at = np.unique(np.asarray(places[row].values)[:, None] - np.arange(1, REACH)[None, :])
            at = at[(at >= 0) & (at < len(long))]
            docs.append(np.full(len(at), row))
            starts.append(at)
            hashes.append(long[at])
        if not docs:
            return None
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(starts).astype(np.int32)),
            pa.array(_signed(np.concatenate(hashes))),
        ], ["doc", "start", "whole"])

    return per_batch(met, kernel, "doc long, start int, whole long")


def repeats(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc): maximal spans of words that stand elsewhere too.

    ``other_doc`` is the smallest other document found for a part of the span.
    """
    docs = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    near = neighbours(docs)
    # deep: the whole 50 words from here stand elsewhere; a chain of deep ones covers all words between them
    placed = near.join(_shared(near.where("whole IS NOT NULL"), "whole"), "whole", "left")
    order = Window.partitionBy("doc").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    deep = F.col("first").isNotNull()
    last_deep = F.last(F.when(deep, F.col("place")), ignorenulls=True).over(before)
    opens = deep & F.coalesce(F.col("place") - last_deep > MIN_WORDS, F.lit(True))
    placed = placed.withColumn("opens", opens)
    head = F.last(F.when(F.col("opens"), F.col("place")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = ~deep | (F.col("place") - head < REACH - 1)
    placed = stored(placed.select("doc", "place", "ahead", "first", "last", edge.alias("edge")), "placed")

    # where one document ends a match, all that share the suffix are compared
    ends = placed.where("edge").select("ahead").distinct()
    places = placed.join(ends, "ahead", "left_semi").groupBy("doc").agg(F.collect_set("place").alias("places"))
    edges = stored(_edges(docs.join(places, "doc").select("doc", "text", "places")), "edges")
    found = edges.join(_shared(edges, "whole"), "whole").select("doc", "start", "first", "last")

    deep = placed.where("first IS NOT NULL").select("doc", F.col("place").alias("start"), "first", "last")
    windows = deep.unionAll(found).select(
        "doc", "start", F.when(F.col("first") == F.col("doc"), F.col("last")).otherwise(F.col("first")).alias("other")
    )
    order = Window.partitionBy("doc").orderBy("start")
    gap = F.coalesce(F.col("start") - F.lag("start").over(order) > MIN_WORDS, F.lit(True))
    spans_ = windows.withColumn("opens", gap.cast("int")).withColumn(
        "span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return spans_.groupBy("doc", "span").agg(
        F.min("start").cast("long").alias("start_word"), (F.max("start") + MIN_WORDS).cast("long").alias("end_word"), F.min("other").alias("other_doc")
    ).select(F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")
