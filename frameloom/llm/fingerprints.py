"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs; a paragraph is a line, cut further after words that their own hash
selects, so an edit touches the pieces around it only. Each piece hashes to a wide vector of +1 and -1; the
fingerprint is the sum of the vectors in 32 bits per lane. Sums do not depend on the order, a piece is put in or
taken out by adding or subtracting its vector, and the squared distance of two sums estimates how many pieces
differ, which gives the likeness. A column value has less than 2^31 bytes and so at most 2^30 pieces: no lane
can wrap, however often a piece is repeated, and equality and likeness hold for the whole sums. Lanes are added up in
slices of pieces, so a text of very many short lines takes no more memory than its words.

Defined cases: null and empty texts have no pieces, the zero fingerprint and likeness 1 with each other;
white space between words does not count; repeated rows have equal fingerprints; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.words import U64, blocks, buffers, mix, run_hashes, spans

LANES = 256
#: A word in so many (a power of two) ends a piece.
PIECE_WORDS = 8
#: Pieces whose lanes are added up at once.
SLICE = 1 << 12
#: Rows of a run of ids.
RUN_ROWS = 1 << 14
#: Bytes of text that are fingerprinted together.
FLUSH_BYTES = 2 << 20


def vectors(texts: list[str | None] | pa.Array) -> np.ndarray:
    """Lane sums of every text."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, LANES), np.int32)
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, at)
        if not len(starts):
            continue
        words = run_hashes(part, starts, ends, lower=False)
        lines = np.cumsum((part == 10) | (part == 13))[starts]
        opens = np.zeros(len(starts), bool)
        opens[1:] = (lines[1:] != lines[:-1]) | (words[:-1] & U64(PIECE_WORDS - 1) == 0)
        heads = first[:-1][first[:-1] < first[1:]]
        opens[heads] = True
        begin = np.flatnonzero(opens)
        place = (np.arange(len(starts)) - np.repeat(begin, np.diff(np.r_[begin, len(starts)]))).astype(U64)
        pieces = np.add.reduceat(mix(words + place * U64(0x9E3779B97F4A7C15)), begin)
        text, own = np.searchsorted(begin, heads), np.flatnonzero(first[:-1] < first[1:]) + a
        for low in range(0, len(pieces), SLICE):  # however many pieces a text has, so many are unpacked at once
            part = pieces[low : low + SLICE]
            lanes = np.stack([mix(part, k + 1) for k in range(LANES // 64)], 1).view(np.uint8)
            i, j = np.searchsorted(text, low, "right") - 1, np.searchsorted(text, low + len(part))
            cuts = np.maximum(text[i:j] - low, 0)
            counts = np.diff(np.r_[cuts, len(part)])
            out[own[i:j]] += 2 * np.add.reduceat(np.unpackbits(lanes, axis=1), cuts, axis=0, dtype=np.int32) - counts[:, None].astype(np.int32)
    return out


def encoded(sums: np.ndarray) -> list[str]:
    """Lanes of 32 bits as base64."""
    return [base64.b64encode(row.tobytes()).decode() for row in sums.astype("<i4")]


def decoded(fingerprint: str) -> np.ndarray:
    """Signed lanes of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), "<i4").astype(np.int64)


def edited_by(fingerprint: str, put: list[str] = (), taken: list[str] = ()) -> str:
    """The fingerprint after whole paragraphs are put in or taken out, without the rest of the text."""
    sums = decoded(fingerprint)[None]
    for texts, sign in ((put, 1), (taken, -1)):
        if texts:
            sums = sums + sign * vectors(list(texts)).sum(0, keepdims=True)
    return encoded(sums)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal multisets, about 0 for disjoint ones: 1 - |a - b|^2 / (|a|^2 + |b|^2), row by row."""
    a, b = a.astype(float), b.astype(float)
    size = (a * a).sum(1) + (b * b).sum(1)
    return np.clip(1 - ((a - b) ** 2).sum(1) / np.maximum(size, 1), 0, 1)


def with_next(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows in runs: (run, ahead, doc_id, tag, text), sorted inside partitions; every run is a range of ids
    and ends with a copy of the first row of the next run (``ahead`` = 1; the last run: of the first).

    Bounds and first rows are as many as there are runs, one for every ``RUN_ROWS`` rows; only they pass through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (2 * RUN_ROWS))
    step = [i / (2 * parts) for i in range(1, 2 * parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", step, max(10_000, 20 * parts))).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    @F.arrow_udf("int")
    def run_of(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, values, "right").astype(np.int32))

    tagged = rows.withColumn("tag", F.xxhash64("text"))
    heads = tagged.select(run_of("doc_id").alias("run"), "doc_id", "tag").groupBy("run").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "doc_id", "tag")).alias("head")
    )
    firsts = sorted((r["run"], r["head"]["doc_id"], r["head"]["tag"]) for r in heads.collect())
    before = {(d, t): firsts[i - 1][0] for i, (_, d, t) in enumerate(firsts)}

    @F.arrow_udf("array<int>")
    def runs_of(ids: pa.Array, tags: pa.Array) -> pa.Array:
        own = np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right").tolist()
        keys = zip(ids.to_pylist(), tags.to_pylist())
        return pa.array([[r] if (p := before.get(k)) is None else [r, p] for r, k in zip(own, keys)], pa.list_(pa.int32()))

    spread = tagged.select("*", F.posexplode(runs_of("doc_id", "tag")).alias("ahead", "run"))
    return (
        spread.select("run", "ahead", "doc_id", "tag", "text").repartition(parts, "run")
        .sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_first(), "tag")
    )


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its text with the last quarter replaced by the start of the next
    document, and its likeness to both."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def done(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of ``ids``; ``texts`` has one more, the next document of the last."""
        edited = []
        for own, after in zip(texts, texts[1:]):
            k = len(own) // 4
            edited.append(own[: len(own) - k] + after[:k])
        own, other = vectors(texts), vectors(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(encoded(own[:-1])), pa.array(encoded(other)),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, now, closed = [], [], 0, None, False
        for batch in batches:
            for number, ahead, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                value = value or ""
                if number != now:
                    now, closed = number, False
                if ahead:
                    if not closed:
                        yield done(ids, [*texts, value])
                        ids, texts, size, closed = [], [], 0, True
                    continue
                if size > FLUSH_BYTES:
                    yield done(ids, [*texts, value])
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(value)
                size += len(value)

    return with_next(docs, doc, text).select("run", "ahead", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
