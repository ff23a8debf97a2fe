"""Target-distribution importance resampling: hashed word runs, log-ratio gains, a keyed Gumbel draw.

Words are scanned with an Aho-Corasick automaton. Its dictionary holds distinct words between delimiters, each
with one payload: the CRC-32 of its bytes and their number. A scan emits the payloads in text order; the CRC of a
run of words is composed of its neighbours' payloads alone (shift by the length, add), and modulo the number of
buckets it is the feature. Every worker grows its own dictionary from the words it meets, up to ``DICTIONARY``
words of at most ``LONGEST`` bytes; a word outside is hashed by itself, so results do not depend on the dictionary.

Each text is scanned once: its buckets are kept as two bytes a feature in the shared folder, and counting and
scoring read them. Counts leave a task as one row a bucket, whatever the task reads. The gains are as many as there
are buckets, a parameter. The draw is ranked by a range partition of the scores, one offset a partition; rows that
agree in everything are dealt by their row number, so no group of copies meets in one task.

Defined cases: a null or empty text has no words and weight 0; a null id draws as the empty string; very long texts
are scanned in slices cut at delimiters, whole; repeated rows are documents of their own, with equal scores, and
take neighbouring ranks; ties go to the smaller id (null first), then fewer features, then the smaller weight; empty
tables give no rows, or gains against a target of nothing; other columns are not read.
"""

from __future__ import annotations

import itertools
import sys
import types
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.store import per_batch, stored

#: Words of a worker's dictionary, and the bytes of its longest.
DICTIONARY, LONGEST = 1 << 16, 48
#: Bytes that are scanned together.
SLICE = 1 << 18
#: Lower-cases A-Z; everything but digits, ASCII letters and the bytes of other characters delimits.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32


def _doublings(steps: int = 31) -> list[np.ndarray]:
    """Tables that put 1, 2, 4, ... zero bytes behind a CRC: four lookups, one for each of its bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    values = [byte << np.uint32(8 * k) for k in range(4)]
    out = [np.stack([one[v & 255] ^ (v >> np.uint32(8)) for v in values])]
    for _ in range(steps - 1):
        out.append(np.stack([_moved(out[-1], row) for row in out[-1]]))
    return out


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_DOUBLINGS = _doublings()


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined byte strings from the CRCs of both and the length of the right one."""
    out = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        out[at] = _moved(_DOUBLINGS[k], out[at])
    return out ^ right


class Dictionary:
    """Words met so far in an automaton; each carries length and CRC as one number."""

    def __init__(self, size: int = DICTIONARY):
        self.size, self.known, self.waiting = size, 0, set()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def _take_in(self) -> None:
        for word in itertools.islice(self.waiting, self.size - self.known):
            self.automaton.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
        self.known = len(self.automaton)
        self.waiting.clear()
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and start of every word of a folded text that begins and ends with a delimiter."""
        inside = np.frombuffer(text, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        crc, unseen = np.zeros(len(starts), np.uint32), np.ones(len(starts), bool)
        if self.known:
            met = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64)
            at = np.searchsorted(ends, met[::2])
            crc[at], unseen[at] = (met[1::2] & 0xFFFFFFFF).astype(np.uint32), False
        for k in np.flatnonzero(unseen).tolist():
            word = text[starts[k] : ends[k]]
            crc[k] = zlib.crc32(word)
            if self.known < self.size and len(word) <= LONGEST:
                self.waiting.add(word)
        if self.known < self.size and len(self.waiting) >= max(512, self.known // 2):
            self._take_in()
        return crc, ends - starts, starts


def own_dictionary() -> Dictionary:
    """The dictionary of this worker process; it outlives a task."""
    holder = sys.modules.setdefault("_frameloom_words", types.ModuleType("_frameloom_words"))
    if not hasattr(holder, "dictionary"):
        holder.dictionary = Dictionary()
    return holder.dictionary


def _slices(text: bytes) -> Iterator[bytes]:
    """A folded text in slices that begin and end with a delimiter and cut no word."""
    start = 0
    while len(text) - start > SLICE:
        cut = text.rfind(b" ", start + 1, start + SLICE)
        cut = cut if cut > start else text.find(b" ", start + SLICE)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[start : cut + 1]
        start = cut
    yield text[start:]


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or b"") > SLICE:
            yield start, k
            start, size = k, 0
        size += len(text or b"") + 1
    yield start, len(texts)


def payloads(texts: list[bytes | None], dictionary: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts in order: number of words of each text, CRCs and lengths of all their words."""
    for a, b in _blocks(texts):
        own = [t or b"" for t in texts[a:b]]
        heads = np.cumsum([0] + [len(t) + 1 for t in own])
        crcs, lengths, starts, base = [], [], [], 0
        for part in _slices((b" " + b" ".join(own) + b" ").translate(FOLD)):
            crc, length, start = dictionary.scan(part)
            crcs.append(crc)
            lengths.append(length)
            starts.append(start + base)
            base += len(part) - 1
        counts = np.diff(np.searchsorted(np.concatenate(starts), heads + 1))
        yield counts, np.concatenate(crcs), np.concatenate(lengths)


def runs(counts: np.ndarray, crc: np.ndarray, length: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC of every run of 1 to ``longest`` words, text by text, and how many each text has."""
    text = np.repeat(np.arange(len(counts)), counts)
    parts, owners, run = [crc], [text], crc
    space, one = np.uint32(zlib.crc32(b" ")), np.int64(1)
    for n in range(2, longest + 1):
        if len(crc) < n:
            break
        run = composed(composed(run[:-1], np.full(len(run) - 1, space), np.full(len(run) - 1, one)), crc[n - 1 :], length[n - 1 :])
        whole = text[n - 1 :] == text[: len(text) - n + 1]
        parts.append(run[whole])
        owners.append(text[n - 1 :][whole])
    owner = np.concatenate(owners)
    return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(counts))


def _code(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, text: str, buckets: int, longest: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, n_words, n_features, codes): the buckets of all word runs of every text."""
    kind = _code(buckets)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        words, sizes, codes = [], [], []
        for counts, crc, length in payloads(texts, own_dictionary()):
            run, n = runs(counts, crc, length, longest)
            words.append(counts)
            sizes.append(n)
            codes += [part.tobytes() for part in np.split((run % buckets).astype(kind), np.cumsum(n)[:-1])]
        more = [pa.array(np.concatenate(x), pa.int64()) for x in (words, sizes)] + [pa.array(codes, pa.binary())]
        return pa.RecordBatch.from_arrays(batch.columns[:-1] + more, [*keep, "n_words", "n_features", "codes"])

    rows = docs.select(*keep, F.col(text).cast("string"))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return per_batch(rows, kernel, f"{own}n_words long, n_features long, codes binary")


def bucket_counts(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): a task adds up all it reads before it hands on a row a bucket."""
    kind = _code(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batch.column(0).drop_null().to_pylist():
                total += np.bincount(np.frombuffer(part, kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return coded.select("codes").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln) of how much likelier the target is to hold each bucket, both smoothed by one."""
    rows = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(
        target.select("bucket", F.lit(0).cast("long"), F.col("n"))
    )
    found = rows.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row a bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in found:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weight_column(gain: list[int], codes: str, buckets: int) -> Column:
    """Sum of the gains of a text's features."""
    table, kind = np.array(gain, np.int64), _code(buckets)

    @F.arrow_udf("long")
    def weight(column: pa.Array) -> pa.Array:
        column = pc.fill_null(column.cast(pa.binary()), b"")
        return pa.array([int(table[np.frombuffer(part, kind)].sum()) for part in column.to_pylist()], pa.int64())

    return weight(codes)


def noise(doc: Column, seed: int) -> Column:
    """floor(1000 x a standard Gumbel number), keyed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share))).cast("long")


def drawn(scored: DataFrame, fits: Column, percent: int) -> DataFrame:
    """``rank`` 1, 2, 3, ... of the highest ``percent`` of the rows that fit; null elsewhere.

    ``scored`` has doc_id, n_features, weight, score and row, a number of its own for every row.
    """
    columns = ["doc_id", "n_features", "weight", "score"]
    n = scored.where(fits).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "n_features", "weight", "row"]
    ranged = scored.where(fits).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select(*columns, F.monotonically_increasing_id().alias("place")), "draw")
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row a partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranks = ranged.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        *columns, F.when(rank <= percent * n // 100, rank).cast("long").alias("rank")
    )
    return ranks.unionAll(scored.where(~fits).select(*columns, F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = 10_000, longest: int = 1, seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """Every document with n_features, weight, score and its rank in the draw of ``percent`` towards the target."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    coded = features(rows, "text", buckets, longest, ("doc_id",))
    coded = stored(coded.withColumn("row", F.monotonically_increasing_id()), "features")
    gain = gains(bucket_counts(coded, buckets), bucket_counts(features(target, target_text, buckets, longest), buckets), buckets)
    scored = coded.select("doc_id", "n_words", "n_features", "row", weight_column(gain, "codes", buckets).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, F.col("n_words") >= least_words, percent)


def oracle(buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """The draw over single words in SQL; CRC-32 byte by byte from its table."""
    return f"""
WITH shift AS (SELECT {_DOUBLINGS[0][0].tolist()}::BIGINT[] AS t),
word AS (
  SELECT 0 AS kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))
  FROM benchmark),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(hex(w)) // 2)::BIGINT),
    lambda i: ('0x' || substr(hex(w), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::BIGINT) % {buckets} AS bucket
  FROM (SELECT DISTINCT w FROM word), shift),
count AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM word JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + {buckets})) / ((s + 1)::DOUBLE * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM count),
weight AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
