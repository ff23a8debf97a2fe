"""Exact Jaccard join of word n-gram sets (five words, 0.75) with prefix trees.

The n-grams of all documents are put in one order, frequent ones last. Two sets that are alike enough
share one of the first n - ceil(0.75 n) + 1 n-grams of each, so documents meet under those alone. Sets
that met are compared in tries: the partners of a document stand in a trie of ordered n-grams, and one walk
counts the overlap of every shared path once and leaves a subtree as soon as the n-grams that remain on
either side cannot reach the overlap needed.

Equal sets collapse first. Then each document is compared with the head of each of its n-grams,
one of the documents that share it (as many pairs as rows), and what links becomes one component; only pairs of different components that
no step has compared are made explicit. So a heap of near copies costs its size, not its pairs. In both steps a pair
is compared only if its early n-grams, by number and place, leave the overlap within reach.

Defined cases: null and empty texts have no n-grams and link with nothing; fewer words than five are one
n-gram of their own; rows with one id are one node; a null id keeps a null component; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.graph import components
from frameloom.llm.store import per_batch, stored
from frameloom.llm.words import U64, blocks, buffers, gram_hashes, mix, run_hashes, spans

WORDS = 5
#: Counters of the frequency sketch: its size is fixed, whatever the corpus.
BUCKETS = 1 << 18
TOKEN_BITS = 58
#: Bytes of text whose n-grams are counted together.
SLICE_BYTES = 16 << 20
#: Partners of a document that one trie holds, on average.
TRIE_SETS = 256


def gram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct n-grams of every text, as sorted 58-bit hashes."""
    data, offsets = buffers(texts)
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, at)
        words = run_hashes(part, starts, ends)
        grams = gram_hashes(words, WORDS) >> U64(64 - TOKEN_BITS)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= WORDS:
                yield np.unique(grams[i : j - WORDS + 1])
            elif j > i:
                yield (gram_hashes(words[i:j], j - i) ^ U64(j - i)) >> U64(64 - TOKEN_BITS)
            else:
                yield np.zeros(0, U64)


def in_order(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens with their frequency class in front, in the global order."""
    keys = tokens | (classes[(tokens & U64(BUCKETS - 1)).astype(np.int64)].astype(U64) << U64(TOKEN_BITS))
    keys.sort()
    return keys.view(np.int64)


def _read(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (kind 0, doc_id, size, two fingerprints) and (kind 1, bucket, count)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(BUCKETS, np.int64), [], 0

        def count():
            _, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            often = n > 1
            tokens = np.concatenate(held)[at[often]]
            np.add.at(sketch, (tokens & U64(BUCKETS - 1)).astype(np.int64), n[often])

        for batch in batches:
            n, one, two = [], [], []
            for tokens in gram_sets(batch.column(1)):
                n.append(len(tokens))
                one.append(int(mix(tokens, 1).sum(dtype=U64)))
                two.append(int(np.bitwise_xor.reduce(mix(tokens, 2))) if len(tokens) else 0)
                held.append(tokens)
                size += len(tokens)
                if size * 6 > SLICE_BYTES:
                    count()
                    held, size = [], 0
            prints = [pa.array(np.array(x, U64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *prints], schema=schema)
        if held:
            count()
        at = np.flatnonzero(sketch)
        zero = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(sketch[at]), zero, zero], schema=schema)

    return docs.mapInArrow(run, "kind int, a long, b long, c long, d long")


def _classes(read: DataFrame) -> np.ndarray:
    """Frequency class of every bucket (at most ``BUCKETS`` rows come to the driver)."""
    rows = read.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where("n >= 16").toArrow()
    classes = np.zeros(BUCKETS, np.uint8)
    classes[np.asarray(rows["a"])] = np.minimum(np.log2(np.asarray(rows["n"]).astype(float)).astype(int) - 3, 31)
    return classes


def _sets(docs: DataFrame, classes: np.ndarray, prefix: bool) -> DataFrame:
    """(doc_id, n, tokens) in the global order, whole or the prefix that can meet."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, parts = [], []
        for tokens in gram_sets(batch.column(1)):
            n = len(tokens)
            keys = in_order(tokens, classes)
            sizes.append(n)
            parts.append(keys[: n // 4 + 1] if prefix else keys)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "n", "tokens"])

    return per_batch(docs, kernel, "doc_id long, n long, tokens array<long>")


def trie_matches(probe: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """Numbers of the members with 100 * intersection >= 75 * union, by a walk over their trie."""
    order = sorted(range(len(members)), key=lambda i: members[i].astype(">i8").tobytes())
    sets = [members[i] for i in order]
    found, n = [], len(probe)
    stack = [(0, len(sets), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        a, b = sets[lo], sets[hi - 1]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        if end > depth:  # the tokens all sets of this subtree share next
            path = a[depth:end]
            at = np.searchsorted(probe, path)
            overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == path))
        rest = n - int(np.searchsorted(probe, a[end - 1], "right")) if end else n
        sizes = [len(s) for s in sets[lo:hi]]
        if 7 * (overlap + min(rest, max(sizes) - end)) < 3 * (n + min(sizes)):
            continue  # too little remains below
        while lo < hi and len(sets[lo]) == end:
            if 7 * overlap >= 3 * (n + end):
                found.append(order[lo])
            lo += 1
        if lo < hi:
            heads = np.array([s[end] for s in sets[lo:hi]])
            cuts = [lo, *(np.flatnonzero(heads[1:] != heads[:-1]) + lo + 1).tolist(), hi]
            stack.extend((x, y, end, overlap) for x, y in zip(cuts, cuts[1:]))
    return found


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    tries = F.greatest(F.ceil(F.count("*").over(Window.partitionBy("a")) / TRIE_SETS), F.lit(1))
    dealt = pairs.withColumn("trie", F.pmod(F.xxhash64("b"), tries))
    whole = sets.select(F.col("doc_id").alias("id"), "tokens")
    probes = dealt.select("a", "trie").distinct().join(whole, F.col("a") == F.col("id")).select("a", "trie", F.lit(0).alias("kind"), "id", "tokens")
    members = dealt.join(whole, F.col("b") == F.col("id")).select("a", "trie", F.lit(1).alias("kind"), "id", "tokens")
    rows = probes.unionAll(members).repartition("a", "trie").sortWithinPartitions("a", "trie", "kind", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, probes, ids, members = None, [], [], []

        def matched():
            hits = sorted({ids[i] for p in probes for i in trie_matches(p, members)}) if ids else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hits), pa.int64()), pa.array(hits, pa.int64())], schema=schema)

        for batch in batches:
            lists = batch.column(4)
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for i, (a, trie, kind, node) in enumerate(keys):
                if (a, trie) != now:
                    if ids:
                        yield matched()
                    now, probes, ids, members = (a, trie), [], [], []
                tokens = values[ends[i] : ends[i + 1]].copy()
                if kind == 0:
                    probes.append(tokens)
                else:
                    ids.append(node)
                    members.append(tokens)
        if ids:
            yield matched()

    return rows.mapInArrow(run, "a long, b long")


def _reachable() -> Column:
    """May two sets with ``shared`` tokens in both prefixes overlap enough?

    Of the two prefixes take the one whose last token comes first: all that the other set shares up to there is
    in its prefix too, so the overlap is at most ``shared`` and what lies behind that prefix.
    """
    behind = F.ceil(F.greatest("n_a", "n_b") * 3 / 4) - 1
    alike = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    return alike & (7 * (F.col("shared") + behind) >= 3 * (F.col("n_a") + F.col("n_b")))


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are exact."""
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    read = stored(_read(docs), "grams")
    classes = _classes(read)
    sizes = read.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "c", "d")
    linkable = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = linkable.groupBy("n_shingles", "c", "d").agg(F.min("doc_id").alias("rep"))
    reps = equal.select(F.col("rep").alias("doc_id")).distinct()

    rows = (
        _sets(docs.where("doc_id IS NOT NULL"), classes, prefix=True).join(reps, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("rep"), "n", F.posexplode("tokens").alias("pos", "token"))
    )
    under = Window.partitionBy("token")
    met = stored(
        rows.withColumn("holders", F.count("*").over(under)).withColumn("low", F.min("rep").over(under))
        .withColumn("high", F.max("rep").over(under)).where("low < high").drop("low", "high"),
        "met",
    )
    def compared(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs``; only their texts are read again."""
        ends = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = stored(_sets(docs.join(ends, "doc_id", "left_semi"), classes, prefix=False), "sets")
        return stored(_verify(pairs, sets), "found")

    # the head of an n-gram: of the documents that hold it the one that meets others most often, which in a
    # heap of near copies is the text they were made from
    meets = met.groupBy("rep").agg((-F.sum("holders")).alias("meets"))
    headed = met.join(meets, "rep").withColumn("head", F.min(F.struct("meets", "rep", "n")).over(under))
    pairs = stored(
        headed.where(F.col("rep") != F.col("head.rep"))
        .groupBy(F.col("head.rep").alias("a"), F.col("rep").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
        .agg(F.count("*").alias("shared")).where(_reachable()).select("a", "b").distinct(),
        "pairs",
    )
    part = components(compared(pairs))

    # pairs of different components that share early tokens and were not compared
    placed = met.select("token", "rep", "n", "pos").join(part, F.col("rep") == F.col("id"), "left")
    placed = placed.select("token", "rep", "n", "pos", F.coalesce("component_id", "rep").alias("part"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("token")
    placed = stored(placed.join(mixed, "token", "left_semi"), "mixed")
    left, right = (placed.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "pos", "part"))) for s in "ab")
    # two sets with the overlap needed share two tokens (one, where a prefix ends sooner) among the first
    # n - needed + 2 of each; behind these places nothing has to meet
    needed = F.ceil(3 * (F.col("n_a") + F.col("n_b")) / 7)
    early = (F.col("pos_a") <= F.col("n_a") - needed + 1) & (F.col("pos_b") <= F.col("n_b") - needed + 1)
    sure = F.least(F.lit(2), needed - F.ceil(F.greatest("n_a", "n_b") * 3 / 4) + 1)
    rest = (
        left.join(right, "token").where("rep_a < rep_b AND part_a != part_b")
        .where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")).where(early)
        .groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= sure).select("a", "b").distinct()
        .join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = compared(stored(rest, "rest"))
    part = components(part.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionAll(more))

    own = equal.join(part, F.col("rep") == F.col("id"), "left").select(
        "n_shingles", "c", "d", F.coalesce("component_id", "rep").alias("part")
    )
    by_set = sizes.join(own, ["n_shingles", "c", "d"], "left").select("doc_id", "n_shingles", "part")
    # rows with one id are one node: links over them join their sets
    return _one_node(by_set)


def _one_node(rows: DataFrame) -> DataFrame:
    """The smallest document of the component, also where an id stands on several rows."""
    many = rows.where("doc_id IS NOT NULL AND part IS NOT NULL").groupBy("doc_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y")
    spread = many.select("doc_id").join(rows, "doc_id").select(F.col("part").alias("a"), F.col("doc_id").alias("b"))
    if not spread.isEmpty():
        part = components(rows.select(F.col("part").alias("a"), F.col("doc_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
        joined = rows.join(part, F.col("doc_id") == F.col("id"), "left")
        return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"))
