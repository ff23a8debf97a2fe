"""Prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A turn is 20 bytes: the MD5 of its role and text and its number of words. A conversation is the string of its turns,
and equal conversations collapse to one string with a count. The strings are range-partitioned and sorted; the
edge between neighbours carries the number of turns they share. A task takes its strings in blocks of bounded size and
merges them along the edges in descending depth: a union lifts both components to that depth, which closes
the nodes below it, and the merge is the branching node.

Nodes that hold a block's first or last string may go on in another block, so they stay open: the block contracts
to these two strings, each with what has been summed up at its open nodes. The contracted strings of all blocks are
sorted and merged anew, in blocks again, until they fit in one; that one closes the rest up to the root. Every
round leaves two strings a block. A closed node whose parent is still open names it by a hash of the path and looks its
smallest member up at the end; a path with very many children is dealt to salts in that join.

The ids that end at a node are sorted by range, packed into strings of up to ``PACK`` ids and hashed pack by pack.
A SHA-256 is one sequence by definition, so the packs of one node are read by one task, as a stream.

Defined cases: rows with a null id belong to no conversation; null role or text is empty; turns with equal number
are ordered by the hash of role and text, and repeated rows are turns of their own; a conversation is one row of 20 bytes a
turn, however long its texts; an empty table gives no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.store import stored

UNIT = 20
#: A block of sorted strings: at most so many, and so many bytes unless it has few.
ROWS, BYTES, FEW = 1 << 14, 16 << 20, 64
#: Ids joined into one string, and parts into which the children of an open path are dealt.
PACK, SALTS = 4096, 16
NO_ID = 2**63 - 1

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: A row is a closed node (depth is not null) or a contracted string (codes is not null).
SCHEMA = f"{_NODE}, ender long, path binary, parent_path binary, codes binary, sums binary"
_SUM = "<qqqqqqq"


class Sums:
    """What is known of one node: members, smallest member, children, leaves and saved tokens below, who ends here."""

    __slots__ = ("n", "first", "children", "leaves", "saved", "ender", "waiting")

    def __init__(self, n=0, first=NO_ID, children=0, leaves=0, saved=0, ender=NO_ID):
        self.n, self.first, self.children, self.leaves, self.saved, self.ender = n, first, children, leaves, saved, ender
        self.waiting: list[list] = []  # closed children that still lack this node's smallest member

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.first = min(self.first, other.first)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ender = min(self.ender, other.ender)
        self.waiting += other.waiting


def packed(sums: dict[int, Sums]) -> bytes:
    return b"".join(struct.pack(_SUM, d, s.n, s.first, s.children, s.leaves, s.saved, s.ender) for d, s in sorted(sums.items()))


def unpacked(data: bytes) -> dict[int, Sums]:
    return {d: Sums(*rest) for d, *rest in struct.iter_unpack(_SUM, data)}


def shared(a: bytes, b: bytes) -> int:
    """Turns that two strings share from the start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // UNIT


class Forest:
    """Components over a block of sorted strings; ``closed`` gets the finished nodes."""

    def __init__(self, codes: list[bytes], sums: list[dict[int, Sums]], late: bool, final: bool):
        # late: contracted strings, whose nodes may have children in earlier rounds
        self.codes, self.sums, self.late, self.final, self.last = codes, sums, late, final, len(codes) - 1
        self.parent = list(range(len(codes)))
        self.low, self.high = list(self.parent), list(self.parent)  # ends of a component
        self.top = [len(c) // UNIT for c in codes]
        self.open: tuple[dict[int, Sums], dict[int, Sums]] = ({}, {})
        self.closed: list[list] = []

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def words(self, row: int, depth: int) -> int:
        return int.from_bytes(self.codes[row][depth * UNIT - 4 : depth * UNIT], "big") if depth else 0

    def path(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.codes[row][: depth * UNIT]).digest()

    def lift(self, root: int, depth: int) -> None:
        """Raise the top of a component to ``depth``; the nodes below are closed or belong to the block's edge."""
        row, sums = self.low[root], self.sums[root]
        first, last = not self.final and self.low[root] == 0, not self.final and self.high[root] == self.last
        while self.top[root] > depth:
            at = self.top[root]
            own = sums.pop(at, None) or Sums()
            if first or last:
                self._leave_open(own, row, at, 0 if first else 1)
            else:
                self._close(own, row, at, sums)
            self.top[root] = at - 1

    def _close(self, own: Sums, row: int, at: int, sums: dict[int, Sums]) -> None:
        leaves = own.leaves if own.children else 1
        saved = own.saved + (own.n - 1) * self.words(row, at)
        for node in own.waiting:
            node[2] = own.first
        node = [own.first, at, None, own.n, own.children, leaves, saved, None if own.ender == NO_ID else own.ender, None, None]
        if self.late:
            node[8] = self.path(row, at)
        self.closed.append(node)
        if at:
            above = sums.setdefault(at - 1, Sums())
            above.add(Sums(own.n, own.first, 1, leaves, saved))
            above.waiting.append(node)

    def _leave_open(self, own: Sums, row: int, at: int, side: int) -> None:
        if own.waiting:
            path = self.path(row, at)
            for node in own.waiting:
                node[9] = path
            own.waiting = []
        self.open[side][at] = own

    def union(self, left: int, right: int, depth: int) -> None:
        a, b = self.find(left), self.find(right)
        self.lift(a, depth)
        self.lift(b, depth)
        if len(self.sums[a]) < len(self.sums[b]):
            self.sums[a], self.sums[b] = self.sums[b], self.sums[a]
        for d, s in self.sums[b].items():
            if d in self.sums[a]:
                self.sums[a][d].add(s)
            else:
                self.sums[a][d] = s
        self.sums[b] = {}
        self.parent[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])

    def run(self) -> None:
        edges = [shared(a, b) for a, b in zip(self.codes, self.codes[1:])]
        for k in sorted(range(len(edges)), key=edges.__getitem__, reverse=True):
            self.union(k, k + 1, edges[k])
        self.lift(self.find(0), -1)

    def contracted(self) -> list[tuple[bytes, bytes]]:
        """The first and the last string with the sums of their open nodes; nodes of both are told by the first."""
        left, right = self.open
        out = [(self.codes[0], packed({d: s for d, s in left.items() if s.n or s.children}))]
        if self.last and right:
            out.append((self.codes[-1], packed({d: s for d, s in right.items() if s.n or s.children})))
        return out


def _rows(forest: Forest) -> pa.RecordBatch:
    closed = list(zip(*forest.closed)) or [()] * 10
    ends = [] if forest.final else forest.contracted()
    none = [None] * len(ends)
    kinds = [pa.int64()] * 8 + [pa.binary()] * 2
    columns = [pa.array(list(c) + none, k) for c, k in zip(closed, kinds)]
    gap = [None] * len(forest.closed)
    columns += [pa.array(gap + [e[k] for e in ends], pa.binary()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in SCHEMA.split(", ")])


def forests(strings: DataFrame, late: bool, final: bool) -> DataFrame:
    """Closed nodes and contracted strings of every block of sorted (codes, n, first) or, in late rounds, (codes, sums)."""

    def own(code: bytes, *told) -> dict[int, Sums]:
        if late:
            return unpacked(told[0])
        return {len(code) // UNIT: Sums(told[0], told[1], ender=told[1])}

    def merged(codes: list[bytes], sums: list[dict[int, Sums]]) -> pa.RecordBatch:
        forest = Forest(codes, sums, late, final)
        forest.run()
        return _rows(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, size = [], [], 0
        for batch in batches:
            for code, *told in zip(*(c.to_pylist() for c in batch.columns)):
                if not final and (len(codes) >= ROWS or (size > BYTES and len(codes) >= FEW)):
                    yield merged(codes, sums)
                    codes, sums, size = [], [], 0
                codes.append(code)
                sums.append(own(code, *told))
                size += len(code) + (len(told[0]) if late else 0)
        if codes:
            yield merged(codes, sums)

    return strings.select("codes", *(["sums"] if late else ["n", "first"])).mapInArrow(run, SCHEMA)


def rebuilt(talks: DataFrame, conv: str, turn: str, role: str, text: str, block: int, most: int) -> DataFrame:
    """(conv, codes): every conversation with its first turns taken from the head of its block of ids."""
    said = talks.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    code = F.concat(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")), F.lpad(F.hex(words), 8, "0"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "code")))
    own = said.select("conv", "turn", code.alias("code")).groupBy("conv").agg(turns["code"].alias("own"))
    heads = own.where(F.col("conv") % block == 0).select(F.col("conv").alias("block"), F.slice("own", 1, most).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = own.withColumn("block", F.col("conv") - F.col("conv") % block).join(heads, "block", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<string>"))
    rest = F.slice("own", h + 1, F.size("own"))
    return joined.select("conv", F.unhex(F.array_join(F.concat(head, rest), "")).alias("codes"))


def end_digests(talks: DataFrame) -> DataFrame:
    """(ender, sha): of the ids with equal strings, in ascending order; the smallest names them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def told(keys, firsts, texts):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["key", "first", "ids"]
            )

        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == PACK):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if out:
                yield told(*zip(*out))
        if ids:
            yield told([key], [ids[0]], [",".join(map(str, ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, state = None, None, None
        for batch in batches:
            out = []
            for k, f, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if state is not None:
                        out.append((first, state.hexdigest()))
                    key, first, state = k, f, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["ender", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([state.hexdigest()])], ["ender", "sha"])

    ids = talks.select(F.md5("codes").alias("key"), "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    packs = ids.mapInArrow(pack, "key string, first long, ids string")
    return packs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "ender long, sha string")


def _with_parents(closed: DataFrame) -> DataFrame:
    """Fill in the parents that were open when their children closed."""
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS))
    late = closed.where("parent_path IS NOT NULL").withColumn("salt", salt).drop("parent_conv_id")
    parents = closed.where("path IS NOT NULL").select(
        F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    return closed.where("parent_path IS NULL").unionByName(late.join(parents, ["parent_path", "salt"]).drop("salt"))


def prefix_trie(
    talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = 20, most: int = 3,
) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    talks = stored(rebuilt(talks, conv, turn, role, text, block, most), "talks")
    strings = talks.groupBy("codes").agg(F.count("*").alias("n"), F.min("conv").alias("first"))
    strings = strings.repartitionByRange("codes").sortWithinPartitions("codes")
    rounds, late = [stored(forests(strings, False, False), "forest")], False
    while not late:
        ends = rounds[-1].where("codes IS NOT NULL").select("codes", "sums")
        n, size = ends.agg(F.count("*"), F.coalesce(F.sum(F.length("codes") + F.length("sums")), F.lit(0))).first()
        late = n <= 8 * FEW or (n <= ROWS and size <= 4 * BYTES)
        if late:
            ends = ends.coalesce(1)
        else:
            # with FEW strings a partition on average, a round leaves a small share of them
            ends = ends.repartitionByRange(1 + min(n // FEW, max(4 * n // ROWS, size // BYTES)), "codes")
        rounds.append(stored(forests(ends.sortWithinPartitions("codes"), True, late), "forest"))
    closed = rounds[0]
    for more in rounds[1:]:
        closed = closed.unionAll(more)
    nodes = _with_parents(closed.where("depth IS NOT NULL").drop("codes", "sums"))
    columns = [part.split()[0] for part in _NODE.split(", ")]
    ended = nodes.where("ender IS NOT NULL").join(end_digests(talks), "ender")
    return ended.select(*columns, F.col("sha").alias("ends_sha256")).unionAll(
        nodes.where("ender IS NULL").select(*columns, F.lit(hashlib.sha256().hexdigest()))
    )


def oracle(block: int = 20, most: int = 3) -> str:
    """The trie in SQL, a list of turns a node; CRC-32 of the ids byte by byte from its table."""
    return f"""
WITH shift AS (SELECT {[_crc_entry(k) for k in range(256)]}::BIGINT[] AS t),
said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS own,
  FROM said GROUP BY c),
keyed AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda i: ascii(i)::BIGINT)),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::BIGINT) % {most + 1} AS h
  FROM own, shift),
seq AS (
  SELECT k.c, list_concat(coalesce(head.own[1:h], []), k.own[h + 1:]) AS s FROM keyed k LEFT JOIN own head ON head.c = k.c - k.c % {block}),
member AS (SELECT c, s, len(s) AS size, unnest(range(0, len(s) + 1)) AS d FROM seq),
node AS (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends_sha256
  FROM member GROUP BY s[1:d], d),
linked AS (
  SELECT a.*, b.conv_id AS parent_conv_id, coalesce(kids.n, 0) AS n_children
  FROM node a LEFT JOIN node b ON a.d = b.d + 1 AND a.p[1:a.d - 1] = b.p
  LEFT JOIN (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2) kids ON kids.p = a.p AND kids.d = a.d),
cost AS (
  SELECT p, d, n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS saved,
    unnest(range(0, d + 1)) AS up FROM linked),
below AS (
  SELECT p[1:up] AS p, up AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM cost GROUP BY p[1:up], up)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN below USING (p, d)"""


def _crc_entry(k: int) -> int:
    for _ in range(8):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k
