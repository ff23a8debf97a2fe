"""Sequential rules over keys of any size, in slots of one range partition each.

Rows are range-partitioned by key and order, so a slot is bounded and a key with a third of all rows lies in many.
Each slot is folded at once as if its first key began there. That is right for every key but the first, and for the
first too unless the slot before ends with the same key. One row a slot, its first and last key and the state at its end,
then tells which slots were entered with a state. Only their first keys are folded again, all slots at a time. Where a slot
holds nothing but one key, its end depends on its entry: with a known, small set of states the
first fold takes along every one of them, so the ends are composed without reading anything again; without, the slots are
folded again from the ends of the slots before until no end changes. Most rules forget their entry within a few rows
(a pause, a flush, a release), so few rounds do; each round settles one more slot at least.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import cut

#: fold(columns, start, stop, state, out) -> state: one key's rows start..stop of a batch; ``out`` is a list a result column,
#: or None where only the state is asked for. A state is JSON; None is the state of a key that has just begun.
Fold = Callable[[dict[str, list], int, int, object, list[list] | None], object]

_SUMMARY = "__slot int, __first boolean, __head string, __tail string, __ends string"


def _runs(batch: pa.RecordBatch, columns: dict[str, list], keys: list[str]) -> Iterator[tuple[str, int, int]]:
    told = list(zip(*(columns[k] for k in keys)))
    start = 0
    for at in range(1, len(told) + 1):
        if at == len(told) or told[at] != told[start]:
            yield json.dumps(told[start], default=str), start, at
            start = at


def fold_slots(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, results: Sequence[tuple[str, pa.DataType]],
    entries: Sequence | None = None,
) -> DataFrame:
    """``df`` with the result columns of a sequential rule per key.

    ``entries``: all states in which a slot can be entered, where they are few.
    """
    keys, order = list(keys), list(order)
    names = df.columns
    spelled = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    made = ", ".join(f"{n} {spelled[t]}" for n, t in results)
    arrow = {n: t for n, t in results}

    def with_results(batch: pa.RecordBatch, out: list[list], more: list[pa.Array], labels: list[str]) -> pa.RecordBatch:
        arrays = [batch.column(n) for n in names] + [pa.array(o, arrow[n]) for o, (n, _) in zip(out, results)] + more
        return pa.RecordBatch.from_arrays(arrays, [*names, *arrow, *labels])

    def first_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, head, tail, state, ends = TaskContext.get().partitionId(), None, None, None, None
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.schema
            columns = {n: batch.column(n).to_pylist() for n in names}
            out = [[None] * batch.num_rows for _ in results]
            first = [False] * batch.num_rows
            for key, a, b in _runs(batch, columns, keys):
                if head is None:
                    head = key
                    ends = {json.dumps(e): e for e in entries or ()}
                if key != tail:
                    tail, state = key, None
                if key == head:
                    first[a:b] = [True] * (b - a)
                    met = {json.dumps(s): s for s in ends.values()}
                    met = {k: fold(columns, a, b, s, None) for k, s in met.items()}
                    ends = {k: met[json.dumps(s)] for k, s in ends.items()}
                state = fold(columns, a, b, state, out)
            n = batch.num_rows
            more = [pa.array([slot] * n, pa.int32()), pa.array(first), *(pa.nulls(n, pa.string()) for _ in range(3))]
            yield with_results(batch, out, more, ["__slot", "__first", "__head", "__tail", "__ends"])
        if head is not None:
            row = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in kinds], names=names)
            told = {"fresh": state, "by_entry": ends if head == tail else {}}
            more = [pa.array([slot], pa.int32()), pa.array([False]), *(pa.array([x]) for x in (head, tail, json.dumps(told)))]
            yield with_results(row, [[None] for _ in results], more, ["__slot", "__first", "__head", "__tail", "__ends"])

    def fold_again(schema_names: list[str], emit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot, state, ends = None, None, {}
            for batch in batches:
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                out = [[None] * batch.num_rows for _ in results] if emit else None
                at = columns["__slot"]
                start = 0
                for stop in range(1, len(at) + 1):
                    if stop < len(at) and at[stop] == at[start]:
                        continue
                    if at[start] != slot:
                        slot, state = at[start], json.loads(columns["__entry"][start])
                    state = fold(columns, start, stop, state, out)
                    ends[slot] = json.dumps(state)
                    start = stop
                if emit and batch.num_rows:
                    yield with_results(batch, out, [], [])
            if not emit and ends:
                yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.int32()), pa.array(list(ends.values()))], schema_names)

        return run

    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    folded = cut(placed.mapInArrow(first_fold, f"{own}, {made}, {_SUMMARY}"))
    rows = folded.where("__head IS NULL")
    slots = sorted(folded.where("__head IS NOT NULL").select("__slot", "__head", "__tail", "__ends").collect())  # a row a slot
    spark, head, tail = df.sparkSession, {s[0]: s[1] for s in slots}, {s[0]: s[2] for s in slots}
    told = {s[0]: json.loads(s[3]) for s in slots}
    before = {s[0]: p[0] for p, s in zip(slots, slots[1:]) if p[2] == s[1]}
    ends = {(s, "null"): told[s]["fresh"] for s in told}
    whole = {s for s in before if head[s] == tail[s]}

    def entered(part: dict[int, object]) -> DataFrame:
        entry = spark.createDataFrame([(s, json.dumps(e)) for s, e in part.items()], "__slot int, __entry string")
        again = rows.where("__first").join(F.broadcast(entry), "__slot")  # a row a slot
        return again.select(*names, "__slot", "__entry").repartition("__slot").sortWithinPartitions("__slot", *order)

    def end(slot: int, entry) -> object:
        return told[slot]["by_entry"].get(json.dumps(entry), ends.get((slot, json.dumps(entry)), ...))

    guess: dict[int, object] = {}
    while True:
        missing = {}
        for slot in sorted(before):
            prior = before[slot]
            entry = end(prior, guess.get(prior)) if prior in whole else told[prior]["fresh"]
            if entry is ...:
                entry = told[prior]["fresh"]  # not known yet: go on from the last guess
            guess[slot] = entry
            if slot in whole and end(slot, entry) is ...:
                missing[slot] = entry
        if not missing:
            break
        found = entered(missing).mapInArrow(fold_again(["__slot", "__end"], False), "__slot int, __end string").collect()  # a row a slot
        ends |= {(s, json.dumps(missing[s])): json.loads(e) for s, e in found}
    guess = {s: e for s, e in guess.items() if e is not None}
    columns = [*names, *arrow]
    if not guess:
        return rows.select(*columns)
    known = spark.createDataFrame([(s, True) for s in guess], "__slot int, __entered boolean")
    kept = rows.join(F.broadcast(known), "__slot", "left").where(~(F.col("__first") & F.coalesce("__entered", F.lit(False))))
    return kept.select(*columns).unionAll(entered(guess).mapInArrow(fold_again([], True), f"{own}, {made}"))
