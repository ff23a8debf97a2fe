"""Layout as data: slot matching, assignment, pacing, rules, sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.boxes import cover_crop, crop_loss, crop_losses, orientation
from frameloom.operators.ordered import HOT_ROWS, HotGroups, OrderedGroups, first_row, hot_groups, listed_groups, top_n

# The five default slots (name, aspect, ideal compositions, face range).
SLOTS = (
    ("portrait_large", 0.75, ("portrait", "full_body"), 1, 2),
    ("portrait_small", 0.75, ("portrait",), 1, 1),
    ("landscape_wide", 1.78, ("group", "landscape"), 0, 5),
    ("group_square", 1.0, ("group", "large_group"), 2, 8),
    ("detail_square", 1.0, ("detail", "environmental"), 0, 1),
)
W_COMPOSITION, W_FACES, W_ASPECT, W_VARIETY, W_SAFETY = 55.0, 25.0, 20.0, 20.0, 150.0
RELATIVES = {"group": "large_group", "large_group": "group", "detail": "landscape", "landscape": "detail"}
EXHAUSTIVE = 7
CROWD_WEIGHT = 0.35


def slot_structs(slots: Sequence[tuple] = SLOTS) -> Column:
    """The slots as one literal array; a slot table is a handful of rows by nature."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"), F.lit(name).alias("name"), F.lit(float(aspect)).alias("aspect"),
                F.lit(list(ideal)).alias("ideal"), F.lit(low).alias("min_faces"), F.lit(high).alias("max_faces"),
            )
            for i, (name, aspect, ideal, low, high) in enumerate(slots)
        ]
    )


def slot_score(
    composition: Column, faces: Column, aspect: Column, boxes: Column, slot: Column, recent: Column | None = None,
    loss: Column | None = None,
) -> Column:
    """How well a photo fits a slot; cropping through faces costs most.

    ``loss`` is the loss of the crop into the slot, for callers that know it.
    """
    relative = F.create_map(*[F.lit(x) for p in RELATIVES.items() for x in p])[composition]
    kind = (
        F.when(F.array_contains(slot["ideal"], composition), 1.0)
        .when(F.coalesce(F.array_contains(slot["ideal"], relative), F.lit(False)), 0.5)
        .otherwise(0.0)
    )
    off = F.greatest(slot["min_faces"] - faces, faces - slot["max_faces"], F.lit(0))
    count = F.greatest(F.lit(0.0), 1.0 - off / 4.0)
    same = F.when(orientation(aspect) == orientation(slot["aspect"]), 1.0).otherwise(0.4)
    near = F.least(aspect, slot["aspect"]) / F.greatest(aspect, slot["aspect"])
    shape = F.when((aspect > 0) & (slot["aspect"] > 0), same * (near * 0.4 + 0.6)).otherwise(0.0)
    score = kind * W_COMPOSITION + count * W_FACES + shape * W_ASPECT
    if recent is not None:
        fresh = (F.size(recent) > 0) & ~F.array_contains(recent, composition)
        score = score + F.when(fresh, W_VARIETY).otherwise(0.0)
    loss = crop_loss(boxes, cover_crop(aspect, slot["aspect"], boxes)) if loss is None else loss
    return score - F.when(F.size(boxes) > 0, loss * W_SAFETY).otherwise(0.0)


def score_slots(df: DataFrame, slots: Sequence[tuple] = SLOTS) -> DataFrame:
    """One row per (photo, slot) with ``slot``, ``slot_name`` and ``score``.

    Expects composition, face_count, aspect and boxes. The slots are exploded from a literal.
    """
    # The crops of a photo into all slots are measured at once, before it meets them.
    losses = crop_losses("boxes", "aspect", [aspect for _, aspect, *_ in slots])
    each = df.withColumn("__losses", losses).withColumn("__s", F.explode(slot_structs(slots)))
    score = slot_score(
        F.col("composition"), F.col("face_count"), F.col("aspect"), F.col("boxes"), F.col("__s"),
        loss=F.get("__losses", F.col("__s.slot")),
    )
    return each.select(*df.columns, F.col("__s.slot").alias("slot"), F.col("__s.name").alias("slot_name"), score.alias("score"))


def _contenders(scored: DataFrame, by: list[str], photo: str, slots: int) -> DataFrame:
    """The best ``slots`` photos of every slot.

    A matching takes at most one photo per other slot, so a slot never needs to look further.
    """
    return top_n(
        scored.select(*by, photo, "slot", "score"), [*by, "slot"], [F.col("score").desc(), F.col(photo)], slots
    )


# Groups of up to this many cells are listed as they are; larger ones are pruned to their contenders first.
LISTED_CELLS = 320


def _cell_lists(scored: DataFrame, by: list[str], photo: str, slots: int, cell: Column, name: str) -> DataFrame:
    """(by, ``name``): the cells of every group, of a large one those of the contenders only."""
    rows = scored.select(*by, photo, "slot", "score")
    hot = hot_groups(rows, by, LISTED_CELLS)
    if hot and by:
        keys = hot.keys.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)))
        large = rows.join(keys, same, "left_semi")
        rows = rows.join(keys, same, "left_anti").unionByName(_contenders(large, by, photo, slots))
    elif hot:
        rows = _contenders(rows, by, photo, slots)
    return rows.groupBy(*by).agg(F.collect_list(cell).alias(name))


def greedy_assignment(scored: DataFrame, by: Sequence[str], photo: str, slots: int = len(SLOTS)) -> DataFrame:
    """(by, slot, photo, score): take triples by score, photo, slot while both ends are free.

    A group has at most ``LISTED_CELLS`` triples, or slots * slots after pruning, so the fold over them is a
    small array expression however many photos the group has.
    """
    by = list(by)
    triple = F.struct((-F.col("score")).alias("cost"), F.col(photo).alias("photo"), F.col("slot").alias("slot"))
    lists = _cell_lists(scored, by, photo, slots, triple, "__t")
    element = scored.select(triple.alias("t")).schema["t"].dataType.simpleString()
    taken = F.aggregate(
        "__t",
        F.array().cast(f"array<{element}>"),
        lambda acc, t: F.when(
            F.exists(acc, lambda a: (a["photo"] == t["photo"]) | (a["slot"] == t["slot"])), acc
        ).otherwise(F.concat(acc, F.array(t))),
    )
    return lists.withColumn("__t", F.sort_array("__t")).select(*by, F.explode(taken).alias("t")).select(
        *by, F.col("t.slot").alias("slot"), F.col("t.photo").alias(photo), (-F.col("t.cost")).alias("score")
    )


def best_assignment(scored: DataFrame, by: Sequence[str], photo: str, slots: int = len(SLOTS)) -> DataFrame:
    """(by, slot, photo, score) with the largest total score, filling as many slots as possible.

    Exact for any number of photos: some best matching only uses each slot's best ``slots``
    photos. Equal totals go to the smaller photo, slot by slot.
    """
    by = list(by)
    photo_type = scored.schema[photo].dataType.simpleString()
    cell = F.struct(F.col("slot").cast("int").alias("slot"), F.col(photo).alias("photo"), F.col("score").cast("double").alias("score"))
    lists = _cell_lists(scored, by, photo, slots, cell, "cells")

    @F.arrow_udf(f"array<struct<slot:int,photo:{photo_type},score:double>>")
    def match(cells: pa.Array) -> pa.Array:
        return _best_matchings(cells, slots)

    return lists.select(*by, F.explode(match("cells")).alias("m")).select(
        *by, F.col("m.slot").alias("slot"), F.col("m.photo").alias(photo), F.col("m.score").alias("score")
    )


# Sets of used photos that are followed at once; groups that need more are matched one by one.
MATCHED_SETS = 200_000


def _best_matchings(lists: pa.Array, slots: int) -> pa.Array:
    """``_best_matching`` of many groups: those with as many photos and slots go through the sets of used photos together."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = lists.flatten()
    group = np.repeat(np.arange(len(sizes)), sizes)
    told = flat.field("photo").dictionary_encode(null_encoding="encode")
    rank = np.empty(len(told.dictionary), dtype=np.int64)
    rank[np.asarray(pc.sort_indices(told.dictionary))] = np.arange(len(rank))
    photo = rank[np.asarray(told.indices)]
    score = flat.field("score").to_numpy(zero_copy_only=False).astype(float)
    kinds, slot = np.unique(np.asarray(flat.field("slot")), return_inverse=True)
    # A slot needs no more than its best few photos.
    by = np.lexsort((photo, -score, slot, group))
    new = np.flatnonzero(np.r_[True, (np.diff(group[by]) != 0) | (np.diff(slot[by]) != 0)][: len(by)])
    place = np.arange(len(by)) - np.repeat(new, np.diff(np.r_[new, len(by)]))
    few = by[place < slots]
    group, slot, photo, score = group[few], slot[few], photo[few], score[few]
    first_few, at = np.unique(group * max(1, len(rank)) + photo, return_index=True)
    owner = group[at]
    begins = np.searchsorted(owner, np.arange(len(sizes)))
    local = np.searchsorted(first_few, group * max(1, len(rank)) + photo) - begins[group]
    photos = np.bincount(owner, minlength=len(sizes))
    slots_of = np.bincount(np.unique(group * max(1, len(kinds)) + slot) // max(1, len(kinds)), minlength=len(sizes))
    must = np.minimum(photos, slots_of)
    cell_at = np.searchsorted(group, np.arange(len(sizes) + 1))
    rows: list[tuple] = []  # group, slot, cell of the photo, score; as arrays
    for n, m in sorted(set(zip(photos.tolist(), must.tolist())) - {(0, 0)}):
        those = np.flatnonzero((photos == n) & (must == m))
        sets = sum(comb(n, k) for k in range(m + 1))
        if sets > MATCHED_SETS or (n + 1) ** len(kinds) >= 2**62:
            for g in those:
                mine = range(cell_at[g], cell_at[g + 1])
                picks = _best_matching([{"photo": int(local[c]), "slot": int(slot[c]), "score": float(score[c])} for c in mine], slots)
                rows += [([g], [p["slot"]], [at[begins[g] + p["photo"]]], [p["score"]]) for p in picks]
            continue
        step = max(1, MATCHED_SETS // sets)
        for part in (those[i : i + step] for i in range(0, len(those), step)):
            value = np.full((len(kinds), n, len(part)), -np.inf)
            number = np.full(len(sizes), -1)
            number[part] = np.arange(len(part))
            mine = np.flatnonzero(number[group] >= 0)
            np.fmax.at(value, (slot[mine], local[mine], number[group[mine]]), score[mine])
            picks = _matched(value, m)
            for k in range(len(kinds)):
                hit = np.flatnonzero(picks[k] < n)
                rows.append((part[hit], np.full(len(hit), k), at[begins[part[hit]] + picks[k][hit]], value[k, picks[k][hit], hit]))
    g, k, c, v = (np.concatenate([np.asarray(r[i]) for r in rows]) if rows else np.empty(0, int) for i in range(4))
    order = np.lexsort((k, g))
    ends = np.r_[0, np.cumsum(np.bincount(g[order].astype(np.int64), minlength=len(sizes)))].astype(np.int32)
    names = flat.field("photo").take(pa.array(few[c[order].astype(np.int64)]))
    made = pa.StructArray.from_arrays(
        [pa.array(kinds[k[order].astype(np.int64)], pa.int32()), names, pa.array(v[order], pa.float64())], ["slot", "photo", "score"]
    )
    return pa.ListArray.from_arrays(pa.array(ends), made)


def _matched(value: np.ndarray, must: int) -> np.ndarray:
    """The photo of every slot in the best matching of each group, or their number for none.

    ``value`` is (slot, photo, group). A set of used photos keeps its best total and, for equal totals, the smallest
    picks, read as the digits of one number.
    """
    count, n, groups = value.shape
    marks = np.array(sorted(sum(1 << p for p in c) for k in range(must + 1) for c in combinations(range(n), k)), dtype=np.int64)
    size = np.array([int(x).bit_count() for x in marks])
    total, code = np.full((len(marks), groups), -np.inf), np.zeros((len(marks), groups), dtype=np.int64)
    total[0] = 0.0

    def better(t, c, other, its):
        return (t > other + 1e-9) | ((np.abs(t - other) <= 1e-9) & (c < its))

    with np.errstate(invalid="ignore"):
        for k in range(count):
            grown, picks = total.copy(), code * (n + 1) + n
            # Sets that the slots left cannot fill any more go nowhere.
            live = (size < must) & (size <= k) & (size + count - k >= must)
            for p in range(n):
                source = np.flatnonzero(live & (marks >> p & 1 == 0))
                target = np.searchsorted(marks, marks[source] | 1 << p)
                t, c = total[source] + value[k, p], code[source] * (n + 1) + p
                keep = better(t, c, grown[target], picks[target])
                grown[target] = np.where(keep, t, grown[target])
                picks[target] = np.where(keep, c, picks[target])
            total, code = grown, picks
    full = np.flatnonzero(size == must)
    top = total[full].max(axis=0)
    best = np.where(total[full] >= top - 1e-9, code[full], np.iinfo(np.int64).max).min(axis=0)
    short = np.flatnonzero(np.isneginf(top))  # too few cells to fill that many slots
    out = np.array([best // (n + 1) ** (count - 1 - k) % (n + 1) for k in range(count)])
    if len(short):
        out[:, short] = _matched(value[:, :, short], must - 1) if must else n
    return out


def _best_matching(cells, slots: int) -> list[dict]:
    """Best matching of a few (slot, photo, score) cells; a state is the set of used photos."""
    names = sorted({c["photo"] for c in cells})
    bit = {p: 1 << n for n, p in enumerate(names)}
    per_slot: dict[int, list] = {}
    for c in cells:
        per_slot.setdefault(c["slot"], []).append((bit[c["photo"]], c["score"]))
    order = sorted(per_slot)
    must = min(len(order), len(names))
    # used photos -> (total, picks); the number of set bits is the number of filled slots.
    states = {0: (0.0, ())}

    def better(new, old):
        if abs(new[0] - old[0]) > 1e-9:
            return new[0] > old[0]
        return new[1] < old[1]

    for n, slot in enumerate(order):
        grown: dict = {}
        left = len(order) - n - 1
        for used, (total, picks) in states.items():
            for mark, score in per_slot[slot]:
                if not used & mark:
                    value = (total + score, (*picks, (slot, mark, score)))
                    key = used | mark
                    if key not in grown or better(value, grown[key]):
                        grown[key] = value
            # Leaving the slot empty must still allow the required number of slots.
            if used.bit_count() + left >= must and (used not in grown or better((total, picks), grown[used])):
                grown[used] = (total, picks)
        states = grown
    best = None
    for used, value in states.items():
        if used.bit_count() == must and (best is None or better(value, best)):
            best = value
    return [{"slot": s, "photo": names[m.bit_length() - 1], "score": v} for s, m, v in best[1]]


# -- ranks ------------------------------------------------------------------------ #
def rank_fractions(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the mean rank of ``value`` in its group as a fraction of 0..1 (.5 for one row).

    Works on counts per distinct value, so a huge group of equal values is one row.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__ties"))
    sizes = counts.groupBy(*by).agg(F.sum("__ties").alias("__size"))
    running = OrderedGroups(counts, by, [F.col(value)]).running_sum(F.col("__ties"), "__upto").df
    first = F.col("__upto") - F.col("__ties")
    share = F.when(F.col("__size") <= 1, F.lit(0.5)).otherwise(
        (first + (F.col("__ties") - 1) / 2.0) / (F.col("__size") - 1)
    )
    return df.join(running.join(sizes, by).select(*by, value, share.alias(name)), [*by, value])


def pair_by_rank(
    photos: DataFrame, slots: DataFrame, by: Sequence[str], photo: str, photo_aspect: str, photo_order: str,
    slot: str, slot_aspect: str,
) -> DataFrame:
    """(by, slot, photo): the k-th narrowest photo goes to the k-th narrowest slot.

    The first photos in ``photo_order`` take part, as many as there are slots; the rest follow in
    order with a null slot.
    """
    by = list(by)
    hot, hot_slots = hot_groups(photos, by), hot_groups(slots, by)
    counts = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("__m"))
    placed = OrderedGroups(photos, by, [F.col(photo_order), F.col(photo)], hot=hot).position("__p").df.join(counts, by, "left")
    inside = placed.filter(F.col("__p") < F.col("__m"))
    extra = placed.filter((F.col("__p") >= F.col("__m")) | F.col("__m").isNull())
    # Fewer photos than slots: only the first slots are filled.
    n = photos.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    used = OrderedGroups(slots, by, [F.col(slot)], hot=hot_slots).position("__p").df.join(n, by).filter(F.col("__p") < F.col("__n")).drop("__p")
    one = OrderedGroups(inside.drop("__m"), by, [F.col(photo_aspect), F.col("__p")], hot=hot).position("__k").df
    two = OrderedGroups(used, by, [F.col(slot_aspect), F.col(slot)], hot=hot_slots).position("__k").df
    pairs = two.select(*by, "__k", slot).join(one.select(*by, "__k", photo), [*by, "__k"])
    return pairs.select(*by, slot, photo).unionByName(
        extra.select(*by, F.lit(None).cast(slots.schema[slot].dataType).alias(slot), photo)
    )


def hero_pick(df: DataFrame, by: Sequence[str], photo: str, face_area: Column, pixels: Column) -> DataFrame:
    """One photo per group: largest face, then most pixels, then the first."""
    key = F.struct((-F.coalesce(face_area, F.lit(0.0))).alias("f"), (-pixels).alias("p"), F.col(photo).alias("o"))
    return first_row(df, list(by), key)


def frame_assignment(
    spreads: DataFrame, by: Sequence[str], photo: str, photo_order: str, aspect: str, faces: str, frames: DataFrame,
) -> DataFrame:
    """(by, frame, photo): the cheapest pairing of the photos of a spread with its frames.

    Cost is the difference of log aspects plus a charge for crowded photos in small frames.
    ``frames`` has (by, frame, frame_aspect, frame_area). Spreads with up to seven photos are
    solved exactly; larger ones are paired by aspect rank.
    """
    by = list(by)
    photo_type = spreads.schema[photo].dataType.simpleString()
    n_photos = spreads.groupBy(*by).agg(F.count(F.lit(1)).alias("__np"))
    n_frames = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("__nf"))
    sizes = n_photos.join(n_frames, by).withColumn("__n", F.least("__np", "__nf"))
    ranked_photos = OrderedGroups(spreads, by, [F.col(photo_order), F.col(photo)]).position("__i").df.join(sizes.select(*by, "__n"), by)
    ranked_photos = ranked_photos.filter(F.col("__i") < F.col("__n"))
    ranked_frames = OrderedGroups(frames, by, [F.col("frame")]).position("__j").df.join(sizes.select(*by, "__n"), by)
    ranked_frames = ranked_frames.filter(F.col("__j") < F.col("__n"))
    small = F.col("__n") <= EXHAUSTIVE
    # At most seven photos and frames per spread reach the lists below.
    p = rank_fractions(ranked_photos.filter(small), by, faces, "__crowd").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("__i", F.col(photo).alias("photo"), F.col(aspect).alias("aspect"), "__crowd"))).alias("ps")
    )
    f = rank_fractions(ranked_frames.filter(small), by, "frame_area", "__room").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("__j", "frame", F.col("frame_aspect").alias("aspect"), "__room"))).alias("fs")
    )

    @F.pandas_udf(f"array<struct<frame:int,photo:{photo_type}>>")
    def solve(ps: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([_cheapest(a, b) for a, b in zip(ps, fs)])

    exact = p.join(f, by).select(*by, F.explode(solve("ps", "fs")).alias("m")).select(
        *by, F.col("m.frame").alias("frame"), F.col("m.photo").alias(photo)
    )
    big_photos, big_frames = ranked_photos.filter(~small).drop("__n"), ranked_frames.filter(~small).drop("__n")
    rough = pair_by_rank(big_photos, big_frames, by, photo, aspect, photo_order, "frame", "frame_aspect")
    return exact.unionByName(rough.filter(F.col("frame").isNotNull()).select(*by, F.col("frame").cast("int").alias("frame"), photo))


def _cheapest(photos, frames) -> list[dict]:
    """Exhaustive search over at most seven photos; the first of equal pairings wins.

    Totals that differ by rounding noise only (nine places) count as equal.
    """
    from itertools import permutations

    import numpy as np

    log = lambda values: np.log(np.maximum(np.array(values, float), 1e-3))
    shape = np.abs(log([f["aspect"] for f in frames])[:, None] - log([p["aspect"] for p in photos])[None, :])
    room = 1.0 - np.array([f["__room"] for f in frames])
    crowd = np.array([p["__crowd"] for p in photos])
    cost = shape + CROWD_WEIGHT * (crowd[None, :] * room[:, None])
    ways = np.array(list(permutations(range(len(photos)))))
    totals = np.zeros(len(ways))
    for row in range(len(frames)):
        totals = totals + cost[row, ways[:, row]]
    best = ways[int(np.argmin(np.round(totals, 9)))]
    return [{"frame": f["frame"], "photo": photos[i]["photo"]} for f, i in zip(frames, best)]


# -- pacing ------------------------------------------------------------------------ #
# Rhythms and per-kind counts.
RHYTHMS = {"editorial": (1.35, 1.0, 1.3, 0.35), "gentle": (1.3, 1.0, 0.7, 1.0)}
PER_SPREAD = {"cover": 1, "couple": 1, "portraits": 2, "family": 4, "highlights": 3, "ceremony": 3, "closing": 3}
DEFAULT_PER_SPREAD = 3
HERO_KINDS = ("cover", "couple")
DENSITY = {"spacious": (0.5, 4), "balanced": (1.0, 4), "dense": (1.8, 6)}
TARGET_PAGES = 25


def spread_budget(sections: DataFrame, by: Sequence[str], kind: str, photos: str, density: str = "balanced", target_pages: int | None = None) -> DataFrame:
    """Add ``per_spread``: photos per spread of each section.

    Hero kinds always get one. The others get their own count scaled by density, raised to what
    the page budget of the whole album needs.
    """
    by = list(by)
    factor, cap = DENSITY.get(density, DENSITY["balanced"])
    scaled = {k: min(max(1, round(n * factor)), cap) for k, n in PER_SPREAD.items()}
    default = min(max(1, round(DEFAULT_PER_SPREAD * factor)), cap)
    pages = max(1, (target_pages or TARGET_PAGES) - 1)
    counted = F.coalesce(F.sum(F.when(F.col(kind) != "cover", F.col(photos))), F.lit(0))
    totals = sections.groupBy(*by).agg(counted.alias("__total")).withColumn(
        "__budget",
        F.when(F.col("__total") <= 0, F.lit(default)).otherwise(F.greatest(F.lit(2), F.ceil(F.col("__total") / pages))).cast("long"),
    )
    own = F.coalesce(F.create_map(*[F.lit(x) for p in scaled.items() for x in p])[F.col(kind)], F.lit(default))
    return sections.join(totals, by).withColumn(
        "per_spread",
        F.when(F.col(kind).isin(*HERO_KINDS), F.lit(1)).otherwise(F.greatest(own, F.col("__budget"))).cast("long"),
    ).drop("__total", "__budget")


def pace_counts(df: DataFrame, by: Sequence[str], total: str, per_spread: str, cap: int, rhythm: str = "editorial") -> DataFrame:
    """(by, spread, photos): one row per spread of each section, counts following a rhythm.

    The four weights of a rhythm repeat, so the raw counts of a section take four values and the
    largest-remainder step is arithmetic on the spread number. Bringing counts into 1..cap one
    unit at a time ends at a level, which the histogram of counts gives; only the spreads at that
    level need their rank. No array ever holds a section.
    """
    by = list(by)
    weights = RHYTHMS.get(rhythm)
    per = F.greatest(F.lit(1), F.col(per_spread).cast("long"))
    base = (
        df.filter(F.col(total) > 0)
        .select(*by, F.col(total).cast("long").alias("T"), per.alias("P"))
        .withColumn("N", F.ceil(F.col("T") / F.col("P")).cast("long"))
    )
    cap = max(1, int(cap))
    if weights is None:
        plain, paced = base, None
    else:
        plain_test = (F.col("P") <= 1) | (F.col("N") < 3) | (F.col("N") * cap < F.col("T"))
        plain, paced = base.filter(plain_test), base.filter(~plain_test)
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("N") - 1)).alias("spread")
    uniform = plain.select("*", spread).select(
        *by, "spread", F.least(F.col("P"), F.col("T") - F.col("spread") * F.col("P")).alias("photos")
    )
    if paced is None:
        return uniform
    # How many spreads a section gets is known before any of them is made.
    hot = listed_groups(paced.filter(F.col("N") > HOT_ROWS).select(*by))
    return uniform.unionByName(_repair(_apportion(paced, by, weights, spread), by, cap, hot))


def _apportion(paced: DataFrame, by: list[str], weights: tuple, spread: Column) -> DataFrame:
    """Largest-remainder counts per spread; ties in the remainder go to the earlier spread."""
    size = len(weights)
    beats = F.lit(list(range(size)))

    def before(k: Column, c: Column) -> Column:
        """How many of the first ``k`` spreads have beat ``c``."""
        return F.floor((k + (size - 1) - c) / size)

    # Everything that depends on the section alone is an array over the four beats.
    known = (
        paced.withColumn("W", F.lit([float(w) for w in weights]))
        .withColumn("M", F.transform(beats, lambda c: before(F.col("N"), c)))
        .withColumn("scale", F.col("T") / F.aggregate(F.zip_with("M", "W", lambda m, w: m * w), F.lit(0.0), lambda a, x: a + x))
        .withColumn("raw", F.transform("W", lambda w: w * F.col("scale")))
        .withColumn("low", F.transform("raw", lambda r: F.floor(r)))
        .withColumn("rest", F.zip_with("raw", "low", lambda r, f: F.round(r - f, 9)))
        .withColumn(
            "short", F.col("T") - F.aggregate(F.zip_with("M", "low", lambda m, f: m * f), F.lit(0).cast("long"), lambda a, x: a + x)
        )
    )
    rows = known.select("*", spread).withColumn("beat", (F.col("spread") % size).cast("int"))
    rows = rows.withColumn("own", F.get("rest", F.col("beat")))
    # Spreads served before this one: larger remainders anywhere, equal ones further left.
    ahead = F.aggregate(
        F.transform(
            beats,
            lambda c: F.when(F.get("rest", c) > F.col("own"), F.get("M", c))
            .when(F.get("rest", c) == F.col("own"), before(F.col("spread"), c)).otherwise(0),
        ),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    extra = (ahead < F.col("short")).cast("int")
    return rows.select(*by, "spread", (F.get("low", F.col("beat")) + extra).cast("long").alias("photos"))


def _repair(counts: DataFrame, by: list[str], cap: int, hot: HotGroups) -> DataFrame:
    """Move units until every count lies in 1..cap: from the fullest, then to the emptiest."""
    counts = _level(counts, by, need=F.greatest(F.lit(0), 1 - F.col("photos")), down=True, bound=1, hot=hot)
    counts = counts.withColumn("photos", F.greatest(F.col("photos"), F.lit(1)))
    counts = _level(counts, by, need=F.greatest(F.lit(0), F.col("photos") - cap), down=False, bound=cap, hot=hot)
    return counts.withColumn("photos", F.least(F.col("photos"), F.lit(cap)).cast("long"))


def _level(counts: DataFrame, by: list[str], need: Column, down: bool, bound: int, hot: HotGroups) -> DataFrame:
    """Take ``need`` units per section from the fullest spreads (or give them to the emptiest).

    Working one unit at a time flattens the counts to a level; what is left over goes to the
    first spreads standing at it.
    """
    sections = counts.groupBy(*by).agg(F.sum(need).alias("__need"), F.max("photos").alias("__top"), F.min("photos").alias("__low"))
    sections = sections.filter(F.col("__need") > 0)
    # Candidate levels: between the bound and the extreme count of the section.
    edge = F.lit(bound).cast("long")
    span = (edge, F.greatest("__top", edge)) if down else (F.least("__low", edge), edge)
    levels = sections.withColumn("level", F.explode(F.sequence(*span)))
    histogram = counts.groupBy(*by, "photos").agg(F.count(F.lit(1)).alias("__c"))
    over = F.col("photos") - F.col("level") if down else F.col("level") - F.col("photos")
    fits = (
        levels.join(histogram, by).groupBy(*by, "level", "__need")
        .agg(F.sum(F.greatest(F.lit(0), over) * F.col("__c")).alias("__moved"))
        .filter(F.col("__moved") <= F.col("__need"))
    )
    pick = F.min if down else F.max
    chosen = fits.groupBy(*by).agg(pick(F.struct("level", "__moved", "__need")).alias("__l"))
    chosen = chosen.select(*by, F.col("__l.level").alias("level"), (F.col("__l.__need") - F.col("__l.__moved")).alias("__left"))
    placed = counts.join(chosen, by, "left")
    at_level = (F.col("photos") >= F.col("level")) if down else (F.col("photos") <= F.col("level"))
    # The last unit round stops at the bound.
    room = (F.col("level") > bound) if down else (F.col("level") < bound)
    flat = F.when(at_level, F.col("level")).otherwise(F.col("photos"))
    placed = placed.withColumn("__flat", F.coalesce(flat, F.col("photos")))
    ranked = OrderedGroups(
        placed.withColumn("__at", F.coalesce(at_level & room, F.lit(False)).cast("int")), by, [F.col("spread")], hot=hot
    ).running_sum(F.col("__at"), "__rank").df
    step = F.when((F.col("__at") == 1) & (F.col("__rank") <= F.col("__left")), 1).otherwise(0)
    return ranked.select(*by, "spread", (F.col("__flat") - step if down else F.col("__flat") + step).cast("long").alias("photos"))


def chunk_by_counts(items: DataFrame, counts: DataFrame, by: Sequence[str], order: list[Column]) -> DataFrame:
    """Add ``spread`` to items filled in order into spreads of the given sizes.

    Items beyond the counts form one extra spread. Each spread lists its own positions, so the
    join is on equality.
    """
    by = list(by)
    placed = OrderedGroups(items, by, order).position("__pos").df
    ends = OrderedGroups(counts.filter(F.col("photos") > 0), by, [F.col("spread")]).running_sum(F.col("photos"), "__end").df
    slots = ends.select(
        *by, "spread",
        F.explode(F.sequence(F.col("__end") - F.col("photos"), F.col("__end") - 1)).alias("__pos"),
    )
    extra = counts.groupBy(*by).agg((F.max("spread") + 1).alias("__extra"))
    return (
        placed.join(slots, [*by, "__pos"], "left").join(extra, by, "left")
        .withColumn("spread", F.coalesce("spread", "__extra", F.lit(0)).cast("long"))
        .drop("__pos", "__extra")
    )


# -- rules and variants --------------------------------------------------------------- #
RULES = ("no_repetition", "vary_orientations", "detail_not_at_ends", "wide_in_center")


def layout_violations(slots: DataFrame, by: Sequence[str], order: str, composition: str, aspect: str) -> DataFrame:
    """One row per spread with a flag per broken rule."""
    by = list(by)
    n = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    walk = OrderedGroups(slots.withColumn("__o", orientation(aspect)), by, [F.col(order)])
    walk.position("__pos").previous(composition, "__c1").previous("__o", "__o1").previous("__o1", "__o2")
    rows = walk.df.join(n, by)
    end = (F.col("__pos") == 0) | (F.col("__pos") == F.col("__n") - 1)
    flags = {
        "no_repetition": F.col(composition) == F.col("__c1"),
        "vary_orientations": (F.col("__o") == F.col("__o1")) & (F.col("__o") == F.col("__o2")),
        "detail_not_at_ends": (F.col("__n") >= 2) & end & (F.col(composition) == "detail"),
        "wide_in_center": (F.col("__n") >= 3) & end & (F.col("__o") == "landscape"),
    }
    return rows.groupBy(*by).agg(
        *[F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False)).alias(name) for name, test in flags.items()]
    )


def layout_penalty(violations: DataFrame, rules: Sequence[str] = RULES, registry: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``penalty``: how many of the named rules are broken; unknown names are skipped.

    ``registry`` maps further rule names to boolean columns of ``violations``.
    """
    known = {name: F.col(name) for name in RULES} | dict(registry or {})
    broken = [known[r].cast("int") for r in rules if r in known]
    return violations.withColumn("penalty", reduce(lambda a, b: a + b, broken, F.lit(0)))


VARIANT_TOLERANCE = 0.15


def choose_variant(spreads: DataFrame, variants: DataFrame, by: Sequence[str], aspects: str, index: str, avoid_gutter: bool = False) -> DataFrame:
    """Pick a template per spread: best orientation match, rotated by ``index`` among near equals.

    ``spreads`` has an array of photo aspects; ``variants`` has (count, variant, frame_aspects,
    crosses_gutter) and is a template library: a few rows per photo count, never data.
    """
    by = list(by)
    logs = lambda a: F.transform(F.array_sort(a), lambda x: F.ln(F.greatest(x, F.lit(1e-3))))
    library = variants.withColumn("__fl", logs(F.col("frame_aspects")))
    rows = spreads.withColumn("count", F.size(aspects)).withColumn("__pl", logs(F.col(aspects)))
    paired = rows.join(F.broadcast(library), "count")
    gap = F.aggregate(F.zip_with("__fl", "__pl", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    cell = F.struct(gap.alias("gap"), F.col("variant"), F.col("crosses_gutter"))
    lists = paired.groupBy(*by, index).agg(F.sort_array(F.collect_list(cell)).alias("__v"))
    if avoid_gutter:
        safe = F.filter("__v", lambda v: ~v["crosses_gutter"])
        lists = lists.withColumn("__v", F.when(F.size(safe) > 0, safe).otherwise(F.col("__v")))
    best = F.element_at("__v", 1)["gap"]
    close = F.filter("__v", lambda v: v["gap"] <= best + VARIANT_TOLERANCE)
    chosen = F.get(close, F.pmod(F.col(index), F.size(close)).cast("int"))
    return lists.select(*by, index, chosen["variant"].alias("variant"), chosen["gap"].alias("gap"))


def rotate_variant(spreads: DataFrame, variants: DataFrame, count: str, index: str) -> DataFrame:
    """Simple form: the ``index``-th template (modulo) with exactly this many photos, null if none."""
    library = variants.groupBy("count").agg(F.sort_array(F.collect_list("variant")).alias("__v"))
    joined = spreads.join(F.broadcast(library), spreads[count] == library["count"], "left").drop(library["count"])
    return joined.withColumn(
        "variant", F.get("__v", F.pmod(F.col(index), F.size("__v")).cast("int"))
    ).drop("__v")


def layout_hint(df: DataFrame, by: Sequence[str], aspect: str) -> DataFrame:
    """mosaic for mixed shapes, grid for alike ones, feature for a single photo."""
    spread = F.max(aspect) / F.greatest(F.lit(1e-6), F.min(aspect))
    n = F.count(F.lit(1))
    hint = F.when(n == 0, "mosaic").when(n == 1, "feature").when(spread > 1.6, "mosaic").otherwise("grid")
    return df.groupBy(*by).agg(hint.alias("layout"), n.alias("photos"))


def grid_dimensions(count: Column, aspect: Column) -> Column:
    """struct(cols, rows) of the squarest grid for ``count`` photos on a canvas."""
    n = count.cast("long")

    def option(cols: Column) -> Column:
        rows = F.ceil(n / cols).cast("long")
        penalty = F.abs(F.ln(aspect / cols * rows)) + (cols * rows - n) * 0.04
        return F.struct(penalty.alias("penalty"), cols.alias("cols"), rows.alias("rows"))

    best = F.array_min(F.transform(F.sequence(F.lit(1).cast("long"), n), option))
    return F.struct(best["cols"].alias("cols"), best["rows"].alias("rows"))


def sheet_fill(entries: DataFrame, by: Sequence[str], order: list[Column], copies: str, cols: int, rows: int) -> DataFrame:
    """(entry columns, tile, row, col): copies placed in order into a sheet until it is full.

    Only the first ``cols * rows`` entries with a copy can matter.
    """
    by = list(by)
    capacity = cols * rows
    wanted = top_n(entries.filter(F.col(copies) > 0), by, order, capacity)
    ends = OrderedGroups(wanted, by, order, hot=HotGroups(None, False)).running_sum(F.col(copies), "__end").df
    start = (F.col("__end") - F.col(copies)).cast("long")
    last = F.least(F.col("__end").cast("long"), F.lit(capacity).cast("long")) - 1
    tiles = ends.filter(start < capacity).withColumn("tile", F.explode(F.sequence(start, last)))
    return tiles.drop("__end").withColumns(
        {"row": F.floor(F.col("tile") / cols).cast("long"), "col": (F.col("tile") % cols).cast("long")}
    )
