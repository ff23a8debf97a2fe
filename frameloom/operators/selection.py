"""Categories, rankings, top lists, sections and stories over scored photos."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.functions.quality import BEST, CATEGORIES, Weights, category, quality_tier
from frameloom.operators.ordered import HotGroups, OrderedGroups, first_row, hot_groups, top_n

# Sizes of the automatic sections.
HIGHLIGHTS, CLOSING, FAMILY_FACES, PORTRAIT_FACES = 24, 8, 3, 1
SHORTLIST_FACTOR = 3


# -- categories --------------------------------------------------------------- #
def best_shot(score: Column, usable: Column, duplicate: Column, floor: float = BEST) -> Column:
    """Usable, no duplicate and scored at least ``floor``; a missing verdict counts as no."""
    return (
        ~F.coalesce(duplicate, F.lit(False))
        & F.coalesce(usable, F.lit(False))
        & F.coalesce(score >= floor, F.lit(False))
    )


def best_shots(df: DataFrame, path: str, score: str, usable: str, duplicate: str) -> DataFrame:
    """The best shots, best first."""
    keep = best_shot(F.col(score), F.col(usable), F.col(duplicate))
    return df.filter(keep).orderBy(F.col(score).desc(), F.col(path))


def flag_members(df: DataFrame, path: str, members: DataFrame, flag: str) -> DataFrame:
    """Boolean column: is the path among ``members`` (one column, any repeats)?"""
    keys = members.select(F.col(members.columns[0]).alias("__m")).distinct()
    return (
        df.join(keys, F.col(path) == F.col("__m"), "left")
        .withColumn(flag, F.col("__m").isNotNull())
        .drop("__m")
    )


def flag_lists(df: DataFrame, path: str, members: Mapping[str, DataFrame]) -> DataFrame:
    """``flag_members`` for several lists at once: they move together as bits of one number a path, and ``df`` moves once."""
    bits = {flag: F.lit(1 << i).cast("long") for i, flag in enumerate(members)}
    listed = reduce(DataFrame.unionAll, (m.select(F.col(m.columns[0]).alias("__m"), bits[flag].alias("__bit")) for flag, m in members.items()))
    marks = listed.groupBy("__m").agg(F.bit_or("__bit").alias("__bits"))
    joined = df.join(marks, F.col(path) == F.col("__m"), "left")
    found = F.coalesce("__bits", F.lit(0).cast("long"))
    return joined.withColumns({flag: found.bitwiseAND(bit) != 0 for flag, bit in bits.items()}).drop("__m", "__bits")


def quality_with_faces(scored: DataFrame, faces: DataFrame, path: str) -> DataFrame:
    """Attach the face verdict; a photo without one has no face."""
    return scored.join(faces, path, "left").withColumns(
        {
            "faces_detected": F.coalesce("faces_detected", F.lit(False)),
            "face_count": F.coalesce("face_count", F.lit(0)),
        }
    )


def face_weight_for_run(faces: DataFrame, failed: str, weights: Weights = Weights()) -> Column:
    """The face weight of a run: zero when face detection failed on every photo.

    A scalar subquery over a one-row aggregate, usable inside any expression.
    """
    verdict = faces.agg(
        F.when(F.coalesce(F.bool_and(failed), F.lit(False)), F.lit(0.0))
        .otherwise(F.lit(weights.face)).alias("w")
    )
    return verdict.scalar()


def inventory(scored: DataFrame, path: str, score: str, usable: str, duplicate: str) -> DataFrame:
    """One record per scored photo: tier, category and flags. Unscored photos are absent."""
    best = best_shot(F.col(score), F.col(usable), F.col(duplicate))
    return (
        scored.filter(F.col(score).isNotNull())
        .withColumn("is_best_shot", best)
        .withColumn("is_duplicate", F.coalesce(F.col(duplicate), F.lit(False)))
        .withColumn("category", category(F.col("is_best_shot"), F.col("is_duplicate"), F.col(usable)))
        .withColumn("tier", quality_tier(score))
    )


def candidate_pool(records: DataFrame) -> DataFrame:
    return records.filter(F.col("category").isin("BestShots", "Review"))


def category_counts(df: DataFrame, category_col: str = "category") -> DataFrame:
    """Photos per category; the four are always there."""
    domain = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "ord int, category string")
    found = df.groupBy(F.col(category_col).alias("category")).agg(F.count(F.lit(1)).alias("photos"))
    return domain.join(found, "category", "left").select(
        "ord", "category", F.coalesce("photos", F.lit(0)).cast("long").alias("photos")
    )


def grouped_category_counts(df: DataFrame, group: str, path: str, score: str, usable: str) -> DataFrame:
    """Photos per category straight from scored photos with their duplicate group: one aggregate a group.

    All of a group but its best are duplicates, so only the best needs its own category and no row is joined back.
    A photo without a group is the best of its own.
    """
    own = F.array_position(F.lit(list(CATEGORIES)), category(best_shot(F.col(score), F.col(usable), F.lit(False)), F.lit(False), F.col(usable)))
    key = F.struct((-F.coalesce(F.col(score), F.lit(-1.0))).alias("q"), F.col(path).alias("p"))
    rows = df.select(F.col(group).alias("g"), own.alias("own"), key.alias("key"))
    groups = rows.where("g IS NOT NULL").groupBy("g").agg(F.min_by("own", "key").alias("own"), (F.count(F.lit(1)) - 1).alias("more"))
    found = groups.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("more").alias("more"))
    alone = rows.where("g IS NULL").groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("more"))
    names, copies = F.lit(list(CATEGORIES)), list(CATEGORIES).index("Duplicates") + 1
    parts = F.explode(F.array(F.struct("own", "n"), F.struct(F.lit(copies).cast("long").alias("own"), F.col("more").alias("n"))))
    summed = found.unionAll(alone).select(parts.alias("c")).groupBy("c.own").agg(F.sum("c.n").alias("photos"))
    domain = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "ord int, category string")
    return domain.join(summed.select(F.get(names, (F.col("own") - 1).cast("int")).alias("category"), "photos"), "category", "left").select(
        "ord", "category", F.coalesce("photos", F.lit(0)).cast("long").alias("photos")
    )


def run_summary(records: DataFrame) -> DataFrame:
    """One row of totals. Expects the columns of ``inventory`` plus ``group_size``."""
    head = F.col("is_representative") & (F.col("group_size") >= 2)
    return records.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(head).alias("duplicate_groups"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
        F.count_if(F.col("category") == "Blurry").alias("blurry"),
        F.count_if(F.col("faces_detected")).alias("with_faces"),
        F.count("quality").alias("scored"),
        F.round(F.avg("quality"), 4).alias("mean_quality"),
    )


def optional_filters(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality filters; a value of None filters nothing."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return reduce(lambda d, t: d.filter(t), tests, df)


def require_faces(df: DataFrame, by: Sequence[str], has_face: str) -> DataFrame:
    """Keep face photos; a group without any face is kept whole. An unknown face is none; rows without a group are a group."""
    return _flagged_or_all(df, list(by), has_face)


def _flagged_or_all(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Rows with the flag; all rows of a group where no row has it. A missing flag counts as no, a missing key as a key."""
    has = F.coalesce(F.col(flag), F.lit(False))
    some = df.groupBy(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by))).agg(F.max(has).alias("__any"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)), F.lit(True))
    return df.join(some, same).filter(has | ~F.col("__any")).drop("__any", *(f"__by{i}" for i in range(len(by))))


# -- rankings ------------------------------------------------------------------ #
def quality_order(score: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(path)]


def time_order(time: str, path: str) -> list[Column]:
    return [F.col(time).asc_nulls_first(), F.col(path)]


def ranked(
    df: DataFrame, by: Sequence[str], order: list[Column], name: str = "pos",
    hot_rows: int | None = None, hot: HotGroups | None = None,
) -> DataFrame:
    return OrderedGroups(df, by, order, hot_rows, hot).position(name).df


def spread_selection(df: DataFrame, by: Sequence[str], path: str, score: str, count: int = 9, spread: bool = True) -> DataFrame:
    """``count`` photos per group, spread over the shoot; ``pick`` is their order.

    A short group is ranked by quality. Otherwise the best ``3 * count`` are put back in path
    order, cut into ``count`` windows and the best of each window is taken.
    """
    if count < 1:
        raise ValueError(f"count must be >= 1, got {count}")
    by = list(by)
    keep = count * SHORTLIST_FACTOR if spread else count
    short = top_n(df, by, [F.col(score).desc(), F.col(path)], keep)
    # At most ``keep`` rows per group from here on, so plain windows are bounded.
    group = Window.partitionBy(*by)
    placed = (
        ranked(ranked(short, by, [F.col(score).desc(), F.col(path)], "__q", hot=HotGroups(None, False)), by, [F.col(path)], "__p", hot=HotGroups(None, False))
        .withColumn("__n", F.count(F.lit(1)).over(group))
    )
    slot = F.floor(((F.col("__p") + 1) * count - 1) / F.col("__n")).cast("long")
    by_rank = (F.col("__n") <= count) | F.lit(not spread)
    placed = placed.withColumn("pick", F.when(by_rank, F.col("__q")).otherwise(slot))
    winner = F.struct((-F.col(score)).alias("q"), F.col("__p"))
    return first_row(placed, [*by, "pick"], winner).select(*df.columns, "pick")


def highlights(df: DataFrame, by: Sequence[str], path: str, score: str, best: str, cover: DataFrame, limit: int = HIGHLIGHTS) -> DataFrame:
    """The strongest photos per group without the cover; from the best shots if there are any."""
    keys = [*by, path]
    front = cover.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)))
    return top_n(_flagged_or_all(df, list(by), best).join(front, same, "left_anti"), list(by), quality_order(score, path), limit)


def closing(df: DataFrame, by: Sequence[str], time: str, path: str, count: int = CLOSING) -> DataFrame:
    """The last photos per group; a count of zero gives none."""
    return top_n(df, by, [F.col(time).desc_nulls_last(), F.col(path).desc()], max(count, 0))


def cover(df: DataFrame, by: Sequence[str], path: str, score: str, best: str, faces: str, prefer_faces: bool = True) -> DataFrame:
    """One photo per group: a best shot with faces if possible, then by quality."""
    pool = _flagged_or_all(df, list(by), best)
    face_first = (~F.coalesce(F.col(faces), F.lit(False)) if prefer_faces else F.lit(False)).cast("int")
    key = F.struct(face_first.alias("f"), (-F.coalesce(F.col(score), F.lit(0.0))).alias("q"), F.col(path).alias("p"))
    return first_row(pool, list(by), key)


def browse_order(df: DataFrame, category_col: str, name: Column) -> list[Column]:
    """Fixed category order, then lower-cased file name."""
    rank = F.array_position(F.lit(list(CATEGORIES)), F.col(category_col))
    return [rank, F.lower(name)]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing; end ``order`` with a unique key for stable pages."""
    return df.orderBy(*order).offset(offset).limit(limit)


# -- people on photos ---------------------------------------------------------- #
def has_label(present: Column, label: Column | str) -> Column:
    return F.array_contains(present, label)


def has_all(present: Column, labels: Column) -> Column:
    return F.size(F.array_except(labels, present)) == 0


def has_only(present: Column, label: Column | str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return (F.size(F.array_distinct(present)) == 1) & F.array_contains(present, label)


# -- sections ------------------------------------------------------------------ #
def rule_sections(
    photos: DataFrame, specs: Sequence[Mapping], by: Sequence[str], path: str, score: str, present: str,
    eligible: Column | None = None, events: DataFrame | None = None, hot: HotGroups | None = None,
) -> DataFrame:
    """Sections from rules, as (by, ordinal, section, pos, path).

    ``specs`` are mappings with name, kind (cover, couple, solo, group, event) and label,
    labels, event_index or limit. ``photos`` carries the labels present on each photo.
    ``events`` has (by, path, segment, pos) and ignores ``eligible``. A rule with a limit is
    cut before it is ranked.
    """
    by = list(by)
    pool = photos if eligible is None else photos.filter(eligible)
    if hot is None:
        hot = hot_groups(pool, by)
    parts = []
    for n, spec in enumerate(specs):
        kind, limit = spec["kind"], spec.get("limit")
        if limit is not None and limit < 0:
            raise ValueError("limit must be >= 0")
        if kind == "event":
            part = events.filter(F.col("segment") == spec["event_index"])
            part = part if limit is None else part.filter(F.col("pos") < limit)
            part = part.select(*by, F.col(path).alias("path"), "pos")
        else:
            tokens = F.col(present)
            if kind == "group":
                match = has_label(tokens, spec["label"])
            elif kind == "solo":
                match = has_only(tokens, spec["label"])
            elif kind in ("couple", "cover"):
                match = has_all(tokens, F.lit(list(spec.get("labels") or ("bride", "groom"))))
            else:
                raise ValueError(f"unknown section kind {kind!r}")
            part = pool.filter(match)
            if kind == "cover":
                limit = 1 if limit is None else min(limit, 1)
            if limit is not None:
                part = top_n(part, by, quality_order(score, path), limit)
            known = hot if limit is None else HotGroups(None, False)
            part = ranked(part, by, quality_order(score, path), hot=known).select(*by, F.col(path).alias("path"), "pos")
        parts.append(
            part.select(
                *by, F.lit(n).alias("ordinal"), F.lit(spec["name"]).alias("section"),
                F.col("pos").cast("long").alias("pos"), "path",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def sticky_edits(
    auto: DataFrame, added: DataFrame, removed: DataFrame, explicit: DataFrame, by: Sequence[str],
) -> DataFrame:
    """Replay manual edits on automatic sections, as (by, pos, path).

    All inputs are (by, path) with ``pos`` where order matters. Removed photos go, added ones
    follow the automatic ones, an explicit order comes first and the rest keeps its place.
    """
    by = list(by)
    key = [*by, "path"]
    base = auto.select(*key, F.lit(0).alias("__src"), "pos").unionByName(
        added.select(*key, F.lit(1).alias("__src"), "pos")
    )
    base = base.groupBy(*key).agg(F.min(F.struct("__src", "pos")).alias("__at"))
    base = base.join(removed.select(*key).distinct(), key, "left_anti")
    first = explicit.groupBy(*key).agg(F.min("pos").alias("__wish"))
    joined = base.join(first, key, "left")
    order = [F.col("__wish").asc_nulls_last(), F.col("__at.__src"), F.col("__at.pos"), F.col("path")]
    return ranked(joined, by, order).select(*by, "pos", "path")


def _told(df: DataFrame, by: list[str], path: str, score: str, time: str, sections: Sequence[tuple]) -> DataFrame:
    """Every row once for each section that wants it; a section is (ordinal, name, test, whether time orders it)."""
    moment = df.schema[time].dataType
    wanted = [
        F.when(test, F.struct(
            F.lit(n).alias("ordinal"), F.lit(name).alias("section"),
            F.when(F.lit(not timed), F.coalesce(F.col(score), F.lit(0.0))).cast("double").alias("__q"),
            F.when(F.lit(timed), F.col(time)).cast(moment).alias("__t"),
        ))
        for n, name, test, timed in sections
    ]
    return df.select(*by, F.col(path).alias("path"), F.inline(F.array_compact(F.array(*wanted))))


def _in_sections(told: Sequence[DataFrame], by: list[str], any_hot: bool) -> DataFrame:
    """(by, ordinal, section, pos, path): places in all sections by one ordering."""
    order = [F.col("__q").desc_nulls_first(), F.col("__t").asc_nulls_first(), F.col("path")]
    rows = reduce(DataFrame.unionByName, told)
    placed = ranked(rows, [*by, "ordinal", "section"], order, hot=None if any_hot else HotGroups(None, False))
    return placed.select(*by, "ordinal", "section", "pos", "path")


def story(
    pool: DataFrame, by: Sequence[str], path: str, score: str, time: str, best: str, faces: str, face_count: str,
) -> DataFrame:
    """Sections of an album without known people, as (by, ordinal, section, pos, path)."""
    by = list(by)
    front = cover(pool, by, path, score, best, faces)
    every, faces_on = F.lit(True), F.coalesce(F.col(face_count), F.lit(0))
    long = [
        (2, "Ceremony", every, True), (3, "Family", faces_on >= FAMILY_FACES, False),
        (4, "Portraits", faces_on == PORTRAIT_FACES, False),
    ]
    told = [
        _told(pool, by, path, score, time, long),
        _told(front, by, path, score, time, [(0, "Cover", every, False)]),
        _told(highlights(pool, by, path, score, best, front), by, path, score, time, [(1, "Highlights", every, False)]),
        _told(closing(pool, by, time, path), by, path, score, time, [(5, "Closing", every, True)]),
    ]
    # Every section is a part of the pool, so without a hot group there no section needs to be counted.
    return _in_sections(told, by, bool(hot_groups(pool, by)))


# The person sections of an album with known people.
PERSON_SECTIONS = (
    {"name": "Couple", "kind": "couple", "labels": ("bride", "groom")},
    {"name": "Bride", "kind": "solo", "label": "bride"},
    {"name": "Groom", "kind": "solo", "label": "groom"},
    {"name": "Bride Family", "kind": "group", "label": "family_bride"},
    {"name": "Groom Family", "kind": "group", "label": "family_groom"},
    {"name": "Close Family", "kind": "group", "label": "close_family"},
)


def story_with_people(pool: DataFrame, by: Sequence[str], path: str, score: str, time: str, present: str) -> DataFrame:
    """Sections of an album with labelled people; highlights draw on every photo by quality."""
    by = list(by)
    couple = has_all(F.col(present), F.lit(["bride", "groom"]))
    key = F.struct((~couple).cast("int").alias("c"), (-F.coalesce(F.col(score), F.lit(0.0))).alias("q"), F.col(path).alias("p"))
    front = first_row(pool, by, key)
    hot = hot_groups(pool, by)
    people = rule_sections(pool, PERSON_SECTIONS, by, path, score, present, hot=hot).withColumn(
        "ordinal", F.col("ordinal") + 1
    )
    rest = top_n(pool.join(front.select(*by, path), [*by, path], "left_anti"), by, quality_order(score, path), HIGHLIGHTS)
    n, every = len(PERSON_SECTIONS), F.lit(True)
    told = [
        _told(pool, by, path, score, time, [(n + 2, "Ceremony", every, True)]),
        _told(front, by, path, score, time, [(0, "Cover", every, False)]),
        _told(rest, by, path, score, time, [(n + 1, "Highlights", every, False)]),
        _told(closing(pool, by, time, path), by, path, score, time, [(n + 3, "Closing", every, True)]),
    ]
    return _in_sections(told, by, bool(hot)).unionByName(people)


def all_photos(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """Photos of all sections in album order, repeats kept, as (by, pos, path)."""
    order = [F.col("ordinal"), F.col("pos")]
    flat = OrderedGroups(sections, by, order).position("album_pos").df
    return flat.select(*by, F.col("album_pos").alias("pos"), "path")


def referenced_assets(sections: DataFrame, spreads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct photos of sections, then spreads, in first-seen order, as (by, pos, path).

    Both inputs are (by, ordinal, pos, path).
    """
    by = list(by)
    cols = [*by, "ordinal", "pos", "path"]
    seen = (
        sections.select(*cols).withColumn("__src", F.lit(0))
        .unionByName(spreads.select(*cols).withColumn("__src", F.lit(1)))
        .groupBy(*by, "path")
        .agg(F.min(F.struct("__src", "ordinal", "pos")).alias("__at"))
    )
    return ranked(seen, by, [F.col("__at"), F.col("path")]).select(*by, "pos", "path")


def section_sizes(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    return sections.groupBy(*by, "ordinal", "section").agg(F.count(F.lit(1)).alias("photos"))


def section_openers(spreads: DataFrame, by: Sequence[str], section: str, index: str) -> DataFrame:
    """Mark the first spread of each section."""
    keys = [*by, section]
    first = spreads.groupBy(*keys).agg(F.min(index).alias("__first"))
    return spreads.join(first, keys).withColumn("is_opener", F.col(index) == F.col("__first")).drop("__first")
