"""Personal data: patterns propose, checksums confirm, nearby words adjust the score. DataFrame functions only.

Every kind has a pattern whose leftmost non-overlapping matches are its proposals, a check of the matched text
(Luhn, mod 97, ranges of numbers) and a score in points: the kind's own, and more where one of its words stands in
the ``CONTEXT`` characters before it, at most back to the proposal before. The four base kinds keep every proposal that passes its
check; the added kinds (iban, tel, ssn) also need ``ENOUGH`` points. Spans of different kinds may overlap.

The text between the matches (``split``) and the matches give the places as running sums, in code points; the sums
are taken in chunks, so a text with a million matches takes no quadratic time. Patterns start at the head of a run and
do not go back into it, which makes them linear in the text and gives the same matches as the plain forms.

Everything happens inside one row, so there is no shuffle and nothing that a hot key could slow down.

Defined cases: a null text is the empty one, without spans; very long texts are read whole; a match that fails its
check is dropped and its parts are not tried again; repeated rows fare alike; a null id is an id; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span whose words count, and the points an added kind needs.
CONTEXT, ENOUGH = 48, 60
#: Matches whose places are summed up together.
CHUNK = 256


class Kind(NamedTuple):
    name: str
    pattern: str  # linear form
    plain: str  # the same matches, without look-behind and possessive repeats
    hint: str  # a text without a match of this has no proposal
    check: Callable[[Column, Column, Column], Column]  # match, character before, character after
    sql: str  # the check in SQL, of m, before and after
    points: int
    words: str
    more: int
    base: bool


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def luhn(digits: Column) -> Column:
    """Whether the weighted digit sum of a digit string is a multiple of ten."""
    back = F.reverse(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(back, at, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))

    def step(rest: Column, at: Column) -> Column:
        char = F.substr(moved, at, F.lit(1))
        letter = char >= "A"
        return (F.when(letter, rest * 100 + F.ascii(char) - 55).otherwise(rest * 10 + char.cast("int"))) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _card(m: Column, before: Column, after: Column) -> Column:
    return F.when(_between(F.length(_digits(m)), 12, 19), luhn(_digits(m))).otherwise(False)


def _iban(m: Column, before: Column, after: Column) -> Column:
    account = F.replace(m, F.lit(" "), F.lit(""))
    edge = ~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]")
    return F.when(edge & _between(F.length(account), 15, 34), mod_97(account)).otherwise(False)


def _ssn(m: Column, before: Column, after: Column) -> Column:
    parts = ~F.left(m, F.lit(3)).isin("000", "666") & (F.left(m, F.lit(1)) != "9") & (F.substr(m, F.lit(5), F.lit(2)) != "00")
    return parts & (F.right(m, F.lit(4)) != "0000") & ~before.rlike("[0-9-]") & ~after.rlike("[0-9-]")


_LUHN_SQL = """list_sum([CASE WHEN k % 2 = 0 THEN 2 * d - CASE WHEN d > 4 THEN 9 ELSE 0 END ELSE d END FOR d, k IN
  [substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1)::INT FOR i IN range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1)]]) % 10 = 0"""
_MOD_SQL = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''),
  lambda x: CASE WHEN x >= 'A' THEN 1000 + ascii(x) - 55 ELSE x::INT END)),
  lambda a, x: CASE WHEN x >= 1000 THEN (a * 100 + x - 1000) % 97 ELSE (a * 10 + x) % 97 END) = 1"""
_BYTE = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_ADDRESS = rf"^{_BYTE}(\.{_BYTE}){{3}}$"

# fixed values: the plain patterns of the base kinds
BASE_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IBAN = r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?"
_TEL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", BASE_PLAIN["email"], "@",
        lambda m, b, a: F.lit(True), "true", 80, "mail|contact|write|reply", 20, True,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", BASE_PLAIN["ip"], r"[0-9]\.[0-9]",
        lambda m, b, a: m.rlike(_ADDRESS), f"regexp_matches(m, '{_ADDRESS}')", 50, "ip|host|server|address|client", 40, True,
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", BASE_PLAIN["card"], r"(?:[0-9][\x20-]?){11}[0-9]", _card,
        f"CASE WHEN length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 THEN {_LUHN_SQL} ELSE false END",
        70, "card|visa|amex|master|pay|credit", 30, True,
    ),
    Kind(
        "phone", BASE_PLAIN["phone"], BASE_PLAIN["phone"], r"\+[0-9]",
        lambda m, b, a: _between(F.length(_digits(m)), 9, 15), "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        60, "phone|tel|call|mobile|fax|cell", 40, True,
    ),
    Kind(
        "iban", _IBAN.replace("(", "(?:"), _IBAN, "[A-Z]{2}[0-9]{2}", _iban,
        "CASE WHEN NOT regexp_matches(before || ' ' || after, '[A-Za-z0-9]') AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 "
        f"THEN {_MOD_SQL} ELSE false END", 80, "iban|account|bank|transfer", 20, False,
    ),
    Kind(
        "tel", _TEL, _TEL, r"[0-9]{3}[\x20.-][0-9]{4}",
        lambda m, b, a: ~b.rlike("[0-9+.-]") & ~a.rlike("[0-9]"),
        "NOT regexp_matches(before, '[0-9+.-]') AND NOT regexp_matches(after, '[0-9]')", 30, "phone|tel|call|mobile|fax|cell", 50, False,
    ),
    Kind(
        "ssn", _SSN, _SSN, "[0-9]-[0-9]{2}-[0-9]", _ssn,
        "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000' "
        "AND NOT regexp_matches(before || ' ' || after, '[0-9-]')", 30, "ssn|social|security", 50, False,
    ),
)
_SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,score:int>"
_STEP = "struct<gap:bigint,size:bigint,keep:boolean,score:int>"


def _places(steps: Column, rank: int, kind: str) -> Column:
    """Steps (gap before a match, size of the match) as spans: running sums in chunks, then in the chunks."""
    none = F.array().cast(f"array<{_SPAN}>")
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)),
    )
    width = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, s: a + s["gap"] + s["size"])
    heads = F.aggregate(
        chunks, F.array(F.lit(0).cast("long")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + width(c)))
    )

    def inside(chunk: Column, head: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            start = state["at"] + s["gap"]
            span = F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), (start + s["size"]).alias("stop"), F.lit(kind).alias("kind"),
                s["score"].alias("score"),
            )
            return F.struct((start + s["size"]).alias("at"), F.when(s["keep"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(head.alias("at"), none.alias("out")), step, lambda state: state["out"])

    placed = F.flatten(F.zip_with(chunks, F.slice(heads, F.lit(1), F.size(chunks)), inside))
    return F.when(F.size(steps) > 0, placed).otherwise(none)


def _steps(kind: Kind, found: Column, pieces: Column) -> Column:
    def step(match: Column, at: Column) -> Column:
        before, after = F.get(pieces, at), F.get(pieces, at + 1)
        near = F.lower(F.right(before, F.lit(CONTEXT))).rlike(f"(^|[^a-z])({kind.words})")
        score = F.lit(kind.points) + F.when(near, kind.more).otherwise(0)
        keep = kind.check(match, F.right(before, F.lit(1)), F.left(after, F.lit(1)))
        keep = keep if kind.base else keep & (score >= ENOUGH)
        return F.struct(
            F.char_length(before).cast("long").alias("gap"), F.char_length(match).cast("long").alias("size"), keep.alias("keep"),
            score.cast("int").alias("score"),
        )

    return F.transform(found, step).cast(f"array<{_STEP}>")


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """A column of all spans (start, rank, stop, kind, score), by start, then kind; stop is exclusive."""
    whole, none, columns = F.coalesce(F.col(text).cast("string"), F.lit("")), F.array().cast("array<string>"), docs.columns
    made = {}
    for k, kind in enumerate(KINDS):
        maybe = whole.contains(kind.hint) if kind.hint == "@" else whole.rlike(kind.hint)
        made[f"__found{k}"] = F.when(maybe, F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))).otherwise(none)
        made[f"__pieces{k}"] = F.when(maybe, F.split(whole, kind.pattern, -1)).otherwise(none)
    steps = {f"__steps{k}": _steps(kind, F.col(f"__found{k}"), F.col(f"__pieces{k}")) for k, kind in enumerate(KINDS)}
    found = docs.select("*", *(c.alias(n) for n, c in made.items()))
    found = found.select(*(f"`{c}`" for c in columns), *(c.alias(n) for n, c in steps.items()))
    spans = F.sort_array(F.concat(*(_places(F.col(f"__steps{k}"), k, kind.name) for k, kind in enumerate(KINDS))))
    return found.select(*(f"`{c}`" for c in columns), spans.alias(name))


def listed(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def personal(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, n_added and top_score."""
    found = with_spans(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
    names = [kind.name for kind in KINDS if kind.base]
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id", *(count(n).alias(f"n_{n}") for n in names),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*names))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count(*(kind.name for kind in KINDS if not kind.base)).alias("n_added"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).cast("long").alias("top_score"),
    )


def oracle() -> str:
    """The same in SQL, from the plain patterns."""
    parts = []
    for k, kind in enumerate(KINDS):
        near = f"regexp_matches(lower(right(gap, {CONTEXT})), '(^|[^a-z])({kind.words})')"
        score = f"{kind.points} + CASE WHEN {near} THEN {kind.more} ELSE 0 END"
        enough = "" if kind.base else f" AND {score} >= {ENOUGH}"
        parts.append(f"""
  SELECT doc, '{kind.name}' AS kind, {k} AS rank, start, stop, {score} AS score FROM (
    SELECT *, right(gap, 1) AS before, left(coalesce(next, ''), 1) AS after,
      sum(length(gap) + length(m)) OVER (PARTITION BY doc ORDER BY i) AS stop,
      sum(length(gap) + length(m)) OVER (PARTITION BY doc ORDER BY i) - length(m) AS start
    FROM (
      SELECT doc, i, found[i] AS m, pieces[i] AS gap, pieces[i + 1] AS next FROM (
        SELECT doc, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT doc, regexp_extract_all(text, '{kind.plain}') AS found, regexp_split_to_array(text, '{kind.plain}') AS pieces FROM doc))))
  WHERE ({kind.sql}){enough}""")
    names = [kind.name for kind in KINDS if kind.base]
    base = ", ".join(f"'{n}'" for n in names)
    listing = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{n}') AS n_{n}" for n in names)
    return f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS doc, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(parts)}),
per AS (
  SELECT doc, {counts}, {listing} FILTER (WHERE kind IN ({base})) AS base, {listing} AS spans,
    count(*) FILTER (WHERE kind NOT IN ({base})) AS n_added, max(score)::BIGINT AS top_score
  FROM span GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(top_score, 0) AS top_score
FROM doc LEFT JOIN per USING (doc)"""
