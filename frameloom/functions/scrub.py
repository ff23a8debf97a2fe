"""Removing private details from texts and metadata before they are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import col

# Image suffixes, redacted keys and limits.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "psd", "heic", "cr2", "nef", "arw", "dng")
FORBIDDEN_KEYS = (
    "password", "password_hash", "new_password", "old_password", "token", "access_token", "refresh_token",
    "api_key", "openai_api_key", "secret", "jwt_secret", "private_key", "signing_key", "authorization",
    "database_url", "license_key",
)
SUSPICIOUS = ("password", "secret", "token", "key", "credential", "authorization")
MAX_LENGTH, MAX_DEPTH = 2000, 6
REDACTED, CUT = "[redacted]", "…[truncated]"

# -- texts: cut into pieces, and every piece decided by what it begins and ends with --------------- #
_DRIVE = r"(?<![<\w])[A-Za-z]:\\(?!Users\\)"


def _pieces(text: Column, pattern: str, change) -> Column:
    """Cut a text at the places where ``pattern`` stands, change every piece and join them again."""
    return F.array_join(F.transform(F.split(text, "(?U)" + pattern, -1), change), "")


def _from(piece: Column, start: str, tag: Column) -> Column:
    """The piece up to where ``start`` is first found, then the tag; without it the piece."""
    at = F.regexp_instr(piece, F.lit("(?U)" + start))
    return F.when(at > 0, F.concat(F.left(piece, at - 1), tag)).otherwise(piece)


def _files(text: Column, suffix: str, start: str, tag) -> Column:
    """Whatever runs from a path's start to the nearest suffix becomes a tag; quotes, brackets, bars and lines end a path.

    A token is cut behind its suffixes. Only pieces that end in one name a file, so the rest of a token is left alone.
    """
    ends = f"(?i)\\.{suffix}$"

    def piece(part: Column) -> Column:
        return F.when(part.rlike(ends), _from(part, start, tag(part))).otherwise(part)

    return _pieces(text, "(?=[\"'<>|\r\n])", lambda token: _pieces(token, f"(?<=(?i:\\.{suffix}))(?!\\w)", piece))


def _folder(word: Column) -> Column:
    """A word that holds a folder on a drive, with two characters of its name at least, up to the folder."""
    return F.when(word.rlike("(?U)" + _DRIVE + ".."), _from(word, _DRIVE, F.lit("<path>"))).otherwise(word)


def _owner(text: Column, head: str, ends: str) -> Column:
    """The folder name behind a home folder's head becomes <user>."""
    parts = F.split(text, f"(?<={head})", -1)
    named = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.regexp_replace(p, f"(?U)^[^{ends}\\s\"']+", "<user>")))
    return F.array_join(named, "")


def scrub_text(text: Column | str, account: str | None = None) -> Column:
    """Image paths become <photo.ext>, other drive paths <path>, the owner of a home folder <user>.

    The three rules are tried in this order, each on what the one before left.
    """
    photo = lambda part: F.concat(F.lit("<photo."), F.lower(F.substring_index(part, ".", -1)), F.lit(">"))
    out = _files(col(text), f"(?:{'|'.join(IMAGE_SUFFIXES)})", r"[A-Za-z]:[/\\]|/", photo)
    out = _files(out, "[0-9A-Za-z]{2,4}", _DRIVE, lambda part: F.lit("<path>"))
    out = _pieces(out, "(?=[\\s\"'<>|])", _folder)
    for head, ends in ((r"[A-Za-z]:\\Users\\", r"\\"), ("/Users/", "/"), ("/home/", "/")):
        out = _owner(out, head, ends)
    if account and len(account) > 2:
        out = F.regexp_replace(out, "(?i)\\Q" + account.replace("\\E", "") + "\\E", "<user>")
    return out


def _private(key: Column) -> Column:
    lowered = F.lower(key)
    test = lowered.isin(*FORBIDDEN_KEYS)
    for part in SUSPICIOUS:
        test = test | lowered.contains(part)
    return test


def _short(value: Column) -> Column:
    return F.when(F.length(value) > MAX_LENGTH, F.concat(F.left(value, F.lit(MAX_LENGTH)), F.lit(CUT))).otherwise(value)


def scrub_map(metadata: Column | str) -> Column:
    """Flat map<string,string>: private keys redacted, long values cut. Stays in the JVM."""
    return F.transform_values(
        col(metadata), lambda k, v: F.when(_private(k), F.lit(REDACTED)).otherwise(_short(v))
    )


def _quoted(value: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), (F.length(listed) - 2).cast("int"))


def _box(text: Column, depth: int) -> Column:
    """An object or a list at ``depth``: its members one by one, in their order; boxes among them go one level down."""
    entry = "array<struct<key:string,raw:string,value:variant>>"
    raw, parsed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    members = F.zip_with(F.map_entries(raw), F.map_entries(parsed), lambda a, b: F.struct(a["key"].alias("key"), a["value"].alias("raw"), b["value"].alias("value")))
    items = F.zip_with(
        F.from_json(text, "array<string>"), F.from_json(text, "array<variant>"),
        lambda a, b: F.struct(F.lit(None).cast("string").alias("key"), a.alias("raw"), b.alias("value")),
    )
    is_list = F.left(F.ltrim(text), F.lit(1)) == "["

    def clean(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        if depth == MAX_DEPTH:
            value = F.lit(f'"{REDACTED}"')
        else:
            value = (
                F.when(e["value"].isNull() | (kind == "VOID"), "null")
                .when(kind == "STRING", _quoted(_short(e["raw"])))
                .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), _box(e["raw"], depth + 1))
                .otherwise(e["raw"])
            )
        hidden = F.coalesce(_private(e["key"]), F.lit(False))
        name = F.when(e["key"].isNull(), "").otherwise(F.concat(_quoted(e["key"]), F.lit(":")))
        # the value stands here once, so the expression grows with the depth and no faster
        return F.concat(name, F.when(hidden, f'"{REDACTED}"').otherwise(value))

    body = F.array_join(F.transform(F.when(is_list, items).otherwise(members).cast(entry), clean), ",")
    return F.concat(F.when(is_list, "[").otherwise("{"), body, F.when(is_list, "]").otherwise("}"))


def scrub_json(metadata: Column | str) -> Column:
    """Nested JSON text, scrubbed at every depth, in the JVM; a text that is no JSON object or list is redacted whole."""
    text = col(metadata)
    kind = F.schema_of_variant(F.try_parse_json(text))
    box = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(text.isNull(), None).when(box, _box(text, 0)).otherwise(REDACTED)
