"""Titles from file names, dates as people say them, passwords, ranges, statuses and pauses: small rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.words import strip

# What recorders put into file names.
_EXTENSION = r"(?i)\.[a-z0-9]{2,5}$"
_GMT_STAMP = r"(?i)^GMT\d{8}-\d{6}\s*"
_SIZE = r"\b\d{3,4}x\d{3,4}\b"
_MEETING_RECORDING = r"(?i)[\s-]*meeting[\s-]*recording\b"
_RECORDING_AT_END = r"(?i)[\s-]*\brecording(\s\d+)?$"
_DATE = r"\b(?:19|20)\d{2}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12]\d|3[01])(?:[ T-]?\d{2}[:.-]?\d{2}(?:[:.-]?\d{2})?)?\b"
_GUESSABLE = r"(?i)^(password|qwerty|12345|letmein|welcome)"
_MIN_PASSWORD = 8


def title(file: Column) -> Column:
    """A meeting's title from its recording's file name: no extension, no stamps, no recorder's words; slugs as words.

    Without two characters left it is the name without its extension, or the name itself. Null stays null.
    """
    base = strip(F.regexp_replace(file, _EXTENSION, ""))
    s = F.regexp_replace(base, "_", " ")
    for pattern in (_GMT_STAMP, _SIZE, _MEETING_RECORDING, _RECORDING_AT_END, _DATE):
        s = F.regexp_replace(s, pattern, "")
    # A name with spaces of its own keeps its dashes and dots; one long word with a stamp in it isn't one.
    spaced = F.regexp_like(F.regexp_replace(F.regexp_replace(base, "_", " "), r"^\S*\d{8}\S*$", ""), F.lit(r"\s"))
    s = F.when(spaced, s).otherwise(F.regexp_replace(s, r"[-.]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"(\s*[-–—]\s*){2,}", " – "), r"\s+", " ")
    s = F.regexp_replace(s, r"^[\s\-–—.,:;]+|[\s\-–—.,:;]+$", "")
    upper = F.when(F.regexp_like(s, F.lit("^[a-z]")), F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s)))).otherwise(s)
    return F.when(F.length(s) < 2, F.when(base == "", file).otherwise(base)).otherwise(upper)


def spoken_date(at: Column, now: Column) -> Column:
    """"Today 09:14", "Yesterday", "12 Sep" in this year, else "12 Sep 2025"; empty for null."""
    days = F.datediff(F.to_date(now), F.to_date(at))
    text = F.when(days == 0, F.concat(F.lit("Today "), F.date_format(at, "HH:mm"))).when(days == 1, "Yesterday")
    return F.when(at.isNull(), "").otherwise(F.coalesce(text, F.when(F.year(at) == F.year(now), F.date_format(at, "d MMM")).otherwise(F.date_format(at, "d MMM yyyy"))))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def ago(at: Column, now: Column) -> Column:
    """"Just now" below a minute and a half, then minutes, hours, "Yesterday", days below a week, then a date; empty for null."""
    s = F.greatest(F.lit(0.0), _seconds(now, at))
    n = lambda unit, word: F.concat(F.floor(s / unit + 0.5).cast("string"), F.lit(f" {word} ago"))
    days = F.floor(s / 86_400)
    found = F.when(s < 90, "Just now").when(s < 3600, n(60, "min")).when(s < 86_400, n(3600, "h")).when(days == 1, "Yesterday")
    found = found.when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(spoken_date(at, now))
    return F.when(at.isNull(), "").otherwise(found)


def left(until: Column, now: Column) -> Column:
    """"in 20 min", "in 5 h" below two days, "in 6 days"; empty once it has passed, and for null."""
    s = _seconds(until, now)
    n = lambda unit: F.floor(s / unit + 0.5)
    said = lambda count, word: F.concat(F.lit("in "), count.cast("string"), F.lit(f" {word}"))
    return F.when(until.isNull() | (s <= 0), "").when(s < 3600, said(F.greatest(F.lit(1), n(60)), "min")).when(s < 2 * 86_400, said(n(3600), "h")).otherwise(said(n(86_400), "days"))


def password_strength(password: Column) -> Column:
    """score (0 to 3) and label of a password: its length, its kinds of characters, spaces inside, and words that are guessed first."""
    p = F.coalesce(password, F.lit(""))
    missing = F.lit(_MIN_PASSWORD) - F.length(p)
    short = F.when(p == "", f"At least {_MIN_PASSWORD} characters").otherwise(F.concat(missing.cast("string"), F.lit(" more character"), F.when(missing == 1, "").otherwise("s")))
    one = lambda c: c.cast("int")
    kinds = sum((one(F.regexp_like(p, F.lit(k))) for k in ("[A-Z]", "[0-9]", "[^A-Za-z0-9]")), one(F.regexp_like(p, F.lit("[a-z]"))))
    different = F.size(F.array_distinct(F.split(F.lower(p), "(?!$)")))
    points = one(F.length(p) >= 12) + one(F.length(p) >= 16) + one(kinds >= 3) + one(F.regexp_like(strip(p), F.lit(r"\s")))
    made = lambda score, label: F.struct(F.lit(score).alias("score"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    return (
        F.when(missing > 0, made(0, short)).when((different <= 3) | F.regexp_like(p, F.lit(_GUESSABLE)), made(1, "Easy to guess"))
        .when(points >= 2, made(3, "Strong")).when((points == 1) | (kinds >= 2), made(2, "Good")).otherwise(made(1, "Could be stronger"))
    )


def clean_name(name: Column, most: int = 80) -> Column:
    """A name without control characters, with single spaces, ``most`` characters at most; null is empty."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1f\x7f]", "")
    return F.substring(strip(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, most)


def upload_details(raw: Column) -> Column:
    """What an upload says about itself (a map of texts), cleaned: filename, title, language, expected_speakers, fault.

    A language that is no tag, or "auto", is null. The number of speakers has to be 1 to 8; else ``fault`` says why.
    """
    given = lambda k: strip(F.coalesce(F.element_at(raw, k), F.lit("")))
    filled = lambda c: F.nullif(c, F.lit(""))
    file = F.substring(strip(F.regexp_extract(F.replace(given("filename"), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)), 1, 255)
    file = F.coalesce(filled(file), F.lit("recording"))
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]+$", "")
    language = F.substring(given("language"), 1, 16)
    is_tag = F.regexp_like(language, F.lit(r"^[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})?$")) & (F.lower(language) != "auto")
    number = given("expected_speakers").try_cast("int")
    fault = F.when(given("expected_speakers") == "", F.lit(None).cast("string")).when(number.isNull(), "expected_speakers must be a number.").when(~number.between(1, 8), "expected_speakers must be between 1 and 8.")
    return F.struct(
        file.alias("filename"), F.coalesce(filled(F.substring(given("title"), 1, 200)), filled(F.substring(stem, 1, 200)), F.lit("Untitled meeting")).alias("title"),
        F.when(is_tag, language).alias("language"), F.when(fault.isNull(), number).alias("expected_speakers"), fault.alias("fault"),
    )


def byte_range(header: Column, size: Column) -> Column:
    """first and last byte that a range header asks for, of a file of ``size`` bytes: whole without a header, the last n for
    a suffix; null if it can't be served."""
    h = strip(header)
    part = lambda i: F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).try_cast("long")
    first = F.coalesce(part(1), F.when(part(2).isNotNull(), F.greatest(F.lit(0).cast("long"), size - part(2))))
    last = F.least(F.when(part(1).isNotNull(), F.coalesce(part(2), size - 1)).otherwise(size - 1), size - 1)
    whole = F.struct(F.lit(0).cast("long").alias("first"), (size - 1).alias("last"))
    return F.when(header.isNull() | (header == ""), whole).when((first < size) & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def model_status(statuses: Column, model: Column, role: Column | None = None) -> Column:
    """A model's status in a variant that gives texts or objects with a status, by role or by model.

    A role's object counts only if it names this model or none. Of a list that doesn't know the model: missing; of an
    empty one, or of what is no object: unknown.
    """
    known = F.try_variant_get(statuses, "$", "map<string,variant>")

    def by(key: Column, named: bool) -> Column:
        value = F.element_at(known, key)
        kind = F.schema_of_variant(value)
        status = F.try_variant_get(value, "$.status", "variant")
        own = F.try_variant_get(value, "$.model", "string")
        right = (F.schema_of_variant(status) == "STRING") & (F.lit(not named) | own.isNull() | (own == model))
        return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("OBJECT") & right, F.try_variant_get(status, "$", "string"))

    found = by(model, False)
    found = found if role is None else F.coalesce(by(role, True), found)
    return F.when(known.isNull() | (F.size(known) == 0), "unknown").otherwise(F.coalesce(found, F.lit("missing")))


def pause_message(stage: Column, detail: Column, error: Column) -> Column:
    """What a paused stage tells its owner, by the reason that was noted."""
    reason = F.coalesce(F.nullif(detail, F.lit("")), error, F.lit(""))
    says = lambda text: F.contains(F.lower(reason), F.lit(text))
    off = F.when(stage == "transcribe", "Speech model unavailable.").otherwise("Processing model unavailable.")
    return F.when(says("llm-proxy catalog unreachable"), "Speech service unavailable.").when(says("disabled in llm-proxy"), off).otherwise("Waiting to resume.")
