"""Words, names, keys, file names and statuses as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a claim.
STOP = """
a about above after again against all also am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further had has
have having he her here hers herself him himself his how i if in into is it its itself just let lets
me more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves yeah okay ok right um uh like really going gonna want
need think know thing things something get got make made one two also well sure yes maybe just
still even much many way we'll we're i'm it's that's don't can't won't need needs going discussed
discuss agreed agree decided decide said says say team meeting will shall should would
"""
# What stands for no value.
NULLISH = ["", "null", "none", "n/a", "na", "unknown", "unclear", "unassigned", "-", "tbd"]

_BLANKS = r"(?U)^\s+|\s+$"
#: The characters that these blanks are made of, for plain strings.
_BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, _BLANKS, "")


def stem(word: Column) -> Column:
    """Without the first of the endings ing, ed, es, s that leaves more than three letters; seven letters at most."""
    n = F.length(word)
    ends = lambda e: word.endswith(e) & (n > len(e) + 3)
    cut = F.when(ends("ing"), n - 3).when(ends("ed") | ends("es"), n - 2).when(ends("s"), n - 1).otherwise(n)
    return F.substring(word, F.lit(1), F.least(cut, F.lit(7)))


def salient(text: Column) -> Column:
    """The distinct stems of a text's words that carry meaning: three letters or more, no stop word, and long enough or with a digit."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9'\-]*"), F.lit(0))
    found = F.transform(found, lambda w: F.regexp_replace(w, r"['\-]+$", ""))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP.split()))])
    keep = F.filter(found, lambda w: (F.length(w) >= 3) & ((F.length(w) >= 4) | w.rlike("[0-9]")) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(keep, stem))


def owner(value: Column) -> Column:
    """Null for words that mean nobody, S2 for "speaker 2" or "s2", else the first 80 characters."""
    v = F.substring(strip(value), 1, 80)
    label = F.regexp_extract(v, r"(?i)^s(?:peaker)?\s*(\d)$", 1)
    return F.when(value.isNull() | F.lower(strip(value)).isin(NULLISH), F.lit(None)).when(label != "", F.concat(F.lit("S"), label)).otherwise(v)


def source_ids(ids: Column) -> Column:
    """Ids as the catalog has them: no white space, no square brackets around them, upper case."""
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.upper(F.regexp_replace(strip(i), r"^[\[\]]+|[\[\]]+$", "")))


def joined(a: str | None, b: str | None) -> str:
    """Two reasons as one, by a semicolon, 500 characters at most; the second is left out if the first holds it. On plain strings, for folds."""
    a, b = (a or "").strip(_BLANK), (b or "").strip(_BLANK)
    return a if b in a else f"{a}; {b}"[:500] if a else b


def joined_columns(a: Column, b: Column) -> Column:
    """As ``joined``, on columns."""
    a, b = strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))
    return F.when((b == "") | F.contains(a, b), a).when(a == "", b).otherwise(F.substring(F.concat(a, F.lit("; "), b), 1, 500))


def speaker_name(label: Column, display: Column | None = None) -> Column:
    """The display name; else "Speaker n" for a label S-n, the label itself, or "Unknown"."""
    number = F.regexp_extract(label, r"^S(\d+)$", 1)
    plain = F.when(number != "", F.concat(F.lit("Speaker "), number)).when(label.isNull() | (label == ""), "Unknown").otherwise(label)
    return plain if display is None else F.coalesce(F.nullif(display, F.lit("")), plain)


def label_order(label: Column) -> list[Column]:
    """Sort keys that put S2 before S10 and every numbered label before the others."""
    number = F.regexp_extract(label, r"^S(\d+)$", 1)
    return [F.when(number == "", 1).otherwise(0), F.coalesce(F.nullif(number, F.lit("")).try_cast("long"), F.lit(0)), label]


def content_key(meeting: Column, idx: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.lit("job"), meeting.cast("string"), idx.cast("string"), sha)


def bumped(key: Column) -> Column:
    """The key of the next attempt: behind it :r1, then :r2, and so on."""
    n = F.regexp_extract(key, r"^(?s:.*):r(\d+)$", 1)
    return F.when(n == "", F.concat(key, F.lit(":r1"))).otherwise(F.concat(F.regexp_replace(key, r":r\d+$", ""), F.lit(":r"), (n.try_cast("long") + 1).cast("string")))


def language(value: Column) -> Column:
    """Null where the language is to be found out, else as given without white space."""
    v = strip(value)
    return F.when(F.lower(v).isin("", "auto", "none", "detect"), F.lit(None)).otherwise(v)


def digest(token: Column) -> Column:
    return F.sha2(token, 256)


def clip_name(idx: Column, start_ms: Column, end_ms: Column, cut: bool = False) -> Column:
    """Numbers filled with zeros to 5, 9 and 9 places. With ``cut`` a longer one keeps its first places only, and null makes null."""
    if cut:
        at, start, end = (F.lpad(c.cast("string"), n, "0") for c, n in ((idx, 5), (start_ms, 9), (end_ms, 9)))
        return F.concat(at, F.lit("_"), start, F.lit("_"), end)
    return F.format_string("%05d_%09d_%09d", idx, start_ms, end_ms)


def extension(name: Column) -> Column:
    """The lower-cased ending of a file name, of letters and digits and at most eight of them; else "bin"."""
    found = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(found == "", "bin").otherwise(found)


def display_name(name: Column, email: Column) -> Column:
    """The name, or the part of the address before the @."""
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.nullif(F.substring_index(email, "@", 1), F.lit("")), email)


def initials(name: Column, email: Column) -> Column:
    """Of the first and last word of the name (or of the address), upper case; the first two letters of a single word."""
    base = F.coalesce(F.nullif(strip(name), F.lit("")), F.regexp_replace(F.substring_index(email, "@", 1), r"[._-]+", " "))
    parts = F.filter(F.split(base, r"\s+"), lambda p: p != "")
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    two = F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1))
    return F.upper(F.when(F.size(parts) > 1, two).otherwise(F.substring(F.coalesce(first, F.lit("?")), 1, 2)))


def speaker_slot(label: Column) -> Column:
    """The colour of a numbered label, one of eight in turn."""
    return F.pmod(F.regexp_extract(label, r"(\d+)", 1).try_cast("long") - 1, F.lit(8))


def http_class(status: Column, message: Column) -> Column:
    """What an answer's status means for a job: pause, auth, gone, transient or permanent."""
    return (
        F.when(status.isin(409, 503) | F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit("disabled")), "pause")
        .when(status.isin(401, 403), "auth")
        .when(status == 404, "gone")
        .when(status.isin(408, 425, 429, 507) | (status >= 500), "transient")
        .otherwise("permanent")
    )


def model_status(raw: Column) -> Column:
    """ready, degraded or disabled as they are; offline and quarantine are quarantined; all else is unknown."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(s.isin("ready", "degraded", "disabled"), s).when(s.isin("offline", "quarantined", "quarantine"), "quarantined").otherwise("unknown")


def device(agent: Column) -> Column:
    """Browser and system of a user agent: "Safari on iPhone"."""
    # What browsers and systems call themselves, the first that fits.
    system = _first(agent, [("iPhone", "iPhone"), ("iPad", "iPad"), ("Android", "Android"), ("Mac OS X|Macintosh", "macOS"), ("Windows", "Windows"), ("CrOS", "ChromeOS"), ("Linux", "Linux")], "")
    browser = _first(agent, [("Edg/", "Edge"), ("OPR/", "Opera"), ("Firefox/|FxiOS", "Firefox"), ("Chrome/|CriOS", "Chrome"), ("Safari/", "Safari"), ("(?i)curl|python|httpx", "Script")], "Browser")
    return F.when(F.coalesce(agent, F.lit("")) == "", "Unknown device").when(system == "", browser).otherwise(F.concat(browser, F.lit(" on "), system))


def device_kind(agent: Column) -> Column:
    phone = agent.rlike("iPhone") | (~agent.rlike("iPad") & agent.rlike("Android") & agent.rlike("Mobile"))
    return F.when(F.coalesce(phone, F.lit(False)), "phone").when(agent.rlike("iPad|Android"), "tablet").otherwise("desktop")


def _first(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    found = F.lit(otherwise)
    for pattern, name in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def safe_list(text: Column) -> Column:
    """The strings of a JSON list; an empty list for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def email(value: Column) -> Column:
    return F.lower(strip(value))


def valid_email(value: Column) -> Column:
    return F.coalesce((F.length(value) <= 254) & value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
