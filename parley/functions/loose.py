"""JSON as models write it: found in a text, checked against a schema, cleaned by a table of rules; and keyed digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.times import parse_prompt_time
from parley.functions.words import owner, strip


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(text: Column) -> Column:
    """The JSON value of a text as a variant: the whole text, what stands in a code fence, or what lies from its first opening
    to its last closing brace; null if none of these is JSON."""

    def inside(bare: Column) -> Column:
        return _once(F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1), lambda fenced: F.when(fenced != "", fenced).otherwise(bare))

    def outermost(inner: Column) -> Column:
        first = F.instr(inner, "{")
        last = F.length(inner) - F.instr(F.reverse(inner), "}") + 1
        return F.when((first > 0) & F.contains(inner, F.lit("}")) & (last > first), F.substring(inner, first, last - first + 1))

    return _once(_once(strip(text), inside), lambda inner: F.coalesce(_only_value(inner), _once(outermost(inner), _only_value)))


def _only_value(text: Column) -> Column:
    """A text that is one JSON value as a variant. The parser stops behind a first value, so the text has to fit between
    brackets and between braces: what follows a value breaks one of them."""
    between = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(between, "$[0]", "variant"))


def first_object(text: Column) -> Column:
    """The first balanced object in a text, as text: braces inside strings don't count, nor do escaped quotes end them; null without one."""
    start = F.instr(text, "{")
    chars = F.split(F.substring(text, start, F.length(text)), "(?!$)")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        n = s["n"] + 1
        on = F.struct(
            depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            n.alias("n"), F.when((depth == 0) & ~s["quoted"] & (c == "}"), n).otherwise(0).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(on)

    end = F.aggregate(chars, begin, step)["end"]
    return F.when((start > 0) & (end > 0), F.substring(text, start, end))


def _kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, boolean, null, integer or number."""
    s = F.schema_of_variant(v)
    whole = s.isin("BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$")
    out = F.when(v.isNull(), F.lit(None).cast("string")).when(s == "VOID", "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
    return out.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(whole, "integer").otherwise("number")


def violations(v: Column, schema: dict, path: str | Column = "$") -> Column:
    """What in a variant breaks a JSON schema, as an array of texts "path: reason"; empty if it holds.

    Of schemas: type (one or several), properties, required, items, enum of texts, minimum, maximum, and
    additionalProperties false. The schema is known, so this is one expression; only arrays and keys vary by row.
    """
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    kind = _kind(v)
    told = lambda broken, reason: F.when(broken, F.array(F.concat(path, reason if isinstance(reason, Column) else F.lit(reason)))).otherwise(none)
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    found = []
    if "enum" in schema:
        found.append(told(~F.coalesce((kind == "string") & F.try_variant_get(v, "$", "string").isin(*schema["enum"]), F.lit(False)), ": not in enum"))
    number = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
    for name, out in (("minimum", lambda m: number < m), ("maximum", lambda m: number > m)):
        if name in schema:
            found.append(told(F.coalesce(out(schema[name]), F.lit(False)), f": beyond {name} {schema[name]}"))
    if schema.get("properties") or schema.get("required") or schema.get("additionalProperties") is False:
        keys = F.when(kind == "object", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(F.array().cast("array<string>"))
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            found.append(told((kind == "object") & ~F.array_contains(keys, name), f".{name}: required"))
        for name, inner in known.items():
            at = F.when(F.array_contains(keys, name), F.variant_get(v, f"$['{name}']", "variant"))
            found.append(F.when(F.array_contains(keys, name), violations(at, inner, F.concat(path, F.lit(f".{name}")))).otherwise(none))
        if schema.get("additionalProperties") is False:
            odd = F.filter(keys, lambda k: ~k.isin(*known)) if known else keys
            found.append(F.transform(odd, lambda k: F.concat(path, F.lit("."), k, F.lit(": unexpected property"))))
    if "items" in schema:
        items = F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>"))
        each = F.transform(items, lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), none))
    inside = F.concat(none, *found)
    if not types:
        return inside
    fits = kind.isin(*types) | ((kind == "integer") & F.lit("number" in types))
    return F.when(F.coalesce(fits, F.lit(False)), inside).otherwise(told(F.lit(True), F.concat(F.lit(f": expected {'|'.join(types)}, got "), F.coalesce(kind, F.lit("nothing")))))


def text_of(v: Column, most: int = 600) -> Column:
    """A variant's text without white space around it, ``most`` characters at most; empty if it is no text."""
    return F.coalesce(_once(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.substring(strip(F.try_variant_get(x, "$", "string")), 1, most))), F.lit(""))


def time_of(v: Column) -> Column:
    """Seconds of a number or a written time; else null."""
    text = _once(v, lambda x: F.when(~F.rlike(F.schema_of_variant(x), F.lit("^(VOID|BOOLEAN|OBJECT|ARRAY)")), F.try_variant_get(x, "$", "string")))
    return _once(text, parse_prompt_time)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


#: Lists of a section, with the rule for each field. An entry counts if the field named first of the rule has a text.
RULES = {
    "decisions": ("text", {"text": text_of, "t": time_of}),
    "action_items": ("task", {"owner": lambda v: _once(F.try_variant_get(v, "$", "string"), owner), "task": text_of, "due": lambda v: _or_null(text_of(v, 80)), "t": time_of}),
    "open_questions": ("text", {"text": text_of, "t": time_of}),
    "speaker_names": ("name", {"label": lambda v: F.upper(text_of(v, 8)), "name": lambda v: text_of(v, 80), "evidence_t": time_of}),
}


def section(v: Column, start: Column, end: Column) -> Column:
    """A section as a model wrote it (a variant), cleaned: texts trimmed and cut, times read, entries without a text gone.

    What is missing, or no list, is empty; entries that are no objects go.
    """
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")

    def entries(v: Column, name: str) -> Column:
        must, fields = RULES[name]
        rows = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        real = F.filter(rows, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")) & (text_of(field(x, must)) != ""))
        return F.transform(real, lambda x: F.struct(*[rule(field(x, n)).alias(n) for n, rule in fields.items()])).alias(name)

    def cleaned(v: Column) -> Column:
        return F.struct(text_of(field(v, "title"), 120).alias("title"), text_of(field(v, "summary"), 2000).alias("summary"), *[entries(v, n) for n in RULES], start.alias("start"), end.alias("end"))

    return _once(v, cleaned)


def keyed_digest(message: Column, key: Column | str | None = None) -> Column:
    """HMAC-SHA-256 of a text in hex, from two nested hashes; with an empty or null key the plain hash. A null message has none."""
    message = message.cast("binary")
    if key is None or (isinstance(key, str) and not key):
        return F.sha2(message, 256)
    secret = (F.lit(key) if isinstance(key, str) else key).cast("binary")
    short = F.when(F.length(secret) > 64, F.unhex(F.sha2(secret, 256))).otherwise(secret)
    padded = F.rpad(F.hex(short), 128, "0")

    def mixed(byte: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i, 2), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0"))
        return F.unhex(F.array_join(pairs, ""))

    inner = F.unhex(F.sha2(F.concat(mixed(0x36), message), 256))
    return F.when(F.coalesce(F.length(secret), F.lit(0)) == 0, F.sha2(message, 256)).otherwise(F.sha2(F.concat(mixed(0x5C), inner), 256))
