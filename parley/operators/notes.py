"""Notes of a meeting: merging section items, grounding them, votes, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import times, words
from parley.operators.exports import clock, named
from parley.operators.intervals import range_join


def numbered_items(items: DataFrame) -> DataFrame:
    """Section items with their catalog ids: D1, D2, ... for decisions, A for actions, Q for questions, in the order of sections.

    items: meeting_id, section, n, kind (decision, action, question), ...
    """
    order = Window.partitionBy("meeting_id", "kind").orderBy("section", "n")
    prefix = F.when(F.col("kind") == "decision", "D").when(F.col("kind") == "action", "A").otherwise("Q")
    return items.withColumn("item_id", F.concat(prefix, F.row_number().over(order).cast("string")))


def merge_sources(reduced: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reduced items resolved to the section items that they name.

    reduced: meeting_id, item, kind, text, owner, due, source_ids; catalog: meeting_id, item_id, kind, text, owner, due,
    t. Only sources of the same kind count, in the order and as often as they are named; an item without one is
    dropped. t is the earliest of theirs. The item's own owner, due and text come first, else the first source's that
    has one.
    """
    named = reduced.select("meeting_id", "item", "kind", F.posexplode(words.source_ids(F.col("source_ids"))).alias("place", "item_id"))
    source = catalog.select("meeting_id", "kind", "item_id", F.struct("t", "text", "owner", "due").alias("s"))
    found = named.join(source, ["meeting_id", "kind", "item_id"])
    first = lambda c: F.min_by(F.col(f"s.{c}"), F.when(F.coalesce(F.col(f"s.{c}"), F.lit("")) != "", F.col("place")))
    found = found.groupBy("meeting_id", "item", "kind").agg(F.min("s.t").alias("t"), F.count(F.lit(1)).alias("n_sources"), first("text").alias("text0"), first("owner").alias("owner0"), first("due").alias("due0"))
    out = reduced.join(found, ["meeting_id", "item", "kind"])
    filled = lambda c: F.nullif(words.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    due = F.coalesce(filled(F.col("due")), F.col("due0"))
    return out.select(
        "meeting_id", "item", "kind", F.coalesce(filled(F.col("text")), "text0").alias("text"),
        F.coalesce(words.owner(F.col("owner")), "owner0").alias("owner"), F.when(~F.lower(due).isin(words.NULLISH), due).alias("due"), "t", "n_sources",
    )


def fallback_merge(sections: DataFrame) -> DataFrame:
    """All sections' items one after another: what the notes hold if the sections could not be reduced."""
    order = Window.partitionBy("meeting_id", "kind").orderBy("section", "n")
    return sections.select("meeting_id", "kind", (F.row_number().over(order) - 1).alias("place"), "text", "t")


def grounded_items(items: DataFrame, sources: DataFrame, verdicts: DataFrame, default_t: int = 0) -> DataFrame:
    """Items with grounded: their own text or that of any source is; an item without a time gets ``default_t`` and isn't.

    items: meeting_id, item, t; sources: meeting_id, item, claim_id, the item's own claim among them; verdicts:
    meeting_id, claim_id, grounded.
    """
    any_ = sources.join(verdicts, ["meeting_id", "claim_id"]).groupBy("meeting_id", "item").agg(F.bool_or("grounded").alias("grounded"))
    out = items.join(any_, ["meeting_id", "item"], "left")
    return out.select("meeting_id", "item", F.coalesce("t", F.lit(default_t)).alias("t"), (F.col("t").isNotNull() & F.coalesce("grounded", F.lit(False))).alias("grounded"))


def vote_near(votes: DataFrame, lines: DataFrame, band_ms: int = 90_000) -> DataFrame:
    """Votes (meeting_id, label, name, t) whose name is said by someone within ``band_ms`` of their time."""
    cell = lambda c: F.floor(c / band_ms).cast("long")
    held = lines.select("meeting_id", F.col("start_ms").alias("a"), F.lower("text").alias("said"), F.explode(F.sequence(cell(F.col("start_ms") - band_ms), cell(F.greatest("start_ms", "end_ms") + band_ms))).alias("cell"), F.greatest("start_ms", "end_ms").alias("z"))
    asked = votes.withColumn("cell", cell(F.col("t")))
    near = (F.col("a") <= F.col("t") + band_ms) & (F.col("z") >= F.col("t") - band_ms) & F.contains("said", F.lower("name"))
    return asked.join(held, ["meeting_id", "cell"]).filter(near).select("meeting_id", "label", "name", "t").distinct()


def tldr(points: DataFrame, chapters: DataFrame, most: int = 6, fallback: int = 5) -> DataFrame:
    """The first ``most`` summary points of a meeting; without one the first ``fallback`` chapter titles that aren't blank."""
    order = Window.partitionBy("meeting_id").orderBy("n")
    own = points.filter(words.strip(F.col("text")) != "").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    titles = chapters.join(own.select("meeting_id").distinct(), "meeting_id", "left_anti").filter(words.strip(F.col("title")) != "")
    titles = titles.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fallback).select("meeting_id", "place", F.col("title").alias("text"))
    return own.select("meeting_id", "place", "text").unionByName(titles)


def _line() -> Column:
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?"))
    return F.concat(F.lit("["), times.prompt_time(F.col("start_ms")), F.lit("] "), who, F.lit(": "), words.strip(F.col("text")))


def transcript(lines: DataFrame) -> DataFrame:
    """Lines as prompts hold them: [mm:ss] label: text, without blank ones; a line of nobody is marked ?."""
    return lines.filter(F.regexp_like("text", F.lit(r"(?U)\S"))).select("meeting_id", "line_id", _line().alias("line"))


def frame_line(frame: Column) -> Column:
    """A frame as prompts show it: time, kind, title and caption, 400 characters of its text on one line, up to six facts.

    ``frame`` is a struct of t (ms), kind, title, caption, visible_text and facts.
    """
    text = F.replace(F.coalesce(frame["visible_text"], F.lit("")), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(text) > 400, F.concat(F.substring(text, 1, 400), F.lit("…"))).otherwise(text)
    or_empty = lambda c, other="": F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    head = F.concat(F.lit("["), times.prompt_time(frame["t"]), F.lit("] "), or_empty(frame["kind"], "frame"), F.lit(": "), or_empty(frame["title"]), F.lit(" — "), or_empty(frame["caption"]))
    facts = F.coalesce(frame["facts"], F.array().cast("array<string>"))
    return F.concat(head, F.when(cut != "", F.concat(F.lit(" Visible text: "), cut)).otherwise(""), F.when(F.size(facts) > 0, F.concat(F.lit(" Facts: "), F.array_join(F.slice(facts, 1, 6), "; "))).otherwise(""))


def map_messages(windows: DataFrame, lines: DataFrame, frames: DataFrame, names: DataFrame) -> DataFrame:
    """(meeting_id, window, message): what is asked about each window of a meeting: its place and times, the speakers that are
    known by name, the frames that lie in it, and its lines.

    windows: meeting_id, line_id, window, as ``moments.greedy_windows`` gives them; frames: meeting_id, frame; names:
    meeting_id, label, display.
    """
    held = lines.join(windows.select("meeting_id", "line_id", "window"), ["meeting_id", "line_id"])
    until = F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms")
    rows = held.groupBy("meeting_id", "window").agg(
        F.min_by("start_ms", F.struct("start_ms", "line_id")).alias("start_ms"), F.max(until).alias("end_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "line_id", _line().alias("line")))), lambda x: x["line"]), "\n").alias("said"),
    )
    total = windows.groupBy("meeting_id").agg((F.max("window") + 1).alias("total"))
    named = names.filter(F.coalesce("display", F.lit("")) != "").groupBy("meeting_id").agg(F.sort_array(F.collect_set(F.concat("label", F.lit(" = "), "display"))).alias("named"))
    spans = rows.select("meeting_id", "window", "start_ms", (F.greatest("end_ms", "start_ms") + 1).alias("end_ms"))
    shots = frames.select("meeting_id", F.col("frame.t").alias("start_ms"), (F.col("frame.t") + 1).alias("end_ms"), "frame")
    seen = range_join(shots, spans, 900_000).groupBy(F.col("r.meeting_id").alias("meeting_id"), F.col("r.window").alias("window"))
    seen = seen.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("l.start_ms").alias("t"), frame_line(F.col("l.frame")).alias("line")))), lambda x: x["line"]), "\n").alias("seen"))
    out = rows.join(total, "meeting_id").join(named, "meeting_id", "left").join(seen, ["meeting_id", "window"], "left")
    place = F.concat(F.lit("Section "), (F.col("window") + 1).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(", ["), times.prompt_time(F.col("start_ms")), F.lit("] to ["), times.prompt_time(F.col("end_ms")), F.lit("]."))
    parts = [place, F.concat(F.lit("Speakers confirmed by the user: "), F.array_join("named", ", ")), F.concat(F.lit("Frames (what was on screen):\n"), "seen"), F.concat(F.lit("Transcript:\n"), "said")]
    return out.select("meeting_id", "window", F.array_join(F.array(*parts), "\n\n").alias("message"))  # parts that are null are left out


def frame_prompts(points: DataFrame, around: DataFrame, lines: DataFrame) -> DataFrame:
    """(meeting_id, point_id, prompt): what is asked about each frame: its time, the hint and the reason if there are any, and
    the lines around it, of which ``around`` (meeting_id, point_id, line_id) says which. points: meeting_id, point_id, t, look_for, why."""
    said = around.join(lines.filter(F.regexp_like("text", F.lit(r"(?U)\S"))), ["meeting_id", "line_id"])
    said = said.groupBy("meeting_id", "point_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "line_id", _line().alias("line")))), lambda x: x["line"]), "\n").alias("said"))
    given = lambda c, head: F.concat(F.lit(head), F.nullif(c, F.lit("")))
    parts = [
        F.concat(F.lit("Frame time: ["), times.prompt_time(F.col("t")), F.lit("]")), given("look_for", "Hint, what might be on screen: "), given("why", "Why this moment was picked: "),
        F.concat(F.lit("Transcript around this moment:\n"), F.coalesce("said", F.lit("(no transcript)"))),
    ]
    return points.join(said, ["meeting_id", "point_id"], "left").select("meeting_id", "point_id", F.array_join(F.array(*parts), "\n\n").alias("prompt"))


def _item_line() -> Column:
    """An item as the reduce step reads it: its id, kind and text, and for an action who has to do it until when."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    due = F.coalesce(F.concat(F.lit(", due: "), filled("due")), F.lit(""))
    extra = F.when(F.col("kind") == "action", F.concat(F.lit(" (owner: "), F.coalesce(filled("owner"), F.lit("unassigned")), due, F.lit(")"))).otherwise("")
    kind = F.when(F.col("kind") == "question", "open question").otherwise(F.col("kind"))
    return F.concat(F.lit("["), "item_id", F.lit("] "), kind, F.lit(": "), "text", extra)


def reduce_input(sections: DataFrame, items: DataFrame, most_tokens: int = 12_000) -> DataFrame:
    """One text per meeting for the reduce step: a head with times and title, the summary, and numbered items of every section.

    Summaries share what the items leave of ``most_tokens``, 200 characters each at least. sections: meeting_id,
    section, title, summary, start_ms, end_ms; items: as ``numbered_items`` takes them, with text, owner and due.
    """
    shown = numbered_items(items).select("meeting_id", "section", F.struct(F.when(F.col("kind") == "decision", 0).when(F.col("kind") == "action", 1).otherwise(2).alias("k"), "n", _item_line().alias("line")).alias("x"))
    block = shown.groupBy("meeting_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("block"))
    rows = sections.join(block, ["meeting_id", "section"], "left").withColumn("block", F.coalesce("block", F.lit("")))
    whole = Window.partitionBy("meeting_id")
    fixed = F.sum(times.tokens(F.col("block"))).over(whole) + 50 * F.count(F.lit(1)).over(whole)
    budget = F.greatest(F.lit(200), F.floor((F.lit(most_tokens) - fixed) * 3.5 / F.count(F.lit(1)).over(whole)).cast("int"))
    rows = rows.withColumn("budget", budget)
    summary = F.coalesce("summary", F.lit(""))
    cut = F.when(F.length(summary) > F.col("budget"), F.concat(F.substring(summary, F.lit(1), F.col("budget")), F.lit("…"))).otherwise(summary)
    head = F.concat(F.lit("## ["), times.prompt_time(F.col("start_ms")), F.lit("–"), times.prompt_time(F.col("end_ms")), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Section")))
    text = F.concat(head, F.lit("\n"), cut, F.when(F.col("block") != "", F.concat(F.lit("\n"), "block")).otherwise(""))
    return rows.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))


#: The parts of the notes in their order.
PARTS = ("TL;DR", "Summary", "Chapters", "Decisions", "Action items", "Open questions", "Key visuals", "Transcript")


def markdown(meetings: DataFrame, names: DataFrame, lines: DataFrame, points: DataFrame | None = None, chapters: DataFrame | None = None, items: DataFrame | None = None, visuals: DataFrame | None = None) -> DataFrame:
    """Notes as Markdown: title, date, length and speakers, then every part that has rows.

    meetings: meeting_id, title, day, length_ms, summary; names: meeting_id, n, label, display; lines: meeting_id,
    line_id, start_ms, speaker, text; points: meeting_id, n, text; chapters: meeting_id, n, start_ms, title, summary;
    items: meeting_id, kind (decision, action, question), n, text, owner, due, t (ms), grounded; visuals: meeting_id,
    n, t, caption. An item that isn't grounded says so; a label is shown by its name. Null texts are empty.
    """
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    stamp = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("["), clock(F.col(c)), F.lit("]"))).otherwise("")
    some = lambda c, before, after="": F.when(s(c) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    part = lambda df, k, n, line: df.select("meeting_id", F.lit(k).alias("part"), F.col(n).cast("long").alias("n"), line.alias("line"))
    rows = [part(meetings.filter(s("summary") != "").withColumn("n", F.lit(0)), 1, "n", words.strip(F.col("summary")))]
    if points is not None:
        rows.append(part(points, 0, "n", F.concat(F.lit("- "), s("text"))))
    if chapters is not None:
        rows.append(part(chapters, 2, "n", F.concat(F.lit("- "), stamp("start_ms"), F.lit(" **"), s("title"), F.lit("**"), some("summary", ": "))))
    if items is not None:
        flag = F.when(F.coalesce("grounded", F.lit(True)), "").otherwise(" _(unverified)_")
        owned = items.join(names.select("meeting_id", F.col("label").alias("owner"), "display"), ["meeting_id", "owner"], "left")
        who = F.coalesce("display", F.nullif("owner", F.lit("")), F.lit("Unassigned"))
        action = F.concat(F.lit("- [ ] **"), who, F.lit("**: "), s("text"), some("due", " (due ", ")"), F.lit(" "), stamp("t"), flag)
        plain = F.concat(F.lit("- "), s("text"), F.lit(" "), stamp("t"), flag)
        for k, kind in ((3, "decision"), (4, "action"), (5, "question")):
            rows.append(part(owned.filter(F.col("kind") == kind), k, "n", action if kind == "action" else plain))
    if visuals is not None:
        rows.append(part(visuals, 6, "n", F.concat(F.lit("- "), stamp("t"), F.lit(" "), s("caption"))))
    said = named(lines, names)
    rows.append(part(said, 7, "line_id", F.concat(F.lit("**"), "who", F.lit("** "), stamp("start_ms"), F.lit(": "), s("text"), F.lit("  "))))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    heads = F.element_at(F.array(*map(F.lit, PARTS)), F.col("part") + 1)
    parts = every.groupBy("meeting_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = parts.select("meeting_id", F.struct("part", F.concat(F.lit("\n## "), heads, F.lit("\n\n"), "body", F.lit("\n")).alias("text")).alias("x"))
    body = parts.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "").alias("body"))
    speakers = names.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", words.speaker_name(F.col("label"), F.col("display")).alias("name")))), lambda x: x["name"]), ", ").alias("speakers"))
    length = F.when(F.coalesce("length_ms", F.lit(0)) > 0, F.concat(F.lit("\n- Duration: "), clock(F.col("length_ms")))).otherwise("")
    head = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Meeting")), F.lit("\n\n- Date: "), F.substring(s("day"), 1, 10), length, some("speakers", "\n- Speakers: "), F.lit("\n"))
    out = meetings.join(body, "meeting_id", "left").join(speakers, "meeting_id", "left")
    return out.select("meeting_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def bundle(meetings: DataFrame, **relations: DataFrame) -> DataFrame:
    """One JSON text per meeting with its row and the rows of every relation, each sorted; a relation without rows is empty."""
    out = meetings.select("meeting_id", F.struct(*meetings.columns).alias("meeting"))
    for name, rows in relations.items():
        body = [c for c in rows.columns if c != "meeting_id"]
        out = out.join(rows.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct(*body))).alias(name)), "meeting_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.select("meeting_id", F.to_json(F.struct("meeting", *relations)).alias("json"))


def card(meetings: DataFrame, points: DataFrame, actions: DataFrame) -> DataFrame:
    """What a card shows besides the title: a gist (the first point, else the summary's first sentence, without marks, 280
    characters at most) and the number of actions. meetings: meeting_id, summary; points: meeting_id, n, text."""
    first = points.groupBy("meeting_id").agg(F.min_by("text", "n").alias("first"))
    n = actions.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_actions"))
    sentence = F.regexp_extract(F.coalesce("summary", F.lit("")), r"^(?s)(.*?[.!?])(?:\s|$)", 1)
    gist = F.coalesce(F.nullif("first", F.lit("")), F.nullif(sentence, F.lit("")), "summary", F.lit(""))
    out = meetings.join(first, "meeting_id", "left").join(n, "meeting_id", "left")
    return out.select("meeting_id", F.substring(F.regexp_replace(gist, r"[*_`#]", ""), 1, 280).alias("gist"), F.coalesce("n_actions", F.lit(0)).alias("n_actions"))
