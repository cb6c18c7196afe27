"""Tool-call transcripts inside text, and folding of prose across turns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_kb.functions.text import bind, lines, strip

# fixed values: the part that keeps a tag name from being read as a call by editors of this file
INVOKE = "in" + "voke"
# fixed values: containers a textual tool call is wrapped in, opening and closing, in order
CONTAINERS = (
    ("<tool_calls", "</tool_calls>"),
    ("<tool_call", "</tool_call>"),
    ("<function_calls", "</function_calls>"),
    ("<function_call", "</function_call>"),
    ("<tool_use", "</tool_use>"),
    (f"<{INVOKE} name=", f"</{INVOKE}>"),
    (f"antml:{INVOKE}", f"</{INVOKE}>"),
    ("<function=", "</function>"),
)
# fixed values: line marks of a transcript
TRANSCRIPT_LINE_STARTS = ("antml:", "tool_use_id")
TRANSCRIPT_LINE_TAGS = (
    "<function=", "<function_call", "</function", "<tool_call", "</tool_call", "<tool_use", "</tool_use",
    f"<{INVOKE} name=", f"</{INVOKE}", "assistant to=functions",
)
JSON_CALL_MARKS = ('{"name":"read_file"', '{"name":"grep"')
DRAFT_MARKER = "<!-- corpus_kb:draft -->"
PAGE_LINE = r"(?m)^[^\S\n]*(?:#|\||- |\* |```|>)"


def _containers() -> list[tuple[str, str]]:
    # a longer opening must not be read as a shorter one, hence the lookahead
    return [(re.escape(o) + ("(?!s)" if o.endswith("_call") else ""), re.escape(c)) for o, c in CONTAINERS]


def _any_of(patterns: list[str]) -> str:
    """The patterns in their order, looked at only where the first character of one stands."""
    return rf"(?=[{''.join(sorted({p.lstrip(chr(92))[0] for p in patterns}))}])(?:{'|'.join(patterns)})"


def _container_regex() -> str:
    closed = [f"{o}(?s:.*?){c}" for o, c in _containers()]
    return _any_of([*closed, *[rf"{o}[^\n]*(?:\n|\z)" for o, _ in _containers()]])


def _line_regex() -> str:
    starts = "|".join(re.escape(s) for s in TRANSCRIPT_LINE_STARTS)
    return rf"^\s*(?:{starts})|{_any_of([re.escape(t) for t in TRANSCRIPT_LINE_TAGS])}"


def has_transcript(text: Column) -> Column:
    opening = _any_of([o for o, _ in _containers()])
    return text.rlike(rf"(?m){opening}|{_line_regex()}")


def strip_calls(text: Column) -> Column:
    """Remove textual tool calls; an unclosed one loses only its own line. Clean text is unchanged."""
    def kept(rest: Column) -> Column:
        return F.array_join(F.filter(lines(rest), lambda l: ~l.rlike(_line_regex())), "\n")

    return bind(text, lambda t: F.when(has_transcript(t), strip(bind(F.regexp_replace(t, _container_regex(), ""), kept))).otherwise(t))


def sanitize_body(text: Column) -> Column:
    """Generated body without transcripts, JSON call lines, draft marks and piled-up blank lines."""
    marks = _any_of([re.escape(m) for m in (*JSON_CALL_MARKS, DRAFT_MARKER)])
    kept = bind(strip_calls(text), lambda t: F.filter(lines(t), lambda l: ~l.rlike(marks)))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def _json_text(value: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'\A\{"v":((?s:.*))\}\z', 1)


def _last_per_key(entries: Column) -> Column:
    return F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )


def tool_calls(text: Column, raw_types: tuple[str, ...] = ()) -> Column:
    """Closed function blocks: ``array<struct<pos, name, args, arguments>>``.

    ``arguments`` is a JSON object with sorted keys; parameters named in ``raw_types`` stay numbers,
    booleans, arrays or objects where their text is valid JSON, all others are strings.
    """
    block = r"<function=([^>]*)>((?s:.*?))</function>"
    param = r"<parameter\s*(?:name\s*)?=\s*[\"']*([^>]*?)[\"']*\s*>((?s:.*?))</parameter>"

    def entries_of(body: Column) -> Column:
        pairs = F.zip_with(
            F.regexp_extract_all(body, F.lit(param), F.lit(1)),
            F.regexp_extract_all(body, F.lit(param), F.lit(2)),
            lambda k, v: F.struct(strip(k).alias("key"), strip(v).alias("value")),
        )
        return bind(pairs, _last_per_key)

    def json_value(e: Column) -> Column:
        is_raw = e["key"].isin(*raw_types) if raw_types else F.lit(False)
        valid = e["value"].rlike(r"\A(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\z") | (
            e["value"].rlike(r"\A[\[{]") & F.try_parse_json(e["value"]).isNotNull()
        )
        return F.when(is_raw & valid, e["value"]).otherwise(_json_text(e["value"]))

    def call(name: Column, body: Column) -> Column:
        return bind(
            F.array_sort(entries_of(body)),
            lambda entries: F.struct(
                F.btrim(strip(name), F.lit('"')).alias("name"),
                F.map_from_entries(entries).alias("args"),
                F.concat(
                    F.lit("{"),
                    F.array_join(F.transform(entries, lambda e: F.concat(_json_text(e["key"]), F.lit(":"), json_value(e))), ","),
                    F.lit("}"),
                ).alias("arguments"),
            ),
        )

    blocks = F.zip_with(
        F.regexp_extract_all(text, F.lit(block), F.lit(1)), F.regexp_extract_all(text, F.lit(block), F.lit(2)), call
    )
    numbered = F.transform(
        blocks,
        lambda c, i: F.struct(
            i.cast("bigint").alias("pos"), c["name"].alias("name"), c["args"].alias("args"), c["arguments"].alias("arguments")
        ),
    )
    return F.filter(numbered, lambda c: c["name"] != "")


def canonical_arguments(arguments: Column) -> Column:
    """JSON arguments with the keys of every object sorted and values of their own type; text that is no JSON object is only trimmed."""
    parsed = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(strip(arguments))


def call_key(name: Column, arguments: Column) -> Column:
    return F.concat(name, F.lit("\x01"), canonical_arguments(arguments))


def looks_like_page(text: Column) -> Column:
    """A heading, table, list, fence or quote line is present."""
    return text.rlike(PAGE_LINE)


def merge_prose(rounds: Column) -> Column:
    """Fold the rounds of one answer (``array<struct<text, is_tool_round>>``) into its page text.

    Narration of tool rounds and repeats of the page's tail are dropped, a round that contains the
    page replaces it, anything else is appended.
    """

    def step(body: Column, r: Column) -> Column:
        prose, current = strip(r["text"]), strip(body)
        line_end = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
        opened = F.when(looks_like_page(prose) & ~line_end.endswith("\n\n"), F.concat(line_end, F.lit("\n"))).otherwise(line_end)
        return (
            F.when((prose == "") | (r["is_tool_round"] & ~looks_like_page(prose)), body)
            .when(current == "", prose)
            .when(current.endswith(prose), body)
            .when(F.contains(prose, current), prose)
            .otherwise(F.concat(opened, prose))
        )

    return F.aggregate(rounds, F.lit("").cast("string"), step)


def model_chunks(answer: Column, schema) -> Column:
    """Chunks in a model's answer: the JSON array between the first ``[`` and the last ``]``.

    Items without a body are dropped; title, summary and lines get defaults. Null where nothing is usable.
    """
    items = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), schema)
    usable = F.filter(items, lambda c: strip(F.coalesce(c["body"], F.lit(""))) != "")

    def clean(c: Column) -> Column:
        title = strip(F.coalesce(c["title"], F.lit("Chunk")))
        summary = strip(F.coalesce(c["summary"], F.lit("")))
        return F.struct(
            title.alias("title"),
            F.coalesce(c["start_line"], F.lit(1)).cast("bigint").alias("start_line"),
            F.coalesce(c["end_line"], F.lit(1)).cast("bigint").alias("end_line"),
            strip(c["body"]).alias("body"),
            F.when(summary == "", title).otherwise(summary).alias("summary"),
        )

    return bind(usable, lambda u: F.when(F.size(u) > 0, F.transform(u, clean)))
