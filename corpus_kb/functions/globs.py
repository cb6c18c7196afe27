"""Path globs and ignore rules, turned into regular expressions when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_kb.functions.text import BLANKS, bind, lines, strip


def glob_regex(pattern: str) -> str:
    """``**`` crosses directories, ``*`` and ``?`` stay inside one segment."""
    out, rest = "", pattern.replace("\\", "/")
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", rest):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return rf"\A(?s:{out})\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """One alternation for a whole pattern list, so a path is tested once."""
    if not patterns:
        return F.lit(False)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(glob_regex(p) for p in patterns))


def ignore_rules(text: Column) -> Column:
    """Parse an ignore file in its own row: ``array<struct<ord, regex, negated>>``.

    Comments and empty lines are dropped; ``!`` negates, a trailing ``/`` marks a directory and a
    leading or inner ``/`` anchors the pattern at the root.
    """
    stripped = F.filter(F.transform(lines(text), lambda l: strip(l)), lambda l: (l != "") & ~l.startswith("#"))

    def parse(line: Column, k: Column) -> Column:
        bare = F.rtrim(F.regexp_replace(line, r"\A!", ""), F.lit("/"))
        anchored = F.contains(bare, F.lit("/"))
        body = F.regexp_replace(bare, r"\A/", "")
        escaped = F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1")
        regex = escaped
        for glob, marker in (("**/", "\x01"), ("**", "\x02"), ("*", "\x03"), ("?", "\x04")):
            regex = F.replace(regex, F.lit(glob), F.lit(marker))
        for marker, fragment in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", ".")):
            regex = F.replace(regex, F.lit(marker), F.lit(fragment))
        # a matched directory takes everything below it along
        full = F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("(?:^|/)")), regex, F.lit("(?:/|$)"))
        return F.struct(k.alias("ord"), full.alias("regex"), line.startswith("!").alias("negated"), body.alias("body"))

    return F.transform(
        F.filter(F.transform(stripped, parse), lambda r: ~r["body"].isin("", "*")),
        lambda r: F.struct(r["ord"].alias("ord"), r["regex"].alias("regex"), r["negated"].alias("negated")),
    )


def is_ignored(rel: Column, rules: Column) -> Column:
    """The last rule that matches decides; no match keeps the file."""
    path = F.regexp_replace(F.replace(rel, F.lit("\\"), F.lit("/")), r"\A(?:\./)+", "")
    return bind(
        F.filter(rules, lambda r: F.regexp_like(path, r["regex"])),
        lambda hit: (F.size(hit) > 0) & ~F.coalesce(F.get(hit, F.size(hit) - 1)["negated"], F.lit(True)),
    )
