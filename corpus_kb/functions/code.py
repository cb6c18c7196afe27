"""Source-code classification and declaration patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_kb.functions.text import bind, lines, strip

# fixed values: file extension to language
LANGUAGES = {
    "rust": "rs",
    "typescript": "ts tsx mts cts",
    "javascript": "js jsx mjs cjs",
    "python": "py pyi",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "c": "c h",
    "cpp": "cpp cc hpp cxx",
}

# fixed values: extensions read as text
TEXT_EXTENSIONS = (
    "rs toml json md txt ts tsx js jsx py go java c h cpp hpp cs rb php sh ps1 bat yml yaml sql css scss html "
    "vue kt swift gradle mod sum cfg ini xml proto mjs cjs lock env gitignore"
).split()

# fixed values: directories no scan enters
SKIP_DIRS = ".git node_modules target dist build .venv venv __pycache__ .idea .vscode .corpus_kb corpus_kb_out".split()

# fixed values: usual names of entry files
ENTRY_NAMES = (
    "main.rs lib.rs App.tsx main.ts main.tsx index.ts index.tsx main.py __main__.py app.py main.go Main.java Program.cs"
).split()

# fixed values: manifest names
MANIFESTS = "cargo.toml package.json pyproject.toml go.mod pom.xml".split()

# fixed values: path keywords of files that hold data models or automation
DATA_MODEL_HINTS = "schema migration model entity db sql store repository".split()
CI_HINTS = [".github/workflows", ".gitlab-ci"]
API_FILES = "lib.rs main.rs index.ts mod.rs App.tsx".split()

# fixed values: directory keyword to role, first match wins
DIRECTORY_ROLES = (
    ("测试", "test"),
    ("文档", "doc"),
    ("前端/UI", "web frontend ui"),
    ("命令行入口", "cli"),
    ("服务/API", "server api"),
    ("核心逻辑", "core lib src"),
    ("存储/数据", "store db data"),
    ("共享工具", "util common shared"),
    ("配置", "config"),
)
DEFAULT_ROLE = "见目录内入口文件"

# fixed values: outline limits
MAX_ITEM_INDENT = 12
MAX_CALLABLE_INDENT = 6

# fixed values: words before the keyword of a declaration
RUST_MODIFIERS = r"pub\((?:crate|super|self|in crate)\)|(?:pub|async|unsafe|default|extern \"C\"|extern) "
JS_MODIFIERS = r"(?:export|default|declare|abstract|async|public|private|protected|readonly|override|static) "
PY_MODIFIERS = r"async "

# fixed values: declaration keywords
RUST_KINDS = {
    "fn": r"const fn |fn ", "struct": "struct ", "enum": "enum ", "trait": "trait ", "macro": "macro_rules! ",
    "mod": "mod ", "type": "type ", "const": "const ", "static": "static ", "union": "union ",
}
JS_KINDS = {
    "function": r"function\*? ", "class": "class ", "interface": "interface ", "type": "type ", "enum": "enum ",
    "const": "const ", "let": "let ", "var": "var ",
}
PY_KINDS = {"def": "def ", "class": "class "}
JS_KEYWORDS = (
    "if for while switch return catch else case await new throw typeof do try void delete yield super this import from"
).split()

# fixed values: what precedes a defined name
DEFINITION_HEADS = (
    "fn, pub fn, pub(crate) fn, pub(super) fn, struct, pub struct, enum, pub enum, trait, pub trait, type, mod, function, "
    "class, const, export function, export class, export const, export async function, def, interface, export interface"
).split(", ")

IDENTIFIER = r"[\p{L}\p{N}_]+"


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = None
    for name, extensions in LANGUAGES.items():
        test = ext.isin(*extensions.split())
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def is_text_extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*TEXT_EXTENSIONS)


def in_skipped_dir(path: Column, skip: list[str] = SKIP_DIRS) -> Column:
    names = "|".join(re.escape(d) for d in skip)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def directory_role(path: Column) -> Column:
    lowered = F.lower(path)
    out = None
    for role, keywords in DIRECTORY_ROLES:
        test = lowered.rlike("|".join(keywords.split()))
        out = F.when(test, F.lit(role)) if out is None else out.when(test, F.lit(role))
    return out.otherwise(F.lit(DEFAULT_ROLE))


def has_hint(path: Column, hints: list[str]) -> Column:
    return F.lower(path).rlike("|".join(re.escape(h) for h in hints))


def defines(line: Column, name: str, prefix: bool = False) -> Column:
    """The line looks like a definition of ``name``; comment lines never do."""
    stripped = strip(line)
    heads = "|".join(re.escape(h) for h in DEFINITION_HEADS)
    end = "" if prefix else rf"(?![\p{{L}}\p{{N}}_])"
    start = rf"\A(?:{heads}) {re.escape(name)}{end}"
    inside = rf"(?:{heads}) {re.escape(name)}[( ]"
    return ~stripped.rlike(r"\A(?://|#|\*|/\*)") & stripped.rlike(f"{start}|{inside}")


def strip_modifiers(line: Column, modifiers: str) -> Column:
    return F.regexp_replace(line, rf"\A(?:\s*(?:{modifiers}))+\s*", "")


def strip_generics(name: Column) -> Column:
    """Drop a leading generic parameter list, nested one or two levels deep."""
    return F.regexp_replace(F.ltrim(name), r"\A<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*", "")


def _declaration(rest: Column, kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("struct<kind:string,name:string>")
    chain = None
    for kind, keyword in kinds.items():
        name = F.regexp_extract(rest, rf"\A(?:{keyword})({IDENTIFIER})", 1)
        test = rest.rlike(rf"\A(?:{keyword})")
        value = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(out)


def _rust_item(line: Column, indent: Column) -> Column:
    return bind(
        strip_modifiers(line, RUST_MODIFIERS),
        lambda rest: F.when(line.rlike(r"\A#[\[!]"), None)
        .when(
            rest.startswith("impl"),
            F.struct(
                F.lit("impl").alias("kind"),
                strip(strip_generics(F.regexp_extract(rest, r"\Aimpl((?:(?! where)[^{])*)", 1))).alias("name"),
            ),
        )
        .otherwise(
            bind(
                _declaration(rest, RUST_KINDS),
                lambda d: F.when((d["kind"] == "fn") & (indent > MAX_CALLABLE_INDENT), None).otherwise(d),
            )
        ),
    )


def _js_item(line: Column, indent: Column) -> Column:
    def method(rest: Column) -> Column:
        name = F.regexp_extract(rest, rf"\A({IDENTIFIER})\s*(?:\(|=.*(?:=>|function)|<.*=>)", 1)
        return F.when(
            (name != "") & ~name.isin(*JS_KEYWORDS) & (indent <= MAX_CALLABLE_INDENT),
            F.struct(F.lit("method").alias("kind"), name.alias("name")),
        )

    return bind(
        strip_modifiers(line, JS_MODIFIERS),
        lambda rest: bind(
            _declaration(rest, JS_KINDS),
            lambda d: F.when(d.isNull(), method(rest))
            .when(d["kind"].isin("const", "let", "var") & ~rest.rlike("=>|function"), None)
            .otherwise(d),
        ),
    )


def _py_item(line: Column, indent: Column) -> Column:
    return F.when(~line.startswith("#"), _declaration(strip_modifiers(line, PY_MODIFIERS), PY_KINDS))


def outline(text: Column, lang: Column, max_items: int | None = None) -> Column:
    """Declarations of a source text: ``array<struct<line, kind, name>>``, at most 200."""

    def item(raw: Column, k: Column) -> Column:
        indent = F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t")))
        line = strip(raw)
        usable = ~line.rlike(r"\A(?:$|//|/\*|\*)") & (indent <= MAX_ITEM_INDENT)
        found = (
            F.when(lang == "rust", _rust_item(line, indent))
            .when(lang.isin("typescript", "javascript"), _js_item(line, indent))
            .when(lang == "python", _py_item(line, indent))
        )
        return bind(
            F.when(usable, found),
            lambda d: F.struct((k + 1).cast("bigint").alias("line"), d["kind"].alias("kind"), d["name"].alias("name")),
        )

    # only lines that can start a declaration reach the pattern chain
    items = F.transform(lines(text), item)
    named = F.filter(items, lambda d: d["kind"].isNotNull() & (d["name"] != "") & (F.octet_length(d["name"]) < 80))
    return named if max_items is None else F.slice(named, 1, max_items)


def symbols(text: Column, lang: Column) -> Column:
    """Public declarations of a source text: ``array<struct<kind, name>>``."""
    heads = {
        "rust": r"\Apub (fn|struct|enum)\s+",
        "typescript": r"\Aexport (function|class|interface|type|const)\s+",
        "python": r"\A(def|class)\s+",
    }

    def of(head: str) -> Column:
        found = F.filter(F.transform(lines(text), lambda l: strip(l)), lambda l: l.rlike(head + IDENTIFIER))
        return F.transform(
            found,
            lambda l: F.struct(
                F.regexp_extract(l, head, 1).alias("kind"),
                F.regexp_extract(l, head + f"({IDENTIFIER})", 2).alias("name"),
            ),
        )

    empty = F.array().cast("array<struct<kind:string,name:string>>")
    return (
        F.when(lang == "rust", of(heads["rust"]))
        .when(lang.isin("typescript", "javascript"), of(heads["typescript"]))
        .when(lang == "python", of(heads["python"]))
        .otherwise(empty)
    )
