"""Text, markdown, code and transcript functions on small fixed cases."""

import pytest
from pyspark.sql import functions as F

from corpus_kb import schemas
from corpus_kb.functions import code, globs, terms
from corpus_kb.functions import markdown as M
from corpus_kb.functions import text as X
from corpus_kb.functions import transcripts as R
from corpus_kb.operators import quality as Q

t = F.col("t")


@pytest.mark.parametrize("text, want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("\n\n", ["", ""]), ("a\n\nb\n", ["a", "", "b"])])
def test_lines(evaluate, text, want):
    assert evaluate(X.lines(t), t=text) == want


def test_trim_line_ends_and_blank_runs(evaluate):
    assert evaluate(X.trim_line_ends(t), t="fn a() {   \r\n    let x = 1;\t\r\n}\r\n") == "fn a() {\n    let x = 1;\n}\n"
    assert evaluate(X.collapse_blank_runs(t), t="\n\n## A\n\n\n\n\n## B\n\n") == "## A\n\n## B"


def test_compaction_is_idempotent(evaluate):
    once = evaluate(X.compact(t), t="\n a  \n\n\t\n\nb\r\n\n")
    assert evaluate(X.compact(t), t=once) == once


@pytest.mark.parametrize("lines", [["x"] * 6, ["long line"] * 4, ["a", "a", "a", "a"], ["", "", "", "", ""], ["p", "q q q"] * 3, ["z"]])
def test_fold_and_unfold(evaluate, lines):
    folded = X.fold_identical_runs(F.split("t", "\n", -1))
    assert evaluate(X.unfold_runs(folded), t="\n".join(lines)) == lines


def test_fold_keeps_numbers(evaluate):
    got = evaluate(X.fold_identical_runs(X.lines(t)), t="a\nsame line\nsame line\nsame line\nsame line\nsame line\nsame line\nb")
    assert [(r["line_no"], r["text"]) for r in got] == [(1, "a"), (2, "same line  (x6)"), (8, "b")]


@pytest.mark.parametrize("path, want", [("a/./b/../c", "a/c"), ("a/../../b", "../b"), ("x//y", "x/y")])
def test_normalize_path(evaluate, path, want):
    assert evaluate(X.normalize_path(t), t=path) == want


def prose(seed, words):
    return " ".join(f"{'aeiou'[(seed + k) % 5]}lm{k % 13}" for k in range(words))


HARBOUR = f"# Harbour\n{prose(1, 120)}\n## Tides\n{prose(2, 120)}\n~~~\nno fence here\n~~~\n```sh\n# not a heading\nls\n```\n## Lights\n{prose(3, 130)}"


def test_chunks_follow_headings(evaluate):
    got = evaluate(M.structural_chunks(t), t=HARBOUR)
    heads = [k for k, line in enumerate(HARBOUR.split("\n"), 1) if line in ("# Harbour", "## Tides", "## Lights")]
    assert [c["start_line"] for c in got] == heads == [1, 3, 12]
    assert [c["title"] for c in got] == ["Harbour", "Tides", "Lights"]
    assert "# not a heading" in got[1]["body"] and got[2]["end_line"] == HARBOUR.count("\n") + 1
    assert all(c["summary"].strip() for c in got)


@pytest.mark.parametrize("text", ["", "\n\n"])
def test_empty_pages_have_no_chunks(evaluate, text):
    assert evaluate(M.structural_chunks(t), t=text) == []


def test_small_chunks_merge(spark):
    big = "x" * 500
    cases = [([("A", big), ("B", "tiny"), ("C", big)], 2), ([("intro", "short"), ("B", big)], 2), ([("A", f"i\n```rust\n{big}\n```"), ("B", "tail")], 2)]
    for pieces, want in cases:
        rows = [(title, 1, 10, body, f"{title} summary") for title, body in pieces]
        df = spark.createDataFrame([(rows,)], "p array<struct<title:string,start_line:bigint,end_line:bigint,body:string,summary:string>>")
        got = df.select(M.merge_small(F.col("p")).alias("m")).first()["m"]
        assert len(got) == want, got
    assert got[0]["title"] == "A"


@pytest.mark.parametrize("text, want", [
    ("---\nowner: me\n---\n# 港口\n文", "港口"), ("words first\n\n#   Two words  \n# Later", "Two words"),
    ("```\n# inside a fence\n```\n# Outside", "Outside"), ("### third level only", None), ("", None),
])
def test_first_heading(evaluate, text, want):
    assert evaluate(M.first_heading(t), t=text) == want


def test_front_matter_round_trip(evaluate):
    text = "---\ntitle: x\ntype: y\n---\n# Body\n"
    assert evaluate(M.page_content(M.front_matter(t), M.strip_front_matter(t)), t=text) == text


def test_links(evaluate):
    text = "x `[a](z)` [t](../a/b.md#s) [u](http://x) [v](c.md \"T\")\n[r]: ./d.md\n```\n[n](no.md)\n```\n~~~\n[m](no.md)\n~~~\n"
    assert evaluate(M.link_targets(t), t=text) == ["../a/b.md", "c.md", "./d.md"]


def test_claims(evaluate):
    text = "- not yet here\n## Claims\n- short\n- a longer claim\n* another claim\n## Other\n- not a claim\n### More CLAIMS\n- last claim of all\n"
    assert evaluate(M.claims_of(t), t=text) == ["a longer claim", "another claim", "last claim of all"]


@pytest.mark.parametrize("pattern, path, want", [
    ("**/*.rs", "crates/a/src/lib.rs", True), ("crates/**/*.rs", "crates/a/src/lib.rs", True), ("**/.env", ".env", True),
    ("**/.env", "web/.env", True), ("*.rs", "src/lib.rs", False), ("src/*.rs", "src/lib.rs", True), ("src/?b.rs", "src/abc.rs", False),
])
def test_globs(evaluate, pattern, path, want):
    assert evaluate(globs.matches_glob(t, pattern), t=path) is want


@pytest.mark.parametrize("path, want", [("app.log", True), ("keep.log", False), ("secrets/a.txt", True), ("src/main.rs", False), ("x/app.log", True), ("root.txt", True), ("x/root.txt", False)])
def test_ignore_rules(evaluate, path, want):
    rules = "# comment\n*.log\nsecrets/\n!keep.log\n/root.txt\n"
    assert evaluate(globs.is_ignored(t, globs.ignore_rules(F.col("r"))), t=path, r=rules) is want


RUST = "use std::fmt;\n\npub enum Tide {\n    High,\n    Low,\n}\n\nimpl fmt::Display for Tide {\n    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {\n        let name = 1;\n    }\n}\n\npub async fn measure(depth: u32) {}\ntrait Gauge {}\n"
TS = "export class Lamp {\n  private on = false;\n  toggle(times: number) {\n    return times;\n  }\n}\n\nfunction dim() {}\nexport const glow = (x) => x;\nwhile (true) {\n}\n"
PY = "import os\n\ndef tide_at(hour):\n    return hour\n\nclass Buoy:\n    async def ring(self):\n        pass\n"


@pytest.mark.parametrize("lang, text, named", [
    ("rust", RUST, {"enum Tide": "pub enum Tide", "fn fmt": "    fn fmt", "fn measure": "pub async fn measure", "trait Gauge": "trait Gauge"}),
    ("typescript", TS, {"class Lamp": "export class Lamp", "method toggle": "  toggle(", "function dim": "function dim", "const glow": "export const glow"}),
    ("python", PY, {"def tide_at": "def tide_at", "class Buoy": "class Buoy", "def ring": "    async def ring"}),
])
def test_outline(evaluate, lang, text, named):
    """Every named declaration is reported on the line that starts with its text, and nothing else but impl blocks is."""
    got = {f"{d['kind']} {d['name']}": d["line"] for d in evaluate(code.outline(t, F.col("l")), t=text, l=lang)}
    lines = text.split("\n")
    assert {k: v for k, v in got.items() if not k.startswith("impl")} == {k: next(i for i, x in enumerate(lines, 1) if x.startswith(v)) for k, v in named.items()}


@pytest.mark.parametrize("line, want", [("pub fn run(x)", True), ("pub fn runner(x)", False), ("// fn run(x)", False), ("export class run {", True), ("  def run(self):", True), ("x = run()", False)])
def test_definitions(evaluate, line, want):
    assert evaluate(code.defines(t, "run"), t=line) is want


def test_query_terms(evaluate):
    question = "灯塔在哪里？"
    got = evaluate(terms.query_terms(t), t=question)
    assert got and all(x in question and len(x) <= 4 for x in got) and len(set(got)) == len(got)
    mixed = evaluate(terms.query_terms(t), t="Where does tide.height use buoy_count?")
    assert {"height", "buoy", "count"} <= set(mixed)
    assert "buoycount" in evaluate(terms.query_terms(t, compat=True), t="buoy_count")
    assert evaluate(terms.query_terms(t), t="塔") == ["塔"]
    assert evaluate(terms.query_terms(t), t=" ") == []


def test_ngrams_keep_characters_whole(evaluate):
    assert evaluate(terms.ngrams(t, 3), t="a\U0001F600b\U0001F601c") == ["a\U0001F600b", "\U0001F600b\U0001F601", "b\U0001F601c"]
    assert evaluate(terms.ngrams(t, 3), t="ab") == []


CALL = "<tool_call><function=sound_horn>\n<parameter=place>\npier/7\n</parameter>\n<parameter=times>3</parameter>\n</function></tool_call>\n"


def test_extracts_typed_calls(evaluate):
    got = evaluate(R.tool_calls(t, ("times",)), t="Before.\n" + CALL + "After.")
    assert [(c["name"], c["arguments"]) for c in got] == [("sound_horn", '{"place":"pier/7","times":3}')]
    quoted = "<function=dim><parameter name='level'>low</parameter></function>"
    assert evaluate(R.tool_calls(t), t=quoted)[0]["args"] == {"level": "low"}
    assert evaluate(R.tool_calls(t), t=CALL.replace("</function>", "")) == []


@pytest.mark.parametrize("opening, closing", R.CONTAINERS)
def test_strips_every_container(evaluate, opening, closing):
    text = f"Kept above\n{opening}x>inner words{closing}\nKept below"
    assert evaluate(R.strip_calls(t), t=text).split() == ["Kept", "above", "Kept", "below"]
    assert evaluate(R.strip_calls(t), t="# Plain\n\ntext ") == "# Plain\n\ntext "


def test_an_unclosed_call_loses_one_line(evaluate):
    cleaned = evaluate(R.sanitize_body(t), t="Above.\n" + CALL.split("</parameter>")[0])
    assert "Above." in cleaned and "pier/7" in cleaned and "<tool_call>" not in cleaned


def test_pollution(evaluate):
    assert evaluate(Q.pollution(t), t="## 职责\n\n定义入口。\n") is None
    assert evaluate(Q.pollution(t), t="a\n" + R.DRAFT_MARKER) == R.DRAFT_MARKER
    assert evaluate(Q.pollution(t), t="<functionx\n<functiony\n") == Q.TRANSCRIPT_LINES


def test_model_chunks(evaluate):
    wrapped = 'Sure:\n```json\n[{"title":"T","summary":"s","body":"b","start_line":2,"end_line":4}]\n```'
    got = evaluate(R.model_chunks(t, schemas.MODEL_CHUNKS), t=wrapped)
    assert [(c["title"], c["start_line"], c["end_line"]) for c in got] == [("T", 2, 4)]
    kept = evaluate(R.model_chunks(t, schemas.MODEL_CHUNKS), t='[{"body":"   "},{"summary":"only summary","body":"kept"}]')
    assert [(c["title"], c["summary"], c["body"]) for c in kept] == [("Chunk", "only summary", "kept")]
    for bad in ("no json at all", "[]"):
        assert evaluate(R.model_chunks(t, schemas.MODEL_CHUNKS), t=bad) is None


def folded(spark, rounds):
    df = spark.createDataFrame([(rounds,)], "r array<struct<text:string,is_tool_round:boolean>>")
    return df.select(R.merge_prose(F.col("r")).alias("b")).first()["b"]


@pytest.mark.parametrize("rounds, want", [
    ([], ""), ([("", False), ("  ", True)], ""), ([("now I will look", True)], ""), ([("now I will look", False)], "now I will look"),
    ([("- a list\n- of tides", True)], "- a list\n- of tides"),
    ([("one", False), ("two", False)], "one\ntwo"), ([("one\n", False), ("# Two", False)], "one\n\n# Two"),
    ([("the tide rises", False), ("so the tide rises, then falls", False)], "so the tide rises, then falls"),
    ([("first\nlast words", False), ("last words", False)], "first\nlast words"),
])
def test_prose_folds(spark, rounds, want):
    """Worked by hand: narration goes, supersets win, repeats of the end are dropped, the rest is appended."""
    assert folded(spark, rounds) == want


def test_prose_fold_properties(spark):
    rounds = [("# Tides\nrise", False), ("looking", True), ("and fall", False), ("## Moon\npulls", False)]
    page = folded(spark, rounds)
    assert folded(spark, [*rounds, (page, False)]) == page
    assert folded(spark, [*rounds, rounds[-1]]) == page
    assert folded(spark, [*rounds, ("more looking", True)]) == page
    assert folded(spark, [*rounds, (page + "\nmore", False)]) == page + "\nmore"


def test_deep_page_has_no_gaps(spark):
    filler = prose(7, 40) + ". "
    cites = "`src/pier.rs` `src/tide.rs` `Lamp::dim` `ring_all` `web/Map.tsx` `tide.toml` `measure()` `light_it` "
    body = f"## A\n{filler}\n## B\n| a | b |\n| - | - |\n| c | d |\n## C\n```mermaid\ngraph LR\n```\n## D\n{filler * 8}\n{filler * 8}\n{cites}\n## Claims\n" + "- one fact here\n" * 5
    rows = [("deep", "Architecture", body), ("placeholder", "Architecture", body + "需人工补全。"), ("thin", "Module", "## One\ntoo short")]
    got = {r["path"]: r["gaps"] for r in Q.quality_report(spark.createDataFrame(rows, "path string, page_type string, body string")).collect()}
    assert got["deep"] == [] and got["placeholder"] == ["placeholder"]
    assert {"chars", "sections", "table", "diagram", "claims_section", "duties"} <= set(got["thin"])


def test_a_body_is_cleaned_once(spark):
    """The patterns of containers and lines stand once in the plan, however often the cleaned text is used."""
    df = spark.createDataFrame([("x",)], "t string").select(R.sanitize_body(F.col("t")).alias("t"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?s:.*?)</tool_calls>") == 1 and plan.count("rlike") + plan.count("RLIKE") <= 3
