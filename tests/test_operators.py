"""Operators on small tables: golden cases, replay, brute force, skew."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_kb.functions import markdown as M
from corpus_kb.operators import conversation as V
from corpus_kb.operators import delta as D
from corpus_kb.operators import graph as G
from corpus_kb.operators import index as I
from corpus_kb.operators import outline as O
from corpus_kb.operators import runs as U
from corpus_kb.operators import scan as P
from corpus_kb.operators import search as S
from corpus_kb.operators import segment as C
from corpus_kb.plans.evidence import BUDGET, evidence

CHUNK = "chunk_id string, page_path string, ord bigint, title string, summary string, body string, start_line bigint, end_line bigint, source string"


def chunk_table(spark, rows):
    return spark.createDataFrame([(i, p, 0, t, s, b, 1, 2, "structural") for i, p, t, s, b in rows], CHUNK)


@pytest.fixture
def chunks(spark):
    return chunk_table(spark, [
        ("ck_1", "pier.md", "Mooring", "how boats are tied to the pier", "The harbour master assigns a mooring buoy to every boat."),
        ("ck_2", "tide.md", "Tide tables", "heights by hour", "The table holds one height for each hour of the day."),
        ("ck_3", "lamp.md", "灯塔", "灯塔的开关时间", "灯塔在日落时打开，在日出时关闭。"),
        ("ck_4", "fog.md", "雾笛", "雾中信号", "能见度低时鸣笛。"),
    ])


def search_ids(spark, chunks, query, **kw):
    queries = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    return [r["id"] for r in S.search(queries, chunks, **kw).orderBy("pos").collect()]


@pytest.mark.parametrize("query, mode, want", [
    ("buoy", "auto", "ck_1"), ("heights of the tide", "auto", "ck_2"), ("灯塔在什么时候打开？", "auto", "ck_3"), ("雾笛", "like", "ck_4"), ("雾笛", "auto", "ck_4"),
])
def test_search_finds(spark, chunks, query, mode, want):
    assert want in search_ids(spark, chunks, query, mode=mode)


def test_blank_query_finds_nothing(spark, chunks):
    assert search_ids(spark, chunks, "  ") == []


def test_entities_and_details(spark, chunks):
    ents = spark.createDataFrame([("e1", "module", "buoy", "module:buoy", "active"), ("e2", "module", "buoy2", "k", "retired")], "id string, kind string, name string, canonical_key string, status string")
    queries = spark.createDataFrame([(1, "buoy")], "query_id bigint, query string")
    got = S.search(queries, chunks, ents).orderBy("pos").collect()
    assert [(r["kind"], r["id"]) for r in got] == [("chunk", "ck_1"), ("module", "e1")]
    assert got[0]["body"] and got[1]["body"] is None


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "be", "a", "gamma", "ga", "delta", "lta", "Ünï", "灯塔", "塔"]
    return [(f"ck_{i:03d}", f"p{i % 7}", rng.choice(words), rng.choice(words), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(n)]


def test_scan_index_and_brute_force_agree(spark, tmp_path):
    rows = random_texts(120, 3)
    table = chunk_table(spark, rows)
    wanted = ["alpha", "a", "be", "lta", "ünï", "灯塔", "塔", "et", "zzz"]
    terms = spark.createDataFrame([(w,) for w in wanted], "term string")
    cols = ("term", "chunk_id", "in_head", "tf")
    brute = set()
    for cid, _, title, summary, body in rows:
        head, text = f"{title}\n{summary}".lower(), f"{title}\n{summary}\n{body}".lower()
        brute |= {(w, cid, w in head, text.count(w) if len(w) >= 3 else 1) for w in wanted if w in text}
    I.write_index(I.gram_sets(table, "chunk_id", S.CHUNK_TEXT), str(tmp_path / "i"), buckets=4)
    stored = I.read_index(spark, str(tmp_path / "i"))
    for kw in ({}, {"max_broadcast_terms": 3}, {"postings": stored}):
        got = S.match_terms(terms, table, "chunk_id", ["title", "summary"], ["body"], **kw)
        assert {tuple(r) for r in got.select(*cols).collect()} == brute


@pytest.mark.parametrize("most", [100_000, 3])
def test_matching_by_words_against_brute_force(spark, most):
    """Terms that hold marks are searched in the texts, all others in the distinct words; rows of equal ids stay apart."""
    rows = [(c, p, t, s, re.sub("alpha beta", "alpha.beta/beta", b)) for c, p, t, s, b in random_texts(90, 5)]
    rows += [("ck_000", "p0", "Anana", "a", "ananana banana_ana"), ("ck_zzz", "p1", "", "", "")]
    table = chunk_table(spark, rows)
    wanted = ["alpha", "a", "be", "lta", "ünï", "灯塔", "塔", "ana", "zzz", "alpha.beta", "a b"]
    terms = spark.createDataFrame([(w,) for w in wanted], "term string")
    got = S.match_terms(terms, table, "chunk_id", ["title", "summary"], ["body"], max_broadcast_terms=most, by_words=True)
    brute = []
    for cid, _, title, summary, body in rows:
        head, text = f"{title}\n{summary}".lower(), f"{title}\n{summary}\n{body}".lower()
        brute += [(w, cid, w in head, text.count(w) if len(w) >= 3 else 1) for w in wanted if w in text]
    assert sorted(tuple(r) for r in got.select("term", "chunk_id", "in_head", "tf").collect()) == sorted(brute)


def random_page(rng):
    out = []
    for _ in range(rng.randint(0, 60)):
        out.append(rng.choice(["", "# T", "## Sub " + "h" * rng.randint(0, 9), "```", "  ```rust", "word " * rng.randint(1, 60), "x" * rng.randint(1, 700), "#tag"]))
    return "\n".join(out) + rng.choice(["", "\n"])


def test_best_hits_need_no_score_for_every_pair(spark, monkeypatch):
    """Against plain BM25 over all pairs; the items that reach the final ranking are few although common words are everywhere."""
    rng, common = random.Random(8), ["tide", "lamp", "pier", "buoy", "fog"]
    rows = [(f"ck_{i:03d}", f"p{i}", "t", "s", " ".join(rng.choices(common, k=30) + [f"rare{rng.randrange(60)}"] * rng.randrange(1, 4))) for i in range(400)]
    table = chunk_table(spark, rows)
    queries = [(q, " ".join(rng.sample(common, 3) + [f"rare{q}", f"rare{q + 20}"])) for q in range(12)]
    terms = S.query_terms(spark.createDataFrame(queries, "query_id bigint, query string"))
    matches = S.match_terms(terms.select("term").distinct(), table, "chunk_id", ["title", "summary"], ["body"])
    sizes = {}
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: sizes.setdefault(name, real(df, name)) if name == "candidates" else real(df, name))
    got = S.bm25_hits(terms, matches, table, "chunk_id", S.CHUNK_TEXT, 3).orderBy("query_id", F.desc("strength"), "chunk_id").collect()
    tf = {(r["term"], r["chunk_id"]): (r["tf"], r["doc_len"]) for r in matches.collect()}
    df = {}
    for term, _ in tf:
        df[term] = df.get(term, 0) + 1
    lengths = [sum(max(len(x) - 2, 0) for x in r[2:]) for r in rows]
    mean = sum(lengths) / len(rows)
    for q, text in queries:
        score = {}
        for term in text.split():
            idf = max(np.log((400 - df.get(term, 0) + 0.5) / (df.get(term, 0) + 0.5)), 1e-6)
            for i, *_ in rows:
                if (term, i) in tf:
                    n, length = tf[term, i]
                    score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]
        mine = [(r["chunk_id"], r["strength"]) for r in got if r["query_id"] == q]
        assert [i for i, _ in mine] == [i for i, _ in best] and np.allclose([x for _, x in mine], [x for _, x in best])
    assert sizes["candidates"].count() < 0.2 * 12 * 400


def is_heading(lines, number):
    """Whether a line (from 1) opens a section: a heading mark outside fences."""
    fences = sum(line.lstrip().startswith("```") for line in lines[: number - 1])
    return fences % 2 == 0 and lines[number - 1].startswith("#")


def test_chunks_keep_the_rules_of_the_split(spark):
    """Stated as properties: where a chunk may start, what it is called, how small and how large it may be."""
    rng = random.Random(11)
    pages = {f"p{i}": random_page(rng) for i in range(150)}
    df = spark.createDataFrame(list(pages.items()), "path string, body string")
    for target in (60, 512):
        chunks = {}
        for r in C.chunk_pages(df, target_tokens=target).orderBy("page_path", "ord").collect():
            chunks.setdefault(r["page_path"], []).append(r)
        for path, text in pages.items():
            lines = text.split("\n")
            own = chunks.get(path, [])
            assert bool(own) == bool(text.strip())
            for before, chunk in zip([None, *own], own):
                at = chunk["start_line"]
                opened = next((k for k in range(at, 0, -1) if is_heading(lines, k)), None)
                assert chunk["title"] == (lines[opened - 1].lstrip("#").strip() if opened else "Overview")
                if before is not None and opened != at:
                    # apart from headings a cut only follows lines that have reached the size, and never lies in a fence
                    assert sum(x.lstrip().startswith("```") for x in lines[: at - 1]) % 2 == 0
                    assert len("\n".join(lines[before["start_line"] - 1 : at - 1])) // 3 + 1 >= target
                # a small piece stands alone only behind a closed code block or at the start
                if before is not None and len(chunk["body"].strip()) < 400:
                    assert before["body"].rstrip().endswith("```")
                assert chunk["body"].strip() and chunk["end_line"] >= at


def test_chunk_spans_are_ordered_and_cover_the_page(spark):
    rng = random.Random(5)
    pages = [(f"p{i}", random_page(rng)) for i in range(60)]
    rows = C.chunk_pages(spark.createDataFrame(pages, "path string, body string"), target_tokens=80).orderBy("page_path", "ord").collect()
    texts = dict(pages)
    for path in texts:
        own = [r for r in rows if r["page_path"] == path]
        assert all(a["end_line"] < b["start_line"] for a, b in zip(own, own[1:]))
        assert len({r["chunk_id"] for r in own}) == len(own)
        kept = sorted(line.strip() for r in own for line in r["body"].split("\n") if line.strip())
        assert kept == sorted(line.strip() for line in texts[path].split("\n") if line.strip())


def test_signature_gate(spark):
    rows = [("ck_1", "a.md", 0, "t", "s", "b", 1, 2, "llm-semantic|hybrid|512|llm=true"), ("ck_2", "a.md", 1, "t", "s", "b", 1, 2, "structural")]
    table = spark.createDataFrame(rows, CHUNK)
    assert [tuple(r) for r in D.chunk_counts(table, "hybrid|512|llm=true").collect()] == [("a.md", 2, 1)]
    assert [tuple(r) for r in D.chunk_counts(table, "hybrid|256|llm=true").collect()] == [("a.md", 2, 0)]
    assert C.signature("nonsense", 512, True) == "hybrid|512|llm=true"


def test_upsert_replay_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v bigint")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "path string, v bigint, seq bigint")
    once = D.upsert(old, new, ["path"], "seq")
    twice = D.upsert(once, new, ["path"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3), ("c", 9)]


def test_prune(spark):
    pages = spark.createDataFrame([("kept.md",), ("gone.md",)], "path string")
    table = chunk_table(spark, [("ck_kept", "kept.md", "t", "s", "body"), ("ck_gone", "gone.md", "t", "s", "body")])
    left = D.prune(pages, table, I.gram_sets(table, "chunk_id", ["body"]), pages.filter("path = 'kept.md'"))
    assert [r[0] for r in left[0].collect()] == ["kept.md"] and left[1].count() == 1
    assert {r["chunk_id"] for r in left[2].collect()} == {"ck_kept"}


def test_fingerprint_follows_scope(spark):
    plan = spark.createDataFrame([("r", "m.md", "src/a", "f", ""), ("r", "all.md", None, "f", "")], "repo string, path string, module string, focus string, evidence string")
    files = [("r", "src/a/x.rs", 10), ("r", "src/b/y.rs", 20)]

    def prints(rows):
        df = spark.createDataFrame(rows, "repo string, rel string, size bigint")
        return {r["path"]: r["fingerprint"] for r in D.fingerprints(plan, df, "salt").collect()}

    base = prints(files)
    assert base == prints(files[::-1])
    outside = prints([files[0], ("r", "src/b/y.rs", 21)])
    assert outside["m.md"] == base["m.md"] and outside["all.md"] != base["all.md"]
    assert prints([("r", "src/a/x.rs", 11), files[1]])["m.md"] != base["m.md"]


def test_entity_props(spark):
    schema = "kind string, name string, canonical_key string, props map<string,string>, status string"
    old = spark.createDataFrame([("id0", "module", "a", "module:a", {"path": "a/"}, "active")], "id string, " + schema)
    new = spark.createDataFrame([("module", "a", "module:a", {"x": "1"}, "active", 1)], schema + ", seq bigint")
    assert G.upsert_entities(old, new).first()["props"] == {"x": "1"}
    merged = G.upsert_entities(old, new, merge_props=True).first()
    assert merged["props"] == {"path": "a/", "x": "1"} and merged["id"] == "id0"


def test_entity_ids(evaluate):
    key = F.col("k")
    assert evaluate(G.legacy_entity_id(key), k="module:港口") == "ent_module___"
    assert evaluate(G.entity_id(key), k="module:港口") != evaluate(G.entity_id(key), k="module:港湾")


def test_hops_and_paths_through_a_hub(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", "r", 1.0) for i in range(50)] + [("n0", "far", "r", 1.0), ("far", "far", "r", 1.0)], "src string, dst string, rel string, confidence double")
    seeds = spark.createDataFrame([("n1",)], "seed string")
    hops = {r["node"]: r["hop"] for r in G.k_hop(edges, seeds, 3).collect()}
    assert hops["n1"] == 0 and hops["hub"] == 1 and hops["n0"] == 2 and hops["far"] == 3 and len(hops) == 52
    pairs = spark.createDataFrame([("n1", "far"), ("n1", "n2"), ("n1", "nowhere")], "src string, dst string")
    got = {r["dst"]: r["path"] for r in G.shortest_paths(edges, pairs, 3).collect()}
    assert got == {"far": ["n1", "hub", "n0", "far"], "n2": ["n1", "hub", "n2"]}
    assert G.k_hop(edges, seeds, 4).count() == 52
    with pytest.raises(ValueError):
        G.k_hop(edges, seeds, 0)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8))
    queries = rng.normal(size=(3, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row], 0) for i, row in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(queries)], "query_id bigint, query array<double>")
    got = {}
    for r in G.nearest_vectors(v, q, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, row in enumerate(queries):
        assert got[i] == set(np.argsort(-(unit @ row))[:5])
    blocks = {(r["query_id"], r["vec_id"]) for r in G.nearest_vectors(v, q, 5, block_rows=1).collect()}
    assert blocks == {(i, x) for i, found in got.items() for x in found}


def test_running_count_over_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "cold"]), i, rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq bigint, hit boolean")
    got = {(r["k"], r["seq"]): r["n"] for r in V.running_count(df, "k", "seq", F.col("hit"), "n", block=37).collect()}
    seen = {}
    for k, seq, hit in rows:
        seen[k] = seen.get(k, 0) + hit
        assert got[(k, seq)] == seen[k]


def test_answers_span_tool_rounds(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "q"), (1, 1, "assistant", "let me look <function=grep></function>"), (1, 2, "assistant", "# Page"), (1, 3, "assistant", "# Page\nmore"),
        (1, 4, "user", "q2"), (1, 5, "assistant", "short answer"),
    ], "conv_id bigint, turn bigint, role string, text string")
    got = {r["answer"]: (r["body"], r["n_rounds"]) for r in V.fold_answers(turns).collect()}
    assert got == {1: ("# Page\nmore", 3), 2: ("short answer", 1)}


def test_stale_runs(spark):
    runs = spark.sql("SELECT 'old' AS run_id, 'running' AS status, timestamp'2024-01-01 00:00:00' AS created_at, cast(null AS string) AS error, cast(null AS timestamp) AS finished_at")
    row = U.fail_stale_runs(runs, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.expr("INTERVAL '0' DAY")).first()
    assert row["status"] == "failed" and row["finished_at"] is not None and row["error"] == "interrupted"


def test_duplicates_where_seq_restarts(spark):
    calls = [(c, q, "grep", '{"q": "a"}' if q != 3 else '{"q": "b"}') for c in (1, 2) for q in (1, 2, 3)]
    df = spark.createDataFrame(calls, "conv bigint, seq bigint, name string, args string")
    got = sorted((r["conv"], r["seq"], r["fresh"]) for r in U.flag_duplicates(df, "conv", "seq").collect())
    assert got == [(c, q, q != 2) for c in (1, 2) for q in (1, 2, 3)]


def test_cache_counters(spark):
    lookups = spark.createDataFrame([("s", k) for k in "aabab"] + [("t", "z")], "scope string, key string")
    got = {r["scope"]: (r["lookups"], r["misses"], r["hits"], r["hit_rate"]) for r in U.cache_accounting(lookups, "scope", ["key"]).collect()}
    assert got == {"s": (5, 2, 3, 0.6), "t": (1, 1, 0, 0.0)}


def test_manifests(spark):
    cargo = '[package]\nname = "demo"\n\n[workspace]\nmembers = [\n "a",\n "b" ]\n\n[dependencies]\nanyhow = "1"\nserde = { version = "1" }\n\n[dev-dependencies]\ntempfile = "3"\n'
    py = '[project]\ndependencies = [\n  "pandas",\n "numpy"]\n[tool.poetry.dependencies]\nrequests = "1"\n'
    go = "module x\nrequire (\n\tgithub.com/a v1\n\tgithub.com/b v2\n)\n"
    js = '{"name":"web","scripts":{"dev":"vite"},"dependencies":{"react":"1"},"devDependencies":{"vite":"2"}}'
    rows = [("Cargo.toml", cargo), ("p/pyproject.toml", py), ("go.mod", go), ("w/package.json", js), ("x.toml", cargo)]
    got = {tuple(r) for r in O.manifest_entries(spark.createDataFrame(rows, "rel string, text string")).collect()}
    assert got == {
        ("Cargo.toml", "package", "demo"), ("Cargo.toml", "member", "a"), ("Cargo.toml", "member", "b"), ("Cargo.toml", "dep", "anyhow"),
        ("Cargo.toml", "dep", "serde"), ("Cargo.toml", "dep", "tempfile"), ("p/pyproject.toml", "dep", "pandas"), ("p/pyproject.toml", "dep", "numpy"),
        ("p/pyproject.toml", "dep", "requests"), ("go.mod", "dep", "github.com/a"), ("go.mod", "dep", "github.com/b"),
        ("w/package.json", "package", "web"), ("w/package.json", "script", "dev"), ("w/package.json", "dep", "react"), ("w/package.json", "dev_dep", "vite"),
    }


def test_module_tiers(spark):
    rows = [("a", "crates/x/src/lib.rs", "rust"), ("a", "src/main.rs", "rust"), ("b", "src/lib.rs", "rust"), ("b", "src/api/x.ts", "typescript"), ("c", "main.py", "python"), ("d", "docs/x.py", "python"), ("d", "run.py", "python")]
    files = spark.createDataFrame([(r, p, l, 1) for r, p, l in rows], "repo string, rel string, language string, size bigint")
    got = {(r["repo"], r["key"], r["hint"]) for r in P.detect_modules(files).collect()}
    assert {("a", "crates/x", "crates/x/"), ("b", "src/src", "src/"), ("b", "src/api", "src/api/")} <= got
    assert not any(r == "a" and k.startswith("src") for r, k, _ in got)


def test_evidence_sections(spark):
    texts = spark.createDataFrame([("r", "src/a/lib.rs", "rust", 60, "pub struct Demo;\n\nimpl Demo {\n    pub fn start(&self) {}\n}\n"), ("r", "src/b/x.py", "python", 9, "def go():\n")], "repo string, rel string, language string, size bigint, text string")
    plan = spark.createDataFrame([("r", "m.md", "M", "about a", "src/a"), ("r", "all.md", "All", "everything", None)], "repo string, path string, title string, description string, module string")
    readme = spark.createDataFrame([("r", "Hello")], "repo string, excerpt string")
    got = {r["path"]: r["evidence"] for r in evidence(plan, texts, readme, BUDGET).collect()}
    assert "- src/a/lib.rs (rust, 60 B)" in got["m.md"] and "src/b/x.py" not in got["m.md"].split("# Files of the")[1]
    assert "`1` struct Demo" in got["m.md"] and "`4` fn start" in got["m.md"] and "Hello" in got["m.md"]
    assert "- src/b/x.py (python, 9 B)" in got["all.md"] and "[M](m.md) — about a" in got["all.md"]


def test_grep_and_read(spark):
    texts = spark.createDataFrame([("a.rs", "fn Main() {\n  // main here\n}\n"), ("b.bin", "main")], "rel string, text string")
    assert [(r["rel"], r["line_no"]) for r in O.grep(texts, "MAIN", "*.rs").orderBy("line_no").collect()] == [("a.rs", 1), ("a.rs", 2)]
    window = O.read_window(texts, "a.rs", 2, 2).collect()
    assert [(r["line_no"], r["total"], r["next_start"]) for r in window] == [(2, 3, 3)]
    assert O.read_window(texts, "a.rs", 9).count() == 0


def test_sections_of_md(evaluate):
    got = evaluate(M.sections(F.col("t")), t="a\n# B\n```\n# no\n```\nc")
    assert [(s["title"], s["start_line"], s["end_line"]) for s in got] == [("Overview", 1, 1), ("B", 2, 6)]


def test_registered_grep_searches_long_texts(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "the start\n" + "word " * 60_000 + "\nand the end", "en", "src15", 300_021), (77, "the only line", "en", "src3", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.path, r.line_no) for r in entry.queries()["P8_grep_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {("d/src15/1.md", 1), ("d/src15/1.md", 3), ("d/src3/77.md", 1)}


def test_whole_queries_return_what_the_others_leave_out(spark, tmp_path):
    import __spark_entry__ as entry

    long = "\n".join(f"word {i}" for i in range(1000))
    rows = [(1, "a\nb\nc\nconst top = () => 1\nd", "en", "src1", 29), (2, "`short x`\nno citations here", "en", "src2", 27), (6, long, "en", "src6", len(long))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path))
    found = run("P18_F22_file_outline_whole").collect()
    assert {(r.line, r.kind, r.name) for r in found if r.rel == "src1/en/1.ts"} == {(2, "class", "b"), (4, "const", "top")}
    # lines 2, 6, 10, ... of 1000 are classes
    assert [(r.line, r.kind) for r in found if r.rel == "src6/en/6.ts"] == [(i, "class") for i in range(2, 1001, 4)]
    assert {"citations", "has_duties", "has_first_steps", "has_glossary"} <= set(run("A12_depth_features_whole").columns)
    assert {r.path: "citations" in r.gaps for r in run("Q1_quality_report_whole").collect()}["d/src2/2.md"]
    assert {r.rel for r in run("L1_files_by_path_whole").collect()} == {"src1/en/1.ts", "src2/en/2.py", "src6/en/6.ts"}


def test_grep_redacts_and_guards_sizes(spark):
    texts = spark.createDataFrame([("a/x.rs", "The one\nno\nthe two"), ("b/x.rs", "the secret"), ("a/big.rs", "the " * 100), ("a/y.md", "the page")], "rel string, text string")
    got = O.grep(texts, "THE", "**/*.rs", redact=["b/**"], max_bytes=100).collect()
    assert sorted((r.rel, r.line_no) for r in got) == [("a/x.rs", 1), ("a/x.rs", 3)]
    assert {r.rel for r in O.grep(texts, "THE").collect()} == {"a/x.rs", "b/x.rs", "a/big.rs", "a/y.md"}


def test_pages_without_a_usable_model_answer_keep_their_chunks(spark):
    good = '[{"title": "T", "summary": "", "body": "whole page", "start_line": 1, "end_line": 2}]'
    pages = spark.createDataFrame([("a", "# A\ntext", good), ("b", "# B\nother text", "no chunks"), ("c", "# C\nmore", None), ("d", "# D\nlast", "[]"), ("e", "# E\nend", '[{"body": " "}]')], "path string, body string, answer string")
    got = {r.page_path: (r.body, r.source.split("|")[0]) for r in C.chunk_pages(pages, "hybrid", answer="answer").collect()}
    assert got["a"] == ("whole page", "llm-semantic") and {k: v[1] for k, v in got.items() if k != "a"} == dict.fromkeys("bcde", "structural")
    assert got["b"][0].startswith("# B")


def test_manifest_lines_are_capped_by_rank(spark):
    from corpus_kb.plans.evidence import manifest_lines

    deps = "\n".join(f'd{i:02d} = "1"' for i in range(5))
    rows = [("r", f"r/{i}/Cargo.toml", f'[package]\nname = "p{i}"\n[dependencies]\n{deps}\n') for i in range(3)] + [("r", "r/9/go.mod", "module m\nrequire (\n\ta v1\n)\nrequire (\n\tb v1\n)\n"), ("q", "q/pyproject.toml", "nothing")]
    got = {r.repo: r.manifests for r in manifest_lines(spark.createDataFrame(rows, "repo string, rel string, text string"), 2, 3).collect()}
    assert got["r"] == "".join(f"- `r/{i}/Cargo.toml` · dep: d00, d01, d02, … · package: p{i}\n" for i in range(2)) and got["q"] == "- `q/pyproject.toml`\n"
    every = manifest_lines(spark.createDataFrame(rows, "repo string, rel string, text string"), 9, 9).where("repo = 'r'").first().manifests
    assert every.endswith("- `r/9/go.mod` · dep: a, b\n")


def test_a_run_without_its_mark_is_not_trusted(spark):
    from corpus_kb.plans import maintenance as N
    from corpus_kb.session import shared_dir

    path = shared_dir(spark, "run")
    pages = spark.createDataFrame([("README.md", "R", "", "x" * 300), ("old.md", "O", "", "y")], "path string, title string, description string, body string")
    chunks = spark.createDataFrame([("c1", "README.md"), ("c2", "old.md")], "chunk_id string, page_path string")
    postings = spark.createDataFrame([("abc", "c1"), ("abd", "c2")], "gram string, chunk_id string")
    files = pages.filter("path = 'README.md'")
    for run, head in (("r1", "h1"), ("r2", "h2"), ("r2", "h2")):  # the second one is repeated
        frames = N.finish_run(pages, chunks, postings, files, path, run, head)
    assert [frames[n].count() for n in ("pages", "chunks", "postings")] == [1, 1, 1]
    done = N.marks(spark, path).orderBy("run_id").collect()
    assert [(r.run_id, r.pages, r.pruned) for r in done] == [("r1", 1, 1), ("r2", 1, 1)] and done[0].problems == frames["problems"].count()
    changed = pages.limit(0).select("path")
    last = lambda head: N.gate(changed, N.marks(spark, path), F.lit(head)).first().no_op
    assert last("h2") and not last("h1")
