"""Graph, link and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_kb.catalog.base import with_views
from corpus_kb.catalog.retrieval import entities as entity_table
from corpus_kb.operators import graph as G
from corpus_kb.operators import search as S
from corpus_kb.sources import tables as T

_BOTH = "SELECT DISTINCT src AS node, dst AS other FROM f_edges UNION SELECT dst, src FROM f_edges"
_ENT = "SELECT concat('ent_', left(sha256(canonical_key), 12)) AS id, kind, name, canonical_key, status FROM f_entities"


def module_pages(spark, d):
    return T.docs(spark, d).select(F.col("lang").alias("repo"), "path", F.when(F.col("lang") != "fr", F.col("source")).alias("module"))


def entity_upsert(spark, d):
    """Customers and suppliers exist already; nations and a second batch of supplier rows arrive later."""
    e = T.entities(spark, d).withColumns({"props": F.create_map(F.lit("path"), F.col("canonical_key")), "updated_run": F.lit("run-0")})
    old = e.filter(F.col("kind").isin("supplier", "customer")).withColumn("id", F.concat(F.lit("old_"), "name"))
    new = e.filter(F.col("kind") != "customer").withColumns({"seq": F.lit(5).cast("bigint"), "updated_run": F.lit("run-5")})
    again = e.filter(F.col("kind") == "supplier").withColumns({"seq": F.lit(9).cast("bigint"), "status": F.lit("renewed"), "updated_run": F.lit("run-9"), "props": F.create_map(F.lit("new"), F.col("name"))})
    done = G.upsert_entities(old, new.unionByName(again), merge_props=True)
    return done.select(F.left("id", F.lit(20)).alias("id"), "kind", "name", "canonical_key", F.to_json("props").alias("props"), "status", "updated_run")


def relation_upsert(spark, d):
    e = T.edges(spark, d).withColumns({"props": F.create_map(F.lit("from"), F.col("src")), "run_id": F.lit("run-0")})
    low = e.filter(F.col("confidence") < 1)
    return G.upsert_relations(e, low.withColumns({"confidence": F.col("confidence") / 2, "run_id": F.lit("run-1"), "props": F.create_map(F.lit("to"), F.col("dst")), "seq": F.lit(1).cast("bigint")})).withColumn("props", F.to_json("props"))


def regions(spark, d):
    return T.table(spark, d, "region").select(F.concat(F.lit("region:"), "r_name").alias("seed"))


def path_pairs(spark, d):
    """Every supplier to the region of the alphabetically first name."""
    first = T.table(spark, d, "region").agg(F.min("r_name").alias("n")).select("n").scalar()
    return T.table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_name").alias("src"), F.concat(F.lit("region:"), first).alias("dst"))


def nation_pairs(spark, d):
    """Every supplier with the nation of the first name in its region: one hop, or three by way of the region."""
    nation = T.table(spark, d, "nation")
    first = nation.groupBy("n_regionkey").agg(F.concat(F.lit("nation:"), F.min("n_name")).alias("dst"))
    home = T.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return home.join(first, "n_regionkey").select(F.concat(F.lit("supplier:"), "s_name").alias("src"), "dst")


def retired(spark, d):
    e = T.entities(spark, d).withColumn("path", F.when(F.col("kind").isin("customer", "supplier"), F.col("name")))
    known = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("path"))
    return G.retire_vanished(e, known).select("canonical_key", "status")


def aliases(spark, d):
    """Entities answer to their brand-like alias: the nation's key is an alias of each of its suppliers."""
    e = entity_table(spark, d)
    alias = T.edges(spark, d).filter(F.col("src").startswith("supplier:")).select(
        F.concat(F.lit("ent_"), F.left(F.sha2("src", 256), F.lit(12))).alias("id"), F.col("dst").alias("alias")
    )
    named = S.with_aliases(e, alias)
    terms = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit(0).alias("pos"), F.lower("n_name").alias("term"), F.lit(1).alias("n_terms"))
    return S.entity_hits(terms, named).select("query_id", "id").distinct()


def mentions(spark, d):
    e = entity_table(spark, d)
    words = T.table(spark, d, "documents").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name")).distinct().filter(F.length("name") >= 3)
    named = words.select(F.concat(F.lit("w:"), "name").alias("id"), F.lit("word").alias("kind"), "name", F.col("name").alias("canonical_key"), F.lit("active").alias("status"))
    return G.mention_totals(T.chunks(spark, d), e.unionByName(named))


def nearest(spark, d):
    v = T.table(spark, d, "embeddings")
    centroids = G.label_centroids(v, "label", "embedding").select(F.col("label").alias("query_id"), "query")
    return G.nearest_vectors(v, centroids, 10).select(F.col("query_id").cast("bigint").alias("query_id"), "vec_id", F.round("score", 6).alias("score"))


ENTRIES = {
    "G1_graph_seed_entities": (
        lambda s, d: G.seed_entities(T.files(s, d)).select("repo", "kind", "name", "canonical_key", F.col("props")["path"].alias("path")),
        with_views("""SELECT repo, 'module' AS kind, repo AS name, concat('module:', repo, '/', repo) AS canonical_key, min(rel) AS path FROM f_files WHERE language IN ('rust', 'typescript', 'python') GROUP BY repo
            UNION ALL SELECT repo, 'symbol', string_split(rel, '/')[-1], concat('symbol:', repo, '/', rel), rel FROM f_files WHERE language IS NOT NULL"""),
    ),
    "G1_graph_seed_relations": (
        lambda s, d: G.seed_relations(T.files(s, d)),
        with_views("SELECT concat('symbol:', repo, '/', rel) AS src, concat('module:', repo, '/', repo) AS dst, 'part_of' AS rel, 1.0::double AS confidence FROM f_files WHERE language IN ('rust', 'typescript', 'python')"),
    ),
    "G2_page_describes_module": (
        lambda s, d: G.describes_relations(module_pages(s, d)),
        with_views("SELECT concat('page:', lang, '/', path) AS src, concat('module:', lang, '/', source) AS dst, 'describes' AS rel, 1.0::double AS confidence FROM f_docs WHERE lang <> 'fr'"),
    ),
    "U3_upsert_entities": (
        entity_upsert,
        with_views("""SELECT left(CASE WHEN kind IN ('supplier', 'customer') THEN 'old_' || name ELSE concat('ent_', left(sha256(canonical_key), 16)) END, 20) AS id, kind, name, canonical_key,
            CASE WHEN kind = 'supplier' THEN concat('{"new":"', name, '","path":"', canonical_key, '"}') ELSE concat('{"path":"', canonical_key, '"}') END AS props,
            CASE WHEN kind = 'supplier' THEN 'renewed' ELSE status END AS status, CASE kind WHEN 'supplier' THEN 'run-9' WHEN 'customer' THEN 'run-0' ELSE 'run-5' END AS updated_run FROM f_entities"""),
    ),
    "U4_upsert_relations": (
        relation_upsert,
        with_views("""SELECT src, dst, rel, CASE WHEN confidence < 1 THEN confidence / 2 ELSE confidence END AS confidence,
            CASE WHEN confidence < 1 THEN concat('{"to":"', dst, '"}') ELSE concat('{"from":"', src, '"}') END AS props, CASE WHEN confidence < 1 THEN 'run-1' ELSE 'run-0' END AS run_id FROM f_edges"""),
    ),
    "G3_neighbourhoods": (
        lambda s, d: G.neighbourhoods(T.edges(s, d), regions(s, d).unionByName(T.table(s, d, "nation").select(F.concat(F.lit("nation:"), "n_name").alias("seed")))),
        with_views("""SELECT s.seed, e.* FROM (SELECT 'region:' || r_name AS seed FROM region UNION ALL SELECT 'nation:' || n_name FROM nation) s JOIN f_edges e ON e.src = s.seed OR e.dst = s.seed"""),
    ),
    "G3_one_neighbourhood": (
        lambda s, d: G.neighbourhood(T.edges(s, d), "nation:NATION_3", 100),
        with_views("SELECT * FROM f_edges WHERE src = 'nation:NATION_3' OR dst = 'nation:NATION_3' ORDER BY src, dst, rel LIMIT 100"),
    ),
    "G4_L11_export_edges": (
        lambda s, d: G.export_edges(T.edges(s, d), 5000), with_views("SELECT * FROM f_edges ORDER BY src, dst, rel LIMIT 5000"),
    ),
    "G4_export_nodes": (
        lambda s, d: G.export_nodes(T.entities(s, d), 1000), with_views("SELECT * FROM f_entities WHERE status = 'active' ORDER BY name, canonical_key LIMIT 1000"),
    ),
    "G4_export_whole": (
        lambda s, d: G.export_edges(T.edges(s, d)).select("src", "dst", "rel").unionByName(
            G.export_nodes(T.entities(s, d)).select(F.col("canonical_key").alias("src"), F.col("name").alias("dst"), F.col("kind").alias("rel"))),
        with_views("SELECT src, dst, rel FROM f_edges UNION ALL SELECT canonical_key, name, kind FROM f_entities WHERE status = 'active'"),
    ),
    "G5_k_hop_neighbourhood": (
        lambda s, d: G.k_hop(T.edges(s, d), regions(s, d), 3, ["part_of"]),
        with_views("""SELECT seed, node, min(hop)::bigint AS hop FROM (
              SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, other, 1 FROM h1 UNION ALL SELECT seed, other, 2 FROM h2
              UNION ALL SELECT DISTINCT seed, b.other, 3 FROM h2 JOIN both_ways b ON h2.other = b.node) GROUP BY seed, node""",
            both_ways=_BOTH, seeds="SELECT 'region:' || r_name AS seed FROM region",
            h1="SELECT DISTINCT seed, other FROM seeds JOIN both_ways ON seed = node",
            h2="SELECT DISTINCT seed, b.other FROM h1 JOIN both_ways b ON h1.other = b.node"),
    ),
    "G6_authoritative_edges": (
        lambda s, d: G.authoritative(T.edges(s, d)), with_views("SELECT * FROM f_edges WHERE confidence >= 0.7"),
    ),
    "G7_page_link_graph": (
        lambda s, d: G.link_graph(T.linked_docs(s, d)),
        with_views("SELECT DISTINCT from_path AS src, to_path AS dst, 'links_to' AS rel FROM f_mdlinks WHERE to_path IN (SELECT path FROM f_docs)"),
    ),
    "F9_web_links": (
        lambda s, d: T.links(s, d), with_views("SELECT from_url, target FROM f_links"),
    ),
    "G8_alias_entity_match": (
        aliases,
        with_views("""SELECT DISTINCT n_nationkey AS query_id, id FROM nation JOIN
            (SELECT id, name, canonical_key FROM ent WHERE status = 'active' UNION ALL SELECT e.id, x.dst, e.canonical_key FROM ent e JOIN f_edges x ON x.src = e.canonical_key WHERE e.kind = 'supplier' AND status = 'active') a
            ON contains(lower(a.name), lower(n_name)) OR contains(lower(a.canonical_key), lower(n_name))""", ent=_ENT),
    ),
    "G9_chunk_entity_mentions": (
        mentions,
        with_views("""SELECT entity_id, count(*) AS chunks, sum(mentions)::bigint AS mentions FROM (SELECT id AS entity_id, c.chunk_id,
              (length(h) - length(replace(h, term, ''))) // length(term) + (length(b) - length(replace(b, term, ''))) // length(term) AS mentions
            FROM names, (SELECT chunk_id, lower(concat(title, chr(10), summary)) AS h, lower(body) AS b FROM f_chunks) c WHERE contains(h, term) OR contains(b, term)) GROUP BY entity_id""",
            names=f"""SELECT id, lower(name) AS term FROM ({_ENT}) WHERE status = 'active' AND length(name) >= 3
               UNION ALL SELECT 'w:' || w, w FROM (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS w FROM documents) WHERE length(w) >= 3"""),
    ),
    "G11_embedding_top_k": (
        nearest,
        """WITH c AS MATERIALIZED (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x::double) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
           SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS pos FROM
             (SELECT c.label::bigint AS query_id, vec_id, list_cosine_similarity(embedding::double[], q) AS score FROM embeddings, c)) WHERE pos <= 10""",
    ),
    "G12_shortest_paths": (
        lambda s, d: G.shortest_paths(T.edges(s, d), path_pairs(s, d), 3).withColumn("path", F.array_join("path", " > ")),
        with_views("""SELECT 'supplier:' || s_name AS src, r AS dst, CASE WHEN n_regionkey = rk THEN 2 END::bigint AS hops,
            concat('supplier:', s_name, ' > nation:', n_name, ' > ', r) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey,
            (SELECT 'region:' || min(r_name) AS r, arg_min(r_regionkey, r_name) AS rk FROM region) WHERE n_regionkey = rk"""),
    ),
    "G12_paths_across_regions": (
        lambda s, d: G.shortest_paths(T.edges(s, d), nation_pairs(s, d), 3).withColumn("path", F.array_join("path", " > ")),
        with_views("""SELECT src, dst, CASE WHEN n = t THEN 1 ELSE 3 END::bigint AS hops, CASE WHEN n = t THEN concat(src, ' > ', dst) ELSE concat(src, ' > nation:', n, ' > region:', r_name, ' > ', dst) END AS path FROM
            (SELECT 'supplier:' || s_name AS src, n_name AS n, t, 'nation:' || t AS dst, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
             JOIN (SELECT n_regionkey AS k, min(n_name) AS t FROM nation GROUP BY n_regionkey) ON k = n_regionkey)"""),
    ),
    "G13_retire_vanished_entities": (
        retired,
        with_views("""SELECT canonical_key, CASE WHEN kind IN ('customer', 'supplier') AND name NOT IN (SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey) THEN 'retired' ELSE status END AS status FROM f_entities"""),
    ),
    "J7_edges_between_kept_nodes": (
        lambda s, d: G.edges_between(T.edges(s, d), T.entities(s, d).filter(F.col("status") == "active").select(F.col("canonical_key").alias("node"))),
        with_views("SELECT * FROM f_edges WHERE src IN (SELECT canonical_key FROM f_entities WHERE status = 'active') AND dst IN (SELECT canonical_key FROM f_entities WHERE status = 'active')"),
    ),
    "P19_L3_active_entities": (
        lambda s, d: G.entities_by_kind(T.entities(s, d), "customer", 200),
        with_views("SELECT * FROM f_entities WHERE status = 'active' AND kind = 'customer' ORDER BY name, canonical_key LIMIT 200"),
    ),
}
