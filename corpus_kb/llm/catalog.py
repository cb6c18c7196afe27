"""Registered queries of this subpackage: one per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_kb.llm import chat, collocations, decontaminate, extract, fingerprint, jaccard, packing, quality, repair, sharding, simhash, toxicity, warc
from corpus_kb.llm.common import table, tokenizer_path


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=decontaminate.LEAST)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic"), threshold=0.5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=1000).drop("url")


#: A conversation whose texts are made of marks and escapes.
HOSTILE = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    turns = rows.unionByName(hostile).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.read_back(chat.format_chats(turns)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality"), threshold=0.3)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, top=2000)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_document_fingerprints, op3_best_fit_packing, op4_decontamination, op5_toxicity, op6_warc, op7_chat_formatting, op8_quality_classifier, op9_sharding, op10_ngram_jaccard_join, op11_conversation_repair, op12_phrase_collocations, op13_simhash_near_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
            SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
        s AS (SELECT *, 18 + length(role) + length(text) + length(regexp_replace(concat(role, text), '[^\\<>]', '', 'g')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::bigint AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op6_warc": """SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages))""",
    "op12_phrase_collocations": r"""WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM places, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
        total AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
        cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, cut, array_to_string(c.w[1:cut], ' ') AS one, array_to_string(c.w[cut + 1:c.k], ' ') AS two FROM often c, range(1, 5) AS t(cut) WHERE c.k > 1 AND cut < c.k),
        scored AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, cut, x.f AS l, y.f AS r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint AS score
            FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = one JOIN often y ON y.lang = cuts.lang AND y.phrase = two JOIN total ON total.lang = cuts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_phrases AS (SELECT DISTINCT o.lang, array_to_string(o.w[i:i + m - 1], ' ') AS phrase, o.f FROM often o, range(1, 5) AS t(i), range(2, 5) AS u(m) WHERE m < o.k AND i + m - 1 <= o.k)
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
            FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)) WHERE rank <= 2000""",
}
