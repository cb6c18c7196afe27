"""Parquet tables and the knowledge-base shapes derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_kb.functions.code import language
from corpus_kb.functions.markdown import html_links, summary_of
from corpus_kb.functions.text import bind, lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# an input of more splits than this is never redistributed, however many cores there are
SMALL_INPUT_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a tiny input over all cores.

    A small single-row-group file would otherwise keep all per-row text work in one task. Inputs of
    more than a few splits pass through untouched, so no large text is shuffled for it.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SMALL_INPUT_SPLITS + 1) else df


def doc_path(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("d/"), source, F.lit("/"), doc_id.cast("string"), F.lit(".md"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages: ``path, body, lang, source, doc_id, n_chars``."""
    return as_docs(spread(table(spark, sf_dir, "documents")))


def as_docs(documents: DataFrame) -> DataFrame:
    """A table or stream of documents in the shape of wiki pages."""
    return documents.select(
        doc_path(F.col("source"), F.col("doc_id")).alias("path"), F.col("text").alias("body"),
        "lang", "source", "doc_id", "n_chars",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository files: ``repo, rel, language, size``."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".rs", ".ts", ".py", ".go", ".bin")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("source").alias("repo"),
            F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("rel"),
            F.col("n_chars").alias("size"),
        )
        .select("repo", "rel", language(F.col("rel")).alias("language"), "size")
    )


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with their text: each line of prose becomes a declaration, comment or plain line by its number."""
    d = spread(table(spark, sf_dir, "documents"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".rs", ".ts", ".py", ".go", ".bin")]), (F.col("doc_id") % 5 + 1).cast("int"))

    def code_line(line: Column, i: Column) -> Column:
        word = F.regexp_extract(line, r"([A-Za-z]+)", 1)
        return (
            F.when(i % 4 == 0, F.concat(F.lit("pub fn "), word, F.lit("(x: u8) {")))
            .when(i % 4 == 1, F.concat(F.lit("class "), word, F.lit(":")))
            .when(i % 4 == 2, F.concat(F.lit("// TODO "), line))
            .otherwise(line)
        )

    return d.select(
        F.col("source").alias("repo"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("rel"),
        F.array_join(F.transform(lines(F.col("text")), code_line), "\n").alias("text"),
        F.col("n_chars").alias("size"),
    ).withColumn("language", language(F.col("rel")))


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(docs(spark, sf_dir))


def markdown(pages: DataFrame) -> DataFrame:
    """Pages with headings, fences and blank lines at fixed line numbers."""

    def md_line(line: Column, i: Column) -> Column:
        n = i + 1
        return (
            F.when(n % 5 == 1, F.concat(F.lit("## "), F.substring(line, 1, 20)))
            .when(n % 11 == 7, F.lit("```"))
            .when(n % 11 == 9, F.lit("```"))
            .when(n % 13 == 4, F.lit(""))
            .otherwise(line)
        )

    built = bind(
        F.transform(lines(F.col("body")), md_line),
        lambda a: F.when(F.size(a) > 0, F.concat(F.array_join(a, "\n"), F.lit("\n"))).otherwise(F.lit("")),
    )
    return pages.withColumn("body", built)


def chunks(spark: SparkSession, sf_dir: str, signature: str = "structural|hybrid|512|llm=false") -> DataFrame:
    """Chunks of five lines each, cut inside the document's own row."""
    pieces = bind(
        lines(F.col("body")),
        lambda a: F.when(
            F.size(a) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 5).cast("int")),
                lambda k: F.struct(
                    k.cast("bigint").alias("ord"),
                    (k * 5 + 1).cast("bigint").alias("start_line"),
                    F.least(k * 5 + 5, F.size(a)).cast("bigint").alias("end_line"),
                    F.array_join(F.slice(a, k * 5 + 1, F.lit(5)), "\n").alias("body"),
                ),
            ),
        ),
    )
    cut = docs(spark, sf_dir).select(F.col("path").alias("page_path"), F.inline(pieces))
    titled = cut.withColumn("title", F.left(F.split_part("body", F.lit("\n"), F.lit(1)), F.lit(40)))
    return titled.select(
        F.concat(
            F.lit("ck_"), F.left(F.sha2(F.concat("page_path", F.col("ord").cast("string"), "body"), 256), F.lit(12))
        ).alias("chunk_id"),
        "page_path", "ord", "title", summary_of(F.col("title"), F.col("body")).alias("summary"), "body",
        "start_line", "end_line", F.lit(signature).alias("source"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hyperlinks by address: within a page's row first, then over pages that share an address."""
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("from_url"), F.explode(F.array_distinct(html_links(F.col("html")))).alias("target")
    ).distinct()


def linked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose body carries one relative link to another page."""
    return table(spark, sf_dir, "documents").select(
        doc_path(F.col("source"), F.col("doc_id")).alias("path"),
        F.concat(
            F.lit("See [next](../src"), ((F.col("doc_id") * 7 + 3) % 20).cast("string"), F.lit("/"),
            ((F.col("doc_id") * 7 + 3) % 1300).cast("string"), F.lit(".md#top \"Next\").\n"), F.col("text"),
        ).alias("body"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, prefix: str, status: Column) -> DataFrame:
        title = F.col(f"{name[0]}_name")
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}:"), title).alias("canonical_key"), F.lit(name).alias("kind"),
            title.alias("name"), status.alias("status"),
        )

    active = F.lit("active")
    by_balance = lambda c: F.when(F.col(c) < 0, F.lit("retired")).otherwise(active)
    return (
        of("region", "r", active)
        .unionByName(of("nation", "n", active))
        .unionByName(of("supplier", "s", by_balance("s_acctbal")))
        .unionByName(of("customer", "c", by_balance("c_acctbal")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    one = F.lit(1.0)
    nation, region = t("nation"), t("region")

    def edge(df: DataFrame, src: str, src_col: str, dst: str, dst_col: str, confidence: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(src), src_col).alias("src"), F.concat(F.lit(dst), dst_col).alias("dst"),
            F.lit("part_of").alias("rel"), confidence.alias("confidence"),
        )

    return (
        edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "nation:", "n_name", "region:", "r_name", one)
        .unionByName(
            edge(
                t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
                "supplier:", "s_name", "nation:", "n_name", F.when(F.col("s_acctbal") < 0, F.lit(0.5)).otherwise(F.lit(0.9)),
            )
        )
        .unionByName(
            edge(
                t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
                "customer:", "c_name", "nation:", "n_name", one,
            )
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderpriority").alias("mode"),
        F.col("o_orderdate").alias("created_at"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("call_no"),
        F.col("l_returnflag").alias("stage"),
        F.floor("l_quantity").cast("bigint").alias("prompt_tokens"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("bigint").alias("cached_tokens"),
        F.col("l_shipdate").alias("created_at"),
    )


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"),
        F.col("props").alias("args"), "ts",
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("dep"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
