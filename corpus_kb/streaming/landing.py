"""Pages land with all that is derived from them: one micro-batch, several tables, one commit.

A batch writes its page rows, then reads them back and writes chunks, claims, page-to-module edges and the index segment of their
grams. The commit record comes last and names the index version that belongs to it, so readers see whole batches only. A batch that failed
half-way is written again under the same number; one that is committed is skipped. :func:`compact` folds what is live into one folder per
table, so a reader's unions stay short.

Deriving needs no shuffle but that of the index segment. Current rows are those of each page's newest batch: one semi-join on the page.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpus_kb.operators import store as X
from corpus_kb.operators.graph import describes_relations
from corpus_kb.operators.segment import DEFAULT_TARGET, chunk_pages, claims
from corpus_kb.functions.markdown import first_heading

PAGES = "path string, repo string, module string, title string, body_hash string, body string"
CHUNKS = "chunk_id string, page_path string, ord long, title string, summary string, body string, start_line long, end_line long, source string"
CLAIMS = "page_path string, ord long, statement string, evidence array<string>, status string"
DESCRIBES = "path string, src string, dst string, rel string, confidence double"
#: schema and page column of each table
TABLES = {"pages": (PAGES, "path"), "chunks": (CHUNKS, "page_path"), "claims": (CLAIMS, "page_path"), "describes": (DESCRIBES, "path")}
INDEXED = ("title", "summary", "body")
_COMMIT = "batch long, folder string, base boolean, index_version long, pages long, chunks long, claims long, describes long"


@dataclass(frozen=True)
class Landing:
    """A folder of landed tables on storage all executors share."""

    spark: SparkSession
    path: str
    target_tokens: int = DEFAULT_TARGET
    buckets: int = 64

    def commits(self) -> list:
        """Live commit records, oldest first: the newest compaction and the batches after it."""
        rows = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits/*").collect() if self._exists("commits") else []
        first = max((r.batch for r in rows if r.base), default=-1)
        return sorted((r for r in rows if r.batch > first or (r.base and r.batch == first)), key=lambda r: r.batch)

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _read(self, table: str, live: list) -> DataFrame:
        schema, _ = TABLES[table]
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{r.folder}").withColumn("batch", F.lit(r.batch).cast("long")) for r in live]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, batch long")

    def current(self, table: str) -> DataFrame:
        """Rows of each page's newest batch; a page that came again without rows of this kind has none."""
        return self._current(table, self.commits())

    def _current(self, table: str, live: list) -> DataFrame:
        key = TABLES[table][1]
        if len(live) <= 1:  # a page comes once in a folder
            return self._read(table, live).drop("batch")
        newest = self._read("pages", live).groupBy(F.col("path").alias(key)).agg(F.max("batch").alias("batch"))
        return self._read(table, live).join(newest, [key, "batch"], "left_semi").drop("batch")

    def index(self) -> X.IndexStore:
        """Gram index of the current chunks."""
        live = self.commits()
        store = X.IndexStore(self.spark, f"{self.path}/index", INDEXED, buckets=self.buckets)
        return replace(store, at=live[-1].index_version) if live else replace(X.create(store), at=0)

    def commit(self, batch: int, folder: str, base: bool, index: int, counts: dict[str, int]) -> None:
        row = (batch, folder, base, index, *(counts[t] for t in TABLES))
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{folder}")


def _write(land: Landing, table: str, folder: str, rows: DataFrame) -> int:
    """Rows written, counted in the pass that writes them."""
    seen = Observation()
    schema = land.spark.createDataFrame([], TABLES[table][0]).schema
    rows.select(*schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{land.path}/{table}/{folder}")
    return seen.get["n"]


def land_batch(land: Landing, pages: DataFrame, batch: int) -> None:
    """Land pages ``path, repo, module, body``; of a page that comes more than once in a batch the row of the greatest ``seq`` counts;
    without that column paths are unique in a batch.

    Null bodies give a page row without chunks or claims, a null module no edge; rows without a path are no pages and do not land. A page
    without chunks takes those it had away.
    """
    if any(r.batch >= batch for r in land.commits()):
        return
    folder, rows = f"b{batch}", pages.where(F.col("path").isNotNull())
    if "seq" in pages.columns:
        newest = F.max_by(F.struct("repo", "module", "body"), F.struct("seq", "body"))
        rows = rows.groupBy("path").agg(newest.alias("v")).select("path", "v.repo", "v.module", "v.body")
    rows = rows.select("path", "repo", "module", F.coalesce(first_heading(F.col("body")), F.col("path")).alias("title"), F.sha2("body", 256).alias("body_hash"), "body")
    counts = {"pages": _write(land, "pages", folder, rows)}
    landed = land.spark.read.schema(PAGES).parquet(f"{land.path}/pages/{folder}")
    counts["chunks"] = _write(land, "chunks", folder, chunk_pages(landed.select("path", "body"), target_tokens=land.target_tokens))
    counts["claims"] = _write(land, "claims", folder, claims(landed))
    counts["describes"] = _write(land, "describes", folder, describes_relations(landed, ("path",)))
    chunks = land.spark.read.schema(CHUNKS).parquet(f"{land.path}/chunks/{folder}")
    version = X.replace(land.index(), landed.select(F.col("path").alias("page_path")), chunks)
    land.commit(batch, folder, False, version, counts)


def land_stream(land: Landing, pages: DataFrame) -> StreamingQuery:
    """Land a stream's pages until the available input is used up; size a batch by ``maxFilesPerTrigger``."""
    query = (
        pages.writeStream.option("checkpointLocation", f"{land.path}/_checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda batch, number: land_batch(land, batch, number)).start()
    )
    query.awaitTermination()
    return query


def compact(land: Landing, factor: int = 4) -> bool:
    """Fold the live batches of every table into one folder and merge index segments of like size; False where there is one already.

    Folders that were folded stay until the caller removes them, since readers may be on them.
    """
    live = land.commits()
    if len(live) <= 1:
        return False
    last = live[-1].batch
    counts = {t: _write(land, t, f"c{last}", land._current(t, live)) for t in TABLES}
    store = land.index()
    merged = X.merge(store, factor)
    land.commit(last, f"c{last}", True, live[-1].index_version if merged is None else merged, counts)
    return True
