"""A stored inverted index for the lexical channels: postings by term, in blocks with the greatest score a block can give.

A term's documents are dealt into blocks of BLOCK ids; a block is one row (term, block, its least length and greatest
term frequency, the postings as an array), so that a hot term is many rows. A query opens its rarest terms' blocks
first. What they find gives each query a floor, the k-th best score so far. A block of a further term is opened only if
its own bound together with the bounds of the query's other terms in the same block of ids can pass the floor: a stop
word's blocks, which add next to nothing, stay closed unless a rarer word is there as well.

The index grows by epochs, as the documents do: a posting is used if its epoch is its document's latest one as of the
read. Counts and lengths for the weights are kept per epoch too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators.channels import ranked
from tracewright.sources.tables import Catalog, checkpoint

#: Document ids per block.
BLOCK = 512
#: Terms of a query, rarest first, whose blocks are all opened to find the floor.
OPENED = 4


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def part(self, idf: Column, tf: Column, length: Column, average: Column) -> Column:
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / average))


def tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lengths(docs: DataFrame) -> DataFrame:
    """version_id, len: what the weights need of a document."""
    return docs.select("version_id", F.coalesce(F.size(tokens("task")), F.lit(0)).alias("len"))


def build(docs: DataFrame) -> DataFrame:
    """docs(version_id, task) -> term, block, n, top_tf, least_len, postings: one row per term and block of ids."""
    block = F.expr(f"version_id div {BLOCK}").alias("block")  # texts are shuffled once; all that follows lies in their block
    d = docs.select("version_id", "task", block).repartition("block").select("block", "version_id", tokens("task").alias("t")).where("t IS NOT NULL").withColumn("len", F.size("t"))
    tf = d.select("block", "version_id", "len", F.explode("t").alias("term")).groupBy("block", "version_id", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    return tf.groupBy("term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("top_tf"), F.min("len").alias("least_len"), F.array_sort(F.collect_list(F.struct("version_id", "tf", "len"))).alias("postings")
    )


def publish(catalog: Catalog, docs: DataFrame, name: str = "postings") -> dict[str, int]:
    """Add a batch of documents (new versions, or versions again) to the index; both tables are one commit."""
    return catalog.commit({name: build(docs), f"{name}_lengths": lengths(docs)})


def current(catalog: Catalog, as_of: int | None = None, name: str = "postings") -> tuple[DataFrame, DataFrame]:
    """(blocks with postings of documents' latest epochs only, lengths of the latest epochs). Blocks without a stale
    posting are passed on as they are, and all are where no document was written again."""
    blocks, sizes = catalog.read(name, as_of), catalog.read(f"{name}_lengths", as_of)
    latest = sizes.groupBy("version_id").agg(F.max_by("len", "epoch").alias("len"), F.max("epoch").alias("epoch"), F.count("*").alias("times"))
    again = latest.where("times > 1").select("version_id", F.col("epoch").alias("latest"))
    if again.isEmpty():
        return blocks.select("term", "block", "n", "top_tf", "least_len", "postings"), latest.select("version_id", "len")
    stale = again.groupBy(F.expr(f"version_id div {BLOCK}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("version_id", "latest"))).alias("latest"))  # BLOCK ids at most
    live = blocks.join(stale, "block", "left")
    kept = F.filter("postings", lambda p: F.coalesce(F.try_element_at(F.col("latest"), p["version_id"]) == F.col("epoch"), F.lit(True)))
    kept = F.when(F.col("latest").isNull(), F.col("postings")).otherwise(kept)
    live = live.withColumn("postings", kept).withColumn("n", F.size("postings").cast("long")).where("n > 0")
    return live.select("term", "block", "n", "top_tf", "least_len", "postings"), latest.select("version_id", "len")


def search(blocks: DataFrame, sizes: DataFrame, queries: DataFrame, limit: int, weights: Bm25 = Bm25(), channel: str = "bm25") -> DataFrame:
    """The `limit` best documents of every query by BM25, in millionths, exact."""
    return ranked(opened(blocks, sizes, queries, limit, weights)[1], channel, limit)


def opened(blocks: DataFrame, sizes: DataFrame, queries: DataFrame, limit: int, weights: Bm25 = Bm25()) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, block of what is opened, query_id, version_id, score of the hits that can be among the best)."""
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    q = queries.select("query_id", F.explode(S.words(F.col("task"))).alias("term"))
    heads = blocks.select("term", "block", "n", "top_tf", "least_len")  # the postings are not read for the bounds
    df = heads.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))  # the requests are a batch
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.join(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "avg_len")  # stats is one row
    rare = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    terms = checkpoint(q.join(weighted, "term").withColumn("nth", rare))
    bound = weights.part(F.col("idf"), F.col("top_tf"), F.col("least_len"), F.col("avg_len"))
    bounds = heads.join(F.broadcast(terms), "term").groupBy("query_id", "term", "nth", "block").agg(F.max(bound).alias("bound"))  # a block may lie in several epochs
    bounds = checkpoint(bounds)

    def hits(terms: DataFrame, reach: DataFrame | None = None) -> DataFrame:
        """Sums over the queries' terms, unrounded, in all blocks or in those that a query can reach. Postings are shuffled
        once, by their block, and not once for each query; what they add up to is not shuffled."""
        named = blocks.select("term", "block", "postings").join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").repartition("block")
        if reach is not None:
            named = named.join(reach.groupBy("block").agg(F.collect_set("query_id").alias("queries")), "block")
        asked = named.join(F.broadcast(terms.select("query_id", "term", "idf", "avg_len")), "term")
        if reach is not None:
            asked = asked.where(F.array_contains("queries", F.col("query_id")))
        found = asked.select("query_id", "block", "idf", "avg_len", F.explode("postings").alias("p"))
        part = weights.part(F.col("idf"), F.col("p.tf"), F.col("p.len"), F.col("avg_len"))
        return found.groupBy("query_id", F.col("p.version_id").alias("version_id"), "block").agg(F.sum(part).alias("sum"))

    best = Window.partitionBy("query_id").orderBy(F.desc("sum"))
    top = hits(terms.where(F.col("nth") <= OPENED)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    floors = checkpoint(top.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("sum")).otherwise(0.0).alias("floor")))
    # a block can pass the floor only if all its terms' bounds together do; sums may differ in their last bits
    reach = bounds.groupBy("query_id", "block").agg(F.sum("bound").alias("reach")).join(floors, "query_id").where(F.col("reach") * 1.000001 >= F.col("floor"))
    reach = checkpoint(reach.select("query_id", "block"))
    chosen = bounds.join(reach, ["query_id", "block"]).select("query_id", "term", "block")
    scored = hits(terms, reach).select("query_id", "version_id", F.round(F.col("sum") * S.PPM).cast("long").alias("score"))
    return chosen, scored
