"""A stream of found records, joined by any alias that two of them share, transitively.

Each batch is joined with the table of known aliases; what it links is handed to the incremental works, which compute anew only
what the links touch. The state is a folder with one subfolder a batch: aliases, records, links and works. A batch that was written whole is
never applied twice, so a stream that is restarted from its checkpoint goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import merges

TABLES = ("aliases", "records", "links", "works")

# Fixed value: DOIs of preprints name a family of versions, not one record.
PREPRINT_DOI = "10.48550/"


def aliases(provider: Column, native: Column, doi: Column, **identifiers: Column) -> Column:
    """The names of a record: its provider's id, a DOI that is no preprint's, and identifiers by scheme."""
    plain = T.doi(doi)
    named = [F.concat(provider, F.lit(":"), native), F.when((plain != "") & ~plain.startswith(PREPRINT_DOI), F.concat(F.lit("doi:"), plain))]
    tail = lambda c: F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)
    named += [F.when(F.trim(c) != "", F.concat(F.lit(f"{scheme}:"), tail(F.trim(c)))) for scheme, c in identifiers.items()]
    return F.array_distinct(F.array_compact(F.array(*named)))


class Watch:
    """The state of a watch in ``folder``, which all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[int]:
        """The numbers of the batches that were written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch long").parquet(f"{self.folder}/done").distinct().collect())

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.batches()[-1]}/{name}")

    def works(self) -> DataFrame:
        """(id, work) of all records so far; none before the first batch."""
        if not self.batches():
            return self.spark.createDataFrame([], "id long, work long")
        return self.table("works").select("id", "work")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take a batch (id, aliases, published, doi, created); a number that was taken before does nothing.

        A record that was seen before keeps its first row and gains the new aliases."""
        done = self.batches()
        if number in done:
            return
        new = batch.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"), *[F.min(c).alias(c) for c in ("published", "doi", "created")])
        if done:
            state = merges.Works(self.table("records"), self.table("links"), self.table("works"), 0)
            known = self.table("aliases")
            fresh = new.join(state.records.select("id"), "id", "left_anti")
        else:
            state, known, fresh = None, self.spark.createDataFrame([], "alias string, id long"), new
        named = new.select("id", F.explode("aliases").alias("alias")).unionByName(known.join(new.select(F.explode("aliases").alias("alias")).distinct(), "alias", "left_semi"))
        first = named.groupBy("alias").agg(F.min("id").alias("first"))
        links = named.join(first, "alias").filter("id <> first").select(F.lit(number).cast("long").alias("seq"), F.col("first").alias("a"), F.col("id").alias("b"), F.lit("merge").alias("op")).distinct()
        state = merges.begin(fresh) if state is None else merges.arrive(state, fresh)
        state = merges.advance(state, links)
        kept = known.join(first.select("alias"), "alias", "left_anti").unionByName(first.select("alias", F.col("first").alias("id")))
        for name, table in zip(TABLES, (kept, state.records, state.links, state.works)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{number}/{name}")
        self.spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply all that the stream holds now, batch by batch."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(self.apply).start().awaitTermination()
