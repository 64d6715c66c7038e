"""Records that a query's change may concern: near-top hits, then related contracts over two gated steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import search as S
from lodestone.storage import materialize

# Kinds that seed an impact analysis; hits taken, related records added in all.
IMPACT_KINDS = ["contract", "integrations", "architecture", "adr", "known_gaps", "code_anchor"]
HITS, RELATED = 5, 3


def query_signals(docs: DataFrame, parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """(query, signals, median): weights of a query's significant tokens over all records, and their upper median."""
    rows = S.token_weights(docs, parsed, matches).where(F.size(X.significant(F.array("token"))) > 0).join(parsed.select(F.col("n").alias("q"), "query"), "q")
    each = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("weight", "token"))).alias("signals"))  # tokens of one query
    return each.withColumn("median", F.element_at("signals", (F.floor(F.size("signals") / 2) + 1).cast("int"))["weight"])


def impact_records(docs: DataFrame, manifest: DataFrame, queries: DataFrame, hits: int = HITS, related: int = RELATED) -> DataFrame:
    """(query, hop, place, id): hop 0 are the seeds; hops 1 and 2 related contracts of the best seeding contract.

    A record of hop 1 must hold a token of the query whose weight reaches the upper median, one of
    hop 2 any significant token; queries without such tokens gate nothing.  Parents of hop 2 go by
    how many strong tokens they hold.  At most ``related`` records are added; none comes twice.
    """
    docs, parsed = S.numbered(docs, "records"), S.numbered(S.parsed_queries(queries), "queries")
    matches = S.matched(docs, parsed)  # of all records; the seeds' kinds are a part of them
    kinds = S.restricted(docs, kinds=IMPACT_KINDS)
    seeds = materialize(S.seeds(S.best(kinds, parsed, matches.join(kinds.select("n"), "n", "left_semi"), hits)), "seeds")
    signals = materialize(query_signals(docs, parsed, matches), "signals")
    links = manifest.select("id", "external_id", "related_contracts").distinct()
    bearer = links.where("external_id <> ''").groupBy("external_id").agg(F.max("id").alias("rid"))
    steps = links.select("id", F.posexplode("related_contracts").alias("pos", "external_id")).join(bearer, "external_id").select(F.col("id").alias("parent"), "pos", "rid")
    blob = F.lower(F.concat_ws(" ", "title", F.array_join(X.strings(F.col("keywords")), " "), F.array_join(X.strings(F.col("headings")), " "), "path", "symbol", "external_id"))
    blobs = docs.select(F.col("id").alias("rid"), blob.alias("blob"))
    taken = seeds.select("query", F.col("id").alias("rid"))

    def judged(rows: DataFrame) -> DataFrame:
        held = F.filter(F.coalesce("signals", F.array().cast("array<struct<weight:double,token:string>>")), lambda s: F.contains(F.col("blob"), s["token"]))
        seen = rows.join(blobs, "rid").join(signals, "query", "left").withColumn("_held", held)
        strong = F.size(F.filter("_held", lambda s: s["weight"] >= F.col("median")))
        return seen.withColumn("strong", strong).withColumn("any", F.size("_held") > 0).withColumn("free", F.col("signals").isNull()).drop("blob", "signals", "_held", "median")

    primary = seeds.where("kind = 'contract'").groupBy("query").agg(F.min_by("id", "hit_rank").alias("parent"))
    one = judged(primary.join(steps, "parent")).where("free or strong > 0").join(taken, ["query", "rid"], "left_anti")
    one = one.groupBy("query", "rid", "strong", "free").agg(F.min("pos").alias("pos"))
    first = materialize(one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where(F.col("place") <= related), "first-hop")
    onward = first.where("free or strong > 0").select("query", F.col("rid").alias("parent"), (-F.col("strong")).alias("weaker"), F.col("place").alias("of")).join(steps, "parent")
    two = judged(onward).where("free or any").join(taken, ["query", "rid"], "left_anti").join(first.select("query", "rid"), ["query", "rid"], "left_anti")
    two = two.groupBy("query", "rid").agg(F.min(F.struct("weaker", "of", "pos")).alias("o"))
    counted = first.groupBy("query").agg(F.count("*").alias("had"))
    second = two.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("o"))).join(counted, "query").where(F.col("place") + F.col("had") <= related)
    return (
        seeds.select("query", F.lit(0).alias("hop"), F.col("hit_rank").alias("place"), "id")
        .unionByName(first.select("query", F.lit(1).alias("hop"), "place", F.col("rid").alias("id")))
        .unionByName(second.select("query", F.lit(2).alias("hop"), "place", F.col("rid").alias("id")))
    )
