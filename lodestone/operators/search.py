"""Batch search: every query is scored against every record it can match, as one join plan.

Scores are exact integers: per token the best place of a match counts, weighted by a soft inverse
document frequency and rounded half to even; exact symbols and gap ids add fixed amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.matching import containing
from lodestone.storage import materialize
from lodestone.vocab import CONTEXT_KINDS, CONTRACT_KINDS, TRUST_RANK, lookup

# What an exact symbol, the implementation of a symbol and an exact gap id add.
SYMBOL_EXACT, SYMBOL_IMPLEMENTATION, GAP_EXACT, GAP_IN_CONTRACT = 80, 50, 50, 12
# Fixed value: what a token that names a record's repository adds, once.
NAMED_REPO = 3
#: records that the rarest tokens of a query may bear together to give its first bound
RARE_RECORDS = 1000
# How far below the best score a hit may lie and still seed an impact analysis.
SEED_RATIO, SEED_DELTA = 0.82, 8

RECORD = ["id", "repo", "path", "kind", "title", "domain", "external_id", "status", "symbol", "anchor_type", "headings", "keywords", "known_gap_ids", "weight", "trust_level"]


def records(manifest: DataFrame) -> DataFrame:
    """Records to search, each once."""
    return manifest.select(*RECORD).where("id is not null").distinct()


def restricted(docs: DataFrame, repos: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Records of one of the kinds whose repo equals, or whose path or domain contains, one of the repos.

    Comparison ignores case; an empty list restricts nothing.  Frequencies are counted after this.
    """
    if repos:
        wanted = F.array(*(F.lit(r.lower()) for r in repos))
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        docs = docs.where(F.exists(wanted, lambda r: (low("repo") == r) | F.contains(low("path"), r) | F.contains(low("domain"), r)))
    if kinds:
        docs = docs.where(F.lower("kind").isin(*(k.lower() for k in kinds)))
    return docs


def parsed_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, tokens, gap_exact, symbol_exact) of the distinct queries that have any of them."""
    q = F.trim(F.col(query))
    one = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    q = F.trim(F.col("query"))
    return one.select(
        "query", X.tokens(F.col("query")).alias("tokens"),
        F.when(F.regexp_extract(q, X.GAP_ID, 0) == q, q).alias("gap_exact"),
        F.when(q.rlike(X.PASCAL), q).alias("symbol_exact"),
    ).where("size(tokens) > 0 or gap_exact <> ''")


def explicit_queries(values: DataFrame, column: str, what: str) -> DataFrame:
    """Queries for a ``gap`` id, upper-cased, or a ``symbol`` alone, in the form of ``parsed_queries``; named "gap ..." or "symbol ..."."""
    value = F.trim(F.col(column))
    rows = values.where(value != "").select(F.concat(F.lit(f"{what} "), column).alias("query"), value.alias("v")).distinct()
    gap, symbol = (F.upper("v"), F.lit(None).cast("string")) if what == "gap" else (F.lit(None).cast("string"), F.col("v"))
    return rows.select("query", F.array().cast("array<string>").alias("tokens"), gap.alias("gap_exact"), symbol.alias("symbol_exact"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a number ``n`` per row: joins on it are narrower than on long ids."""
    return materialize(df.withColumn("n", F.monotonically_increasing_id()), name)


def places(docs: DataFrame) -> DataFrame:
    """(run, n, place, whole, base): where each run of token characters stands in each record.

    ``whole`` tells that the run is all of a keyword, symbol or part of a repository's name.
    """
    field = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("place"), F.lower(v).alias("v")))
    single = lambda name, c: field(name, F.array(F.coalesce(F.col(c), F.lit(""))))
    parts = F.array_union(F.array(F.coalesce(F.lower("repo"), F.lit(""))), F.split(F.coalesce(F.lower("repo"), F.lit("")), "[^a-z0-9]+"))
    repo_names = F.when(F.lower("kind").isin(*CONTEXT_KINDS), parts).otherwise(F.array().cast("array<string>"))
    all_fields = F.concat(
        single("title", "title"), field("keyword", X.strings(F.col("keywords"))), field("heading", X.strings(F.col("headings"))),
        single("path", "path"), single("symbol", "symbol"), single("external_id", "external_id"), field("gap", X.strings(F.col("known_gap_ids"))), field("repo", repo_names),
    )
    each = docs.select("n", base_points().alias("base"), F.explode(all_fields).alias("f")).select("n", "base", "f.place", "f.v", F.explode(X.runs(F.col("f.v"))).alias("run"))
    return each.groupBy("run", "n", "place").agg(F.max(F.col("v") == F.col("run")).alias("whole"), F.max("base").alias("base"))


def base_points() -> Column:
    """What a record's weight and trust add to any match."""
    return (F.floor(F.coalesce("weight", F.lit(0)) / 10) + F.floor(lookup(TRUST_RANK, F.coalesce("trust_level", F.lit("confirmed")), 0) / 10)).cast("int")


def token_matches(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(token, n, points, in_title, in_blob, names_repo, base) of the distinct tokens and the records they occur in.

    ``base`` is what a record scores by itself, ``names_repo`` tells that the token is the name of
    its repository, or a part of it, and the record of a kind that profits from this.
    """
    where = materialize(places(docs), "places")
    hits = containing(needles, "token", where, "run").join(where, "run")
    at = lambda name: F.max(F.when(F.col("place") == name, True).otherwise(False))
    exact = lambda name: F.max(F.when((F.col("place") == name) & F.col("whole") & (F.col("run") == F.col("token")), True).otherwise(False))
    found = hits.groupBy("token", "n").agg(
        at("title").alias("in_title"), at("keyword").alias("in_keyword"), exact("keyword").alias("is_keyword"), at("heading").alias("in_heading"), at("path").alias("in_path"),
        exact("symbol").alias("is_symbol"), at("gap").alias("in_gap"), F.max(~F.col("place").isin("gap", "repo")).alias("in_blob"), exact("repo").alias("names_repo"), F.max("base").alias("base"),
    )
    best = F.when(F.col("in_title") | F.col("is_keyword"), 3).when(F.col("in_keyword"), 2).when(F.col("in_heading") | F.col("in_path"), 1).otherwise(0)
    points = best + F.when(F.col("is_symbol"), 5).otherwise(0) + F.when(F.col("in_gap"), 5).otherwise(0)
    return found.select("token", "n", points.alias("points"), "in_title", "in_blob", "names_repo", "base").where("points > 0 or in_blob or names_repo")


def inverse_frequency(total: Column, frequency: Column) -> Column:
    return F.lit(1.0) + F.log((total + 1) / (frequency + 1))


def query_tokens(parsed: DataFrame) -> DataFrame:
    """(q, token, times) of numbered queries."""
    return parsed.select(F.col("n").alias("q"), F.explode("tokens").alias("token")).groupBy("q", "token").agg(F.count("*").alias("times"))


def token_weights(docs: DataFrame, parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """(q, token, times, df, total, weight): a token that a query repeats counts its frequency as often."""
    counted = matches.where("in_blob").groupBy("token").agg(F.count("*").alias("df_one"))
    total = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    each = query_tokens(parsed).join(counted, "token", "left").crossJoin(total)  # one row of totals
    df = F.col("times") * F.coalesce(F.col("df_one"), F.lit(0))
    return each.select("q", "token", "times", df.alias("df"), "total", inverse_frequency(F.col("total"), df).alias("weight"))


def exact_points(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(q, n, exact, base): points for exact symbols, their implementations and exact gap ids."""
    about = docs.select("n", "kind", "symbol", "known_gap_ids", base_points().alias("base"))
    symbols = parsed.where("symbol_exact is not null").select(F.col("n").alias("q"), F.col("symbol_exact").alias("k"))
    equal = symbols.join(about.where("symbol <> ''").select("n", "base", F.col("symbol").alias("k")), "k").select("q", "n", F.lit(SYMBOL_EXACT).alias("exact"), "base")
    starts = F.transform(F.sequence(F.lit(1), F.length("symbol") - 1), lambda size: F.left(F.col("symbol"), size))
    longer = about.where(F.col("symbol").endswith("Impl") & (F.length("symbol") > 1)).select("n", "base", F.explode(starts).alias("k"))
    implementing = symbols.join(longer, "k").select("q", "n", F.lit(SYMBOL_IMPLEMENTATION).alias("exact"), "base")
    gaps = parsed.where("gap_exact is not null").select(F.col("n").alias("q"), F.col("gap_exact").alias("k"))
    holding = about.select("n", "kind", "base", F.explode(F.array_distinct(X.strings(F.col("known_gap_ids")))).alias("k"))
    extra = F.when(F.col("kind").isin(*CONTRACT_KINDS), GAP_EXACT + GAP_IN_CONTRACT).otherwise(GAP_EXACT)
    listed = gaps.join(holding, "k").select("q", "n", extra.alias("exact"), "base")
    return equal.unionByName(implementing).unionByName(listed)


def matched(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """``token_matches`` of numbered records and the tokens of numbered queries, as a written table."""
    return materialize(token_matches(docs, parsed.select(F.explode("tokens").alias("token")).distinct()), "token-matches")


def _parts(weights: DataFrame, matches: DataFrame, on: list[str] = ["token"]) -> DataFrame:  # noqa: B006
    """(q, n, part, titled, names_repo, base): what each token of a query gives each record, or each given one."""
    part = F.when(F.col("points") > 0, F.greatest(F.lit(1), F.bround(F.col("points") * F.col("weight")).cast("int"))).otherwise(0)
    times = F.col("times").cast("int")
    return weights.join(matches, on).select("q", "n", (part * times).alias("part"), F.when(F.col("in_title"), times).otherwise(0).alias("titled"), "names_repo", "base")


def _sums(parts: DataFrame) -> DataFrame:
    """(q, n, content, titled, named, base) of all parts of a query and a record, in one aggregation over two numbers."""
    return parts.groupBy("q", "n").agg(F.sum("part").alias("content"), F.sum("titled").alias("titled"), F.max("names_repo").alias("named"), F.max("base").alias("base"))


def _content() -> Column:
    return F.col("content") + F.when(F.col("titled") >= 2, 3 * (F.col("titled") - 1)).otherwise(0)


def _score() -> Column:
    return (_content() + F.col("base") + F.when(F.col("named"), NAMED_REPO).otherwise(0)).cast("bigint")


def _by_name(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    return exact_points(docs, parsed).select("q", "n", F.col("exact").alias("part"), F.lit(0).alias("titled"), F.lit(False).alias("names_repo"), "base")


def scored(docs: DataFrame, parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """(q, n, score) of all records that a query matches; both sides numbered."""
    weights = token_weights(docs, parsed, matches).select("q", "token", "times", "weight")
    return _sums(_parts(weights, matches).unionByName(_by_name(docs, parsed))).where(_content() > 0).select("q", "n", _score().alias("score"))


def scored_near(docs: DataFrame, parsed: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """(q, n, score) of all records that can be among the first ``limit`` of a query, with ties, and some more.

    Scores of the rarest tokens alone give a bound that ``limit`` records reach.  The most common
    tokens of a query whose points together can't lift a record to it don't make candidates: they
    are added only to candidates that the query's other tokens make and that can still reach the
    bound.  So the pairs of common tokens with most records are never written out.
    """
    of_token = matches.groupBy("token").agg(F.count("*").alias("held"), F.max("points").alias("most"), F.max("in_title").alias("any_title"))
    most = F.when(F.col("most") > 0, F.greatest(F.lit(1), F.bround(F.col("most") * F.col("weight")).cast("int"))).otherwise(0) + F.when(F.col("any_title"), 3).otherwise(0)
    weights = materialize(token_weights(docs, parsed, matches).join(of_token, "token").select("q", "token", "times", "weight", "held", (most * F.col("times")).alias("most")), "token-bounds")
    by_name = materialize(_by_name(docs, parsed), "exact-points")
    rarest = Window.partitionBy("q").orderBy("held", "token")
    rare = weights.withColumn("_sum", F.sum("held").over(rarest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(rarest)).where((F.col("_r") == 1) | (F.col("_sum") <= RARE_RECORDS))
    low = _sums(_parts(rare, matches).unionByName(by_name)).where(_content() > 0).select("q", _score().alias("score"))
    reached = low.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("_r") == limit).select("q", F.col("score").alias("bound"))
    base = docs.agg(F.coalesce(F.max(base_points()), F.lit(0)).alias("most_base"))
    commonest = Window.partitionBy("q").orderBy(F.col("held").desc(), "token").rowsBetween(Window.unboundedPreceding, 0)
    lifted = F.sum("most").over(commonest) + F.col("most_base") + NAMED_REPO
    ranked = materialize(weights.join(reached, "q", "left").crossJoin(base).withColumn("common", F.coalesce(lifted < F.col("bound"), F.lit(False))), "token-roles")  # one row of base
    common = ranked.where("common")
    added = ranked.groupBy("q").agg(F.max("bound").alias("bound"), F.sum(F.when(F.col("common"), F.col("most")).otherwise(0)).alias("added"))
    candidates = _sums(_parts(ranked.where("not common"), matches).unionByName(by_name))
    near = candidates.join(added, "q", "left").where(F.col("bound").isNull() | (_score() + F.col("added") + NAMED_REPO >= F.col("bound"))).drop("bound", "added")
    near = materialize(near, "candidates")
    keys = near.select("q", "n").join(common.select("q", "token", "times", "weight"), "q")
    completed = _parts(keys, matches, ["token", "n"])
    whole = near.select("q", "n", F.col("content").alias("part"), "titled", F.col("named").alias("names_repo"), "base").unionByName(completed)
    return _sums(whole).where(_content() > 0).select("q", "n", _score().alias("score"))


def search(docs: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, hit_rank, id, repo, path, kind, score): the best records of every distinct query.

    Order is score, path, id; null paths count as empty.  Records that tie with the last place are
    kept until their paths decide, so only few rows per query meet the records' columns.
    """
    return search_parsed(docs, parsed_queries(queries), limit)


def search_parsed(docs: DataFrame, parsed: DataFrame, limit: int = 10) -> DataFrame:
    """The same for queries in the form of ``parsed_queries``."""
    docs, parsed = numbered(docs, "records"), numbered(parsed, "queries")
    return best(docs, parsed, matched(docs, parsed), limit)


def best(docs: DataFrame, parsed: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """The same for numbered records and queries whose matches are known, so that several searches share them."""
    near = scored_near(docs, parsed, matches, limit).withColumn("_r", F.rank().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("_r") <= limit)
    named = near.join(docs.select("n", "id", "repo", "path", "kind"), "n").join(parsed.select(F.col("n").alias("q"), "query"), "q")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.coalesce(F.col("path"), F.lit("")), "id")
    return named.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= limit).select("query", "hit_rank", "id", "repo", "path", "kind", "score")


def seeds(hits: DataFrame) -> DataFrame:
    """Hits whose score is near the best one of their query."""
    top = F.max("score").over(Window.partitionBy("query"))
    return hits.withColumn("_top", top).where(F.col("score") >= F.greatest((F.col("_top") * SEED_RATIO).cast("int"), F.col("_top") - SEED_DELTA)).drop("_top")
