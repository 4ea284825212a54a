"""Evidence retrieval: the k best knowledge-base entries of every claim, exactly.

A claim's score for an entry needs one shared token, so the plain plan joins the two
tables on token.  Tokens that are frequent on both sides would then emit every pair
of their groups.  Here a claim is joined with lists of bounded length instead.  A token held
by at most ``hot_df`` entries is *rare*, any other *hot*:

* A rare token has the list of all its entries.
* A hot token has its *champions*: of entries that share just this token with a claim only
  the first k by credibility can matter (and those that rounding could make equal).

So an entry outside the lists shares at least two hot tokens with the claim and no rare one. Entries
with two or more hot tokens, of equal sets of them only the champions, lie in *blocks* of bounded
size, each an inverted index of its own. They are searched last (``operators.blocks``), for those
claims only whose hot tokens together could still lift an entry above the k-th best score so far,
and in a block from the heaviest token on until what is left can't lift a new entry there.

Of the entries in the lists only those are scored whose upper bound, taken from their number of hot
tokens, reaches the k-th best lower bound of their claim.

An index consists of segments, each with lists of its own over its own entries; token weights
come from all of them.  Adding entries adds a segment, compaction makes one of all.

Scores are sums of token weights in units of 1e-12 as integers, so they do not
depend on the order in which rows arrive.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from factlake.functions import fixed_values as fv
from factlake.functions.numbers import exact_round
from factlake.functions.text import raw_tokens
from factlake.operators.blocks import inverted_blocks, search_blocks
from factlake.operators.rows import unnest
from factlake.session import bucketed_table, materialized, write_bucketed

CLAIM_KEY = ["answer_id", "claim_index"]
HOT_DF = 64
LONG_ENTRY = 48
#: Files of a saved list table; its rows with one token lie in one of them.
BUCKETS = 64
_UNIT = 1e12
# Half a unit of the fourth decimal and a margin for the double arithmetic.
_ROUNDING = 6e-5
# Credibilities further apart than this give scores that differ after rounding.
_TIE = 1.1e-4 / fv.KB_CREDIBILITY_WEIGHT


def _weight(idf: Column) -> Column:
    return F.round(idf * F.lit(_UNIT)).cast("long")


def _weighted(counts: DataFrame, entries: int) -> DataFrame:
    """token, df, weight of ``counts`` (token, df) over so many entries."""
    idf = F.log(F.lit(float(entries)) / (F.col("df") + 1)) + 1.0
    return counts.select("token", "df", _weight(idf).alias("weight"))


def _keyword_counts(kb: DataFrame) -> DataFrame:
    return unnest(kb, "keywords", name="token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def kb_idf(kb: DataFrame) -> DataFrame:
    """``token, df, idf`` with ``idf = ln(entries / (df + 1)) + 1``."""
    entries = kb.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = F.log(entries / (F.col("df") + 1)) + 1.0
    return _keyword_counts(kb).withColumn("idf", idf)


def _champions(rows: DataFrame, *key: str, k: int) -> DataFrame:
    """Of each key's rows (key, credibility, kb_id) those that can be among its best k.

    The first k of every credibility, down to the credibility that rounding could make equal
    to that of the k-th best.
    """
    alike = Window.partitionBy(*key, "credibility").orderBy("kb_id")
    best = Window.partitionBy(*key).orderBy(F.desc("credibility"), "kb_id")
    place = F.col("_place")
    first = rows.withColumn("_place", F.row_number().over(alike)).where(place <= k).drop("_place")
    lowest = F.when(F.count(F.lit(1)) >= k, F.min("credibility")).alias("_kth")
    kth = (
        first.withColumn("_place", F.row_number().over(best))
        .where(place <= k)
        .groupBy(*key)
        .agg(lowest)
    )
    matters = F.col("_kth").isNull() | (F.col("credibility") >= F.col("_kth") - _TIE)
    return first.join(kth, list(key)).where(matters).drop("_kth")


@dataclass(frozen=True)
class Segment:
    """Some entries, prepared for retrieval; rare and hot are meant within the segment.

    Only ``local`` has the tokens themselves, everywhere else a token is its ``id`` there.
    """

    local: DataFrame  # token, df, id
    marks: DataFrame  # kb_id, credibility, hot (sorted array of hot tokens or null)
    lists: DataFrame  # token, kb_id, lowest, highest (credibility), most_hot: rare tokens, champions
    blocks: DataFrame  # block, token, places and kb_ids, credibilities: entries of several hot tokens

    TABLES = {"local": ("token",), "marks": (), "lists": ("token",), "blocks": ()}

    @classmethod
    def build(cls, kb: DataFrame, k: int, hot_df: int) -> Segment:
        credibility = F.coalesce("source_credibility", F.lit(fv.DEFAULT_CREDIBILITY))
        postings = materialized(
            unnest(
                kb.select("kb_id", F.array_distinct("keywords").alias("tokens")),
                "tokens",
                "kb_id",
                name="token",
            ).select("token", "kb_id")
        )
        local = materialized(
            postings.groupBy("token")
            .agg(F.count(F.lit(1)).alias("df"))
            .withColumn("id", F.monotonically_increasing_id())
        )
        postings = materialized(
            postings.join(local, "token")
            .select(F.col("id").alias("token"), "kb_id", (F.col("df") > hot_df).alias("is_hot"))
        )
        hot_sets = (
            postings.where("is_hot")
            .groupBy("kb_id")
            .agg(F.sort_array(F.collect_set("token")).alias("hot"))
        )
        marks = materialized(
            kb.select("kb_id", credibility.alias("credibility")).join(hot_sets, "kb_id", "left")
        )
        held = ("kb_id", "credibility")
        of_hot_tokens = unnest(marks, "hot", *held, name="token").select("token", *held)
        rare = postings.where(~F.col("is_hot")).select("token", "kb_id")
        lists = rare.unionAll(_champions(of_hot_tokens, "token", k=k).select("token", "kb_id"))
        n_hot = F.size(F.coalesce("hot", F.array()))
        bounds = marks.groupBy("kb_id").agg(
            F.min("credibility").alias("lowest"),
            F.max("credibility").alias("highest"),
            F.max(n_hot).alias("most_hot"),
        )
        lists = lists.join(bounds, "kb_id").select("token", "kb_id", "lowest", "highest", "most_hot")
        # Of entries that are alike in set and credibility only the first k can matter.
        alike = Window.partitionBy("hot", "credibility").orderBy("kb_id")
        several = marks.where(n_hot >= 2).withColumn("_place", F.row_number().over(alike))
        several = materialized(several.where(F.col("_place") <= k).drop("_place"))
        return cls(
            local=local,
            marks=marks,
            lists=materialized(lists),
            blocks=materialized(inverted_blocks(several, "hot")),
        )


@dataclass(frozen=True)
class KnowledgeIndex:
    """A knowledge base prepared for retrieval with up to ``k`` results.

    All tables but the entries are written to the shared folder once, so that no batch,
    round or stream goes through the knowledge base again; ``save`` keeps an index for
    other sessions, with the rows of a token in one file so that a join shuffles the claims
    only.
    """

    entries: DataFrame  # the knowledge base itself
    stats: DataFrame  # token, df, weight
    size: int
    segments: tuple[Segment, ...]
    hot_df: int
    k: int
    long_entry: int

    @classmethod
    def build(
        cls,
        kb: DataFrame,
        k: int = fv.EVIDENCE_PER_CLAIM,
        hot_df: int = HOT_DF,
        long_entry: int = LONG_ENTRY,
    ) -> KnowledgeIndex:
        """``hot_df`` bounds the length of a list; ``long_entry`` makes no difference any more."""
        size = kb.count()
        counts = materialized(_keyword_counts(kb))
        return cls(
            entries=kb,
            stats=_weighted(counts, size),
            size=size,
            segments=(Segment.build(kb, k, hot_df),),
            hot_df=hot_df,
            k=k,
            long_entry=long_entry,
        )

    def add(self, kb: DataFrame) -> KnowledgeIndex:
        """This index with more entries, whose ids must be new.

        Only the new entries are gone through; the weights follow. An index retrieves the
        same, whether its entries were built at once or added.
        """
        size = self.size + kb.count()
        both = self.stats.select("token", "df").unionAll(_keyword_counts(kb))
        counts = materialized(both.groupBy("token").agg(F.sum("df").alias("df")))
        more = Segment.build(kb, self.k, self.hot_df)
        return replace(
            self,
            entries=self.entries.unionByName(kb.select(*self.entries.columns)),
            stats=_weighted(counts, size),
            size=size,
            segments=(*self.segments, more),
        )

    def compact(self) -> KnowledgeIndex:
        """The same index with one segment, which retrieves faster than many."""
        return KnowledgeIndex.build(self.entries, self.k, self.hot_df, self.long_entry)

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Write the index below ``path``; the folder must be new."""
        self.entries.write.parquet(f"{path}/entries")
        tables = {"stats": (self.stats, ("token",))}
        for i, segment in enumerate(self.segments):
            for name, by in Segment.TABLES.items():
                tables[f"segment-{i}/{name}"] = getattr(segment, name), by
        for where, (df, by) in tables.items():
            if by:
                write_bucketed(df, f"{path}/{where}", buckets, *by)
            else:
                df.write.parquet(f"{path}/{where}")
        schemas = {where: df.schema.json() for where, (df, _) in tables.items()}
        limits = (self.hot_df, self.k, self.long_entry, self.size, len(self.segments), buckets, schemas)
        names = (
            "hot_df long, k long, long_entry long, size long, segments long, buckets long, "
            "schemas map<string,string>"
        )
        self.stats.sparkSession.createDataFrame([limits], names).write.parquet(f"{path}/limits")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnowledgeIndex:
        """An index that ``save`` has written."""
        limits = spark.read.parquet(f"{path}/limits").first()

        def read(where: str, by: tuple[str, ...]) -> DataFrame:
            schema = StructType.fromJson(json.loads(limits["schemas"][where]))
            if by:
                return bucketed_table(spark, f"{path}/{where}", schema, limits["buckets"], *by)
            return spark.read.schema(schema).parquet(f"{path}/{where}")

        segments = [
            Segment(**{n: read(f"segment-{i}/{n}", by) for n, by in Segment.TABLES.items()})
            for i in range(limits["segments"])
        ]
        return cls(
            entries=spark.read.parquet(f"{path}/entries"),
            stats=read("stats", ("token",)),
            size=limits["size"],
            segments=tuple(segments),
            hot_df=limits["hot_df"],
            k=limits["k"],
            long_entry=limits["long_entry"],
        )


def query_text(claim: Column, sources: Column) -> Column:
    """Trusted sources (or the default ones) followed by the claim."""
    chosen = F.when(F.size(F.coalesce(sources, F.array())) > 0, sources).otherwise(
        F.array(*[F.lit(s) for s in fv.DEFAULT_TRUSTED_SOURCES])
    )
    return F.concat_ws(" ", F.array_join(chosen, " "), claim)


def _score(weight: Column, total: Column, credibility: Column) -> Column:
    share = weight.cast("double") / total.cast("double")
    return fv.RELEVANCE_WEIGHT * share + fv.KB_CREDIBILITY_WEIGHT * credibility


def _shared_weight(claim_hot: Column, entry_hot: Column) -> Column:
    shared = F.filter(claim_hot, lambda t: F.array_contains(entry_hot, t["token"]))
    return F.aggregate(shared, F.lit(0).cast("long"), lambda a, t: a + t["weight"])


def _best(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*CLAIM_KEY).orderBy(F.desc("relevance_score"), "kb_id")
    return df.withColumn("kb_rank", F.row_number().over(order)).where(F.col("kb_rank") <= k)


def claim_tokens(claims: DataFrame, index: KnowledgeIndex) -> DataFrame:
    """``answer_id, claim_index, token, weight`` of every token looked for."""
    sources = (
        F.col("trusted_sources")
        if "trusted_sources" in claims.columns
        else F.lit(None).cast("array<string>")
    )
    tokens = unnest(
        claims.select(
            *CLAIM_KEY, raw_tokens(query_text(F.col("text"), sources)).alias("tokens")
        ),
        "tokens",
        *CLAIM_KEY,
        name="token",
    )
    weight = F.coalesce("weight", _weight(F.lit(fv.UNKNOWN_TOKEN_IDF))).alias("weight")
    return tokens.join(index.stats, "token", "left").select(*CLAIM_KEY, "token", weight)


def _placed(tokens: DataFrame, segment: Segment) -> DataFrame:
    """The tokens that the segment knows, with their ``df`` there."""
    return tokens.join(segment.local, "token")


def _hot_of_claims(placed: DataFrame, hot_df: int) -> DataFrame:
    """Each claim's hot tokens, lightest (most frequent) first, and their ids sorted."""
    hot = F.sort_array(F.collect_list(F.struct("weight", F.col("id").alias("token")))).alias("hot")
    found = placed.where(F.col("df") > hot_df).groupBy(*CLAIM_KEY).agg(hot)
    return found.withColumn("names", F.array_sort(F.transform("hot", lambda t: t["token"])))


def candidates(placed: DataFrame, segment: Segment, hot_df: int) -> DataFrame:
    """``answer_id, claim_index, kb_id, rare_weight`` of the entries in a claim's lists.

    The list of a rare token has at most ``hot_df`` rows, that of a hot one k for each credibility
    that matters; so a claim of r rare and h hot tokens has at most
    (r + h) * max(hot_df, champions) candidates, however large the knowledge base.

    With it ``hot_known``, a hot weight that claim and entry surely share, the ``lowest`` and
    ``highest`` credibility, and ``most_hot``, the number of hot tokens of the entry.
    """
    none = F.lit(0).cast("long")
    is_rare = F.col("df") <= hot_df
    looked_for = placed.select(
        *CLAIM_KEY,
        F.col("id").alias("token"),
        F.when(is_rare, F.col("weight")).otherwise(none).alias("rare_weight"),
        F.when(is_rare, none).otherwise(F.col("weight")).alias("hot_known"),
    )
    # Dealt by claim at once, which is also how the best of a claim are found.
    return (
        looked_for.join(segment.lists, "token")
        .drop("token")
        .repartition(*CLAIM_KEY)
        .groupBy(*CLAIM_KEY, "kb_id")
        .agg(
            F.sum("rare_weight").alias("rare_weight"),
            F.max("hot_known").alias("hot_known"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.max("most_hot").alias("most_hot"),
        )
    )


def _worth_scoring(found: DataFrame, of_claim: DataFrame, k: int) -> DataFrame:
    """The candidates that can be among their claim's best k.

    An entry of s hot tokens shares at most the weight of the claim's s heaviest.
    """
    n_hot = F.size("heaviest")
    shared = F.when(F.col("repeats"), n_hot).otherwise(F.least("most_hot", n_hot))
    hot = F.when(shared > 0, F.get("heaviest", shared - 1)).otherwise(F.lit(0))
    sure = _score(F.col("rare_weight") + F.col("hot_known"), F.col("total"), F.col("lowest"))
    possible = _score(F.col("rare_weight") + hot, F.col("total"), F.col("highest"))
    best = Window.partitionBy(*CLAIM_KEY).orderBy(F.desc("sure"))
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Two scores that rounding could make equal are told apart by the id.
    enough = F.col("floor").isNull() | (F.col("possible") + 2 * _ROUNDING >= F.col("floor"))
    return (
        found.where("kb_id IS NOT NULL")
        .join(of_claim, CLAIM_KEY)
        .select(*CLAIM_KEY, "kb_id", "rare_weight", sure.alias("sure"), possible.alias("possible"))
        .withColumn("floor", F.nth_value("sure", k).over(whole))
        .where(enough)
        .select(*CLAIM_KEY, "kb_id", "rare_weight")
    )


def _scored_candidates(
    tokens: DataFrame, totals: DataFrame, segment: Segment, hot_df: int, k: int
) -> DataFrame:
    placed = _placed(tokens, segment)
    of_claim = totals.join(_hot_of_claims(placed, hot_df), CLAIM_KEY, "left")
    weights = F.reverse(F.transform(F.coalesce("hot", F.array()), lambda t: t["weight"]))
    # The weight of the heaviest hot token, of the two heaviest, and so on.
    heaviest = F.transform(
        weights,
        lambda w, i: F.aggregate(F.slice(weights, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    names = F.coalesce("names", F.array())
    bounds = of_claim.select(
        *CLAIM_KEY,
        "total",
        heaviest.alias("heaviest"),
        (F.size(F.array_distinct(names)) < F.size(names)).alias("repeats"),
    )
    hot_weight = F.when(
        F.col("entry_hot").isNotNull() & F.col("hot").isNotNull(),
        _shared_weight(F.col("hot"), F.col("entry_hot")),
    ).otherwise(F.lit(0))
    return (
        _worth_scoring(candidates(placed, segment, hot_df), bounds, k)
        .join(segment.marks.withColumnRenamed("hot", "entry_hot"), "kb_id")
        .join(of_claim, CLAIM_KEY)
        .withColumn("weight", F.col("rare_weight") + hot_weight)
        .withColumn("score", _score(F.col("weight"), F.col("total"), F.col("credibility")))
        .select(*CLAIM_KEY, "kb_id", exact_round(F.col("score"), 4).alias("relevance_score"))
    )


def _beyond_lists(
    tokens: DataFrame, totals: DataFrame, floors: DataFrame, segment: Segment, hot_df: int, k: int
) -> DataFrame:
    """Scores of entries that no list holds and that could still reach the claim's floor."""
    placed = _placed(tokens, segment)
    ceiling = segment.marks.agg(F.max("credibility")).scalar()
    most = _score(F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w), F.col("total"), ceiling)
    essential = (
        _hot_of_claims(placed, hot_df)
        .join(totals, CLAIM_KEY)
        .join(floors, CLAIM_KEY, "left")
        .select(
            *CLAIM_KEY,
            "total",
            (F.col("floor") - _ROUNDING).alias("least"),
            # The heaviest first.
            F.reverse(F.transform("hot", lambda t: t["token"])).alias("tokens"),
            F.reverse(F.transform("hot", lambda t: t["weight"])).alias("weights"),
        )
        .where((F.size("tokens") >= 2) & (F.col("least").isNull() | (most >= F.col("least"))))
    )
    found = search_blocks(materialized(essential), segment.blocks, k, 2 * _ROUNDING)
    score = _score(F.col("weight"), F.col("total"), F.col("credibility"))
    return found.select(*CLAIM_KEY, "kb_id", exact_round(score, 4).alias("relevance_score"))


def score_entries(claims: DataFrame, index: KnowledgeIndex) -> DataFrame:
    """``answer_id, claim_index, kb_id, relevance_score, kb_rank`` of the best k entries.

    ``claims`` has ``text`` and may have ``trusted_sources``.
    """
    k, hot_df = index.k, index.hot_df
    tokens = materialized(claim_tokens(claims, index))
    totals = tokens.groupBy(*CLAIM_KEY).agg(F.sum("weight").alias("total"))
    union = DataFrame.unionByName
    first = reduce(
        union, [_scored_candidates(tokens, totals, s, hot_df, k) for s in index.segments]
    )
    first = materialized(_best(first, k))
    beyond = [s for s in index.segments if not s.blocks.isEmpty()]
    if not beyond:
        return first
    floors = first.groupBy(*CLAIM_KEY).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("relevance_score")).alias("floor")
    )
    rest = reduce(union, [_beyond_lists(tokens, totals, floors, s, hot_df, k) for s in beyond])
    # What is in the lists has been scored with its rare tokens.
    rest = rest.join(first.select(*CLAIM_KEY, "kb_id"), [*CLAIM_KEY, "kb_id"], "left_anti")
    found = _best(first.drop("kb_rank").unionByName(rest), k)
    # Rows of one entry that is there twice take a place each, but come out as one.
    return _best(found.groupBy(*CLAIM_KEY, "kb_id").agg(F.max("relevance_score").alias("relevance_score")), k)


def retrieve_evidence(claims: DataFrame, index: KnowledgeIndex) -> DataFrame:
    """The best k entries per claim with their source, snippet and url.

    A missing source is "unknown", a missing snippet or url is empty.
    """
    texts = index.entries.select(
        "kb_id",
        F.coalesce("source", F.lit(fv.UNKNOWN_SOURCE)).alias("source"),
        F.coalesce("snippet", F.lit("")).alias("snippet"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    return score_entries(claims, index).join(texts, "kb_id")
