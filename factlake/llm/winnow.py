"""Benchmark decontamination by winnowing, with built-in functions only.

A text is a sequence of words. Of every stretch of ``w`` consecutive k-grams the least hash is
its fingerprint, where k + w - 1 is the length of a shared span that must be found: two equal
spans of that length have the same k-grams and so the same least hash. So every span that an
item and a document share leaves a fingerprint on both sides, and the join misses none.
Hits are extended by comparing the words of the spans around a shared fingerprint, so a hash
that two different spans have in common adds nothing.

An item of fewer words than a span is a span of its own length; each such length that
occurs has its own k and w.

Scale: a document sends its different fingerprints only, and only those that a table of
2^20 bits over the benchmark's fingerprints lets through. That table has one size whatever
the benchmark; a large benchmark fills it, and then the join on fingerprints does all the work.
Equal texts are one node from the second step on. Words are compared in spans, of which each is
one row whatever the number of items that have it; spans with the same items are one class, so
that a passage in a third of all items is expanded once per document and not per span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import fresh
from factlake.session import Scratch

SPAN = 10
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bit table is an array of so many longs.
_LONGS = 1 << 14


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    # One byte per sign: plain ASCII, where lower() changes A-Z only and is much faster.
    plain = F.octet_length(text) == F.length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def gram_and_window(length: int) -> tuple[int, int]:
    """(words of a gram, grams of a window) so that a span of ``length`` words is one window."""
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _over_neighbours(
    df: DataFrame, column: str, size: int, combine: Callable[[Column, Column], Column]
) -> DataFrame:
    """``column`` becomes, at every place, a combination of ``size`` neighbours.

    By doubling: stretches of 2, 4, 8... and then two that overlap. Each step is a column:
    within one expression it would be worked out at every use.
    """
    have = 1
    while have < size:
        shift = min(have, size - have)
        left = F.greatest(F.size(column) - shift, F.lit(0))
        both = F.slice(column, 1, left), F.slice(column, 1 + shift, left)
        df = df.withColumn(column, F.zip_with(*both, combine))
        have += shift
    return df


def with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (words) with prints{length}: the fingerprint of every span, in order."""
    hashed = fresh("hashed")
    df = df.withColumn(hashed, F.transform("words", lambda w: F.xxhash64(w)))
    for length in lengths:
        gram, window = gram_and_window(length)
        prints = f"prints{length}"
        df = df.withColumn(prints, F.col(hashed))
        df = _over_neighbours(df, prints, gram, lambda a, b: F.xxhash64(a, b))
        df = _over_neighbours(df, prints, window, lambda a, b: F.least(a, b))
    return df.drop(hashed)


def _span_at(start: Column, length: int) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def item_spans(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, length, span text, fingerprint) of every different span of every item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(span))).where("n > 0")
    out = None
    for length in range(1, span + 1):
        some = with_fingerprints(rows.where(F.col("n") == length), [length])
        spans = F.transform(
            f"prints{length}",
            lambda p, k: F.struct(_span_at(k, length).alias("span"), p.alias("print")),
        )
        some = some.select("item_id", F.lit(length).alias("length"), F.inline(spans))
        out = some if out is None else out.unionAll(some)
    return out.distinct()


def _bit_table(prints: DataFrame) -> Column:
    """An array of 2^14 longs: the bits that any fingerprint sets, as one value."""
    place = F.pmod("print", F.lit(_LONGS)).alias("place")
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(print, 58) AS INT))").alias("bit")
    none = prints.sparkSession.range(_LONGS).select("id", F.lit(0).cast("bigint"))
    words = prints.select(place, bit).unionAll(none).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    every = F.sort_array(F.collect_list(F.struct("place", "bits"))).alias("every")
    return words.agg(every).select(F.transform("every", lambda w: w["bits"])).scalar()


def _let_through(prints: Column, table: Column) -> Column:
    """The different fingerprints whose bit is set; a few others get through by chance."""

    def is_set(p: Column) -> Column:
        word = F.get(table, F.pmod(p, F.lit(_LONGS)).cast("int"))
        return F.getbit(word, F.shiftrightunsigned(p, 58).cast("int")) == 1

    return F.filter(F.array_distinct(prints), is_set)


def _covered(spans: Column) -> Column:
    """Words covered by (start, length) spans, sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(so_far: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        more = F.greatest(F.lit(0), end - F.greatest(s["start"], so_far["end"]))
        return F.struct(
            (so_far["n"] + more).alias("n"), F.greatest(so_far["end"], end).alias("end")
        )

    return F.aggregate(F.sort_array(spans), zero, add, lambda x: x["n"].cast("bigint"))


class Decontamination:
    """What documents share with a benchmark.

    ``hits``: doc_id, n_words, n_hit (words inside any shared span), one row for every row of
    the documents, and ``key1``, ``key2``, which stand for its text. ``items``: (key1, key2,
    item_id), every item that shares a span with the text, once.
    """

    def __init__(self, hits: DataFrame, items: DataFrame) -> None:
        self.hits, self.items = hits, items


def shared_spans(docs: DataFrame, items: DataFrame, *, span: int = SPAN) -> Decontamination:
    """Finds every run of ``span`` words that documents share with items.

    ``docs`` needs doc_id and text, ``items`` item_id and text. Null and empty texts have no
    words, share nothing and keep their row. Rows with equal texts get equal results, whatever
    their doc_id; rows that repeat an item_id are parts of one item. An item without item_id
    marks words, but isn't listed.
    """
    scratch = Scratch(docs.sparkSession)
    spans = scratch.table(item_spans(items.select("item_id", "text"), span))
    # At most ``span`` numbers, however large the benchmark.
    lengths = sorted(r["length"] for r in spans.select("length").distinct().collect())
    prints = scratch.table(spans.select("print").distinct())

    keys = ["key1", "key2"]
    key1 = F.xxhash64("text").alias("key1")
    key2 = F.xxhash64(F.lit("second"), "text").alias("key2")
    table, words = fresh("bits"), words_of(F.col("text")).alias("words")
    rows = docs.select("doc_id", key1, key2, words, _bit_table(prints).alias(table))
    rows = with_fingerprints(rows, lengths)
    found = [_let_through(F.col(f"prints{length}"), F.col(table)) for length in lengths]
    sent = F.concat(*found, F.array().cast("array<bigint>")).alias("prints")
    n_words = F.size("words").cast("bigint").alias("n_words")
    rows = scratch.table(rows.select("doc_id", *keys, n_words, sent))
    # Texts with a fingerprint of the benchmark, and those of their fingerprints.
    shared = rows.select(*keys, F.explode("prints").alias("print"))
    shared = shared.join(prints, "print", "left_semi").groupBy(*keys)
    shared = scratch.table(shared.agg(F.collect_set("print").alias("shared")))

    # Their spans with those fingerprints, compared word by word with the benchmark's.
    texts = docs.select("text", key1, key2).join(shared, keys).dropDuplicates(keys)
    texts = with_fingerprints(texts.select(*keys, "shared", words), lengths)
    places = F.concat(*[_places(length) for length in lengths], F.array().cast(_PLACES))
    near = texts.select(*keys, F.inline(places))
    classes = scratch.table(_classes(spans))
    hit = scratch.table(near.join(classes, "span").drop("span"))

    covered = _covered(F.collect_set(F.struct("start", "length"))).alias("n_hit")
    hits = rows.drop("prints").join(hit.groupBy(*keys).agg(covered), keys, "left")
    hits = scratch.table(hits.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint"))))
    named = spans.where("item_id IS NOT NULL").join(classes, "span")
    members = named.select("s1", "s2", "item_id").distinct()
    of_text = hit.select(*keys, "s1", "s2").distinct().join(members, ["s1", "s2"])
    listed = scratch.table(of_text.select(*keys, "item_id").distinct())
    scratch.drop_all(hits, listed)
    return Decontamination(hits, listed)


_PLACES = "array<struct<start:int,length:int,span:string>>"


def _places(length: int) -> Column:
    """Starts (from 0) and words of the spans whose fingerprint is one of ``shared``."""

    def place(p: Column, k: Column) -> Column:
        at = F.struct(
            k.alias("start"), F.lit(length).alias("length"), _span_at(k, length).alias("span")
        )
        return F.when(F.array_contains("shared", p), at)

    return F.array_compact(F.transform(f"prints{length}", place)).cast(_PLACES)


def _classes(spans: DataFrame) -> DataFrame:
    """(span, s1, s2): s1 and s2 stand for the set of items that have the span."""
    one = F.xxhash64("item_id").cast("decimal(38,0)")
    two = F.xxhash64(F.lit("second"), "item_id").cast("decimal(38,0)")
    return spans.groupBy("span").agg(F.sum(one).alias("s1"), F.sum(two).alias("s2"))


def contamination(docs: DataFrame, items: DataFrame, *, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, items: sorted ids as strings) of every row of ``docs``.

    As ``shared_spans``, with the items of a document in one array. A document that shares
    nothing has an empty one.
    """
    found = shared_spans(docs, items, span=span)
    listed = found.items.groupBy("key1", "key2").agg(
        F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items")
    )
    none = F.array().cast("array<string>")
    return found.hits.join(listed, ["key1", "key2"], "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items")
    )
