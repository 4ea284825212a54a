"""Which sources of a language differ, by how much, and in which terms.

A term is a run of letters (ASCII letters in lower case and any other sign beyond ASCII). An
Arrow compute pipeline counts them: lower case, split by a pattern, dictionary encoding and
hash grouping over a slice of texts at a time, inside mapInArrow. What it returns are partial
counts, already merged over what a task has seen; Spark adds them up. The counted terms of a
language are dealt by hash into columnar shards of bounded size, a matrix of terms by sources;
every shard returns its part of each pair's divergence and its best terms of each group, and
Spark merges those. All arithmetic is on whole numbers.

Scale: texts are read once and never shuffled; what is shuffled are counts by (lang, source,
term) after each task has merged its own, so a source with a third of all rows weighs no more
than its vocabulary. A shard holds one part of one language's terms, however large the
language; the pairs of sources it returns are the rows that the result itself asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from factlake.session import Scratch

#: RE2: everything that isn't part of a term once the text is in lower case.
_BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
TOP_TERMS = 200
#: p and q are in units of 1 / 10^9, which is _BASE to the power of _STEPS.
_STEPS, _BASE = 3, 1000
#: (lang, source, term) counts of one shard.
SHARD_ROWS = 100_000
#: Bytes of text that are split at a time, and partial counts that a task merges at a time.
_SLICE_BYTES, _MERGED_ROWS = 8 << 20, 400_000
#: Cells of the matrices that a shard works on at a time.
_CELLS = 1 << 20
_KEYS = ["lang", "source", "term"]
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``_SLICE_BYTES`` of text, or one longer row."""
    ends = pc.cumulative_sum(pc.binary_length(batch["text"]).cast(pa.int64())).to_numpy()
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (lang, source, text) without nulls.

    Every (lang, source) has a row with the empty term and no counts, so that groups without
    terms are known, too.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), _BETWEEN)
    terms, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(terms, "")
    terms, row = terms.filter(full).dictionary_encode(), row.filter(full)
    code = terms.indices.cast(pa.int64())
    lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    # The first row of every group names it.
    _, first, group = np.unique(both, return_index=True, return_inverse=True)
    by_row = pa.table({"row": row, "code": code}).group_by(["row", "code"], use_threads=False)
    by_row = by_row.aggregate([([], "count_all")])
    of = pa.array(group[by_row["row"].to_numpy()])
    by_group = pa.table({"group": of, "code": by_row["code"], "n": by_row["count_all"]})
    by_group = by_group.group_by(["group", "code"], use_threads=False)
    found = by_group.aggregate([("n", "sum"), ([], "count_all")])
    at, first = pa.array(first[found["group"].to_numpy()]), pa.array(first)
    out = pa.table(
        {
            "lang": batch["lang"].take(at),
            "source": batch["source"].take(at),
            "term": terms.dictionary.take(found["code"]),
            "n": found["n_sum"],
            "docs": found["count_all"],
        }
    )
    zeros = pa.array(np.zeros(len(first), np.int64))
    names = pa.table(
        {
            "lang": batch["lang"].take(first),
            "source": batch["source"].take(first),
            "term": pa.array([""] * len(first), pa.string()),
            "n": zeros,
            "docs": zeros,
        }
    )
    return pa.concat_tables([out.cast(names.schema), names])


def _merged(parts: list[pa.Table]) -> pa.Table:
    counts = pa.concat_tables(parts).combine_chunks().group_by(_KEYS, use_threads=False)
    summed = counts.aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns([*_KEYS, "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for some in _slices(batch):
            parts.append(partial_counts(some))
            rows += parts[-1].num_rows
            if rows > 2 * _MERGED_ROWS:
                parts = [_merged(parts)]
                rows = parts[0].num_rows
                if rows > _MERGED_ROWS:
                    yield from parts[0].to_batches(max_chunksize=50_000)
                    parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all documents; null lang, source or text is ''.

    Each occurring (lang, source) has a row with the empty term, too.
    """
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    partial = docs.select(*plain).mapInArrow(_counted, _COUNTS)
    return partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), digit by digit: no product leaves a long."""
    rest, out = count + 1, 0
    for _ in range(_STEPS):
        rest = rest * _BASE
        out = out * _BASE + rest // total
        rest = rest % total
    return 1 + out


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square is a long."""
    d = p - q
    return ((d * d).astype(np.uint64) // q.astype(np.uint64)).astype(np.int64)


def _sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sum of the distance over all terms (rows), from each source (column) to each other."""
    n = len(totals)
    out = np.zeros((n, n), dtype=object)
    step = max(1, _CELLS // max(1, n))
    for at in range(0, len(counts), step):
        p = _share(counts[at : at + step], totals[None, :])
        for g in range(n):
            # Halves are added apart, so that no sum of a chunk leaves a long.
            f = _distance(p[:, g : g + 1], p)
            high, low = (f >> 32).sum(axis=0), (f & 0xFFFFFFFF).sum(axis=0)
            out[g] += high.astype(object) * (1 << 32) + low.astype(object)
    return out


def _shard(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(source, item, part, value) of a shard: part sums of pairs, best terms of groups."""

    def work(counts: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        sources, lang = groups["source"].combine_chunks(), groups["lang"][0].as_py()
        vocabulary = groups["vocabulary"].to_numpy()
        totals = groups["total"].to_numpy() + vocabulary
        of_lang = groups["lang_total"].to_numpy()[0] + vocabulary[0]
        terms = counts["term"].combine_chunks().dictionary_encode()
        row = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        column = pc.index_in(counts["source"].combine_chunks(), sources).to_numpy(zero_copy_only=False)
        n = counts["n"].to_numpy()
        names, items, parts, values = [], [], [], []

        sums = np.zeros((len(sources),) * 2, dtype=object)
        many = len(terms.dictionary)
        order = np.argsort(row, kind="stable")
        row, column, n = row[order], column[order], n[order]
        step = max(1, _CELLS // len(sources))
        for at in range(0, many, step):
            upto = min(at + step, many)
            some = slice(*np.searchsorted(row, [at, upto]))
            dense = np.zeros((upto - at, len(sources)), dtype=np.int64)
            dense[row[some] - at, column[some]] = n[some]
            sums += _sums(dense, totals)
        g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
        names.append(sources.take(pa.array(g)))
        items.append(sources.take(pa.array(h)))
        parts.append(["pair"] * len(g))
        values.extend(int(v) for v in sums[g, h])

        if len(n):
            # A term's count in the language is the same on all its rows.
            in_lang = counts["lang_n"].to_numpy()[order]
            p, q = _share(n, totals[column]), _share(in_lang, np.full(len(n), of_lang))
            over = np.flatnonzero(p > q)
            table = pa.table(
                {
                    "source": pa.array(column[over]),
                    "value": pa.array(_distance(p[over], q[over])),
                    "term": terms.dictionary.take(pa.array(row[over])),
                }
            ).sort_by([("source", "ascending"), ("value", "descending"), ("term", "ascending")])
            of = table["source"].to_numpy()
            kept = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) < top)
            table = table.take(pa.array(kept))
            names.append(sources.take(table["source"].combine_chunks()))
            items.append(table["term"].combine_chunks())
            parts.append(["term"] * len(kept))
            values.extend(table["value"].to_pylist())
        return pa.table(
            {
                "lang": pa.array([lang] * len(values), pa.string()),
                "source": pa.concat_arrays([x.cast(pa.string()) for x in names]),
                "part": pa.array(sum(parts, []), pa.string()),
                "item": pa.concat_arrays([x.cast(pa.string()) for x in items]),
                "value": pa.array([str(v) for v in values], pa.string()),
            }
        )

    return work


def source_divergence(
    docs: DataFrame,
    *,
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(lang, source, part, item, value, rank from 1) of every (lang, source) group.

    ``docs`` needs lang, source and text; null counts as '' in each, so rows without a text
    still make their group known. Repeated rows are documents of their own. Only terms in at
    least ``least_docs`` documents of their language count. Part ``pair``: value is the
    divergence from each other source of the language, 0 if the language has no such terms.
    Part ``term``: the ``top_terms`` terms that are more frequent in the group than in its
    language, by their part of the divergence from it. Ties rank by item in UTF-8 order. A
    language with one source has no pairs; an empty table gives an empty result. A divergence
    beyond a long raises an error.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.table(term_counts(docs))
    real = counts.where("term != ''")
    by_term = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    known = by_term.where(F.col("docs") >= least_docs).drop("docs")
    kept = scratch.table(real.drop("docs").join(known, ["lang", "term"]))

    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("lang_total"))
    # Each counted term of the language stands on as many rows as it has sources.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups = (
        counts.where("term = ''").select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(by_lang.join(sizes, "lang"), "lang", "left")
        .select("lang", "source", *[zero(c) for c in ("total", "vocabulary", "lang_total", "rows")])
    )
    groups = scratch.table(
        groups.withColumn("shards", (F.col("rows") / shard_rows).cast("bigint") + 1).drop("rows")
    )
    shards = groups.groupBy("lang").agg(F.max("shards").alias("shards"))
    dealt = kept.join(shards, "lang").withColumn(
        "shard", F.pmod(F.xxhash64("term"), F.col("shards"))
    )
    beside = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    key = ["lang", "shard"]
    found = (
        dealt.select(*key, "source", "term", "n", "lang_n").groupBy(*key)
        .cogroup(beside.select(*key, "source", "total", "vocabulary", "lang_total").groupBy(*key))
        .applyInArrow(_shard(top_terms), "lang string, source string, part string, item string, value string")
    )
    found = scratch.table(found.withColumn("value", F.col("value").cast("decimal(38,0)")))
    scratch.drop(counts, kept, groups)
    merged = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("bigint").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = merged.withColumn("rank", F.row_number().over(place))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
