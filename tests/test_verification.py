import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.operators import blocks, retrieval
from factlake.operators.evidence import with_evidence_index
from factlake.operators.retrieval import (
    KnowledgeIndex,
    candidates,
    claim_tokens,
    kb_idf,
    score_entries,
)
from factlake.operators.verdicts import failed_claims, risk_level, risk_scores, verify_claims
from factlake.plans.verify import verify_answers

KB = "kb_id long, source string, source_credibility double, snippet string, url string, keywords array<string>"
PAIRS = (
    "answer_id long, claim_index int, claim string, claim_type string, kb_id long, source string, "
    "snippet string, url string, relevance_score double, rank int"
)


def _verdicts(spark, *rows):
    df = spark.createDataFrame(
        [(1, i, c, "factual", k, "imf", s, "", 0.5, r) for i, c, k, s, r in rows], PAIRS
    )
    return verify_claims(with_evidence_index(df)).orderBy("claim_index").collect()


def test_verdict_cases(spark):
    rows = _verdicts(
        spark,
        (0, "Peru exports copper ore", None, None, 1),
        (1, "Peru exports copper ore", 1, "Peru exports much copper ore today", 1),
        (2, "Peru exports copper ore", 2, "That Peru exports copper is false and incorrect", 1),
        (3, "Peru has 34 million people", 3, "Peru has 10 million people", 1),
        (4, "a b c d", 4, "a b c d", 1),
    )
    assert [r["verdict"] for r in rows] == [
        "NOT_ENOUGH_EVIDENCE", "SUPPORTED", "CONTRADICTED", "CONTRADICTED", "NOT_ENOUGH_EVIDENCE",
    ]
    assert [r["evidence_indices"] for r in rows] == [[], [0], [1], [2], []]
    assert rows[0]["confidence"] == 0.0
    assert "numeric conflict" in rows[3]["reasoning"]


def test_risk(spark):
    df = spark.createDataFrame(
        [(1, "SUPPORTED"), (1, "CONTRADICTED"), (1, "NOT_ENOUGH_EVIDENCE")], "answer_id long, verdict string"
    )
    answers = spark.createDataFrame([(1,), (2,)], "answer_id long")
    first, second = risk_scores(df, answers).orderBy("answer_id").collect()
    assert (first["risk_score"], first["risk_level"]) == (0.5, "MEDIUM")
    assert first["summary"] == (
        "1 of 3 claims are supported by evidence. 1 claim contradict evidence. 1 claim lack sufficient "
        "evidence. Overall hallucination risk is MEDIUM (score: 0.50)."
    )
    assert second["risk_score"] == 0.0
    assert second["summary"] == ". Overall hallucination risk is LOW (score: 0.00)."


def test_risk_level_bounds(spark):
    df = spark.createDataFrame([(0.33,), (0.34,), (0.66,), (0.67,)], "s double")
    assert [r[0] for r in df.select(risk_level(F.col("s"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_failed_claims_name_missing_texts(spark):
    verdicts = spark.createDataFrame(
        [(1, 0, "CONTRADICTED"), (1, 7, "NOT_ENOUGH_EVIDENCE")], "answer_id long, claim_index int, verdict string"
    )
    claims = spark.createDataFrame([(1, 0, "First.")], "answer_id long, claim_index int, text string")
    row = failed_claims(verdicts, claims).first()
    assert (row["contradicted"], row["unsupported"]) == (["First."], ["Claim 7"])


def test_idf_of_a_word_in_every_entry(spark):
    kb = spark.createDataFrame([(i, "s", 0.9, "x", "", ["peru", f"w{i}"]) for i in range(6)], KB)
    idf = {r["token"]: r["idf"] for r in kb_idf(kb).collect()}
    assert idf["peru"] == pytest.approx(math.log(6 / 7) + 1)


def _brute_force(claims, kb, k):
    df = {}
    for entry in kb:
        for word in entry[5]:
            df[word] = df.get(word, 0) + 1
    idf = {w: math.log(len(kb) / (n + 1)) + 1 for w, n in df.items()}
    out = []
    for answer_id, index, text in claims:
        query = set(f"wikipedia world-bank {text}".lower().split())
        total = sum(idf.get(t, 1.0) for t in query)
        scored = []
        for entry in kb:
            shared = query & set(entry[5])
            if shared:
                share = sum(idf[t] for t in shared) / total
                cred = 0.5 if entry[2] is None else entry[2]
                scored.append((-round(0.7 * share + 0.3 * cred, 4), entry[0]))
        out += [(answer_id, index, kb_id, -score) for score, kb_id in sorted(scored)[:k]]
    return sorted(out)


def _some_knowledge(entries):
    """One word is in a third of all entries and claims, many entries are copies."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]

    def some(n):
        return rng.choices(words, weights, k=n) + (["everywhere"] if rng.random() < 0.34 else [])

    kb = [
        (i, "s", rng.choice([None, 0.3, 0.9, 0.95]), "x", "", sorted(set(some(rng.randint(1, 5)))))
        for i in range(entries)
    ]
    claims = [(i // 5, i % 5, " ".join(some(rng.randint(1, 7)) + ["unseen"] * (i % 2))) for i in range(120)]
    return kb, claims


CLAIMS = "answer_id long, claim_index int, text string"


def _found(spark, claims, index):
    rows = score_entries(spark.createDataFrame(claims, CLAIMS), index).collect()
    return sorted((r["answer_id"], r["claim_index"], r["kb_id"], r["relevance_score"]) for r in rows)


@pytest.mark.parametrize("hot_df, long_entry", [(0, 48), (1, 2), (3, 48), (3, 3), (20, 48), (256, 48)])
def test_retrieval_is_exact_whatever_counts_as_frequent(spark, hot_df, long_entry):
    kb, claims = _some_knowledge(300)
    index = KnowledgeIndex.build(spark.createDataFrame(kb, KB), hot_df=hot_df, long_entry=long_entry)
    assert _found(spark, claims, index) == _brute_force(claims, kb, 3)


def test_an_index_takes_additions(spark, tmp_path):
    """Built and added, compacted, or saved and read again: the same as built at once."""
    kb, claims = _some_knowledge(300)
    frame = spark.createDataFrame(kb, KB)
    index = KnowledgeIndex.build(frame.where("kb_id < 130"), hot_df=8)
    grown = index.add(frame.where("kb_id >= 130 AND kb_id < 290")).add(frame.where("kb_id >= 290"))
    want = _brute_force(claims, kb, 3)
    assert len(grown.segments) == 3 and _found(spark, claims, grown) == want
    assert _found(spark, claims, index) == _brute_force(claims, kb[:130], 3)
    compact = grown.compact()
    assert len(compact.segments) == 1 and _found(spark, claims, compact) == want
    df = lambda i: {tuple(r) for r in i.stats.collect()}
    assert df(grown) == df(compact)
    grown.save(f"{tmp_path}/index", buckets=4)
    again = KnowledgeIndex.load(spark, f"{tmp_path}/index")
    assert _found(spark, claims, again) == want
    more = again.add(spark.createDataFrame([(999, "s", 0.99, "x", "", ["w1", "w2"])], KB))
    assert _found(spark, claims, more) == _brute_force(claims, [*kb, (999, "s", 0.99, "x", "", ["w1", "w2"])], 3)


def test_lists_bound_the_candidates_of_a_claim(spark):
    """However large the knowledge base: the lists a claim is joined with don't grow."""
    hot_df, credibilities, most = 16, 4, {}
    for entries in (400, 4000):
        kb, claims = _some_knowledge(entries)
        index = KnowledgeIndex.build(spark.createDataFrame(kb, KB), hot_df=hot_df)
        tokens = claim_tokens(spark.createDataFrame(claims, CLAIMS), index)
        placed = tokens.join(index.segments[0].local, "token")
        per_claim = placed.groupBy("answer_id", "claim_index").agg(
            F.count_if(F.col("df") <= hot_df).alias("r"), F.count_if(F.col("df") > hot_df).alias("h")
        )
        found = candidates(placed, index.segments[0], hot_df).groupBy("answer_id", "claim_index").count()
        rows = found.join(per_claim, ["answer_id", "claim_index"]).collect()
        bound = max(hot_df, credibilities * index.k)
        assert all(r["count"] <= (r["r"] + r["h"] ** 2) * bound for r in rows)
        most[entries] = sum(r["count"] for r in rows) / len(rows)
    print("candidates per claim:", most)
    assert most[4000] < 2 * most[400]


def test_hopeless_candidates_are_not_scored(spark, monkeypatch):
    """Those that can't be among a claim's best are dropped by their bounds; the result is exact."""
    kb, claims = _some_knowledge(300)
    counts = {}
    worth = retrieval._worth_scoring

    def counted(found, of_claim, k):
        counts["kept"] = (kept := worth(found, of_claim, k)).count()
        counts["found"] = found.count()
        return kept

    monkeypatch.setattr(retrieval, "_worth_scoring", counted)
    index = KnowledgeIndex.build(spark.createDataFrame(kb, KB), hot_df=8)
    assert _found(spark, claims, index) == _brute_force(claims, kb, 3)
    print("candidates, scored:", counts)
    assert 0 < counts["kept"] < counts["found"]


def test_reports_of_a_small_knowledge_base(spark):
    kb = spark.createDataFrame(
        [
            (1, "wikipedia", 0.9, "Peru had an estimated 34 million people in 2023.", "https://x.org/1", ["peru", "million", "2023"]),
            (2, "imf", 0.95, "Lima is the capital and largest city of Peru.", "https://x.org/2", ["lima", "capital", "peru"]),
        ],
        KB,
    )
    answers = spark.createDataFrame(
        [(1, "Lima is the capital of Peru. Bananas are yellow and sweet fruit.", None)],
        "answer_id long, answer string, trusted_sources array<string>",
    )
    report = verify_answers(answers, KnowledgeIndex.build(kb)).reports.first()
    assert [v["verdict"] for v in report["verdicts"]] == ["SUPPORTED", "NOT_ENOUGH_EVIDENCE"]
    assert report["verdicts"][0]["evidence_indices"] == [0]
    assert [c["source"] for c in report["citations"]] == ["imf"]
    assert (report["risk_score"], report["risk_level"]) == (0.25, "LOW")


def test_an_index_grows_with_its_postings(spark):
    """Not with the pairs of an entry's tokens: 20 frequent tokens an entry are 190 pairs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    kb = [(i, "s", 0.9, "x", "", sorted(rng.sample(words, 20))) for i in range(200)]
    (segment,) = KnowledgeIndex.build(spark.createDataFrame(kb, KB), hot_df=8).segments
    rows = sum(getattr(segment, table).count() for table in segment.TABLES)
    assert rows <= 200 * 20


@pytest.mark.parametrize("size, part", [(7, 11), (64, 1 << 17)])
def test_blocks_find_the_best_of_all(spark, monkeypatch, size, part):
    """In small blocks and parts, with and without a score to reach, against brute force."""
    monkeypatch.setattr(blocks, "PART", part)
    rng = random.Random(size)
    entries = [(i, rng.choice([0.3, 0.9, 0.95]), rng.sample(range(30), rng.randint(2, 6))) for i in range(150)]
    claims = []
    for i in range(60):
        tokens = sorted(rng.sample(range(35), rng.randint(2, 7)))
        claims.append((i, 0, 60, rng.choice([None, 0.5, 0.6, 0.7]), tokens, sorted((rng.randint(1, 9) for _ in tokens), reverse=True)))
    index = blocks.inverted_blocks(
        spark.createDataFrame(entries, "kb_id long, credibility double, hot array<long>"), "hot", size=size
    )
    asked = spark.createDataFrame(
        claims, "answer_id long, claim_index int, total long, least double, tokens array<long>, weights array<long>"
    )
    found = {}
    for r in blocks.search_blocks(asked, index, 3, 1e-6).collect():
        found.setdefault(r["answer_id"], []).append((-(0.7 * (r["weight"] / 60) + 0.3 * r["credibility"]), r["kb_id"]))
    for i, _, total, least, tokens, weights in claims:
        of, best = dict(zip(tokens, weights)), []
        for kb_id, credibility, held in entries:
            score = 0.7 * (sum(of.get(t, 0) for t in held) / total) + 0.3 * credibility
            if sum(t in of for t in held) >= 2 and score >= (least or 0):
                best.append((-score, kb_id))
        # Those that share one token only may come, too.
        several = {kb_id for _, kb_id in best}
        shared_two = [e for e in sorted(found.get(i, [])) if e[1] in several]
        ahead = [e for e in sorted(found.get(i, [])) if e[1] not in several][:3]
        assert shared_two[: 3 - len(ahead)] == sorted(best)[: 3 - len(ahead)]


def test_a_block_scores_only_entries_of_several_tokens():
    """A long list costs a look, not a score for each of its entries."""
    lists = [np.arange(0, 1000), np.arange(999, 3000), np.array([5, 999, 2999])]
    sums, extra = np.zeros(3000, "int64"), np.zeros(3000)
    for weights in ([9, 8, 7], [9, 3, 2]):
        seen, weight = blocks._shared(lists, weights, 1.0, 30.0, extra, 0.0, 3, 30.0, sums)
        held = {5: weights[0] + weights[2], 999: sum(weights), 2999: weights[1] + weights[2]}
        assert dict(zip(seen.tolist(), weight.tolist())) == held and not sums.any()


def test_every_pair_of_part_and_block_may_be_a_task(spark, monkeypatch):
    """Whatever the number of shuffle partitions is."""
    monkeypatch.setattr(blocks, "SMALL_PART", 4)
    entries = spark.range(64).selectExpr("id AS kb_id", "0.9D AS credibility", "array(1L, 2L) AS hot")
    index = blocks.inverted_blocks(entries, "hot", size=16).cache()
    asked = spark.range(32).selectExpr(
        "id AS answer_id", "0 AS claim_index", "9L AS total", "CAST(NULL AS DOUBLE) AS least",
        "array(1L, 2L) AS tokens", "array(4L, 3L) AS weights",
    )
    found = blocks.search_blocks(asked, index, 3, 1e-6)
    assert found.rdd.getNumPartitions() >= 32
    assert found.groupBy("answer_id").count().where("count >= 3").count() == 32
