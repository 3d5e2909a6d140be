"""Candidates of the pipeline's near-duplicates: ball hashing beside keys of minima, and a check of all."""

import random

import corpus_pipeline
from kinloom.llm import near_text, simhash


def test_the_ball_gives_candidates_without_keys(spark):
    fps = [0b1011, 0b1011, 0b0100, 0b0100 ^ 0b1111 << 20, -1]  # twice one, at 4 bits from it the third, then out of reach
    rows = [(i + 1, 100, [], fp) for i, fp in enumerate(fps)] + [(9, 10, [], 0b1011)]  # too short to be as similar
    nodes = spark.createDataFrame([*rows, (7, 90, [], 0b1010)], "node long, size long, bands array<long>, fp long")
    got = {tuple(r) for r in near_text._candidates(nodes, 80).collect()}
    assert got == {(1, 2), (1, 7), (3, 7)}


def test_the_stage_links_by_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10_000)}" for _ in range(2_000)]
    near, other = words[:1_000] + ["other"] + words[1_001:], [f"v{rng.randrange(10_000)}" for _ in range(2_000)]
    texts = [" ".join(x) for x in (words, near, other)]
    assert bin(simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).count("1") <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: asked.append(fps.count()) or links(fps))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and asked and asked[0] >= 2


def test_sizes_and_signs_of_texts(spark):
    texts = ["A b  c", "", None, "a b c d e f", "a b c d e f a b c d e f " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in near_text._rows(docs, 5).collect():
        assert r["fp"] % (1 << 64) == simhash.fingerprint(texts[r["id"]], 5)
        assert r["size"] == len(near_text.shingles(texts[r["id"]], 5)[1])
