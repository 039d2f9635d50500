"""The near-duplicate stage takes candidates from SimHash fingerprints and the trie self-join."""

from strandwork.llm import neardup

from .test_neardup import near_copies


def test_stage_asks_the_trie_join(spark, sf, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(neardup, "trie_links", lambda fps, bits, f=neardup.trie_links: asked.append((fps.count(), bits)) or f(fps, bits))
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert stage(spark, near_copies(spark), sf).count() > 0
    assert asked == [(6, neardup.SIMHASH_BITS)]


def test_candidates_by_fingerprints(spark):
    """Nodes of one fingerprint in a star around the least, and fingerprints a bit or two apart; others not."""
    nodes = spark.createDataFrame([(5, 0b0), (3, 0b0), (9, 0b0), (4, 0b11), (8, -1)], "node long, fp long")
    assert sorted(map(tuple, neardup._by_fingerprints(nodes).collect())) == [(3, 4), (3, 5), (3, 9)]
