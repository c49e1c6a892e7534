from tessera.plans import catalogue, derived  # noqa: F401 - they register their queries


def test_windows_of_documents_are_counted_before_they_are_shuffled(spark, sf):
    out = derived.registry.queries["doc_kmers"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert out.columns == ["kmer", "n"] and out.where("length(kmer) <> 11 or n < 1").isEmpty()
