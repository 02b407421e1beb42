"""Layers, dependents and merging of job tables against plain ones."""

import pytest

from tessella.operators import jobs


def graph(spark, edges, n):
    rows = [(f"j{i}",) for i in range(n)]
    return spark.createDataFrame(rows, "job_id string"), spark.createDataFrame([(f"j{a}", f"j{b}") for a, b in edges], "job_id string, needs string")


def test_layers_are_longest_ways(spark):
    edges = [(1, 0), (2, 1), (2, 0), (3, 0), (4, 2), (4, 3), (4, 3), (5, 99)]
    got = jobs.topological_layers(*graph(spark, edges, 6)).collect()
    assert sorted(map(tuple, got)) == [("j0", 0), ("j1", 1), ("j2", 2), ("j3", 1), ("j4", 3), ("j5", 0)]


def test_no_jobs_have_no_layers(spark):
    assert jobs.topological_layers(*graph(spark, [], 0)).count() == 0


@pytest.mark.parametrize("edges", [[(0, 0)], [(1, 2), (2, 3), (3, 1), (4, 3)]])
def test_cycles_are_errors(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        jobs.topological_layers(*graph(spark, edges, 5))


def test_dependents_of_a_cycle_end(spark):
    _, edges = graph(spark, [(1, 0), (2, 1), (0, 2), (3, 2)], 4)
    got = jobs.transitive_dependents(edges, spark.createDataFrame([("j0",)], "root string")).collect()
    assert sorted(r["job_id"] for r in got) == ["j0", "j1", "j2", "j3"]


def test_merging_keeps_known_jobs(spark):
    schema = "job_id string, status string, fingerprint string"
    base = spark.createDataFrame([("a", "DONE", "1"), ("b", "DONE", None)], schema)
    more = spark.createDataFrame([("a", "PLANNED", "1"), ("b", "PLANNED", None), ("c", "PLANNED", "3")], schema)
    assert sorted(map(tuple, jobs.merged(base, more).collect())) == [("a", "DONE", "1"), ("b", "DONE", None), ("c", "PLANNED", "3")]
    assert jobs.conflicts(base, more).count() == 0


@pytest.mark.parametrize("fingerprint", ["2", None])
def test_merging_another_input_is_an_error(spark, fingerprint):
    schema = "job_id string, status string, fingerprint string"
    base, more = spark.createDataFrame([("a", "DONE", "1")], schema), spark.createDataFrame([("a", "PLANNED", fingerprint)], schema)
    assert jobs.conflicts(base, more).count() == 1
    with pytest.raises(Exception, match="another fingerprint"):
        jobs.merged(base, more).collect()
