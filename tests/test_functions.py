import pytest
from pyspark.sql import functions as F

from tessera.errors import ContractError
from tessera.functions import seq, sets


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_sequence_functions(spark):
    lit = F.lit
    assert value(spark, seq.reverse_complement(lit("ACGTN"))) == "NACGT"
    assert value(spark, seq.kmers(lit("ACGT"), 3)) == ["ACG", "CGT"]
    assert value(spark, seq.kmers(lit("AC"), 3)) == []
    assert value(spark, seq.canonical(lit("TTT"))) == "AAA"
    assert value(spark, seq.motif_count(lit("AAAA"), lit("AA"))) == 3
    assert value(spark, seq.motif_count(lit("AAAA"), lit(""))) == 0
    assert value(spark, seq.motif_count(lit("A"), lit("AAA"))) == 0
    assert value(spark, seq.either_strand_count(lit("ACGT"), lit("ACGT"))) == 1
    assert value(spark, seq.either_strand_count(lit("AATT"), lit("AA"))) == 2
    assert value(spark, seq.junction(lit("ATGC"), lit("TGCA"), 4)) == "ATGCA"
    assert value(spark, seq.covers(lit("ACGG"), lit("CGT"))) is True
    assert value(spark, seq.covers(lit("ACGG"), lit("TTCCGTT"))) is True
    assert value(spark, seq.covers(lit("ACGG"), lit(""))) is False
    assert value(spark, seq.overlaps(lit("AACG"), lit("CGT"), lit(2))) is True
    assert value(spark, seq.overlaps(lit("AACG"), lit("CGT"), lit(0))) is True
    assert value(spark, seq.overlaps(lit("AACG"), lit("CGT"), lit(-1))) is False
    assert value(spark, seq.base4(lit(6), 4)) == "AACG"
    assert value(spark, seq.gc(lit("ACGN"))) == 0.5
    assert value(spark, seq.entropy(lit("ACGT"))) == 2.0
    assert value(spark, seq.wrapped(lit("ABCDE"), 2)) == "AB\nCD\nE"
    assert value(spark, seq.route_number(lit("bus:42a"))) == 42
    assert value(spark, seq.route_number(lit("bus"))) is None


def test_set_operations(spark):
    a, b = F.array(*map(F.lit, (3, 1, 2))), F.array(*map(F.lit, (2, 5)))
    got = {op: value(spark, sets.combine(a, b, op)) for op in sets.OPERATIONS}
    assert got == {"replace": [2, 5], "merge": [1, 2, 3, 5], "intersect": [2], "subtract": [1, 3]}
    with pytest.raises(ContractError):
        sets.combine(a, b, "xor")
    assert value(spark, sets.parse(F.lit("0, 1"))) == [0, 1]
    assert value(spark, sets.parse(F.lit(""))) == []
    assert value(spark, sets.text(F.array(F.lit(4), F.lit(2)))) == "4,2"


def test_no_codegen_breaking_udfs(spark):
    plan = spark.range(5).select(seq.reverse_complement(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
