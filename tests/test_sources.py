import pytest

from tessera.errors import ContractError
from tessera.sources import text


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "x.fa", ">a one\nacg\nTT\n>b\n\nGG\n")
    assert [(r["id"], r["seq"]) for r in text.fasta(spark, p).orderBy("id").collect()] == [("a", "ACGTT"), ("b", "GG")]
    with pytest.raises(ContractError, match="2 records are called a"):
        text.require_records(text.fasta(spark, put(tmp_path, "y.fa", ">a\nA\n>a\nC\n")))


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "x.fq", "@r1 x\nacgt\n+\nIIII\n\n@r2\nGG\n+\nII\n")
    assert sorted(map(tuple, text.fastq(spark, p).collect())) == [("r1", "ACGT"), ("r2", "GG")]
    with pytest.raises(ContractError):
        text.fastq(spark, put(tmp_path, "y.fq", "@r1\nA\n-\nI\n"))


def test_gfa(spark, tmp_path):
    p = put(tmp_path, "x.gfa", "H\tVN:Z:1.0\nS\ta\tacg\nS\tb\tCGT\nL\ta\t+\tb\t-\t2M\n")
    nodes, edges = text.gfa(spark, p)
    assert sorted(map(tuple, nodes.collect())) == [("a", "ACG"), ("b", "CGT")]
    assert [tuple(r)[1:] for r in edges.collect()] == [("a", "b", "+-", 2)]
    with pytest.raises(ContractError, match="unknown GFA record X"):
        text.gfa(spark, put(tmp_path, "y.gfa", "X\t1\n"))
    with pytest.raises(ContractError, match="overlap"):
        text.gfa(spark, put(tmp_path, "z.gfa", "S\ta\tA\nL\ta\t+\ta\t+\t2I\n"))


def test_fastg(spark, tmp_path):
    p = put(tmp_path, "x.fastg", ">N_ID_1_cov_2.5_ID_1:N_ID_2;\nACGTA\n>N_ID_1_cov_2.5_ID_1';\nTACGT\n>N_ID_2;\nGTACC\n".replace("N_ID_1_cov_2.5_ID_1", "NODE_cov_2.5_ID_1").replace("N_ID_2", "NODE_cov_1_ID_2"))
    nodes, edges = text.fastg(spark, p, 3)
    assert sorted((r["node_id"], r["sequence"], r["coverage"]) for r in nodes.collect()) == [("n000001", "ACGTA", 2.5), ("n000002", "GTACC", 1.0)]
    assert [tuple(r) for r in edges.collect()] == [("n000001", "n000002", "++", 3)]


def test_classifier_outputs(spark, tmp_path):
    p = put(tmp_path, "k.txt", "C\ta\t562\t10\t562:3 0:2 9606:0\nC\tc\t7\t5\t0:5\nU\tb\t0\t4\t\n")
    assert {r["seq_id"]: r["taxa"] for r in text.kraken2(spark, p).collect()} == {"a": [562], "c": [7], "b": []}
    p = put(tmp_path, "j.txt", "C\ta\t562\nU\tb\t0\n")
    assert {r["seq_id"]: r["taxa"] for r in text.kaiju(spark, p).collect()} == {"a": [562], "b": []}


def test_tsv(spark, tmp_path):
    p = put(tmp_path, "x.tsv", "a\tb\n1\t\n\n2\tx\n")
    assert sorted(map(tuple, text.tsv(spark, p).collect())) == [("1", ""), ("2", "x")]
    with pytest.raises(ContractError):
        text.tsv(spark, put(tmp_path, "y.tsv", "a\ta\n1\t2\n"))
    with pytest.raises(ContractError):
        text.tsv(spark, put(tmp_path, "z.tsv", "a\tb\n1\n"))


def test_write_fasta(spark, tmp_path):
    rows = spark.createDataFrame([("b", "ACGT" * 30), ("a", "AC")], "node_id string, sequence string")
    text.write_fasta(rows, str(tmp_path / "out"))
    assert {r["id"]: r["seq"] for r in text.fasta(spark, str(tmp_path / "out")).collect()} == {"a": "AC", "b": "ACGT" * 30}
