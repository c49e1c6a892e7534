import pytest

from tessera.errors import ContractError
from tessera.operators import annotate, colour
from tessera.sources import tables


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_taxdump(spark, tmp_path):
    nodes = put(tmp_path, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tfamily\t|\n")
    names = put(tmp_path, "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tX\t|\t\t|\tsynonym\t|\n2\t|\tFam\t|\t\t|\tscientific name\t|\n")
    assert sorted(map(tuple, tables.taxdump(spark, nodes, names).collect())) == [(1, 1, "no rank", "root"), (2, 1, "family", "Fam")]


def test_paf_keeps_the_first_best(spark, tmp_path):
    line = "{}\t9\t0\t9\t+\t{}\t9\t0\t9\t{}\t9\t60\n"
    p = put(tmp_path, "x.paf", line.format("q", "a", 5) + line.format("q", "b", 7) + line.format("q", "c", 7) + line.format("r", "d", 1))
    assert sorted(map(tuple, tables.paf_best(spark, p).collect())) == [("q", "b", 7), ("r", "d", 1)]


def test_read_taxa(spark, tmp_path):
    p = put(tmp_path, "k.txt", "C\ta\t5\nC\tb\t5\nU\tc\t0\n")
    assert sorted(map(tuple, tables.read_taxa(spark, p).collect())) == [(0, 1), (5, 2)]


def test_timetable(spark, tmp_path):
    put(tmp_path, "stops.txt", "stop_id,stop_name,stop_lat,stop_lon\ns1,A,1.0,2.0\ns2,B,1.5,2.5\ns3,C,0,0\n")
    put(tmp_path, "routes.txt", "route_id,route_type,route_short_name\nr1,3,7\nr2,1,M\n")
    put(tmp_path, "trips.txt", "trip_id,route_id\nt1,r1\nt2,r2\n")
    put(tmp_path, "stop_times.txt", "trip_id,stop_sequence,stop_id\nt1,2,s2\nt1,1,s1\nt2,1,s3\n")
    stops, trips, visits = tables.timetable(spark, str(tmp_path), {3: "bus"})
    assert sorted(r["stop_id"] for r in stops.collect()) == ["s1", "s2"]
    assert [tuple(r) for r in trips.collect()] == [("t1", "r1", "bus", "7")]
    assert visits.count() == 2
    put(tmp_path, "trips.txt", "trip_id,route_id\nt1,zz\n")
    with pytest.raises(ContractError, match="unknown route zz"):
        tables.timetable(spark, str(tmp_path), {3: "bus"})


def test_reports_and_pins(spark, tmp_path):
    p = put(tmp_path, "r.jsonl", '{"accession": "A.1", "organism": {"organismName": "X"}}\n{"assembly_accession": "B.1", "organism_name": "Y"}\n')
    assert sorted(map(tuple, tables.report_identities(spark, p).collect())) == [("A.1", "X"), ("B.1", "Y")]
    good = put(tmp_path, "p.tsv", "pair_id\trole\taccession\n1\tsim\tA.1\n1\tdb\tB.1\n")
    assert tables.pin_pairs(spark, good).count() == 2
    bad = put(tmp_path, "q.tsv", "pair_id\trole\taccession\n1\tsim\tA.1\n2\tsim\tA.2\n2\tdb\tB.1\n")
    with pytest.raises(ContractError) as caught:
        tables.pin_pairs(spark, bad)
    assert caught.value.errors == ["pair 1 has not one row of sim and one of db", "sim accession A stands in more than one pair"]


def test_transfer(spark):
    rows = spark.createDataFrame([("a", 1.5, "x"), ("b", 2.0, "y")], "node_id string, cov double, kind string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    got = sorted(map(tuple, annotate.transfer(rows, "node_id", ["cov", "kind"], ids).collect()))
    assert got == [("a", "cov", "1.5"), ("a", "kind", "x"), ("b", "cov", "2.0"), ("b", "kind", "y")]
    with pytest.raises(ContractError, match="a is not in the compacted graph"):
        annotate.transfer(rows, "node_id", ["cov"], ids.where("id = 'b'"))
    with pytest.raises(ContractError, match="blank cell kind of b"):
        annotate.transfer(rows.replace("y", " ", "kind"), "node_id", ["kind"], ids)


def test_paint_always_mints_new_colours(spark):
    e = spark.createDataFrame([("a", [0]), ("b", [0])], "id string, color_ids array<int>")
    names = spark.createDataFrame([(0, "n", "p")], "color_id int, namespace string, value string")
    v = spark.createDataFrame([("a", "q", 1), ("a", "p", 0)], "id string, value string, pos long")
    got, left = colour.paint(e, v, names, "n")
    assert {r["id"]: r["color_ids"] for r in got.collect()} == {"a": [0, 1, 2], "b": [0]}
    assert sorted(map(tuple, left.collect())) == [(0, "n", "p"), (1, "n", "p"), (2, "n", "q")]
    got, _ = colour.paint(e, v, names, "n", "intersect")
    assert {r["id"]: r["color_ids"] for r in got.collect()} == {"a": [], "b": [0]}
    got, left = colour.paint(e, v, names, "n", "replace")
    assert {r["id"]: r["color_ids"] for r in got.collect()} == {"a": [0, 1], "b": []} and left.count() == 2
