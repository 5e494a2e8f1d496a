import json

from kinweave.plans import cli


def test_writers_and_final(spark, tmp_path):
    rec = tmp_path / "r.jsonl"
    rec.write_text("\n".join(json.dumps({"recording_id": f"r{i}", "recording_title": f"T{i}", "authors": [{"name": n, "mbid": "", "relation": "composer"} for n in names]}) for i, names in enumerate((["A", "B"], ["A", "B", "C"]))))
    cli.main(["writers", str(rec), "--prefix", str(tmp_path / "w")])
    edges = spark.read.option("header", True).csv(str(tmp_path / "w_edges")).collect()
    assert {(r.u, r.v, r.weight, r.examples) for r in edges} == {("A", "B", "2", "T0; T1"), ("A", "C", "1", "T1"), ("B", "C", "1", "T1")}
    assert spark.read.option("header", True).csv(str(tmp_path / "w_nodes")).count() == 3
    (tmp_path / "b.csv").write_text("artist_mbid,artist_name,window_years\n1,A,5\n2,B,5\n")
    (tmp_path / "n.csv").write_text("node,degree\n1,3\n")
    (tmp_path / "e.csv").write_text("artist_mbid,n2v_0\n1,0.5\n")
    (tmp_path / "m.jsonl").write_text('{"artist_id": "s", "followers": 7, "popularity": 1, "artist_mbid": "1"}\n')
    cli.main(["final", "--base-features", str(tmp_path / "b.csv"), "--node-features", str(tmp_path / "n.csv"), "--node-embeddings", str(tmp_path / "e.csv"), "--metrics-jsonl", str(tmp_path / "m.jsonl"), "--output", str(tmp_path / "f")])
    rows = {r.artist_mbid: r for r in spark.read.option("header", True).csv(str(tmp_path / "f")).collect()}
    assert rows["1"].followers == "7" and rows["1"].degree == "3" and rows["2"].degree is None
