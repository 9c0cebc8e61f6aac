from __future__ import annotations

import glob
import os

import pytest

from graphloom.operators import resolve, universe
from graphloom.sources import fragments
from graphloom.sources.views import view

DIR = "/root/testdata/sf0.001"


def test_snapshot_round_trip_and_corrupt_files(spark, tmp_path):
    nodes, edges = view(spark, DIR, "pl_nodes"), view(spark, DIR, "pl_edges")
    root = str(tmp_path / "v")
    fragments.write(nodes, edges, root)
    got = fragments.read(spark, root)
    cols = ["file", "symbol", "branches", "outcome_arity", "escapes", "entrypoint", "entrypoint_kind"]
    key = lambda r: repr(tuple(r))
    assert sorted(got.nodes.select(*cols).collect(), key=key) == sorted(nodes.select(*cols).collect(), key=key)
    assert sorted(got.edges.collect(), key=key) == sorted(edges.select("from", "to", "calls").collect(), key=key)
    assert got.corrupt.isEmpty()
    captured = {r.column: r.captured for r in universe.captured(got.nodes, ["escapes", "toll_booth"]).collect()}
    assert captured == {"escapes": True, "toll_booth": False}
    # a broken line takes its whole file with it; a stray folder is not read
    path = sorted(glob.glob(f"{root}/fragments/*/*.txt"))[0]
    with open(path) as f:
        lines = f.readlines()
    lost = lines[0].split('"')[3]
    with open(path, "w") as f:
        f.writelines([lines[0][: len(lines[0]) // 2] + "\n", *lines[1:]])
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    os.makedirs(f"{root}/fragments/shard=999")
    with open(f"{root}/fragments/shard=999/x.txt", "w") as f:
        f.write(lines[0])
    again = fragments.read(spark, root)
    assert [r.file for r in again.corrupt.collect()] == [lost]
    assert again.nodes.where(f"file = '{lost}'").isEmpty() and again.nodes.count() == nodes.where(f"file <> '{lost}'").count()


def test_csv_allowlist(spark, tmp_path):
    (tmp_path / "a.csv").write_text('pr,title,author\n1,"a ""b"", c",x\n')
    assert fragments.csv(spark, str(tmp_path / "a.csv"), ["pr", "title"]).first() == ("1", 'a "b", c')
    with pytest.raises(ValueError):
        fragments.csv(spark, str(tmp_path / "a.csv"), ["Author"])


def test_arities_follow_references(spark):
    tokens = spark.createDataFrame([("a", "true"), ("b", "nil"), ("c", "false"), ("e", "unresolved"), ("g", "true")], "fq string, token string")
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "gone"), ("g", "h"), ("h", "g")], "fq string, callee string")
    got = {r.fq: r.arity for r in resolve.arities(tokens, refs).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": None, "e": None, "f": 1, "g": 2, "h": 2}


def test_ancestors_end_on_a_cycle(spark):
    rows = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", None), ("X", "Y"), ("Y", "X")], "fq_name string, superclass string")
    got = {(r.fq_name, r.ancestor) for r in resolve.ancestors(rows).collect()}
    assert got == {("A", "B"), ("A", "C"), ("B", "C"), ("X", "Y"), ("Y", "X")}
