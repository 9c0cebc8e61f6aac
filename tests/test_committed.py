from __future__ import annotations

import json
import os

import pytest

from graphloom.sources import committed
from graphloom.sources.views import view

DIR = "/root/testdata/sf0.001"


def lay_out(docs, root, tree=".graph"):
    for r in docs.collect():
        path = os.path.join(root, r.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(r.text)
    with open(os.path.join(root, "aggregate.json"), "w") as f:
        f.write(committed.aggregate_text(docs, tree).first().value)


@pytest.mark.parametrize("limit", [64 * 1024, 3000, 300])
def test_round_trip_in_every_mode(spark, tmp_path, limit):
    nodes = view(spark, DIR, "mx_nodes").where("symbol <> 'P9'").selectExpr("*", "concat('K', CAST(substr(symbol, 2) AS INT) % 3) AS klass", "CAST(branches AS DOUBLE) / 3 AS score")
    nodes = nodes.selectExpr("* EXCEPT (file)", "concat('lib/', substr(file, 1, 2), '.rb') AS file")
    edges = view(spark, DIR, "mx_edges").where("`from` <> 'P9'")
    docs = committed.documents(nodes, edges, ".graph", limit).cache()
    modes = {r.shard_mode for r in docs.select("shard_mode").distinct().collect()}
    assert modes == {"single"} if limit == 64 * 1024 else ("per_class" in modes if limit == 3000 else "per_method" in modes)
    for r in docs.limit(20).collect():
        d = json.loads(r.text)
        assert list(d) == sorted(d) and all(list(n) == sorted(n) for n in d["nodes"]) and (r.text.endswith("}\n"))
    lay_out(docs, tmp_path)
    got = committed.read(spark, str(tmp_path), "aggregate.json", (".graph/", "graph/"))
    cols = ["file", "symbol", "klass", "branches", "outcome_arity", "escapes", "toll_booth", "entrypoint", "entrypoint_kind", "kind"]
    assert sorted(map(repr, got.nodes.select(*cols).collect())) == sorted(map(repr, nodes.select(*cols).collect()))
    assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, edges.select("from", "to", "calls").collect()))
    assert got.corrupt.isEmpty()


def test_only_pointed_files_are_opened(spark, tmp_path):
    tree = tmp_path / "graph" / "lib"  # exported without the dot
    os.makedirs(tree / "wide.rb" / "K")
    one = {"edges": [{"calls": 1, "from": "A#x", "to": "B#y"}], "file": "lib/a.rb", "nodes": [{"symbol": "A#x", "branches": 2, "escapes": None}, {"kind": "function"}], "serializer_version": 5}
    (tree / "a.rb.json").write_text(json.dumps(one))
    (tree / "wide.rb" / "K.json").write_text(json.dumps({"nodes": [{"symbol": "K#a"}], "edges": []}))
    (tree / "wide.rb" / "K" / "b.json").write_text(json.dumps({"nodes": [{"symbol": "K#b"}], "edges": []}))
    (tree / "broken.rb.json").write_text('{"nodes": [{"symb')
    (tree / "stray.rb.json").write_text("not even read")
    os.chmod(tree / "stray.rb.json", 0)
    os.symlink("/nowhere/at/all", tree / "dangling.rb.json")
    sources = {f"lib/{n}.rb": {"path": f".graph/lib/{n}.rb" + (".json" if n != "wide" else ""), "shard_mode": "single" if n != "wide" else "per_method"} for n in ("a", "wide", "broken", "gone")}
    (tmp_path / "aggregate.json").write_text(json.dumps({"serializer_version": 5, "sources": sources}, indent=1))
    got = committed.read(spark, str(tmp_path), "aggregate.json", (".graph/", "graph/"))
    assert {(r.file, r.symbol, r.branches, tuple(r.keys_present)) for r in got.nodes.collect()} == {
        ("lib/a.rb", "A#x", 2, ("branches", "escapes", "symbol")), ("lib/wide.rb", "K#a", None, ("symbol",)), ("lib/wide.rb", "K#b", None, ("symbol",)),
    }
    assert {r.file for r in got.corrupt.collect()} == {"lib/broken.rb", "lib/gone.rb"} and got.edges.count() == 1
