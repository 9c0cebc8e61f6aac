from __future__ import annotations

import random

import pytest

from graphloom.operators import capture


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_bindings_are_the_fold_of_the_writes(spark, seed):
    rng = random.Random(seed)
    writes, want = [], {}
    for scope in range(40):
        state = None
        for pos in range(rng.randrange(30)):
            fq = rng.choice([None, "A", "A", "B", "C"])
            writes.append((f"s{scope}", "x", 10 * pos, fq))
            state = None if fq is None or state not in (None, fq) else fq
            want[f"s{scope}", "x", 10 * pos] = state
    df = spark.createDataFrame(writes, "scope string, name string, pos long, fq string")
    bound = capture.bindings(df)
    assert {(r.scope, r.name, r.pos): r.fq for r in bound.collect()} == want
    reads = spark.createDataFrame([(f"{s}@{p}", s, "x", p) for s in ("s0", "s1", "nowhere") for p in range(0, 300, 5)], "site_id string, scope string, name string, pos long")
    got = {r.site_id: r.fq for r in capture.types_at(reads, bound).collect()}
    for s in ("s0", "s1", "nowhere"):
        for p in range(0, 300, 5):
            before = [q for (t, _, q) in want if t == s and q < p]
            assert got[f"{s}@{p}"] == (want[s, "x", max(before)] if before else None)


def facts(spark):
    sites = [
        (1, "mount", None, None, None, None, "Api"), (2, "mount", None, None, None, None, "Plain"), (3, "perform_async", "Job", None, None, None, None), (4, "perform_later", "Gone", None, None, None, None),
        (5, "send", None, "Job", "Api", "run", None), (6, "send", None, None, "Api", "build", None), (7, "send", None, None, "Api", None, None), (8, "get", "Net::HTTP", None, None, None, None),
        (9, "get", "::Some :: Gem", None, None, None, None), (10, "get", "Job", None, None, None, None), (11, "put_object", "Aws::S3", None, None, None, None),
    ]
    return capture.Facts(
        spark.createDataFrame(sites, "site_id int, name string, constant string, typed string, enclosing string, literal string, mounted string"),
        spark.createDataFrame([("Api", "Grape::API", True), ("Plain", None, False), ("Job", None, False)], "fq_name string, superclass string, api boolean"),
        spark.createDataFrame([("Api#DELETE[0]",), ("Api#PUT[0]",), ("Job#perform",), ("Job#run",), ("Job.run",), ("Api.build",), ("Plain#GET[0]",)], "fq string"),
    )


def test_probes_in_their_order(spark):
    want = {
        1: ("Api#PUT[0]", "grape"), 2: (None, None), 3: ("Job#perform", "sidekiq_dispatch"), 4: ("<external:queue:Gone>", "egress"), 5: ("Job#run", "meta_send"), 6: ("Api.build", "meta_send"), 7: (None, None),
        8: ("<external:http:Net::HTTP>", "egress"), 9: ("<external:gem:Some::Gem>", "egress"), 10: (None, None), 11: ("<external:gem:Aws::S3>", "egress"),
    }
    assert {r.site_id: (r.target, r.provenance) for r in capture.probe(facts(spark)).collect()} == want

    @capture.register("mine", before="sidekiq_dispatch")
    def mine(f):
        return f.sites.where("constant = 'Job'").selectExpr("site_id", "'mine!' AS target")

    try:
        got = {r.site_id: r.provenance for r in capture.probe(facts(spark)).collect()}
        assert got[3] == got[10] == "mine" and got[1] == "grape"
        with pytest.raises(ValueError):
            capture.register("mine")(mine)
        assert {r.provenance for r in capture.probe(facts(spark), ["egress"]).collect()} == {"egress", None}
    finally:
        capture.unregister("mine")


def test_routes_in_nested_namespaces(spark):
    s = "file string, open long, close long, kind string, name string, to string, only array<string>, except array<string>"
    rows = [
        ("r", 0, 100, "namespace", "api", None, None, None), ("r", 10, 50, "scope", "v_one", None, None, None), ("r", 20, 25, "resources", "user_items", None, ["show", "made_up"], ["show"]),
        ("r", 30, 35, "to", None, "admin/users#show", None, None), ("r", 60, 65, "resource", "account", None, None, ["show"]), ("r", 70, 90, "namespace", None, None, None, None), ("r", 75, 80, "to", None, "lost#show", None, None),
        ("r", 110, 115, "to", None, "nothing", None, None), ("r", 120, 125, "to", None, "home#", None, None), ("r", 130, 135, "to", None, "home#index", None, None), ("r", 140, 145, "to", None, "gone#index", None, None),
        ("q", 0, 5, "resources", "users", None, None, None),
    ]
    methods = ["Api::VOne::UserItemsController#show", "Api::VOne::UserItemsController#index", "Api::VOne::Admin::UsersController#show", "Api::AccountController#show", "Api::AccountController#edit", "Api::AccountController#index", "Api::LostController#show", "HomeController#index", "UsersController#destroy"]
    got = capture.routes(spark.createDataFrame(rows, s), spark.createDataFrame([(m,) for m in methods], "fq string"))
    want = [("Api::AccountController", "edit"), ("Api::VOne::Admin::UsersController", "show"), ("Api::VOne::UserItemsController", "show"), ("HomeController", "index"), ("UsersController", "destroy")]
    assert rows_of(got) == want
    assert capture.routes(spark.createDataFrame([], s), spark.createDataFrame([("a",)], "fq string")).count() == 0


def test_seeders(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = capture.Evidence(
        frame([("Base", "ApplicationJob"), ("Child", "Base"), ("Mixed", None), ("Below", "Mixed"), ("Other", "Base2"), ("A::Ware", None), ("Ring", "Rang"), ("Rang", "Ring")], "fq_name string, superclass string"),
        frame([("Mixed", "Sidekiq::Job"), ("Other", "Comparable")], "fq_name string, module string"),
        frame([("Child#perform",), ("Below#perform",), ("Other#perform",), ("A::Ware#call",), ("Base#call",)], "fq string"),
        frame([("A::Ware",), ("Base",)], "fq_name string"), frame([("A::Ware",), ("Base",)], "fq_name string"), frame([("Ware",)], "name string"),
        frame([("class", "Child"), ("class", "Gone"), ("rake", "db:clean"), ("runner", "Below.perform_now"), ("runner", "Below.other"), ("runner", "nonsense")], "kind string, target string"),
    )
    marked = capture.seeded(e)
    assert rows_of(marked) == [("A::Ware#call", "middleware"), ("Below#perform", "jobs"), ("Child#perform", "jobs")]
    tasks = frame([("rake:db:clean[0]",), ("rake:db:clean[1]",), ("rake:db:cleaner[0]",)], "fq string")
    links = {(r.entry, r.fq) for r in capture.cron_links(e, marked.select("fq").union(tasks)).collect()}
    assert links == {
        ("class:Child", "Child#perform"), ("class:Gone", None), ("rake:db:clean", "rake:db:clean[0]"), ("rake:db:clean", "rake:db:clean[1]"), ("runner:Below.perform_now", "Below#perform"), ("runner:Below.other", None), ("runner:nonsense", None),
    }
