"""Facts about source code, resolved as tables: ordered type bindings, probes, route catalogues, root seeders.

Probes and seeders are functions in a registry, tried in its order; a caller adds its own with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_counting
from .graph import spread
from .resolve import first_tier

# ---------------------------------------------------------------- type bindings


def bindings(writes: DataFrame) -> DataFrame:
    """scope, name, pos, fq: what is known of a variable after each of ``writes(scope, name, pos, fq)``, null where nothing is.

    Writes count in their order. One without a type, or with another type than the one that holds, drops the binding; a write onto nothing sets it. So
    a run of equal writes ends bound unless it is a single write onto another type, and whether a binding holds follows from how many
    such single writes stand in a row: windows count them, and nothing is folded write by write.
    """
    by = Window.partitionBy("scope", "name").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    w = writes.select("scope", "name", "pos", "fq")
    begins = F.coalesce(~F.col("fq").eqNullSafe(F.lag("fq").over(by)), F.lit(True)) | (F.row_number().over(by) == 1)
    w = w.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(so_far))
    run = Window.partitionBy("scope", "name", "_run")
    w = w.withColumn("_nth", F.row_number().over(run.orderBy("pos"))).withColumn("_length", F.count("*").over(run))
    # rows that begin a run: does the run end bound whatever was before (2), unbound (0), or the other way round (1)?
    ends = F.when(F.col("fq").isNull(), 0).when(F.col("_length") > 1, 2).otherwise(1)
    first = w.where("_begins = 1").withColumn("_ends", ends).withColumn("_block", F.sum(F.when(F.col("_ends") != 1, 1).otherwise(0)).over(so_far))
    block = Window.partitionBy("scope", "name", "_block").orderBy("pos")
    turns = F.sum(F.when(F.col("_ends") == 1, 1).otherwise(0)).over(block.rowsBetween(Window.unboundedPreceding, 0))
    anchor = F.first("_ends").over(block.rowsBetween(Window.unboundedPreceding, 0)) == 2  # a block without an anchor begins unbound
    first = first.withColumn("_bound", (anchor.cast("int") + turns) % 2 == 1)
    first = first.withColumn("_before", F.coalesce(F.lag("_bound").over(by), F.lit(False)))
    state = w.join(first.select("scope", "name", "_run", "_before"), ["scope", "name", "_run"])
    held = F.col("fq").isNotNull() & (~F.col("_before") | (F.col("_nth") > 1))
    return state.select("scope", "name", "pos", F.when(held, F.col("fq")).alias("fq"))


def types_at(reads: DataFrame, bound: DataFrame) -> DataFrame:
    """``reads(site_id, scope, name, pos)`` with ``fq``, the binding that holds just before ``pos``; null if none does."""
    rows = bound.select("scope", "name", "pos", "fq", F.lit(None).cast(reads.schema["site_id"].dataType).alias("site_id"), F.lit(1).alias("_read")).withColumn("_read", F.lit(0))
    asked = reads.select("scope", "name", "pos", F.lit(None).cast("string").alias("fq"), "site_id", F.lit(1).alias("_read"))
    # a read at the place of a write comes before it
    by = Window.partitionBy("scope", "name").orderBy("pos", F.desc("_read")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_read") == 0, F.struct("fq")), ignorenulls=True).over(by)
    return rows.unionByName(asked).withColumn("_last", last).where("_read = 1").select("site_id", "scope", "name", "pos", F.col("_last.fq").alias("fq"))


def receivers(local: DataFrame, ivar: DataFrame, accessor: DataFrame) -> DataFrame:
    """site_id, fq: the type of a receiver by ``(site_id, fq)`` of local variables, instance variables and accessors, the first that knows one."""
    every = [df.select("site_id", F.lit(k).alias("k"), "fq").where("fq is not null") for k, df in enumerate((local, ivar, accessor))]
    best = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("site_id").agg(F.min(F.struct("k", "fq")).alias("m"))
    return best.select("site_id", F.col("m.fq").alias("fq"))


# ---------------------------------------------------------------- probes

#: Fixed vocabularies.
VERBS = ("get", "post", "put", "patch", "delete")
DISPATCH = ("perform_async", "perform_later", "perform_in", "perform_at")
META = ("send", "public_send", "__send__", "try", "try!")
HTTP_CONSTANTS = ("Faraday", "Net::HTTP", "HTTParty", "RestClient", "Typhoeus", "HTTP", "Excon")
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "request", "start", "open", "new")
JOB_MIXINS = ("Sidekiq::Job", "Sidekiq::Worker")
JOB_BASES = ("Sidekiq::Worker", "ApplicationJob", "ActiveJob::Base")
PERFORM = ("perform", "perform_now", "perform_async", "perform_later", "perform_inline")


@dataclass
class Facts:
    """sites(site_id, name, constant, typed, enclosing, literal, mounted), classes(fq_name, superclass, api), methods(fq).

    constant is the receiver if it is one, typed its type if it is a variable that has one, enclosing the class of the caller where the receiver is
    self or missing, literal the first argument if it is a name, mounted if it is a constant.
    """

    sites: DataFrame
    classes: DataFrame
    methods: DataFrame

    def existing(self, candidates: DataFrame) -> DataFrame:
        """The first of ``candidates(site_id, rank, target)`` of each site that is a method: site_id, target."""
        found = candidates.join(self.methods.select(F.col("fq").alias("target")).distinct(), "target", "left_semi")
        return found.groupBy("site_id").agg(F.min(F.struct("rank", "target")).alias("m")).select("site_id", "m.target")


Probe = Callable[[Facts], DataFrame]
_probes: list[tuple[str, Probe]] = []


def register(name: str, before: str | None = None):
    """Add a probe (facts -> site_id, target) under a name, at the end or before another one."""

    def add(f: Probe) -> Probe:
        names = [n for n, _ in _probes]
        if name in names:
            raise ValueError(f"there is a probe {name} already")
        _probes.insert(names.index(before) if before else len(names), (name, f))
        return f

    return add


def unregister(name: str) -> None:
    _probes[:] = [p for p in _probes if p[0] != name]


def probe(facts: Facts, chosen: list[str] | None = None) -> DataFrame:
    """site_id, target, provenance: the answer of the first probe that has one, in the registry's order; null where none has."""
    return first_tier(facts.sites, [(name, f(facts)) for name, f in _probes if chosen is None or name in chosen])


@register("grape")
def mounted_api(facts: Facts) -> DataFrame:
    """mount of an API class: its first endpoint by verb."""
    api = facts.classes.where("api").select(F.col("fq_name").alias("mounted")).distinct()
    verbs = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(v.upper()).alias("verb")) for k, v in enumerate(VERBS)))).alias("v")
    rows = facts.sites.where("name = 'mount'").join(api, "mounted", "left_semi").select("site_id", "mounted", verbs)
    return facts.existing(rows.select("site_id", "v.rank", F.concat("mounted", F.lit("#"), "v.verb", F.lit("[0]")).alias("target")))


@register("sidekiq_dispatch")
def dispatched_job(facts: Facts) -> DataFrame:
    """An asynchronous dispatch to a constant: its perform."""
    rows = facts.sites.where(F.col("name").isin(*DISPATCH) & F.col("constant").isNotNull())
    return facts.existing(rows.select("site_id", F.lit(0).alias("rank"), F.concat("constant", F.lit("#perform")).alias("target")))


@register("meta_send")
def literal_send(facts: Facts) -> DataFrame:
    """A send with a literal name: the method itself, of the instance first."""
    on = F.coalesce("constant", "typed", "enclosing")
    rows = facts.sites.where(F.col("name").isin(*META) & F.col("literal").isNotNull() & on.isNotNull())
    forms = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.concat(on, F.lit(s), F.col("literal")).alias("target")) for k, s in enumerate("#.")))).alias("f")
    return facts.existing(rows.select("site_id", forms).select("site_id", "f.rank", "f.target"))


def egress(facts: Facts) -> DataFrame:
    """site_id, category, target: calls to constants that are no class here: http, queue or gem."""
    rows = facts.sites.where("constant is not null").join(facts.classes.select(F.col("fq_name").alias("constant")).distinct(), "constant", "left_anti")
    http = (F.col("constant").isin(*HTTP_CONSTANTS) | F.startswith("constant", F.lit("Aws::"))) & F.col("name").isin(*HTTP_VERBS)
    category = F.when(http, "http").when(F.col("name").isin(*DISPATCH), "queue").otherwise("gem")
    return rows.select("site_id", category.alias("category"), F.regexp_replace(F.regexp_replace("constant", r"\s+", ""), "^::", "").alias("target"))


@register("egress")
def egress_sink(facts: Facts) -> DataFrame:
    return egress(facts).select("site_id", F.concat(F.lit("<external:"), "category", F.lit(":"), "target", F.lit(">")).alias("target"))


# ---------------------------------------------------------------- routes

#: Fixed lists.
RESOURCES = ("index", "show", "new", "create", "edit", "update", "destroy")
RESOURCE = RESOURCES[1:]


def camelize(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 10_000)))), "")


def namespaces(statements: DataFrame, max_depth: int = 100) -> DataFrame:
    """``statements(file, open, close, kind, name, ...)`` other than namespaces, with ``path``, the names of the namespaces around each; one inside a
    namespace without a fixed name is left out.

    A statement covers its places from open to close; statements lie inside one another or apart. Levels are running sums over a file's
    places, the innermost namespace around a place is the last one a level above, and paths grow by a join a level.
    """
    space = F.col("kind").isin("namespace", "scope")
    up = statements.select("file", F.col("open").alias("at"), F.when(space, 1).otherwise(0).alias("step"), "open", space.alias("space"))
    down = statements.where(space).select("file", F.col("close").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("open"), F.lit(False).alias("space"))
    run = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    levels = up.unionByName(down).withColumn("level", F.sum("step").over(run) - F.col("step")).where("open is not null")  # namespaces around it
    # of the namespaces a level above that begin earlier, the last is the one around it
    above = levels.where("space").select("file", "open", (F.col("level") + 1).alias("level"), F.col("open").alias("of")).withColumn("inner", F.lit(False))
    both = above.unionByName(levels.select("file", "open", "level", F.lit(None).cast("long").alias("of"), F.lit(True).alias("inner")))
    last = F.last("of", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("open", F.desc("inner")).rowsBetween(Window.unboundedPreceding, 0))
    parents = both.withColumn("parent", last).where("inner").select("file", "open", F.when(F.col("level") > 0, F.col("parent")).alias("parent"))
    named = statements.where(space).select("file", F.col("open").alias("up"), F.col("name").alias("segment")).join(parents.select("file", F.col("open").alias("up"), F.col("parent").alias("next")), ["file", "up"])
    rows = statements.where(~space).join(parents, ["file", "open"]).withColumn("path", F.array().cast("array<string>"))
    for _ in range(max_depth):
        step = rows.withColumnRenamed("parent", "up").join(named, ["file", "up"], "left").where("up is null or segment is not null")
        path = F.when(F.col("up").isNotNull(), F.concat(F.array("segment"), "path")).otherwise(F.col("path"))
        rows, n = cut_counting(step.withColumn("path", path).withColumnRenamed("next", "parent").drop("up", "segment"), F.col("parent").isNotNull())
        if not n:
            return rows.drop("parent")
    raise RuntimeError("the namespaces are nested too deep")


def routes(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """controller, action: what a catalogue of routes calls, as far as such methods exist; each once.

    Statements of kind to (``to``: 'controller#action'), resources and resource (``name``, arrays ``only`` or else ``except``), inside namespaces.
    """
    rows = namespaces(statements)
    base = F.array(*map(F.lit, RESOURCES))
    every = F.when(F.col("kind") == "resources", base).when(F.col("kind") == "resource", F.array(*map(F.lit, RESOURCE)))
    kept = F.when(F.col("only").isNotNull(), F.array_intersect(every, "only")).when(F.col("except").isNotNull(), F.array_except(every, "except")).otherwise(every)
    parts = F.split("to", "#", 2)
    explicit = (F.col("kind") == "to") & (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "")
    actions = F.when(explicit, F.array(F.get(parts, F.lit(1)))).otherwise(kept)
    named = F.when(explicit, F.get(parts, F.lit(0))).otherwise(F.col("name"))
    segments = F.concat("path", F.split(named, "/"))
    controller = F.concat(F.array_join(F.transform(segments, camelize), "::"), F.lit("Controller"))
    found = rows.where(actions.isNotNull() & named.isNotNull()).select(controller.alias("controller"), F.explode(actions).alias("action")).distinct()
    have = methods.select("fq").distinct()
    return found.join(have, F.concat("controller", F.lit("#"), "action") == F.col("fq"), "left_semi")


# ---------------------------------------------------------------- root seeders


@dataclass
class Evidence:
    """classes(fq_name, superclass), mixins(fq_name, module), methods(fq), call_env(fq_name), app_ivar(fq_name), registered(name), schedule(kind, target)."""

    classes: DataFrame
    mixins: DataFrame
    methods: DataFrame
    call_env: DataFrame
    app_ivar: DataFrame
    registered: DataFrame
    schedule: DataFrame

    def having(self, classes: DataFrame, method: str) -> DataFrame:
        """fq of ``method`` in those of ``classes(fq_name)`` that have it."""
        fq = classes.select(F.concat("fq_name", F.lit(method)).alias("fq")).distinct()
        return fq.join(self.methods.select("fq").distinct(), "fq", "left_semi")


def job_roots(e: Evidence) -> DataFrame:
    """perform of classes that mix in or extend a job, themselves or by an ancestor: the mark goes down the chains from where it stands."""
    marked = e.mixins.where(F.col("module").isin(*JOB_MIXINS)).select("fq_name").union(e.classes.where(F.col("superclass").isin(*JOB_BASES)).select("fq_name"))
    down = e.classes.where("superclass is not null").select(F.col("superclass").alias("a"), F.col("fq_name").alias("b")).distinct()
    below = spread(down, marked.withColumnRenamed("fq_name", "symbol"))
    known = below.withColumnRenamed("symbol", "fq_name").join(e.classes.select("fq_name").distinct(), "fq_name", "left_semi")
    return e.having(known, "#perform")


def middleware_roots(e: Evidence) -> DataFrame:
    """call of classes that define call(env), keep the app and are registered by their whole or their last name."""
    both = e.call_env.select("fq_name").intersect(e.app_ivar.select("fq_name"))
    name = e.registered.select("name").distinct()
    last = F.element_at(F.split("fq_name", "::"), -1)
    met = both.join(name, F.col("name") == F.col("fq_name"), "left_semi").union(both.join(name, F.col("name") == last, "left_semi"))
    return e.having(met, "#call")


#: Seeders in the order in which their marks count.
SEEDERS: dict[str, Callable[[Evidence], DataFrame]] = {"jobs": job_roots, "middleware": middleware_roots}


def seeded(e: Evidence, seeders: dict[str, Callable[[Evidence], DataFrame]] | None = None) -> DataFrame:
    """fq, category: methods that a seeder marks; the first seeder wins."""
    out = None
    for rank, (name, f) in enumerate((seeders or SEEDERS).items()):
        rows = f(e).select("fq", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("category")).alias("m"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("fq").agg(F.min("m").alias("m")).select("fq", "m.category")


def cron_links(e: Evidence, marked: DataFrame) -> DataFrame:
    """entry, fq: scheduled entries and the marked methods they run, null where none is. Kinds: class, rake (all tasks of the name), runner.

    A runner is 'Const.method' with a method that performs a job; other entries are declined.
    """
    call = F.split("target", r"\.", 2)
    const = F.when(F.col("kind") == "class", F.col("target")).when((F.col("kind") == "runner") & F.get(call, F.lit(1)).isin(*PERFORM), F.get(call, F.lit(0)))
    rows = e.schedule.select(F.concat("kind", F.lit(":"), "target").alias("entry"), "kind", F.coalesce(F.concat(const, F.lit("#perform")), F.when(F.col("kind") == "rake", F.concat(F.lit("rake:"), "target"))).alias("key")).distinct()
    task = marked.select("fq", F.regexp_replace("fq", r"^(rake:.*)\[\d+\]$", "$1").alias("key"))  # a task by its name, any other by itself
    return rows.join(task, "key", "left").select("entry", "fq")
