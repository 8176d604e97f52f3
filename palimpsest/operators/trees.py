"""Trees as tables of materialised paths `rhs/1/2`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.order import Carried, scan
from palimpsest.sources.store import materialize, tasks_for


def path_key(path: Column) -> Column:
    """Path as an array of numbers; arrays sort in pre-order, parents before children."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("int"))


def path_index(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """All columns plus idx, the pre-order number in the tree, from 1 for its root. Pre-order is the order of the paths' numbers, so it
    is a place along a sort, and a tree may have any number of nodes."""
    rows = scan(nodes.withColumn("k", path_key(F.col("path"))), [tree], ["k"], Carried(sums={"idx": F.lit(1)}))
    return rows.withColumn("idx", (F.col("idx") + 1).cast("long")).drop("k")


def subtree_span(indexed: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, path, last_idx, nodes): the size of each subtree, each node counting for itself and all of its ancestors, whose number is the
    depth; in pre-order a subtree ends as many numbers after its root."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    sizes = indexed.select(tree, F.explode(above).alias("path")).groupBy(tree, "path").agg(F.count("*").alias("nodes"))
    rows = indexed.select(tree, "path", "idx").hint("merge").join(sizes, [tree, "path"])
    return rows.select(tree, "path", (F.col("idx") + F.col("nodes") - 1).alias("last_idx"), "nodes")


def node_faults(nodes: DataFrame) -> DataFrame:
    """(path, reason) of nodes that break their kind's rule."""
    children = nodes.where("path LIKE '%/%'").groupBy(F.regexp_replace("path", "/[0-9]+$", "").alias("path")).agg(F.count("*").alias("children"))
    rows = nodes.hint("merge").join(children, "path", "left").withColumn("depth", F.size(F.split("path", "/"))).fillna(0, ["children"])
    reason = F.expr("case when depth < 4 and children = 0 then 'a choice without a child' when depth = 4 and children > 0 then 'a leaf with a child' when depth = 4 and name like '%7' then 'empty name' end")
    return rows.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def split_alternatives(items: DataFrame) -> DataFrame:
    alts = items.groupBy("lhs", "alt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " ").alias("expr"))
    rules = alts.groupBy("lhs").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt", "expr"))), lambda x: x["expr"]).alias("alternatives"))
    return rules.select("lhs", F.posexplode("alternatives").alias("i", "expr")).select("lhs", F.concat(F.lit("rhs/"), F.col("i") + 1).alias("path"), "expr")


#: A normalised subtree: its kind, how it is written, its parts if it is a sequence or choice, what is in it if it is an optional, and whether
#: it can be empty.
_PART = "struct<written: string, empty: boolean>"
_TREE = f"struct<kind: string, written: string, parts: array<{_PART}>, inner: {_PART}, empty: boolean>"


def _tree(kind: Column, written: Column, parts: Column | None, inner: Column | None, empty: Column) -> Column:
    none = F.lit(None)
    return F.struct(kind.alias("kind"), written.alias("written"), (none if parts is None else parts).alias("parts"), (none if inner is None else inner).alias("inner"), empty.alias("empty")).cast(_TREE)


def _written(parts: Column, mark: str) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: p["written"]), mark), F.lit(")"))


def normalized(nodes: DataFrame, empty_names: DataFrame) -> DataFrame:
    """(tree, path, operation, written): what became of each node of expression trees (tree, path, kind, name, minimum) when nested sequences
    and choices are flattened, repeated choices dropped (the first stays), sequences and choices of one node unwrapped, optionals
    removed around what can be empty, and repeats of an optional made to repeat what is in it, from none on. A node without
    operation is `identity`; a sequence or choice that stays one is flattened, whether or not it had others in it; a child that
    its choice drops is `choice-deduplicate`, beside its own operation. empty_names (name): references that can be empty.

    Trees are rewritten from their deepest nodes up, a round each level, whatever their depth; a round reads the nodes of one level and
    the trees of the level below, which go to their parents by a key of their own, dealt out to as many tasks as nodes need."""
    depth = F.size(F.split("path", "/"))
    rows = nodes.select("tree", "path", "kind", "name", "minimum", depth.alias("depth"))
    rows = materialize(rows, "nodes")
    tasks = tasks_for(rows)
    known = materialize(empty_names.select("name").distinct().withColumn("known", F.lit(True)), "names")
    # Only references are looked up: the nodes that have no name would be a single key.
    refs = rows.where("kind = 'reference'").hint("merge").join(known, "name", "left")
    refs = materialize(refs.select("tree", "path", "kind", "name", "depth", F.coalesce("known", F.lit(False)).alias("known")), "references")
    tokens = rows.where("kind = 'token'").select("tree", "path", "kind", "name", "depth", F.lit(False).alias("known"))
    levels = [r["depth"] for r in rows.select("depth").distinct().orderBy(F.desc("depth")).collect()]
    below, done = None, None
    for level in levels:
        own = rows.where(F.col("depth") == level)
        name = F.when(F.col("kind") == "token", F.concat(F.lit("'"), F.col("name"), F.lit("'"))).otherwise(F.col("name"))
        leaf = _tree(F.col("kind"), name, None, None, F.col("known"))
        leaves = refs.unionByName(tokens).where(F.col("depth") == level).select("tree", "path", F.lit("identity").alias("operation"), leaf.alias("t"), F.lit(None).cast("array<string>").alias("dropped"))
        here = leaves
        if below is not None:
            last = F.element_at(F.split("path", "/"), -1).cast("int")
            children = below.select("tree", F.regexp_replace("path", "/[0-9]+$", "").alias("path"), F.struct(last.alias("n"), F.col("path").alias("at"), "t").alias("c"))
            children = children.repartition(tasks, "tree", "path").groupBy("tree", "path").agg(F.array_sort(F.collect_list("c")).alias("c"))
            inner = own.where("kind NOT IN ('reference', 'token')").repartition(tasks, "tree", "path").hint("merge").join(children, ["tree", "path"])
            here = leaves.unionByName(_rewritten(inner))
        here = materialize(here, "trees")
        log = here.select("tree", "path", "operation", F.col("t.written").alias("written"))
        log = log.unionByName(here.select("tree", F.explode("dropped").alias("path"), F.lit("choice-deduplicate").alias("operation"), F.lit(None).cast("string").alias("written")))
        done = log if done is None else done.unionByName(log)
        below = here
    return done if done is not None else rows.selectExpr("tree", "path", "kind as operation", "name as written").limit(0)


def _rewritten(inner: DataFrame) -> DataFrame:
    """Rows of normalized for nodes with children c, an array of structs of number, path and tree."""
    kind, own = F.col("kind"), lambda c: F.struct(c["t"]["written"].alias("written"), c["t"]["empty"].alias("empty"))

    def spliced(same: str) -> Column:
        """Structs of part and the path of the child that it is or comes from, where it may be dropped."""
        one = lambda c: F.array(F.struct(own(c).alias("part"), c["at"].alias("at")))
        many = lambda c: F.transform(c["t"]["parts"], lambda p: F.struct(p.alias("part"), F.lit(None).cast("string").alias("at")))
        return F.flatten(F.transform("c", lambda c: F.when(c["t"]["kind"] == same, many(c)).otherwise(one(c))))

    rows = inner.withColumn("items", F.when(kind == "sequence", spliced("sequence")).when(kind == "choice", spliced("choice")))
    written = F.transform("items", lambda x: x["part"]["written"])
    rows = rows.withColumn("written", written)
    first = lambda x, i: F.array_position(F.col("written"), x["part"]["written"]) == i + 1
    rows = rows.withColumn("kept", F.when(kind == "choice", F.filter("items", first)).otherwise(F.col("items")))
    lost = F.filter("items", lambda x, i: ~first(x, i) & x["at"].isNotNull())
    rows = rows.withColumn("dropped", F.when(kind == "choice", F.transform(lost, lambda x: x["at"])))
    rows = rows.withColumn("parts", F.transform("kept", lambda x: x["part"])).withColumn("child", F.col("c")[0]["t"])
    # The tree of a lone part: that of the child which is it; a lone part that comes from a flattened child can't be.
    lone = F.filter("c", lambda c: c["t"]["written"] == F.col("parts")[0]["written"])[0]["t"]
    all_empty = F.forall("parts", lambda p: p["empty"])
    any_empty = F.exists("parts", lambda p: p["empty"])
    inside = F.struct(F.col("child.written").alias("written"), F.col("child.empty").alias("empty")).cast(_PART)
    optional = _tree(kind, F.concat(F.lit("["), F.col("child.written"), F.lit("]")), None, inside, F.lit(True))
    bare = F.coalesce(F.col("child.inner"), inside)
    least = F.when(F.col("child.kind") == "optional", 0).otherwise(F.col("minimum"))
    repeat = _tree(kind, F.concat(F.lit("{"), bare["written"], F.lit("}"), least.cast("string")), None, None, (least == 0) | bare["empty"])
    tree = F.when(kind == "optional", F.when(F.col("child.empty"), F.col("child")).otherwise(optional)).when(kind == "repeat", repeat)
    tree = tree.when(F.size("parts") == 1, lone).when(kind == "sequence", _tree(kind, _written(F.col("parts"), " "), F.col("parts"), None, all_empty))
    tree = tree.otherwise(_tree(kind, _written(F.col("parts"), " | "), F.col("parts"), None, any_empty))
    removed = ((kind == "optional") & F.col("child.empty")) | ((kind == "repeat") & (F.col("child.kind") == "optional"))
    operation = F.when(removed, "optional-wrapper-removal").when(kind.isin("optional", "repeat"), "identity")
    operation = operation.otherwise(F.concat(kind, F.when(F.size("parts") == 1, "-collapse").otherwise("-flatten")))
    return rows.select("tree", "path", operation.alias("operation"), tree.alias("t"), "dropped")
