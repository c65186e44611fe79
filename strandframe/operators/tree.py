"""Trees as rows (tree_id, node_id, parent_id, child_ord, name, label, branch_length, is_leaf).

Ancestor relations, paths and sets are DataFrame plans over all trees at once.  What rewrites a tree
(pruning, rooting, consensus) runs once per tree in a grouped task; one tree is one task's size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.schemas import TREE
from ..plans.shared import checkpointed
from ..plans.shipping import ship_package
from . import newick

_FIELDS = [c.split()[0] for c in TREE.split(", ")]


def parse_newick(texts: DataFrame) -> DataFrame:
    """Tree rows of texts(tree_id, newick)."""
    ship_package(texts.sparkSession)

    def run(batches):
        for pdf in batches:
            out = [(t, *r) for t, n in zip(pdf["tree_id"], pdf["newick"]) for r in newick.rows(newick.parse(n))]
            yield pd.DataFrame(out, columns=_FIELDS).astype({"parent_id": "Int64"})

    return texts.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(run, TREE)


def _records(pdf: pd.DataFrame) -> list[tuple]:
    clean = lambda v: None if v is None or v != v else v
    return [
        (int(n), None if clean(p) is None else int(p), int(o), clean(name), clean(label), clean(length), bool(leaf))
        for n, p, o, name, label, length, leaf in zip(pdf["node_id"], pdf["parent_id"], pdf["child_ord"], pdf["name"], pdf["label"], pdf["branch_length"], pdf["is_leaf"])
    ]


def per_tree(nodes: DataFrame, change, schema: str = TREE) -> DataFrame:
    """change(tree_id, root) per tree: a root, None for nothing, or with another schema a list of rows."""
    ship_package(nodes.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = pdf["tree_id"].iloc[0]
        got = change(tree_id, newick.from_rows(_records(pdf)))
        if schema == TREE:
            got = [] if got is None else [(tree_id, *r) for r in newick.rows(got)]
        out = pd.DataFrame(got, columns=names)
        return out.astype({"parent_id": "Int64"}) if schema == TREE else out

    return nodes.groupBy("tree_id").applyInPandas(run, schema)


def to_newick(nodes: DataFrame, digits: int | None = None) -> DataFrame:
    """(tree_id, newick)."""
    return per_tree(nodes, lambda t, root: [(t, newick.write(root, digits))], "tree_id string, newick string")


# ---- relations ------------------------------------------------------------------------------------------


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, anc_id, hops, path_len): every node with its ancestors and itself.

    Pointer doubling: each round joins paths of length up to n with themselves, so a tree of depth d
    takes log2 d rounds, each a shuffle on (tree_id, node)."""
    length = F.coalesce("branch_length", F.lit(0.0))
    self_rows = nodes.select("tree_id", "node_id", F.col("node_id").alias("anc_id"), F.lit(0).alias("hops"), F.lit(0.0).alias("path_len"))
    step = nodes.filter("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("anc_id"), F.lit(1).alias("hops"), length.alias("path_len"))
    known, reach = step, 1
    while True:
        top = known.filter(F.col("hops") == reach).select("tree_id", "node_id", F.col("anc_id").alias("mid"), F.col("hops").alias("h1"), F.col("path_len").alias("l1"))
        rest = known.select("tree_id", F.col("node_id").alias("mid"), "anc_id", F.col("hops").alias("h2"), F.col("path_len").alias("l2"))
        more = top.join(rest, ["tree_id", "mid"]).select("tree_id", "node_id", "anc_id", (F.col("h1") + F.col("h2")).alias("hops"), (F.col("l1") + F.col("l2")).alias("path_len"))
        more = checkpointed(more)
        if more.isEmpty():
            return self_rows.unionByName(known)
        known, reach = known.unionByName(more), reach * 2


def root_to_tip(nodes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, name, distance) of the leaves."""
    c = closure if closure is not None else ancestors(nodes)
    far = c.groupBy("tree_id", "node_id").agg(F.max("hops").alias("hops"), F.max("path_len").alias("distance"))
    return nodes.filter("is_leaf").join(far, ["tree_id", "node_id"]).select("tree_id", "node_id", "name", "distance")


def leaf_sets(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(tree_id, anc_id, leaf): the leaves below every node."""
    leaves = nodes.filter("is_leaf").select("tree_id", "node_id", F.col("name").alias("leaf"))
    return closure.join(leaves, ["tree_id", "node_id"]).select("tree_id", "anc_id", "leaf")


def common_ancestor(nodes: DataFrame, closure: DataFrame, tips: DataFrame) -> DataFrame:
    """(tree_id, anc_id): the deepest node above all tips(tree_id, name) of a tree."""
    own = nodes.filter("is_leaf").join(tips.select("tree_id", "name").distinct(), ["tree_id", "name"]).select("tree_id", "node_id")
    n = own.groupBy("tree_id").agg(F.count("*").alias("n"))
    up = closure.join(own, ["tree_id", "node_id"]).groupBy("tree_id", "anc_id").agg(F.count("*").alias("k"), F.sum("hops").alias("far"))
    w = Window.partitionBy("tree_id").orderBy("far", "anc_id")
    return up.join(n, "tree_id").filter("k = n").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("tree_id", "anc_id")


def monophyletic_ancestors(nodes: DataFrame, closure: DataFrame, targets: DataFrame) -> DataFrame:
    """(tree_id, node_id): maximal clades whose leaves are all targets(name)."""
    below = leaf_sets(nodes, closure).join(targets.select(F.col("name").alias("leaf"), F.lit(True).alias("hit")).distinct(), "leaf", "left")
    pure = below.groupBy("tree_id", "anc_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("pure")).filter("pure").select("tree_id", F.col("anc_id").alias("node_id"))
    up = pure.join(nodes.select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"])
    return up.join(pure.select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"], "left_anti").select("tree_id", "node_id")


def ancestors_of_leaves(nodes: DataFrame, closure: DataFrame, names: DataFrame) -> DataFrame:
    """(tree_id, anc_id): every inner node above given leaves."""
    own = nodes.filter("is_leaf").join(names.select("name").distinct(), "name", "left_semi").select("tree_id", "node_id")
    return closure.join(own, ["tree_id", "node_id"]).filter("hops > 0").select("tree_id", "anc_id").distinct()


def descendants(nodes: DataFrame, closure: DataFrame, node_id: int) -> DataFrame:
    return closure.filter((F.col("anc_id") == node_id) & (F.col("hops") > 0)).select("tree_id", "node_id").join(nodes, ["tree_id", "node_id"])


def bipartition_sets(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(tree_id, split): non-trivial splits as sorted leaf names of the side without the smallest leaf."""
    below = leaf_sets(nodes, closure)
    every = nodes.filter("is_leaf").groupBy("tree_id").agg(F.array_sort(F.collect_list("name")).alias("all"))
    side = below.groupBy("tree_id", "anc_id").agg(F.array_sort(F.collect_list("leaf")).alias("side")).join(every, "tree_id")
    other = F.when(F.array_contains("side", F.get("all", 0)), F.array_except("all", "side")).otherwise(F.col("side"))
    ok = (F.size("side") > 1) & (F.size("side") < F.size("all") - 1)
    return side.filter(ok).select("tree_id", other.alias("split")).distinct()


def rf_distances(nodes: DataFrame) -> DataFrame:
    """(a, b, rf) of all pairs of trees a < b with the same leaves: differing splits over 2 (n - 3).

    Trees with differing leaves need prune_to() first; fewer than four leaves give null."""
    c = ancestors(nodes)
    s = bipartition_sets(nodes, c)
    n = nodes.filter("is_leaf").groupBy("tree_id").agg(F.array_sort(F.collect_list("name")).alias("leaves"))
    k = n.join(s.groupBy("tree_id").agg(F.count("*").alias("k")), "tree_id", "left").select("tree_id", "leaves", F.coalesce("k", F.lit(0)).alias("k"))
    common = s.select(F.col("tree_id").alias("a"), "split").join(s.select(F.col("tree_id").alias("b"), "split"), "split").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    pairs = k.select(F.col("tree_id").alias("a"), F.col("leaves"), F.col("k").alias("ka")).join(k.select(F.col("tree_id").alias("b"), F.col("leaves").alias("lb"), F.col("k").alias("kb")), F.col("a") < F.col("b"))
    x = pairs.join(common, ["a", "b"], "left")
    differ = F.col("ka") + F.col("kb") - 2 * F.coalesce("c", F.lit(0))
    return x.select("a", "b", F.when((F.size("leaves") >= 4) & (F.col("leaves") == F.col("lb")), differ / (2.0 * (F.size("leaves") - 3))).alias("rf"))


def discordance(rf: DataFrame) -> DataFrame:
    """(tree_id, mean_rf, median_rf, max_rf) over a tree's distances to the others, nulls skipped."""
    both = rf.select(F.col("a").alias("tree_id"), "rf").unionByName(rf.select(F.col("b").alias("tree_id"), "rf"))
    return both.groupBy("tree_id").agg(F.avg("rf").alias("mean_rf"), F.median("rf").alias("median_rf"), F.max("rf").alias("max_rf"))


def id_agreement(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(tips, ids, only_tips, only_ids): counts and both differences of leaf names and sequence ids."""
    t = nodes.filter("is_leaf").select(F.col("name").alias("id")).distinct().withColumn("t", F.lit(True))
    s = sequences.select(F.col("seq_id").alias("id")).distinct().withColumn("s", F.lit(True))
    x = t.join(s, "id", "full_outer")
    return x.agg(
        F.count("t").alias("tips"), F.count("s").alias("ids"),
        F.array_sort(F.collect_list(F.when(F.col("s").isNull(), F.col("id")))).alias("only_tips"), F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.col("id")))).alias("only_ids"),
    )


def sequences_of_tips(sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    return sequences.join(nodes.filter("is_leaf").select(F.col("name").alias("seq_id")), "seq_id", "left_semi")


def relative_rates(gene_tips: DataFrame, species_tips: DataFrame, accession: Column) -> DataFrame:
    """Gene root-to-tip distance over the species' of the same accession."""
    g = gene_tips.select("name", F.col("distance").alias("gene_distance"), accession.alias("accession"))
    s = species_tips.select(F.col("name").alias("accession"), F.col("distance").alias("species_distance"))
    return g.join(s, "accession", "left").withColumn("relative_rate", F.try_divide("gene_distance", "species_distance"))


def rename_tips(nodes: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """Leaves renamed by names(name, new_name); a leaf without one is an error, or with strict false keeps its own."""
    if strict:
        lost = nodes.filter("is_leaf").join(names, "name", "left_anti").select("name").limit(3).collect()
        if lost:
            raise ValueError(f"no new name for {[r[0] for r in lost]}")
    x = nodes.join(names.select("name", "new_name"), "name", "left")
    return x.withColumn("name", F.when(F.col("is_leaf"), F.coalesce("new_name", "name"))).select(*nodes.columns)


def safe_names(ids: DataFrame) -> DataFrame:
    """(name, new_name): T000001 and so on in the order of ids."""
    x = numbered(ids.select("name").distinct(), [F.col("name")])
    n = F.col("nth").cast("string")
    return x.select("name", F.concat(F.lit("T"), F.when(F.length(n) < 6, F.lpad(n, 6, "0")).otherwise(n)).alias("new_name"))


def reverse_children(nodes: DataFrame, names: list[str]) -> DataFrame:
    """child_ord mirrored under the named nodes."""
    hit = nodes.filter(F.coalesce("name", "label").isin(names)).select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_hit"))
    x = nodes.join(hit, ["tree_id", "parent_id"], "left").withColumn("_top", F.max("child_ord").over(Window.partitionBy("tree_id", "parent_id")))
    return x.withColumn("child_ord", F.when(F.col("_hit"), F.col("_top") - F.col("child_ord")).otherwise(F.col("child_ord"))).select(*nodes.columns)


# ---- support labels -------------------------------------------------------------------------------------


def branch_support(label) -> Column:
    """struct<alrt, ufboot> of an 'alrt/ufboot' label, null where it isn't one."""
    c = F.col(label) if isinstance(label, str) else label
    part = lambda i: F.regexp_extract(c, r"^\s*([0-9.eE+-]+)\s*/\s*([0-9.eE+-]+)\s*$", i).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("alrt"), part(2).alias("ufboot")))


def local_posterior(label) -> Column:
    """The pp1 value of a species-tree label."""
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_extract(c, r"pp1=([0-9.eE+-]+)", 1).try_cast("double")


def percent_label(value: Column, digits: int = 0) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value * 100))


def support_of(text: str | None) -> tuple[float, float] | None:
    try:
        a, b = (text or "").split("/")
        return float(a), float(b)
    except ValueError:
        return None


# ---- rewriting ------------------------------------------------------------------------------------------


def prune_to(nodes: DataFrame, keep: set[str]) -> DataFrame:
    return per_tree(nodes, lambda t, root: newick.prune(root, keep))


def prune_to_sequences(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Trees of the leaves that are sequence ids; the two meet in a join, no id list is collected."""
    hit = nodes.join(sequences.select(F.col("seq_id").alias("name"), F.lit(True).alias("_hit")).distinct(), "name", "left")
    marked = hit.withColumn("label", F.when(F.col("is_leaf"), F.when(F.col("_hit"), F.lit("keep")).otherwise("drop")).otherwise(F.col("label")))
    ship_package(nodes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = set(pdf.loc[pdf["is_leaf"] & (pdf["label"] == "keep"), "name"])
        pdf.loc[pdf["is_leaf"], "label"] = None
        got = newick.prune(newick.from_rows(_records(pdf)), keep)
        tree_id = pdf["tree_id"].iloc[0]
        return pd.DataFrame([] if got is None else [(tree_id, *r) for r in newick.rows(got)], columns=_FIELDS).astype({"parent_id": "Int64"})

    return marked.select(*nodes.columns).groupBy("tree_id").applyInPandas(run, TREE)


def resolve(nodes: DataFrame, length: float = 0.0, seed: int | None = None, trifurcate_root: bool = False) -> DataFrame:
    return per_tree(nodes, lambda t, root: newick.resolve_polytomies(root, length, seed, trifurcate_root))


def collapse_weak(nodes: DataFrame, least_alrt: float = 80.0, least_ufboot: float = 95.0) -> DataFrame:
    """Trees without the inner branches that miss a support threshold or have no support label."""

    def weak(x) -> bool:
        s = support_of(x.name)
        return s is None or s[0] < least_alrt or s[1] < least_ufboot

    def change(t, root):
        newick.collapse(root, weak)
        return root

    return per_tree(nodes, change)


def collapse_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tree_id, inner_before, inner_after, retained_percent), best first."""
    n = lambda d, c: d.filter("not is_leaf and parent_id is not null").groupBy("tree_id").agg(F.count("*").alias(c))
    x = before.select("tree_id").distinct().join(n(before, "inner_before"), "tree_id", "left").join(n(after, "inner_after"), "tree_id", "left").na.fill(0)
    return x.withColumn("retained_percent", F.try_divide(100.0 * F.col("inner_after"), F.col("inner_before"))).orderBy(F.col("retained_percent").desc_nulls_last(), "tree_id")


def root_on_outgroup(nodes: DataFrame, outgroup: set[str]) -> DataFrame:
    return per_tree(nodes, lambda t, root: newick.root_on_outgroup(root, outgroup))


def consensus(nodes: DataFrame, least: float = 0.5, group: str = "consensus") -> DataFrame:
    """One majority consensus tree of all trees on their common leaves.  Trees travel as text; a group is one task."""
    ship_package(nodes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = newick.majority_consensus([newick.parse(t) for t in pdf.sort_values("tree_id")["newick"]], least)
        return pd.DataFrame([] if got is None else [(group, *r) for r in newick.rows(got)], columns=_FIELDS).astype({"parent_id": "Int64"})

    return to_newick(nodes).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, TREE)


def reconciliation(genes: DataFrame, species_newick: str, gene_to_species: dict[str, str], loss_cost: float = 1.0, duplication_cost: float = 1.0) -> DataFrame:
    """(tree_id, edge, duplications, losses, cost, optimal): every rooting of each gene tree, all best ones marked."""

    def change(t, root):
        text = newick.write(root)
        out = []
        for i in range(1, len(list(root.walk()))):
            tree = newick.parse(text)
            tree = newick.reroot_above(tree, list(tree.walk())[i])
            d, lost = newick.reconcile(newick.resolve_polytomies(tree), newick.parse(species_newick), gene_to_species.__getitem__)
            out.append((t, i, d, lost, d * duplication_cost + lost * loss_cost))
        return out

    x = per_tree(genes, change, "tree_id string, edge int, duplications int, losses int, cost double")
    return x.withColumn("optimal", F.rank().over(Window.partitionBy("tree_id").orderBy("cost")) == 1)


def layout(nodes: DataFrame, spacing: float = 1.3, unit: bool = False) -> DataFrame:
    """(tree_id, node_id, x, y) for drawing."""

    def change(t, root):
        at = newick.coordinates(root, spacing, unit)
        return [(t, i, *at[id(x)]) for i, x in enumerate(root.walk())]

    return per_tree(nodes, change, "tree_id string, node_id int, x double, y double")


def foreground_labelled(nodes: DataFrame, tips: set[str], label: str = "#1") -> DataFrame:
    return per_tree(nodes, lambda t, root: newick.label_foreground(root, tips, label))
