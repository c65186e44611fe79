"""More operators on the driver's tables: relations that files don't enter, closed forms of the special functions, trees that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import maths, sequence
from .operators import expression, genome, information, kmers, plotdata, tables, tree
from .plans.session import rounded
from .plans.shared import fresh
from .queries import _GENES, _STATUS, _long, _six, line_counts, order_genes, place_tree, query, status_matrix, table
from .streaming import events as streams

# ---- joins, sets, order -----------------------------------------------------------------------------------------


@query("select o_orderkey as k from orders where o_custkey in (select c_custkey from customer where c_custkey % 9 > 3)")
def sequences_of_tips(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.format_string("Customer#%09d", "o_custkey").alias("seq_id"))
    return tree.sequences_of_tips(s, place_tree(spark, d).filter("branch_length > 3")).select("k")


@query("""with h as (select l_orderkey as query_name, l_partkey as p, case l_returnflag when 'A' then 'PF01085' when 'N' then 'PF01079' else 'PF9' end as acc, case l_linestatus when 'F' then 'a_VwA_3' else 'other' end as name from lineitem),
  f as (select query_name, min(p) filter (acc = 'PF01085') as s, min(p) filter (name = 'a_VwA_3') as v, min(p) filter (acc = 'PF01079') as h from h group by 1)
select query_name, s as signal_from, v as vwa_from, h as hint_from,
  case when h is null then 'no_hint' when s < h then 'signal_then_hint' when v < h then 'vwa_then_hint' when s is null and v is null then 'hint_only' else 'other' end as class from f""")
def hint_architectures(spark, d):
    acc = F.when(F.col("l_returnflag") == "A", "PF01085.2").when(F.col("l_returnflag") == "N", "PF01079.1").otherwise("PF9")
    name = F.when(F.col("l_linestatus") == "F", "a_VwA_3").otherwise("other")
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_name"), acc.alias("target_accession"), name.alias("target_name"), F.col("l_partkey").alias("ali_from"))
    return _long(tables.classify_architectures(hits, tables.hint_kinds(), tables.hint_ladder))


_WIDE = ", ".join(f"sum(l_quantity) filter (l_suppkey % 6 = {i}) as s{i}" for i in range(6))


@query(f"select l_partkey as gene, {_WIDE} from lineitem group by 1")
def merged_counts(spark, d):
    x = expression.merged_counts(line_counts(spark, d), [str(i) for i in range(6)])
    return x.select("gene", *[F.col(str(i)).alias(f"s{i}") for i in range(6)])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"with {_STATUS} select busco_id, " + ", ".join(f"max(status) filter (assembly = '{p}') as a{i}" for i, p in enumerate(_PRIORITIES)) + " from m group by 1")
def wide_status_table(spark, d):
    x = tables.status_wide(status_matrix(spark, d), _PRIORITIES)
    return x.select("busco_id", *[F.col(f"`{p}`").alias(f"a{i}") for i, p in enumerate(_PRIORITIES)])


@query("""with f as (select coalesce(a.k, b.k) as k, a.n as n0, b.n as n1 from (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'A' group by 1) a
  full outer join (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1) b on a.k = b.k) select k as gene, n0, n1 from f""")
def outer_joined_counts(spark, d):
    x = table(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("sample")).agg(F.count("*").alias("n"))
    return expression.merged_counts(x, ["A", "R"]).select("gene", F.col("A").alias("n0"), F.col("R").alias("n1"))


@query("""with s as (select translate(cast(s_suppkey * 7919 as varchar), '0123456789', 'ACGTACGTAC') as seq from supplier), l(c) as (values ('A'), ('C'), ('G'), ('T')),
  w as (select a.c || b.c || e.c || f.c as kmer from l a, l b, l e, l f), k as (select substr(seq, i, 4) as kmer from s, generate_series(1, 10) t(i) where i + 3 <= length(seq))
select w.kmer, count(k.kmer) as n from w left join k on k.kmer = w.kmer group by 1""")
def kmers_with_zeros(spark, d):
    s = table(spark, d, "supplier").select(F.translate((F.col("s_suppkey") * 7919).cast("string"), "0123456789", "ACGTACGTAC").alias("seq"))
    return kmers.count_kmers(s, 4, "ACGT")


@query("select 's' || s_suppkey as seq_id, s_name as seq from supplier union all select 'c' || c_custkey, c_name from customer")
def union_of_unique_ids(spark, d):
    part = lambda name, p, k, v: table(spark, d, name).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("seq_id"), F.col(v).alias("seq"))
    return tables.union_unique([part("supplier", "s", "s_suppkey", "s_name"), part("customer", "c", "c_custkey", "c_name")])


@query("select distinct c_custkey as seq_id, c_name as seq from customer join orders on o_custkey = c_custkey")
def requested_sequences(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("seq_id"), F.col("c_name").alias("seq"))
    ids = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("ord"))
    return tables.requested_records(s, ids).select("seq_id", "seq")


@query("""with p as (select 's' || s_suppkey as taxid, 'n' || s_nationkey as parent, 'supplier' as rank from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey, 'nation' from nation
  union all select 'r' || r_regionkey, 'root', 'region' from region)
select c_mktsegment as segment, coalesce(r_name, 'none') as region from (select distinct c_mktsegment from customer) left join region on r_regionkey = length(c_mktsegment) % 7""")
def looked_up_with_default(spark, d):
    x = table(spark, d, "customer").select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("segment"), (F.length("c_mktsegment") % 7).alias("k"))
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))
    return plotdata.with_default(x, names, "k", "region", "none").select("segment", "region")


@query("select 'supplier' as rank, (1000 + s_suppkey)::bigint as taxid from supplier where s_suppkey = 3 union all select 'nation', 100 + s_nationkey from supplier where s_suppkey = 3 union all select 'region', 10 + n_regionkey from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 3 union all select 'root', 1")
def lineage_of_taxon(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("taxid"), (F.col("s_nationkey") + 100).cast("long").alias("parent"), F.lit("supplier").alias("rank"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("taxid"), (F.col("n_regionkey") + 10).cast("long").alias("parent"), F.lit("nation").alias("rank"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("region").alias("rank"))
    root = spark.createDataFrame([(1, 1, "root")], s.schema)
    return tables.lineage_ranks(s.unionByName(n).unionByName(r).unionByName(root), 1003).select("rank", "taxid")


@query("""with g as (select n_regionkey as r, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1), p as (select i as perm_id from generate_series(1, 4) t(i))
select perm_id, r::bigint as r, n as rows, n as partners, true as inside from g, p""")
def seeded_shuffle(spark, d):
    """Each permutation gives every id one partner of its own group."""
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seq_id"), F.col("n_regionkey").alias("r"))
    y = information.shuffled_within(x, "r", 2026, 4).join(x, "seq_id").join(x.select(F.col("seq_id").alias("partner"), F.col("r").alias("pr")), "partner")
    return _long(y.groupBy("perm_id", "r").agg(F.count("*").alias("rows"), F.countDistinct("partner").alias("partners"), F.bool_and(F.col("r") == F.col("pr")).alias("inside")))


@query(f"""with {_GENES}, x as (select contig, gene_id, s, strand, lag(gene_id) over w as lg, lag(strand) over w as ls, lag(e) over w as le from g window w as (partition by contig order by s, e, gene_id)),
  p as (select contig, lg as left_gene, gene_id as right_gene, le, s from x where ls = '-' and strand = '+' and s > le + 1)
select left_gene, right_gene, case when le + 1 > length(text) then '' else substr(text, le + 1, s - le - 1) end as region from p join documents on doc_id = contig""")
def intergenic_regions(spark, d):
    contigs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    return genome.intergenic_sequences(genome.divergent_pairs(order_genes(spark, d)), contigs).select("left_gene", "right_gene", "region")


# ---- functions --------------------------------------------------------------------------------------------------


@query("select p_partkey, printf('#%02X%02X%02X', round(p_size / 5e1 * 255)::int, round((p_partkey % 11) / 1e1 * 255)::int, 0) as hex, printf('#%02X%02X%02X', p_size::int, (p_partkey % 256)::int, 7) as from_text from part")
def colours(spark, d):
    rgb = F.concat_ws(",", F.concat(F.lit("rgb("), F.col("p_size").cast("string")), (F.col("p_partkey") % 256).cast("string"), F.lit("7)"))
    return table(spark, d, "part").select("p_partkey", sequence.hex_colour(F.col("p_size") / 50, (F.col("p_partkey") % 11) / 10, F.lit(0.0)).alias("hex"), sequence.rgb_text_to_hex(rgb).alias("from_text"))


@query("""with x as (select p_partkey, (p_partkey % 401) / 4e1 - 5 as t, (p_partkey % 307) / 1e1 as c from part)
select p_partkey, round(1 - 2 / pi() * atan(abs(t)), 9) + 0e0 as t1, round(1 - abs(t) / sqrt(2 + t * t), 9) + 0e0 as t2,
  round(1 - 3e0 / 4 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))), 9) + 0e0 as t4,
  round(exp(-c / 2), 9) + 0e0 as c2, round(exp(-c / 2) * (1 + c / 2), 9) + 0e0 as c4, round(exp(-c / 2) * (1 + c / 2 + c * c / 8 + c * c * c / 48 + pow(c, 4) / 384), 9) + 0e0 as c10 from x""")
def special_functions(spark, d):
    """Tails of Student's t and chi-square where they have closed forms."""
    x = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 401) / 40.0 - 5).alias("t"), ((F.col("p_partkey") % 307) / 10.0).alias("c"))
    t = [maths.student_t_two_sided("t", F.lit(float(n))).alias(f"t{n}") for n in (1, 2, 4)]
    c = [maths.chi_square_upper("c", F.lit(float(n))).alias(f"c{n}") for n in (2, 4, 10)]
    y = x.select("p_partkey", *t, *c)
    return y.select("p_partkey", *[rounded(F.col(k), 9).alias(k) for k in y.columns[1:]])


@query("select event_type, count(*) as n, true as near from events group by 1")
def jittered_points(spark, d):
    x = plotdata.density_jitter(table(spark, d, "events").select("event_type", "value"), "value", "event_type", centre=2.0)
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("x") - 2) < 0.5).alias("near"))


@query("""with x as (select p_size * 1e0 + case when p_partkey % 3 = 0 then 5000 else 0 end as v, p_partkey % 3 = 0 as high from part)
select round(count(*) * 1e0 / (select count(*) from x), 2) + 0e0 as weight, round(avg(v), 3) + 0e0 as mean, round(var_pop(v), 2) + 0e0 as variance from x group by high""")
def mixture(spark, d):
    x = table(spark, d, "part").select((F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 5000.0).otherwise(0.0)).alias("v"))
    return spark.createDataFrame([(round(w, 2), round(m, 3), round(v, 2)) for w, m, v in plotdata.gaussian_mixture(x, "v", 2)], "weight double, mean double, variance double")


# ---- trees ------------------------------------------------------------------------------------------------------


def grouping_trees(spark, d) -> DataFrame:
    """Five trees over the nations, each with groups of its own."""
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("g"))
    groups = n.groupBy("g", (F.col("n_nationkey") * F.col("g") % (F.col("g") + 3)).alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    side = F.when(F.size("names") > 1, F.concat(F.lit("("), F.array_join("names", ","), F.lit(")"))).otherwise(F.get("names", 0))
    t = groups.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(side)), ",").alias("t"))
    return t.select(F.concat(F.lit("t"), F.col("g").cast("string")).alias("tree_id"), F.concat(F.lit("("), "t", F.lit(");")).alias("newick"))


_GROUPS = """sides as (select g, list_sort(list(n_name)) as side from nation, generate_series(1, 5) s(g) group by g, n_nationkey * g % (g + 3)),
  whole as (select list_sort(list(n_name)) as names, min(n_name) as low, count(*) as n from nation),
  splits as (select distinct g, case when list_contains(side, low) then list_sort(list_filter(names, lambda x: not list_contains(side, x))) else side end as split from sides, whole where len(side) between 2 and n - 2),
  k as (select g, count(*) as k from splits group by 1),
  rf as (select a.g as a, b.g as b, (a.k + b.k - 2 * (select count(*) from splits x join splits y on x.split = y.split where x.g = a.g and y.g = b.g)) / (2e0 * (n - 3)) as rf from k a join k b on a.g < b.g, whole)"""


@query(f"with {_GROUPS} select 't' || a as a, 't' || b as b, round(rf, 9) + 0e0 as rf from rf")
def rf_of_groupings(spark, d):
    return tree.rf_distances(tree.parse_newick(grouping_trees(spark, d))).select("a", "b", rounded(F.col("rf"), 9).alias("rf"))


@query(f"with {_GROUPS}, e as (select a as t, rf from rf union all select b, rf from rf) select 't' || t as tree_id, round(avg(rf), 9) + 0e0 as mean_rf, round(median(rf), 9) + 0e0 as median_rf, round(max(rf), 9) + 0e0 as max_rf from e group by 1")
def discordance_of_groupings(spark, d):
    x = tree.discordance(tree.rf_distances(tree.parse_newick(grouping_trees(spark, d))))
    return x.select("tree_id", *[rounded(F.col(c), 9).alias(c) for c in ("mean_rf", "median_rf", "max_rf")])


@query(f"with {_GROUPS} select 't' || g as tree_id, split from splits")
def splits_of_groupings(spark, d):
    t = tree.parse_newick(grouping_trees(spark, d))
    return tree.bipartition_sets(t, tree.ancestors(t)).select("tree_id", "split")


@query(f"""with {_GROUPS}, s as (select g, list_sort(list_filter(side, lambda x: ends_with(x, '1') or ends_with(x, '4') or ends_with(x, '7'))) as side from sides),
  t as (select g, case when len(side) > 1 then '(' || array_to_string(side, ',') || ')' else side[1] end as side from s where len(side) > 0), n as (select g, string_agg(side, ',' order by side) as t, count(*) as k from t group by 1)
select 't' || g as tree_id, case when k > 1 then '(' || t || ');' else t || ';' end as newick from n""")
def pruned_groupings(spark, d):
    t = tree.parse_newick(grouping_trees(spark, d))
    names = table(spark, d, "nation").select(F.col("n_name").alias("seq_id")).filter(F.col("seq_id").rlike("[147]$"))
    return sorted_newick(tree.to_newick(tree.prune_to_sequences(t, names)))


def sorted_newick(trees: DataFrame) -> DataFrame:
    """Two-level trees with the children of their root in order."""
    parts = F.regexp_extract_all(F.regexp_replace("newick", r"^\(|\);$|;$", ""), F.lit(r"(\([^()]*\)|[^(),]+)"), F.lit(1))
    joined = F.array_join(F.array_sort(parts), ",")
    return trees.select("tree_id", F.when(F.size(parts) > 1, F.concat(F.lit("("), joined, F.lit(");"))).otherwise(F.concat(joined, F.lit(";"))).alias("newick"))


@query("select 't' || g as tree_id, n_name as name, count(*) over (partition by g) as leaves, true as beside_the_rest from nation, generate_series(1, 5) s(g) qualify n_nationkey = 7")
def rerooted_groupings(spark, d):
    """Rooted on one nation, it stands beside all the others."""
    t = tree.root_on_outgroup(tree.parse_newick(grouping_trees(spark, d)), {"NATION_7"})
    n = t.filter("is_leaf").groupBy("tree_id").agg(F.count("*").alias("leaves"))
    root = t.filter("parent_id is null").select("tree_id", F.col("node_id").alias("root"))
    kids = t.groupBy("tree_id", F.col("parent_id").alias("root")).agg(F.count("*").alias("kids"))
    out = t.filter("name = 'NATION_7'").select("tree_id", "name", "parent_id")
    x = out.join(root, "tree_id").join(kids, ["tree_id", "root"]).join(n, "tree_id")
    return x.select("tree_id", "name", "leaves", ((F.col("parent_id") == F.col("root")) & (F.col("kids") == 2)).alias("beside_the_rest"))


@query("select 'once' as tree_id, 0::bigint as duplications, 0::bigint as losses, 2::bigint as rootings union all select 'twice', 1, 0, 2 union all select 'moved', 1, 3, 2")
def reconciled_rootings(spark, d):
    """Gene trees over the first nations against their ladder: the same tree, two copies of it, one leaf at another place."""
    a, b, c, e = (r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").limit(4).collect())
    ladder = f"((({a},{b}),{c}),{e})"
    moved = f"((({a},{c}),{b}),{e})"
    trees = spark.createDataFrame([("once", ladder + ";"), ("twice", f"({ladder},{ladder});"), ("moved", moved + ";")], "tree_id string, newick string")
    x = tree.reconciliation(tree.parse_newick(trees), ladder + ";", {n: n for n in (a, b, c, e)}).filter("optimal")
    return _long(x.groupBy("tree_id", "duplications", "losses").agg(F.count("*").alias("rootings")))


@query("""select 'support' as tree_id, count(*)::bigint as inner_before, count(*) filter (r_regionkey * 10 + 60 >= 80 and r_regionkey * 2 + 90 >= 95) as inner_after,
  round(1e2 * count(*) filter (r_regionkey * 10 + 60 >= 80 and r_regionkey * 2 + 90 >= 95) / count(*), 6) + 0e0 as retained_percent from region""")
def collapsed_branches(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("t"))
    sides = n.select(F.concat(F.lit("("), "t", F.lit(")"), (F.col("n_regionkey") * 10 + 60).cast("string"), F.lit("/"), (F.col("n_regionkey") * 2 + 90).cast("string"), F.lit(":1")).alias("s"))
    t = tree.parse_newick(sides.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("s")), ","), F.lit(");")).alias("newick")).withColumn("tree_id", F.lit("support")))
    return _six(tree.collapse_summary(t, tree.collapse_weak(t)), "retained_percent")


@query("select (n_nationkey + 10)::bigint as anc_id, (select count(*) from customer where c_nationkey = 3) as below from nation where n_nationkey = 3")
def common_ancestor(spark, d):
    t = place_tree(spark, d)
    c = tree.ancestors(t)
    tips = table(spark, d, "customer").filter("c_nationkey = 3").select(F.lit("t").alias("tree_id"), F.col("c_name").alias("name"))
    x = tree.common_ancestor(t, c, tips)
    return _long(x.join(tree.leaf_sets(t, c), ["tree_id", "anc_id"]).groupBy("anc_id").agg(F.count("*").alias("below")))


@query("select c_name as name, row_number() over (order by c_custkey) as nth from customer where c_nationkey = 2")
def descendants_of_node(spark, d):
    t = place_tree(spark, d)
    x = tree.descendants(t, tree.ancestors(t), 12).filter("is_leaf")
    return _long(x.select("name", F.row_number().over(_by_id()).alias("nth")))


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("node_id")  # the leaves below one nation


# ---- streams ----------------------------------------------------------------------------------------------------


@query("""select time_bucket(interval 6 hour, ts) - i * interval 6 hour as start, event_type, count(*) as n, round(sum(value), 4) + 0e0 as total from events, generate_series(0, 3) t(i) group by 1, 2""")
def sliding_windows(spark, d):
    x = streams.tumbling(table(spark, d, "events"), "1 day", "6 hours")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("""with w as (select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) + 0e0 as total from events group by 1, 2)
select start, event_type, n, total from w where start + interval 1 hour <= (select max(ts) - interval 1 hour from events)""")
def streamed_windows(spark, d):
    """Hours that the watermark has closed, by a stream that stops and goes on from its checkpoint with a second half."""
    x = table(spark, d, "events")
    source, sink, state = fresh(spark, "events"), fresh(spark, "windows"), fresh(spark, "state")
    schema = ", ".join(f"{n} {t}" for n, t in x.dtypes)
    half = x.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (x.filter(F.col("event_id") <= half), x.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(source)
        streams.run_to_table(streams.tumbling(streams.event_stream(spark, source, schema), "1 hour"), sink, state)
    y = spark.read.parquet(sink)
    return y.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))
