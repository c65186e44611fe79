"""Queries that have no SQL, against slow versions; and readers whose files are split."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe import queries
from strandframe.operators import information, newick, tables, tree
from strandframe.operators.cluster import upgma_clusters, upgma_newick
from strandframe.sources import readers
from strandframe.sources import sinks


def slow_upgma(names, dist):
    """Clusters as lists of names and their joining heights, by the mean of all pairs."""
    left = [[n] for n in sorted(names)]
    out = []
    while len(left) > 1:
        mean = {(i, j): sum(dist[a, b] for a in left[i] for b in left[j]) / (len(left[i]) * len(left[j])) for i in range(len(left)) for j in range(i + 1, len(left))}
        i, j = min(mean, key=lambda k: round(mean[k], 12))
        out.append((frozenset(left[i] + left[j]), mean[i, j]))
        left = [x for k, x in enumerate(left) if k not in (i, j)] + [left[i] + left[j]]
    return out


def deepest(node):
    return max((c.length + deepest(c) for c in node.children), default=0.0)


def test_upgma_brute(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        names = [f"n{g}{i}" for i in range(rng.randint(2, 9))]
        dist = {}
        for i, a in enumerate(names):
            for b in names[:i]:
                dist[a, b] = dist[b, a] = rng.random()
                rows.append((f"g{g}", a, b, dist[a, b]))
        want[f"g{g}"] = (names, slow_upgma(names, dist))
    e = spark.createDataFrame(rows, "aln_id string, a string, b string, dist double")
    cut = {}
    for r in upgma_clusters(e, 0.4).collect():
        cut.setdefault(r.aln_id, {}).setdefault(r.cluster, set()).add(r.genome)
    for g, (names, merges) in want.items():
        own = [frozenset([n]) for n in names]
        for members, height in merges:
            if height <= 0.4:
                own = [x for x in own if not x <= members] + [members]
        assert set(map(frozenset, cut[g].values())) == set(own)
    for r in upgma_newick(e).collect():
        names, merges = want[r.aln_id]
        root = newick.parse(r.newick)
        found = {frozenset(x.name for x in node.leaves()) for node in root.walk() if not node.is_leaf}
        assert found == {members for members, _ in merges}
        assert deepest(root) == pytest.approx(merges[-1][1], abs=1e-5)


def test_upgma_queries(spark, sf):
    newicks = {r.aln_id: r.newick for r in queries.QUERIES["upgma_newick"](spark, sf).collect()}
    cuts = queries.QUERIES["upgma_cut"](spark, sf).collect()
    leaves = {g: {x.name for x in newick.parse(t).leaves()} for g, t in newicks.items()}
    assert {g: {str(r.genome) for r in cuts if r.aln_id == g} for g in leaves} == leaves


def test_consensus_brute(spark, sf):
    """Its clades are those in more than half of the trees."""
    trees = [newick.parse(r.newick) for r in queries.segment_trees(spark, sf).collect()]
    clades = lambda root: {frozenset(x.name for x in n.leaves()) for n in root.walk() if not n.is_leaf}
    common = frozenset.intersection(*(frozenset(x.name for x in t.leaves()) for t in trees))
    seen = {}
    for t in trees:
        for c in {c & common for c in clades(t)}:
            if len(c) > 1:
                seen[c] = seen.get(c, 0) + 1
    got = queries.QUERIES["consensus_tree"](spark, sf).first().newick
    assert {c for c in clades(newick.parse(got)) if len(c) > 1} == {c for c, n in seen.items() if 2 * n > len(trees)}


def test_layout_brute(spark, sf):
    """Leaves are evenly spaced in their order, a node's x is its parent's and its branch, and its y lies among its children's."""
    t = tree.parse_newick(queries.segment_trees(spark, sf)).collect()
    at = {(r.tree_id, r.node_id): (r.x, r.y) for r in queries.QUERIES["tree_layout"](spark, sf).collect()}
    assert len(at) == len(t)
    for k in {r.tree_id for r in t}:
        own = [r for r in t if r.tree_id == k]
        ys = [at[k, r.node_id][1] for r in sorted(own, key=lambda r: r.node_id) if r.is_leaf]
        steps = {round(abs(b - a), 9) for a, b in zip(ys, ys[1:])}
        assert len(steps) == 1 and 0 not in steps
        for r in own:
            kids = [at[k, c.node_id][1] for c in own if c.parent_id == r.node_id]
            if kids:
                assert min(kids) <= at[k, r.node_id][1] <= max(kids)


def test_benjamini_hochberg_over_a_whole_table(spark):
    rng = random.Random(2)
    p = [round(rng.random() ** 2, 3) for _ in range(500)]
    order = sorted(range(500), key=lambda i: (p[i], i))
    want, low = {}, 1.0
    for k in range(499, -1, -1):
        low = min(low, p[order[k]] * 500 / (k + 1))
        want[order[k]] = low
    d = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    for x in (information.benjamini_hochberg(d), information._whole_table_q(d, "p", "id", chunk=7)):
        assert {r.id: pytest.approx(r.q) for r in x.collect()} == want


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_readers_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(4)
    reads = [(f"@r{i}", "".join(rng.choices("ACGT", k=rng.randint(1, 60)))) for i in range(1500)]
    p = tmp_path / "a.fq"
    p.write_text("".join(f"{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    assert spark.read.text(str(p)).rdd.getNumPartitions() > 10
    x = readers.read_fastq(spark, str(p))
    assert [(r.read_id, r.seq) for r in x.orderBy("ord").collect()] == reads
    p.write_text(p.read_text() + "\n\n+\nX\n@late\nA\n+\nI\n")
    assert readers.read_fastq(spark, str(p)).count() == 1500
    lines = readers._lines(spark, str(p), numbered=True).orderBy("ord").collect()
    assert [r.ord for r in lines] == list(range(len(lines))) and lines[5].line == reads[1][1]
    f = tmp_path / "b.fa"
    f.write_text("\n".join(f">s{i % 700} of > many\n{s}" for i, (_, s) in enumerate(reads)))
    assert {r.seq_id: r.seq for r in readers.read_fasta(spark, str(f)).collect()} == {f"s{i % 700}": s for i, (_, s) in enumerate(reads)}
    c = tmp_path / "c.clstr"
    c.write_text("".join(f">Cluster {k}\n" + "".join(f"{j}\t9aa, >m{k}_{j}... {'*' if j == 0 else 'at 9%'}\n" for j in range(k % 7 + 1)) for k in range(400)))
    got = {r.cluster_id: (r.rep, r.member_count) for r in tables.cluster_table(readers.read_clusters(spark, str(c))).collect()}
    assert got == {k: (f"m{k}_0", k % 7 + 1) for k in range(400)}
    running = readers._running(readers._lines(spark, str(c), numbered=True), F.col("line").startswith(">"), "n", chunk=50).collect()
    text = c.read_text().splitlines()
    assert all(r.n == sum(x.startswith(">") for x in text[: r.ord + 1]) for r in running)


def test_files_of_one_name(spark, tmp_path):
    """Two folders may hold files of the same name."""
    for k in (0, 1):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.fq").write_text(f"@a{k}\nAC\n+\nII\n@b{k}\nG\n+\nI\n")
    assert sorted(r.read_id for r in readers.read_fastq(spark, [str(tmp_path / "d0"), str(tmp_path / "d1")]).collect()) == ["@a0", "@a1", "@b0", "@b1"]


def test_download_commands(tmp_path):
    from strandframe.plans.pipelines import genome_download

    got = genome_download("ids.txt", ["genome", "gff3", "genome"], "a.zip", "out")
    assert got[0][:2] == ["datasets", "download"] and "genome,gff3" in got[0] and got[2][-2:] == ["--directory", "out"]
    with pytest.raises(ValueError):
        genome_download("ids.txt", [], "a.zip", "out")


def test_phylip_lines_have_a_header(spark):
    x = spark.createDataFrame([("a", "AC"), ("b", "GT")], "seq_id string, seq string")
    assert sorted(r.value for r in sinks.phylip_lines(x).select("value").collect()) == ["2 2", "a  AC", "b  GT"]


def test_rows_of_a_wide_node(monkeypatch):
    """A node's children are numbered in one pass, not searched one by one."""

    class Children(list):
        def index(self, *_):
            raise AssertionError("children are searched")

    root = newick.Node("r")
    root.children = Children()
    for k in range(5):
        root.add(newick.Node(f"l{k}", 1.0))
    assert [r[:3] for r in newick.rows(root)] == [(0, None, 0)] + [(k + 1, 0, k) for k in range(5)]
    assert [x.name for x in newick.parse("(a b[note]_c:1.5,'it''s (d)':2);").leaves()] == ["a b_c", "it's (d)"]


def test_single_linkage_of_rows(spark, monkeypatch):
    """The same groups as from the table of all pairs, which is not made; blocks smaller than an alignment among them."""
    from strandframe.operators import alignment, cluster

    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT-") for _ in range(20)) for _ in range(8)]
    rows = [(i % 3, f"s{i}", "".join(rng.choice("acgt-") if rng.random() < 0.06 else c for c in rng.choice(base))[: rng.choice((20, 20, 12))]) for i in range(90)]
    rows += [(0, "gaps", "-" * 20), (0, "none", None), (7, "alone", "ACGT"), (None, "lost", "ACGT"), (1, None, "ACGT")]
    x = spark.createDataFrame(rows, "aln_id int, seq_id string, seq string")
    want = {r.id: r.component for r in cluster.single_linkage(alignment.identity_distances(x), 0.9).collect()}
    assert 10 < len(set(want.values())) < 80
    monkeypatch.setattr(alignment, "identity_distances", None)
    own = cluster.linked_rows
    monkeypatch.setattr(cluster, "linked_rows", lambda a, t, gap: own(a, t, gap, block=7))
    assert {r.id: r.component for r in cluster.single_linkage_of_rows(x, 0.9).collect()} == want
