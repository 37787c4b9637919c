"""Models, ranges, reference checks and special functions against plain forms and enumeration."""

import itertools
import math
import re

import numpy as np
import pytest
from genoframe.functions import genetics as gen
from genoframe.functions import special
from genoframe.functions.keys import site_key
from genoframe.operators import calling, filters, genotype, joins, lines, merge, ranges, reshape, sequence, stats
from genoframe.sources.vcf import Header
from genoframe.streaming import events as ev
from pyspark.sql import functions as F


def test_contigs_that_share_positions(spark):
    rows = spark.createDataFrame([("1", 100, "A", ["C"]), ("2", 100, "A", ["C"]), ("2", 300, "A", ["C"])], "chrom string, pos long, ref string, alts array<string>")
    regions = spark.createDataFrame([("1", 90, 110, "x")], "chrom string, from1 long, to1 long, name string")
    got = joins.select_regions(rows, regions, start=F.col("pos"), end=F.col("pos"))
    assert [(r.chrom, r.pos) for r in got.collect()] == [("1", 100)]
    got = joins.annotate_intervals(rows, regions, start=F.col("pos"), end=F.col("pos"), value="name", order="from1")
    assert {(r.chrom, r.pos): r.name for r in got.collect()} == {("1", 100): "x", ("2", 100): None, ("2", 300): None}
    with pytest.raises(ValueError):
        site_key(rows, rows.drop("chrom"))


def test_merge_gathers_alleles(spark):
    schema = "chrom int, pos long, id string, ref string, alts array<string>, qual double, filter string, mask int, samples array<struct<sample:int,a:int,b:int>>, x array<int>, g array<int>"
    one = spark.createDataFrame([(1, 5, "a", "A", ["C"], 9.0, "PASS", 1, [(1, 0, 1)], [3], [0, 1, 2])], schema)
    two = spark.createDataFrame([(1, 5, "b", "AT", ["GT", "<DEL>"], None, "q10", 1, [(2, 1, 2), (3, None, 0)], [5, 6], [9, 8, 7, 6, 5, 4])], schema)
    r = merge.merge_files([one, two], {"x": ("sum", "A"), "g": ("max", "G")}, mode="both").first()
    assert (r.ref, r.alts, r.id, r.qual, r.filters) == ("AT", ["CT", "GT", "<DEL>"], "a;b", 9.0, ["q10"])
    assert [(s.sample, s.a, s.b) for s in r.samples] == [(1, 0, 1), (2, 2, 3), (3, None, 0)]
    assert r.x == [3.0, 5.0, 6.0] and r.g == [9, 1, 2, 8, None, 7, 6, None, 5, 4] and r.top_alt in (1, 2, 3)
    for mode in ("none", "some", "all", "snps", "indels"):
        assert merge.merge_files([one, two], {}, mode=mode, sizes=[1, 2]).count() in (1, 2)


def test_split_and_join_of_haploid_vectors(spark):
    df = spark.createDataFrame([(1, 7, 0, "A", ["C", "G"], 1.0, [10, 11, 12], [(1, 2, None)])], "chrom int, pos int, rec int, ref string, alts array<string>, qual double, p array<int>, samples array<struct<sample:int,a:int,b:int>>")
    parts = reshape.split_alleles(df, per_genotype=["p"])
    got = {r.nth: (r.p, r.samples[0].a) for r in parts.collect()}
    assert got == {1: ([10, 11], 0), 2: ([10, 12], 1)}
    r = reshape.join_alleles(parts.withColumn("rec", F.col("nth")), F.lit(0), {"p": "G"}).first()
    assert r.alts == ["C", "G"] and r.p == [10, 11, 12] and (r.samples[0].a, r.samples[0].b) == (2, None)


def test_batches_equal_single_sites():
    rng = np.random.default_rng(1)
    for n_alleles, samples in ((1, 3), (2, 5), (3, 4), (4, 2)):
        g = n_alleles * (n_alleles + 1) // 2
        prob = rng.random((30, samples, g)) ** 4
        prob[rng.random((30, samples)) < 0.1] = 0
        total = prob.sum(axis=2, keepdims=True)
        prob = prob / np.where(total > 0, total, 1)
        qs = rng.dirichlet(np.ones(n_alleles), 30)
        keep, quality, calls = calling.batch_kernel(prob, qs)
        pairs = [(i, j) for j in range(n_alleles) for i in range(j + 1)]
        for k in range(30):
            want_keep, want_quality, want_calls = calling.site_kernel(prob[k], qs[k])
            assert np.flatnonzero(keep[k]).tolist() == want_keep and quality[k] == pytest.approx(want_quality, abs=1e-6)
            assert [pairs[c] if c >= 0 else (-1, -1) for c in calls[k]] == want_calls


def test_frequency_posterior_by_enumeration():
    rng = np.random.default_rng(3)
    p = rng.random((2, 3, 3))
    got = calling.frequency_posterior(p, 1e-2)
    for k in range(2):
        weight = np.zeros(7)
        for g in itertools.product(range(3), repeat=3):
            weight[sum(g)] += math.prod(p[k, s, x] * math.comb(2, x) for s, x in enumerate(g))
        prior = np.array([0, *(1e-2 / j for j in range(1, 7))])
        prior[0] = 1 - prior[1:].sum()
        post = weight / [math.comb(6, j) for j in range(7)] * prior
        assert got[k] == pytest.approx(post / post.sum())
        fold = weight / [math.comb(6, j) for j in range(7)] * (prior + prior[::-1]) / 2
        assert calling.frequency_posterior(p, 1e-2, folded=True)[k] == pytest.approx(fold / fold.sum())
        like = np.exp(calling.count_likelihood(p)[k])
        assert like / like.sum() == pytest.approx(weight / [math.comb(6, j) for j in range(7)] / sum(weight / [math.comb(6, j) for j in range(7)]))


def test_posteriors_of_three_alleles(spark):
    """Of the alleles kept only, in their order; equal chances go to the homozygous genotype."""
    pls = [[[60.0, 50.0, 40.0, 0.0, 45.0, 50.0], [0.0, 30.0, 60.0, 40.0, 70.0, 80.0], [0.0] * 6], [[0.0, 40.0, 80.0, 40.0, 80.0, 80.0]] * 3]
    rows = spark.createDataFrame([(k, x, q) for k, (x, q) in enumerate(zip(pls, ([0.5, 0.01, 0.49], [0.9, 0.05, 0.05])))], "key int, pls array<array<double>>, qs array<double>")
    got = {r.key: r for r in calling.call_sites(rows).collect()}
    for k, r in got.items():
        q = np.where(np.isin(range(3), r.alleles), [0.5, 0.01, 0.49] if k == 0 else [0.9, 0.05, 0.05], 0)
        q = q / q.sum()
        pairs = [(i, j) for j in range(3) for i in range(j + 1)]
        kept = [n for n, (i, j) in enumerate(pairs) if i in r.alleles and j in r.alleles]
        for s, pl in enumerate(pls[k]):
            post = np.array([10 ** (-pl[n] / 10) * q[pairs[n][0]] * q[pairs[n][1]] * (1 if pairs[n][0] == pairs[n][1] else 2) for n in kept])
            post /= post.sum()
            assert r.gp[s] == [int(-4.34294 * math.log(x)) for x in post] and r.pl[s] == [pl[n] for n in kept]
            assert r.gq[s] == (127 if post.max() == 1 else min(127, int(-4.34294 * math.log(1 - post.max()))))
    assert got[0].alleles == [0, 2] and got[1].alleles == [0] and got[1].gp == [[0]] * 3
    assert calling._likeliest(np.array([0.0, 0.25, 0.25]), np.array([(0, 0), (0, 1), (1, 1)])) == 2


def test_interval_leaves_a_fortieth_on_either_side():
    post = np.array([[0.02, 0.01, 0.5, 0.44, 0.03], [1.0, 0, 0, 0, 0], [0.025, 0.95, 0, 0, 0.025], [0.2] * 5])
    low, high = calling.credible_interval(post)
    assert low.tolist() == [0.25, 0, 0.25, 0] and high.tolist() == [1, 0, 0.25, 1]


def test_reference_without_quality(spark):
    rows = spark.createDataFrame([([0.0, 30.0],), ([0.0, 1.5],), ([5.0, 5.0],), ([0.0, 0.0],)], "q array<double>")
    got = [r.n for r in rows.select(calling.normalised_quality_sums(F.col("q")).alias("n")).collect()]
    assert got == [pytest.approx(x) for x in ([32 / 62, 30 / 62], [1e-3 / 1.501, 1.5 / 1.501], [0.5, 0.5], [1.0, 0.0])]
    assert calling.watterson(1e-3, 2) == pytest.approx(math.log(1e-3 * (1 + 1 / 2 + 1 / 3))) and calling.watterson(5, 2) == math.log(0.99)


def test_frequency_estimates_reach_the_maximum():
    rng = np.random.default_rng(4)
    p = rng.random((5, 12, 3)) ** 3
    f = calling.estimate_frequency(p)
    like = lambda x: np.log((p[..., 0] * (1 - x) ** 2 + p[..., 1] * 2 * x * (1 - x) + p[..., 2] * x * x)).sum(axis=1)
    best = np.max([like(x) for x in np.linspace(0.001, 0.999, 999)], axis=0)
    assert (like(f[:, None]) >= best - 1e-2).all()


def test_trio_tables():
    table = calling.trio_table(2)
    assert len(table) == 15 and all(sum(p for f, m, _, p in table if (f, m) == key) == pytest.approx(1) for key in {(f, m) for f, m, *_ in table})
    assert len(calling.trio_table(3)) == 78 and len(calling.trio_table(2, "x-boy")) == 8 and len(calling.trio_table(2, "x-girl")) == 8
    assert dict(((f, m, c), p) for f, m, c, p in table)[(1, 1, 0)] == 0.25


def test_trio_missing_and_de_novo(spark):
    sure = lambda k: [0.0 if i == k else -50.0 for i in range(3)]
    rows = [(1, sure(0), sure(0), sure(1)), (2, sure(1), None, sure(2)), (3, sure(0), sure(2), sure(1))]
    df = spark.createDataFrame(rows, "k int, father array<double>, mother array<double>, child array<double>")
    got = {r.k: (r.unconstrained, r.constrained, r.de_novo) for r in calling.call_trios(df, mendel=1 - 1e-8).collect()}
    assert got[1] == ([0, 0, 1], [0, 0, 1], True) and got[2] == ([1, -1, 2], [1, -1, 2], False) and got[3] == ([0, 2, 1], [0, 2, 1], False)


def test_special_functions():
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248) and special.gamma_upper(3.0, 5.0) == pytest.approx(0.12465201948)
    assert special.chi2_upper(3.841458820694124) == pytest.approx(0.05) and special.gamma_upper(0.5, 0.0) == 1.0
    assert special.fisher_exact(3, 1, 1, 3) == pytest.approx(34 / 70) and special.fisher_exact(0, 0, 0, 0) == 1.0
    assert special.minimise(lambda x: (x - np.array([0.3, 1.0])) ** 2, np.zeros(2), np.ones(2)) == pytest.approx([0.3, 1.0], abs=1e-6)
    assert special.one_sided_t([5], [5], [50], [510], [40], [330])[0] == pytest.approx(0.04025812)
    assert special.one_sided_t([5, 0], [5, 3], [40, 0], [330, 0], [50, 1], [510, 1]).tolist() == [1.0, 1.0]


def test_bias_tests(spark):
    i16 = [3.0, 1.0, 1.0, 3.0, 100.0, 2600.0, 60.0, 950.0, 80.0, 1700.0, 40.0, 450.0, 20.0, 110.0, 25.0, 170.0]
    r = calling.bias_tests(spark.createDataFrame([(1, i16), (2, [0.0] * 16), (3, None)], "k int, i16 array<double>")).orderBy("k").collect()
    assert r[0].dp4 == [3, 1, 1, 3] and r[0].mq == int(math.sqrt(2150 / 8) + 0.499) and r[0].pv4[0] == pytest.approx(34 / 70)
    assert r[0].pv4[3] == 1.0 and 0 < r[0].pv4[1] < 0.5 and r[1].pv4 is None and r[1].mq is None and r[2].dp4 is None


def test_ranges_across_cuts(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), int(p), int(v)) for c in (1, 2) for p, v in zip(np.sort(rng.choice(5000, 120, replace=False)), rng.integers(0, 5, 120))]
    df = spark.createDataFrame(rows, "chrom int, pos long, v int")
    prior = {(r.chrom, r.pos): r.previous for r in ranges.with_previous(df, "v", [F.col("pos")], size=64).collect()}
    total = {(r.chrom, r.pos): r.t for r in ranges.running_total(df, "v", "t", [F.col("pos")], size=64).collect()}
    odd = F.when(F.col("v") == 3, F.col("pos"))
    near = {(r.chrom, r.pos): (r.before, r.after) for r in ranges.with_neighbours(df, odd, size=64).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        marks = [r[1] for r in own if r[2] == 3]
        for k, (_, p, _) in enumerate(own):
            assert prior[c, p] == (own[k - 1][2] if k else None) and total[c, p] == sum(r[2] for r in own[: k + 1])
            assert near[c, p] == (max((m for m in marks if m <= p), default=None), min((m for m in marks if m >= p), default=None))


def test_order_breaks(spark):
    file = [("1", 5), ("1", 9), ("1", 7), ("2", 1), ("2", 4), ("1", 11), ("3", 2), ("3", 2)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(file)], "rec long, chrom string, pos long")
    assert sorted(r.rec for r in ranges.order_breaks(df, size=2).collect()) == [2, 5]


def test_repeat_context_against_plain_form(spark):
    rng = np.random.default_rng(5)
    seq = "".join(rng.choice(list("ACGT"), 300)) + "CA" * 20 + "".join(rng.choice(list("ACGT"), 100)) + "T" * 30 + "".join(rng.choice(list("ACGT"), 300))
    ref = spark.createDataFrame([(1, k, seq[k * 100 : k * 100 + 100]) for k in range(0, len(seq), 100) for k in [k // 100]], "chrom int, chunk long, seq string")
    rows = [(1, p, "A", ["A" + "C" * int(rng.integers(1, 5))]) if p % 2 else (1, p, "ACG", ["A"]) for p in range(250, 560, 7)]
    got = stats.repeat_context(spark.createDataFrame(rows, "chrom int, pos long, ref string, alts array<string>"), ref, chunk=100).collect()
    want = {}
    for _, p, r, (a,) in rows:
        w, best = seq[p : p + 50], (0, 0, 0)
        for k in range(1, 11):
            m = re.match(rf"((.{{{k}}})\2+)", w)
            if m and len(m[1]) > best[0]:
                best = (len(m[1]), k, len(m[1]) // k)
        n = len(a) - len(r)
        key = (best[1], best[2], best[1] > 0 and abs(n) % best[1] == 0)
        d, i = want.get(key, (0, 0))
        want[key] = (d + (n < 0), i + (n > 0))
    assert {(r.unit, r.copies, r.consistent): (r.deletions, r.insertions) for r in got} == want


def test_reference_policies(spark):
    ref = spark.createDataFrame([(1, 0, "ACGTACGTAC"), (1, 1, "GTACGTACGT")], "chrom int, chunk long, seq string")
    rows = [(1, 10, "CG", ["C"], [(1, 0, 1)]), (1, 1, "T", ["A", "G"], [(1, 1, 2)]), (1, 2, "T", ["G"], [(1, 0, 1)]), (1, 99, "A", ["C"], [(1, 0, 0)])]
    df = spark.createDataFrame(rows, "chrom int, pos long, ref string, alts array<string>, samples array<struct<sample:int,a:int,b:int>>")
    check = lambda policy: {r.pos: r for r in reshape.check_ref(df, ref, policy, window=10).collect()}
    assert {p: r.ref_ok for p, r in check("warn").items()} == {10: True, 1: False, 2: False, 99: None}
    assert set(check("exclude")) == {10, 99}
    fixed = check("fix")
    assert (fixed[1].ref, fixed[1].alts, fixed[1].samples[0].a, fixed[1].samples[0].b) == ("A", ["T", "G"], 0, 2) and (fixed[2].ref, fixed[2].alts) == ("C", ["G"])
    with pytest.raises(Exception, match="REF differs at 1:"):
        check("stop")


def test_targets_unseen_and_fill(spark):
    sites = spark.createDataFrame([("1", 5, "A", ["C", "<*>"], [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0]])], "chrom string, pos long, ref string, alts array<string>, pls array<array<double>>")
    targets = spark.createDataFrame([("1", 5, ["A", "G"]), ("1", 9, ["A", "T"])], "chrom string, pos long, alleles array<string>")
    got = {r.pos: r for r in calling.constrained_to_targets(sites, targets, insert_missed=True).collect()}
    assert got[5].alts == ["G"] and got[5].pls == [[0.0, 3.0, 5.0]] and got[9].pls is None and got[9].ref == "A"
    assert calling.constrained_to_targets(sites, targets).count() == 1
    df = spark.createDataFrame([([[0.0, None, None, 3.0, 4.0, 5.0], [None] * 6],)], "p array<array<double>>")
    assert df.select(calling.fill_unseen(F.col("p"), F.lit(3)).alias("x")).first().x == [[0.0, 3.0, 5.0, 3.0, 4.0, 5.0], [None] * 6]


def test_scalars_and_samples(spark):
    r = spark.range(1).select(
        F.array(*[gen.genotype_alleles(F.lit(k)) for k in range(6)]).alias("g"), gen.compatible_refs(F.lit("AC"), F.lit("A")).alias("c"), gen.compatible_refs(F.lit("AC"), F.lit("AT")).alias("d")
    ).first()
    assert [(x.i, x.j) for x in r.g] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)] and r.c and not r.d
    with pytest.raises(ValueError):
        genotype.subset_samples(F.col("samples"), [1, 9], known=[1, 2])
    x = spark.createDataFrame([([0.1, 0.2, 0.7], [0.0, 30.0, 60.0], 0, 1), (None, [0.0, 30.0, 60.0], 0, 1), (None, None, 0, 1), (None, None, None, 1)], "gp array<double>, pl array<double>, a int, b int")
    got = [r.d for r in x.select(genotype.best_dosage(F.col("gp"), F.col("pl"), F.struct("a", "b")).alias("d")).collect()]
    assert got[0] == pytest.approx(1.6) and 0 < got[1] < 0.2 and got[2:] == [1.0, -1.0]


def test_lines_and_headers():
    assert lines.heading(["CHROM", "POS"], ["A"], ["GT"]) == "# [1]CHROM\t[2]POS\t[3]A:GT"
    assert lines.listed(["AC"]) == ["CHROM", "POS", "MASK", "REF", "ALT", "AC"]
    have = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">']
    out = lines.appended(have, ['##INFO=<ID=DP,Number=2,Type=Float>', '##INFO=<ID=T_STR,Number=1,Type=String,Description="t">'])
    assert out == [*have, '##INFO=<ID=T_STR,Number=1,Type=String,Description="t">'] and Header.of(out).info["T_STR"] == ("1", "String")
    assert lines.with_provenance(have, "merge", "1", "merge a b")[2:] == ["##mergeVersion=1", "##mergeCommand=merge a b"]
    with pytest.raises(ValueError):
        lines.appended(have, ["#CHROM"])


def test_concat_checks(spark):
    a = spark.createDataFrame([(1, 5), (1, 9)], "chrom int, pos int")
    b = spark.createDataFrame([(1, 8), (2, 1)], "chrom int, pos int")
    assert reshape.concat_files([a, b]).count() == 4
    with pytest.raises(ValueError):
        reshape.concat_files([a, b], allow_overlap=False).count()
    with pytest.raises(ValueError):
        reshape.concat_files([a, b], samples=[["x"], ["y"]])


def test_site_tests_without_samples(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 9)], "q double, d int")
    both = filters.Test(F.col("q") > 0) | filters.Test(F.col("d") > 6)
    assert both.samples is None and [r.x for r in df.select(both.site.alias("x")).collect()] == [True, True]


def test_stateful_stream_equals_table(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = ev.read_stream(spark, "/root/testdata/sf0.001", schema, "events.parquet")
    ev.run_to_table(ev.latest_totals(stream), "totals", str(tmp_path / "c"), "update")
    want = ev.latest_totals(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    got = {r.user_id: (r.n, round(r.total, 6), r.last) for r in spark.table("totals").collect()}
    assert got == {r.user_id: (r.n, round(r.total, 6), r.last) for r in want.collect()}


def test_headers_of_several_files(spark, tmp_path):
    from genoframe.sources.vcf import read_header, read_vcf

    head = "##fileformat=VCFv4.2\n##contig=<ID=1>\n##INFO=<ID=DP,Number=1,Type=Integer>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    for k in range(2):
        (tmp_path / f"{k}.vcf").write_text(head + "".join(f"1\t{p}\t.\tA\tC\t.\t.\tDP={p}\n" for p in range(1, 4)))
    paths = [str(tmp_path / f"{k}.vcf") for k in range(2)]
    assert len(read_header(spark, str(tmp_path)).lines) == 3 and read_header(spark, paths).info == {"DP": ("1", "Integer")}
    assert sorted(r.info.DP for r in read_vcf(spark, paths)[1].collect()) == [1, 1, 2, 2, 3, 3]


def test_batches_of_sites_of_many_shapes(spark):
    """Sites of one to four samples in one batch: rows come as they went in, each as if it were alone."""
    pls = [[[0.0, 7.0 * k + s, 40.0] for s in range(1 + k % 4)] for k in range(12)]
    pls[5][0] = [None, 3.0, 9.0, 1.0]
    rows = spark.createDataFrame(list(enumerate(pls)), "key int, pls array<array<double>>").coalesce(1)
    got = calling.consensus_call(rows).collect()
    assert [r.key for r in got] == list(range(12)) and [len(r.genotypes) for r in got] == [len(p) for p in pls]
    for k in (0, 5, 11):
        assert calling.consensus_call(rows.filter(f"key = {k}")).first() == got[k]


def test_bias_tests_need_no_shuffle(spark):
    rows = spark.createDataFrame([(k, [float(k % 5), 2.0, 3.0, k % 3 + 0.0, *([30.0 * k, 900.0 * k] * 6)]) for k in range(20)], "k int, i16 array<double>")
    out = calling.bias_tests(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        a, b, c, d = r.dp4
        assert r.pv4[0] == special.fisher_exact(a, b, c, d)


def test_frequency_rounds_in_batches(spark):
    g = [(k, 0.2 + 0.1 * s, 0.5, 0.1 * k) for k in range(6) for s in range(1 + k)] + [(9, None, 1.0, 1.0), (9, 0.1, 0.1, 0.8), (10, 0.0, 0.0, 0.0)]
    out = calling.allele_frequency_em(spark.createDataFrame(g, "k int, g0 double, g1 double, g2 double"), "k")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.af, r.samples) for r in out.collect()}
    for key in {r[0] for r in g}:
        own = sorted((r[1:] for r in g if r[0] == key), key=lambda r: (r[0] is not None, r))
        f = 0.2
        for _ in range(20):
            t = 0.0
            for x in own:
                if None not in x and sum(x):
                    a, b, c = x[0] * (1 - f) * (1 - f), x[1] * 2 * f * (1 - f), x[2] * f * f
                    t += (b + 2 * c) / (a + b + c)
            f = t / (2 * len(own))
        assert got[key] == (pytest.approx(f, abs=1e-12), len(own))
