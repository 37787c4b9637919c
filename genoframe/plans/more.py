"""More registered queries: masks of samples, gates, targets, discordance, calling models, checks of order and reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions import genetics as gen
from genoframe.operators import annotate, calling, filters, genotype, joins, lines, merge, ranges, reshape, sequence, stats
from genoframe.plans.queries import _G, _I, _L, _MASK, _P, _PAIR, _PL, _S, _SNPS, _TWO, LIGATED, MERGED_ROWS, SITE, files_of_samples, likelihoods, phased_files, query, table, two_sets, variants
from genoframe.sources.views import genotypes, intervals
from genoframe.streaming import events as ev


def matrix_of(spark, sf_dir, *columns: str) -> DataFrame:
    return genotype.matrix(genotypes(spark, sf_dir).select(*SITE, "sample", *columns))


# --- masks and gates -----------------------------------------------------------


@query(f"""WITH {_S}, {_G}, t AS (SELECT g.chrom AS chrom, g.pos AS pos, sample, dp > 40 AS p, a <> b AS h, qual > 300 AS q FROM g JOIN s ON g.chrom = s.chrom AND g.pos = s.pos)
 SELECT chrom, pos, string_agg(CASE WHEN p AND h THEN 1 ELSE 0 END, '' ORDER BY sample) AS both, string_agg(CASE WHEN p AND q THEN 1 ELSE 0 END, '' ORDER BY sample) AS with_site,
 string_agg(CASE WHEN p OR h THEN 1 ELSE 0 END, '' ORDER BY sample) AS either, bool_or(p) OR any_value(q) AS site, string_agg(CASE WHEN p THEN 1 ELSE 0 END, '' ORDER BY sample) AS own,
 string_agg(CASE WHEN p OR q THEN 1 ELSE 0 END, '' ORDER BY sample) AS spread FROM t GROUP BY chrom, pos""")
def sample_masks(spark, sf_dir):
    """Conditions on samples and on the site: which samples ``and`` and both kinds of ``or`` leave."""
    m = matrix_of(spark, sf_dir, "a", "b", "dp").join(variants(spark, sf_dir).select(*SITE, "qual"), SITE)
    x = F.col("samples")
    deep, het = filters.Test.of_samples(x, lambda s: s["dp"] > 40), filters.Test.of_samples(x, lambda s: s["a"] != s["b"])
    good = filters.Test(F.col("qual") > 300)
    shown = lambda t: F.array_join(F.transform(t.samples, lambda b: b.cast("int").cast("string")), "")
    return m.select(
        *SITE, shown(deep & het).alias("both"), shown(deep & good).alias("with_site"), shown(deep | het).alias("either"), (deep | good).site.alias("site"),
        shown(deep | good).alias("own"), shown(deep.or_all(good)).alias("spread"),
    )


@query(f"""WITH {_S} SELECT s.chrom AS chrom, s.pos AS pos, s.qual < t.qual AS lower FROM s JOIN s t ON s.chrom = t.chrom AND t.pos = s.pos + 2 WHERE s.filter IN ('P', 'O') AND t.filter IN ('P', 'O') AND (s.kind IN (1, 2)) = (t.kind IN (1, 2))""")
def filters_before_join(spark, sf_dir):
    """Records whose FILTER is P or unset (``O`` stands for it), chosen before two files are joined."""
    v = variants(spark, sf_dir).withColumn("filters", F.when(F.col("filter") != "O", F.array("filter")))
    v = joins.apply_filters(v, ["P", "."]).select(*SITE, "ref", "alts", "qual", "mask")
    moved = v.withColumns({"pos": F.col("pos") - 2, "qual": F.col("qual")})
    both = joins.intersect([v, moved], 2, "=", "both").select(*SITE, F.col("first.qual").alias("qual"))
    later = moved.select(*SITE, F.col("qual").alias("then"))
    return both.join(later, SITE).select(*SITE, (F.col("qual") < F.col("then")).alias("lower"))


@query(f"""WITH {_G}, t AS (SELECT chrom, pos, 2 * count(*) AS an, sum(CASE WHEN a = 1 THEN 1 ELSE 0 END) AS one, sum(CASE WHEN b = 1 THEN 1 ELSE 0 END) AS two FROM g GROUP BY chrom, pos)
 SELECT chrom, pos, CAST(one + two AS INTEGER) AS nref, CAST(one AS INTEGER) AS alt1, CAST(least(one + two, an - one - two) AS INTEGER) AS minor, CAST(an - greatest(one, two, an - one - two) AS INTEGER) AS nonmajor,
 (one + two) / CAST(an AS DOUBLE) AS af FROM t""")
def allele_count_kinds(spark, sf_dir):
    """``b`` has the second ALT."""
    m = genotype.matrix(genotypes(spark, sf_dir).select(*SITE, "sample", "a", (F.col("b") * 2).alias("b")))
    x = F.col("samples")
    m = genotype.with_frequency(m, F.lit(2))
    return m.select(*SITE, *[genotype.allele_count(x, F.lit(2), k).alias(k) for k in ("nref", "alt1", "minor", "nonmajor")], "af")


@query(f"""WITH {_S} SELECT chrom, pos FROM s WHERE ref NOT LIKE 'A%' AND kind IN (0, 3) AND kind = 0""")
def caller_gates(spark, sf_dir):
    """``A`` stands for an unknown REF; indels are skipped, then biallelic SNPs chosen."""
    v = variants(spark, sf_dir).withColumn("ref", F.translate("ref", "A", "N"))
    return filters.biallelic(filters.caller_gate(v, variants_only=True, skip="indels")).select(*SITE)


def _legacy_sql() -> str:
    """A fold of each island, record by record: ``st`` is the list of its records so far with their letters."""
    made = lambda letter: "{'rec': x.rec, 'pos': x.pos, 'fin': x.fin, 'rl': x.rl, 'alt': x.alt, 'kind': x.kind, 'score': x.score, 'letter': " + letter + "}"
    rival = "CASE WHEN kind = 3 THEN x.kind = 3 AND x.letter = 'U' AND x.fin + 10 >= pos ELSE x.kind <> 3 AND x.fin >= pos END"
    return f"""WITH RECURSIVE {_S}, x AS (SELECT chrom, pos, rec, CASE WHEN kind = 3 THEN ref || 'ACG' ELSE ref END AS ref, CASE WHEN kind = 3 THEN alt || 'ACG,' || alt2 || 'TTT' ELSE alt END AS alt,
   CASE WHEN kind IN (1, 2) THEN 3 WHEN kind = 3 THEN 2 ELSE 1 END AS kind, CAST(qual AS DOUBLE) AS qual, src % 50 AS dp, src % 37 AS mq, src % 9 AS alts, (src % 29) / 10000.0 AS p, (rec % 9) / 20.0 AS g0, (rec % 7) / 10.0 AS g1, (rec % 13) / 10000.0 AS hwe FROM s),
 y AS (SELECT *, pos + length(ref) - 1 AS fin, qual * 100 + alts AS score, CASE WHEN hwe < 0.0001 AND 2 * g0 + g1 > 0 AND 2 * g0 + g1 < 1 AND g1 > (2 * g0 + g1) * (1 - 2 * g0 - g1) THEN 'S'
   WHEN alts < 2 THEN 'a' WHEN dp < 3 THEN 'd' WHEN dp > 45 THEN 'D' WHEN mq < 3 THEN 'Q' WHEN p < 0.0002 THEN 'P' ELSE 'U' END AS letter FROM x),
 f AS (SELECT *, max(fin + CASE WHEN kind = 3 THEN 10 ELSE 3 END) OVER (PARTITION BY chrom ORDER BY pos, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y),
 g AS (SELECT *, sum(CASE WHEN pos <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos, rec) AS isle FROM f),
 n AS (SELECT *, row_number() OVER (PARTITION BY chrom, isle ORDER BY pos, rec) AS i, {{'rec': rec, 'pos': pos, 'fin': fin, 'rl': length(ref), 'alt': alt, 'kind': kind, 'score': score, 'letter': letter}} AS own FROM g),
 fold AS (SELECT chrom, isle, i, [own] AS st FROM n WHERE i = 1 UNION ALL
  SELECT chrom, isle, i, CASE WHEN letter <> 'U' THEN list_append(st, own) ELSE list_append(list_transform(st2, lambda x, k: {made("CASE WHEN " + rival + " AND (halt IS NULL OR k < halt) THEN mark ELSE x.letter END")}),
    {{'rec': own.rec, 'pos': own.pos, 'fin': own.fin, 'rl': own.rl, 'alt': own.alt, 'kind': own.kind, 'score': own.score, 'letter': CASE WHEN halt IS NOT NULL THEN mark WHEN gapped AND NOT same THEN 'G' ELSE 'U' END}}) END
  FROM (SELECT *, list_position(list_transform(st2, lambda x: {rival} AND floor(x.score) >= score), true) AS halt, CASE WHEN kind = 3 THEN 'g' ELSE 'M' END AS mark FROM (
   SELECT *, list_transform(st, lambda x: {made("CASE WHEN kind = 3 AND x.kind <> 3 AND x.letter = 'U' AND x.fin + 3 >= pos OR gapped AND same AND x.rec = gap.rec THEN 'G' ELSE x.letter END")}) AS st2 FROM (
    SELECT *, gap IS NOT NULL AS gapped, coalesce(length(gap.alt) - gap.rl = 1 AND gap.pos + length(gap.alt) - 1 = pos AND right(gap.alt, 1) = left(alt, 1), false) AS same FROM (
     SELECT n.*, st, CASE WHEN n.kind <> 3 THEN list_filter(st, lambda x: x.kind = 3 AND x.fin + 3 >= n.pos)[1] END AS gap FROM fold JOIN n ON fold.chrom = n.chrom AND fold.isle = n.isle AND n.i = fold.i + 1) a) b) c) d),
 whole AS (SELECT chrom, unnest(st) AS x FROM (SELECT chrom, isle, max_by(st, i) AS st FROM fold GROUP BY chrom, isle))
 SELECT chrom, x.pos AS pos, x.letter AS letter FROM whole"""


@query(_legacy_sql())
def legacy_filter(spark, sf_dir):
    """All gates, and neighbours in order of reading; sites with two ALTs are made MNPs, which reach their neighbours."""
    v = variants(spark, sf_dir)
    two, src, rec = F.col("kind") == 3, F.col("src"), F.col("rec")
    alt = lambda k, tail: F.concat(F.get("alts", F.lit(k)), F.lit(tail))
    rows = v.withColumns({
        "ref": F.when(two, F.concat("ref", F.lit("ACG"))).otherwise(F.col("ref")), "alts": F.when(two, F.array(alt(0, "ACG"), alt(1, "TTT"))).otherwise(F.col("alts")),
        "dp": src % 50, "mq": src % 37, "dp4": F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), src % 9), "pv4": F.array(*[(src % 29) / 10000.0] * 4),
        "g3": F.array((rec % 9) / 20.0, (rec % 7) / 10.0, F.lit(0.0)), "hwe": (rec % 13) / 10000.0,
    })
    return filters.legacy_gates(rows, min_depth=3, max_depth=45, min_quality=3, bias=(2e-4,) * 4).select(*SITE, "letter")


# --- joins ---------------------------------------------------------------------


@query(f"""WITH {_S} SELECT chrom, pos, rec % 3 = 0 AS known FROM s""")
def known_positions(spark, sf_dir):
    v = variants(spark, sf_dir)
    return joins.mark_known(v, v.filter("rec % 3 = 0").unionByName(v.filter("rec % 6 = 0"))).select(*SITE, "known")


@query(f"""WITH {_S} SELECT chrom, pos, src / 1000.0 AS af FROM s WHERE rec % 3 <> 0 AND rec % 4 <> 0""")
def frequencies_of_source(spark, sf_dir):
    """Frequencies by exactly the same alleles: the source lacks some sites and has other ALTs at others."""
    v = variants(spark, sf_dir)
    source = v.filter("rec % 3 <> 0").withColumns({"af": F.col("src") / 1000.0, "alts": F.when(F.col("rec") % 4 == 0, F.array(F.lit("<DEL>"))).otherwise(F.col("alts"))})
    return joins.allele_frequencies(v.select(*SITE, "ref", "alts"), source).select(*SITE, "af")


@query(f"""WITH {_S}, {_G}, {_PL}, l AS (SELECT chrom, pos, string_agg(p2 || ',' || p1 || ',' || p0, ' ' ORDER BY sample) AS pl FROM pl GROUP BY chrom, pos)
 SELECT s.chrom AS chrom, s.pos AS pos, CASE WHEN s.rec % 2 = 0 THEN alt ELSE ref END AS ref, CASE WHEN s.rec % 2 = 0 THEN ref ELSE alt END AS alts,
 CASE WHEN s.rec % 2 = 0 THEN pl ELSE (SELECT string_agg(p0 || ',' || p1 || ',' || p2, ' ' ORDER BY sample) FROM pl WHERE pl.chrom = s.chrom AND pl.pos = s.pos) END AS pl
 FROM s LEFT JOIN l ON s.chrom = l.chrom AND s.pos = l.pos WHERE kind = 0 AND s.rec % 3 <> 0""")
def target_calls(spark, sf_dir):
    """Targets whose alleles are exchanged at every other site: likelihoods follow; targets without data come with none."""
    v = variants(spark, sf_dir).filter("kind = 0")
    rows = likelihoods(spark, sf_dir).groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample", "pl"))).alias("s"))
    data = v.join(rows, SITE).select(*SITE, "ref", "alts", F.transform("s", lambda x: x["pl"]).alias("pls"))
    want = F.when(F.col("rec") % 2 == 0, F.array("alt", "ref")).otherwise(F.array("ref", "alt"))
    out = calling.constrained_to_targets(data, v.filter("rec % 3 <> 0").select(*SITE, want.alias("alleles")), insert_missed=True)
    text = F.array_join(F.transform("pls", lambda p: F.array_join(F.transform(p, lambda x: x.cast("int").cast("string")), ",")), " ")
    return out.select(*SITE, "ref", F.array_join("alts", ",").alias("alts"), text.alias("pl"))


# --- statistics ------------------------------------------------------------------


@query(f"""WITH {_S}, {_I}, x AS (SELECT chrom, pos, length(ref) - length(alt) AS lost, length(alt) - length(ref) AS n FROM s WHERE kind IN (1, 2)),
 h AS (SELECT x.chrom AS chrom, x.pos AS pos, any_value(lost) AS lost, any_value(n) AS n, arg_min(from1, name) AS from1, arg_min(to1, name) AS to1 FROM x LEFT JOIN iv ON iv.chrom = x.chrom AND x.pos <= to1 AND x.pos + greatest(lost, 0) >= from1 GROUP BY x.chrom, x.pos),
 k AS (SELECT CASE WHEN from1 IS NULL THEN 0 WHEN n > 0 THEN n ELSE least(pos + lost, to1) - greatest(pos + 1, from1) + 1 END AS k FROM h)
 SELECT count(*) FILTER (k > 0 AND k % 3 = 0) AS in_frame, count(*) FILTER (k > 0 AND k % 3 <> 0) AS out_of_frame, count(*) FILTER (k <= 0) AS not_applicable,
 count(*) FILTER (k > 0 AND k % 3 <> 0) / CAST(nullif(count(*) FILTER (k > 0), 0) AS DOUBLE) AS share FROM k""")
def frameshift_counts(spark, sf_dir):
    return annotate.frameshifts(variants(spark, sf_dir), intervals(spark, sf_dir))


@query(f"""WITH {_G}, {_TWO}, {_PAIR} SELECT chrom, pos, sample, gx, gy FROM p WHERE gx <> gy""")
def genotype_mismatches(spark, sf_dir):
    return stats.mismatches(*two_sets(spark, sf_dir))


@query(f"""WITH {_G}, {_TWO}, {_PAIR}, f AS (SELECT chrom, pos, CAST(least(9, floor(10.0 * sum(a + b) / (2 * count(*)))) AS INTEGER) AS bin FROM g GROUP BY chrom, pos),
 q AS (SELECT p.*, bin FROM p JOIN f ON p.chrom = f.chrom AND p.pos = f.pos), c AS (SELECT bin, count(*) FILTER (gx = gy AND gx = 0) AS rr, count(*) FILTER (gx = gy AND gx = 1) AS ra,
 count(*) FILTER (gx = gy AND gx = 2) AS aa, count(*) FILTER (gx <> gy) AS mismatch FROM q GROUP BY bin),
 t AS (SELECT chrom, pos, bin, count(*) AS n, sum(gx) AS sx, sum(gy) AS sy, sum(gx * gx) AS sxx, sum(gy * gy) AS syy, sum(gx * gy) AS sxy FROM q GROUP BY chrom, pos, bin),
 r AS (SELECT bin, CASE WHEN n * sxx = sx * sx OR n * syy = sy * sy THEN 1.0 ELSE CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE) END AS r2 FROM t),
 m AS (SELECT bin, round(avg(r2), 6) AS r2, count(*) AS sites FROM r GROUP BY bin)
 SELECT c.bin AS bin, rr, ra, aa, mismatch, round(CASE WHEN ra + aa + mismatch = 0 THEN 0.0 ELSE 100.0 * mismatch / CAST(ra + aa + mismatch AS DOUBLE) END, 6) AS nrd, r2, sites FROM c JOIN m ON c.bin = m.bin""")
def concordance_by_frequency(spark, sf_dir):
    x, y = two_sets(spark, sf_dir)
    out = stats.concordance_by_frequency(x, y)
    return out.withColumns({"nrd": F.round(F.col("nrd").cast("double"), 6), "r2": F.round("r2", 6)})


_ERR = f"""{_G}, {_PL}, e AS (SELECT x.sample AS i, y.sample AS j, least(x.p0 + y.p0, x.p1 + y.p1, x.p2 + y.p2) AS d FROM pl x JOIN pl y ON x.chrom = y.chrom AND x.pos = y.pos AND y.sample < x.sample),
 c AS (SELECT i, j, count(*) AS sites, CAST(sum(d) AS DOUBLE) AS score, sum(d) / CAST(count(*) AS DOUBLE) AS average FROM e GROUP BY i, j)"""


@query(f"""WITH {_ERR} SELECT *, CAST(row_number() OVER (ORDER BY average DESC, i, j) - 1 AS INTEGER) AS rank FROM c""")
def likelihood_pairs(spark, sf_dir):
    """Two samples at a time: the least sum of likelihoods over genotypes, site by site; the worst pair first."""
    return stats.likelihood_discordance(likelihoods(spark, sf_dir), width=2)


@query(f"""WITH {_ERR}, b AS (SELECT i AS sample, j AS other, average FROM c UNION ALL SELECT j, i, average FROM c)
 SELECT sample, round(avg(average), 6) AS average, max(average) AS largest, arg_min(other, average) AS nearest FROM b GROUP BY sample""")
def sample_averages(spark, sf_dir):
    out = stats.sample_discordance(stats.likelihood_discordance(likelihoods(spark, sf_dir)))
    return out.withColumn("average", F.round("average", 6))


@query(f"""WITH {_S}, x AS (SELECT floor(qual) AS score, kind IN (0, 3) AS good FROM s), c AS (SELECT score, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM x GROUP BY score),
 r AS (SELECT score, sum(g) OVER (ORDER BY score DESC) AS goods, sum(b) OVER (ORDER BY score DESC) AS bads, sum(g) OVER () AS tg, sum(b) OVER () AS tb FROM c)
 SELECT CAST(score AS DOUBLE) AS score, CAST(goods AS BIGINT) AS goods, CAST(bads AS BIGINT) AS bads, goods / CAST(tg AS DOUBLE) AS true_rate, bads / CAST(tb AS DOUBLE) AS false_rate FROM r""")
def score_roc(spark, sf_dir):
    rows = variants(spark, sf_dir).select(F.floor("qual").cast("double").alias("score"), (F.col("mask") == gen.SNP).alias("good"))
    return stats.roc(rows, size=16)


_H = "number of SNPs\tnumber of transitions\tnumber of transversions\tnumber of indels\trepeat-consistent\trepeat-inconsistent\tnot applicable"
_HEADINGS = {
    "SN": "id\tkey\tvalue", "TSTV": "id\tts\ttv\tts/tv\tts (1st ALT)\ttv (1st ALT)\tts/tv (1st ALT)", "SiS": f"id\tallele count\t{_H}", "AF": f"id\tallele frequency\t{_H}",
    "QUAL": "id\tQuality\tnumber of SNPs\tnumber of transitions (1st ALT)\tnumber of transversions (1st ALT)\tnumber of indels", "USR:price": "id\tprice\tnumber of SNPs\tnumber of transitions (1st ALT)\tnumber of transversions (1st ALT)",
    "IDD": "id\tlength (deletions negative)\tcount", "ST": "id\ttype\tcount", "DP": "bin\tnumber of genotypes\tfraction of genotypes (%)",
    "PSC": "sample\tnRefHom\tnNonRefHom\tnHets\tnTransitions\tnTransversions\tnIndels\taverage depth\tnSingletons", "ENDS": "chrom\ttop",
}
_TAB = lambda *cells: "concat_ws(chr(9), " + ", ".join(cells) + ")"
_AT = "CASE WHEN ac = 1 THEN 0 WHEN an = 0 THEN 1 ELSE 1 + CAST(floor(ac * 99 / an) AS INTEGER) END"


@query(f"""WITH {_S}, {_G}, {_L}, {_SNPS}, c AS (SELECT chrom, pos, sum(a + b) AS ac, 2 * count(*) AS an, sum(CASE WHEN a + b > 0 THEN 1 ELSE 0 END) AS carriers FROM g GROUP BY chrom, pos),
 v AS (SELECT s.*, filter AS id2, {_MASK} AS mask, CAST(least(floor(qual), 998) AS INTEGER) AS level FROM s), w AS (SELECT DISTINCT filter FROM s),
 x AS (SELECT n.*, CASE WHEN nth = 0 THEN coalesce(c.ac, 0) ELSE 0 END AS ac, coalesce(an, 0) AS an, CAST(least(floor(qual), 998) AS INTEGER) AS level FROM n LEFT JOIN c ON n.chrom = c.chrom AND n.pos = c.pos),
 d AS (SELECT s.filter AS filter, length(alt) - length(ref) AS size, coalesce(c.ac, 0) AS ac, coalesce(an, 0) AS an FROM s LEFT JOIN c ON s.chrom = c.chrom AND s.pos = c.pos WHERE kind IN (1, 2)),
 b AS (SELECT filter, bin, sum(ts) AS ts, sum(tv) AS tv, sum(gap) AS gap FROM (SELECT filter, {_AT} AS bin, CAST(ts AS INT) AS ts, CAST(NOT ts AS INT) AS tv, 0 AS gap FROM x UNION ALL SELECT filter, {_AT}, 0, 0, 1 FROM d) u GROUP BY filter, bin),
 t AS (SELECT filter, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv, count(*) FILTER (ts AND nth = 0) AS ts1, count(*) FILTER (NOT ts AND nth = 0) AS tv1 FROM x GROUP BY filter),
 p AS (SELECT g.*, kind IN (0, 3) AS snp, s.ref AS ref, s.alt AS alt, carriers, abs(instr('ACGT', s.ref) - instr('ACGT', s.alt)) = 2 AS its FROM g JOIN s ON g.chrom = s.chrom AND g.pos = s.pos JOIN c ON g.chrom = c.chrom AND g.pos = c.pos)
 SELECT unnest({list(_HEADINGS)}) AS section, replace(unnest({['# ' + h for h in _HEADINGS.values()]}), '\\t', chr(9)) AS row
 UNION ALL SELECT 'SN', {_TAB('filter', "k", "CAST(n AS VARCHAR)")} FROM (SELECT filter, unnest(['number of samples:', 'number of SNPs:', 'number of MNPs:', 'number of indels:', 'number of others:', 'number of multiallelic sites:', 'number of multiallelic SNP sites:']) AS k,
  unnest([7, count(*) FILTER (mask = 1), 0, count(*) FILTER (mask = 2), 0, count(*) FILTER (kind = 3), count(*) FILTER (kind = 3)]) AS n FROM v GROUP BY filter)
 UNION ALL SELECT 'TSTV', {_TAB('filter', 'ts', 'tv', "printf('%.2f', CASE WHEN tv = 0 THEN 0 ELSE ts / tv END)", 'ts1', 'tv1', "printf('%.2f', CASE WHEN tv1 = 0 THEN 0 ELSE ts1 / tv1 END)")} FROM t
 UNION ALL SELECT 'SiS', {_TAB('w.filter', "'1'", 'coalesce(ts + tv, 0)', 'coalesce(ts, 0)', 'coalesce(tv, 0)', 'coalesce(gap, 0)', "'0'", "'0'", 'coalesce(gap, 0)')} FROM w LEFT JOIN b ON w.filter = b.filter AND bin = 0
 UNION ALL SELECT 'AF', {_TAB('filter', "printf('%f', 100.0 * (greatest(bin, 1) - 1) / 100)", 'sum(ts + tv)', 'sum(ts)', 'sum(tv)', 'sum(gap)', "'0'", "'0'", 'sum(gap)')} FROM b GROUP BY filter, greatest(bin, 1)
 UNION ALL SELECT 'QUAL', {_TAB('v.filter', 'v.level', 'v.a', 'coalesce(q.a, 0)', 'coalesce(q.b, 0)', 'v.b')} FROM (SELECT filter, level, count(*) FILTER (mask = 1) AS a, count(*) FILTER (mask = 2) AS b FROM v GROUP BY filter, level) v
  LEFT JOIN (SELECT filter, level, count(*) FILTER (ts) AS a, count(*) FILTER (NOT ts) AS b FROM x WHERE nth = 0 GROUP BY filter, level) q ON v.filter = q.filter AND v.level = q.level
 UNION ALL SELECT 'USR:price', {_TAB('filter', "printf('%e', 10.0 + 390.0 * bin / 20)", 'ts + tv', 'ts', 'tv')} FROM (SELECT filter, CAST(floor((greatest(10, least(400, CAST(qual AS DOUBLE))) - 10) / 390 * 20) AS INTEGER) AS bin, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv FROM x WHERE nth = 0 GROUP BY 1, 2)
 UNION ALL SELECT 'IDD', {_TAB('filter', 'size', 'count(*)')} FROM d GROUP BY filter, size
 UNION ALL SELECT 'ST', {_TAB('w.filter', "r.b || '>' || a.b", '(SELECT count(*) FROM x WHERE x.filter = w.filter AND x.ref = r.b AND x.one = a.b)')} FROM w, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) r, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) a WHERE r.b <> a.b
 UNION ALL SELECT 'DP', {_TAB("CASE WHEN dp >= 40 THEN '>40' ELSE CAST(dp // 5 * 5 AS VARCHAR) END", 'count(*)', "printf('%.6f', count(*) * 100.0 / (SELECT count(*) FROM g))")} FROM g GROUP BY CASE WHEN dp >= 40 THEN '>40' ELSE CAST(dp // 5 * 5 AS VARCHAR) END
 UNION ALL SELECT 'PSC', {_TAB('sample', 'count(*) FILTER (snp AND a + b = 0)', 'count(*) FILTER (snp AND a + b = 2)', 'count(*) FILTER (snp AND a <> b)', 'count(*) FILTER (snp AND a + b > 0 AND its)', 'count(*) FILTER (snp AND a + b > 0 AND NOT its)',
   'count(*) FILTER (NOT snp AND a + b > 0)', "printf('%.1f', sum(dp) / count(*))", 'count(*) FILTER (a + b > 0 AND carriers = 1)')} FROM p GROUP BY sample
 UNION ALL SELECT 'ENDS', {_TAB('chrom', 'max(pos)')} FROM s GROUP BY chrom""")
def statistics_sections(spark, sf_dir):
    """All sections from one call, sets by FILTER; counts of alleles are those of the genotypes."""
    g = genotypes(spark, sf_dir)
    counts = g.groupBy(*SITE).agg(F.sum(F.col("a") + F.col("b")).alias("n"), (2 * F.count("*")).alias("an"))
    v = variants(spark, sf_dir).withColumnsRenamed({"id": "name"}).withColumns({"id": F.col("filter"), "price": F.col("qual").cast("double")}).join(counts, SITE, "left")
    ac = F.transform("alts", lambda a, k: F.when(k == 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)))
    v = v.withColumns({"ac": ac, "an": F.coalesce("an", F.lit(0))})
    ends = {"ENDS": v.groupBy("chrom").agg(F.max("pos").alias("top"))}
    return stats.report(v, n_samples=7, genotypes=g, user={"price": (10, 400, 21)}, depth=(0, 40, 5), more=ends)


@query()
def repeat_context(spark, sf_dir):
    """Indels by the repeat that follows; tests hold it against brute force. The reference is drawn from the contigs' sites."""
    v = variants(spark, sf_dir)
    return stats.repeat_context(v, reference_of(v, 1000))


def reference_of(v: DataFrame, chunk: int) -> DataFrame:
    """Chunks of a made-up reference that repeats each contig's number in bases: (chrom, chunk, seq) where there are sites."""
    here = v.select("chrom", F.floor(F.col("pos") / chunk).alias("chunk"))
    every = here.unionByName(here.withColumn("chunk", F.col("chunk") + 1)).distinct()
    unit = F.substr(F.lit("ACACGTTTGCA"), F.lit(1), F.col("chrom") + 2)
    return every.withColumn("seq", F.substr(F.repeat(unit, chunk), F.lit(1), F.lit(chunk)))


# --- order and reference -----------------------------------------------------------


@query(f"""WITH {_S}, x AS (SELECT chrom, pos, CASE WHEN rec % 1000 = 7 THEN rec - 40 ELSE rec END AS place, rec FROM s), o AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY place, rec % 1000) AS before FROM x)
 SELECT chrom, pos FROM o WHERE pos < before""")
def order_breaks(spark, sf_dir):
    """Files of one contig each, in which every thousandth record was moved forward by forty: what comes after a later position."""
    v = variants(spark, sf_dir).withColumn("at", F.when(F.col("rec") % 1000 == 7, F.col("rec") - 40).otherwise(F.col("rec")))
    v = v.withColumn("rec", F.col("chrom").cast("long") * (1 << 40) + F.col("at") * 1000 + F.col("rec") % 1000)
    return ranges.order_breaks(v.select(*SITE, "rec"), size=1 << 22).select(*SITE)


@query(f"""WITH {_S}, x AS (SELECT chrom, pos, ref, alt, substr(repeat(substr('ACACGTTTGCA', 1, chrom + 2), 1000), CAST((pos - 1) % 1000 + 1 AS INTEGER), 1) AS seen FROM s WHERE kind = 0)
 SELECT chrom, pos, ref = seen AS ref_ok, seen AS fixed, CASE WHEN ref = seen THEN alt WHEN alt = seen THEN ref ELSE alt END AS alts FROM x""")
def reference_check(spark, sf_dir):
    """REF against the reference: a flag, and what fixing gives."""
    v = variants(spark, sf_dir).filter("kind = 0").select(*SITE, "ref", "alts")
    ref = reference_of(v.withColumn("pos", F.col("pos") - 1), 1000)
    fixed = reshape.check_ref(v, ref, "fix").select(*SITE, F.col("ref").alias("fixed"), F.get("alts", F.lit(0)).alias("alts"))
    return reshape.check_ref(v, ref, "warn").select(*SITE, "ref_ok").join(fixed, SITE)


@query()
def left_aligned(spark, sf_dir):
    """Deletions of what the reference has at each site, moved left; tests hold it against plain forms."""
    v = variants(spark, sf_dir).filter("kind = 2").select(*SITE, "rec", "span")
    ref = reference_of(v.withColumn("pos", F.col("pos") - 1), 1000)
    own = v.withColumn("chunk", F.floor((F.col("pos") - 1) / 1000)).join(ref, ["chrom", "chunk"])
    base = F.substr("seq", ((F.col("pos") - 1) % 1000 + 1).cast("int"), F.col("span"))
    return reshape.left_align(own.select(*SITE, "rec", base.alias("ref"), F.array(F.substr(base, F.lit(1), F.lit(1))).alias("alts")), ref)


@query(f"""WITH RECURSIVE {LIGATED}, kept AS (SELECT chrom, k, pos FROM site WHERE NOT coalesce(before, false) AND NOT coalesce(after, false) UNION ALL SELECT chrom, CASE WHEN later THEN k + 1 ELSE k END, pos FROM pairs)
 SELECT num.sample AS sample, num.chrom AS chrom, num.pos AS pos, CASE WHEN swapped THEN b ELSE a END AS a, CASE WHEN swapped THEN a ELSE b END AS b, phased OR swapped AS phased, ps AS phase_set,
 CASE WHEN num.pos = second THEN q END AS quality FROM num JOIN kept ON num.chrom = kept.chrom AND num.k = kept.k AND num.pos = kept.pos JOIN st ON num.sample = st.sample AND num.chrom = st.chrom AND num.k = st.k""")
def ligated_rows(spark, sf_dir):
    """The files as one call set with phase sets."""
    return sequence.ligated_rows(phased_files(spark, sf_dir))


@query(f"""WITH {_S} SELECT chrom, pos, chrom || chr(9) || pos || chr(9) || ref || chr(9) || alt || CASE WHEN alt2 IS NULL THEN '' ELSE ',' || alt2 END || chr(9) || CASE WHEN kind IN (1, 2) THEN 'INDEL' ELSE 'SNP' END
 || chr(9) || coalesce(alt2, '.') || chr(9) || filter || chr(9) || coalesce(id, '.') AS line FROM s""")
def listed_lines(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("filters", F.array("filter"))
    return lines.format_lines(v, ["CHROM", "POS", "REF", "ALT", "TYPE", "alts{1}", "FILTER", "ID"])


# --- models --------------------------------------------------------------------------


@query(f"""WITH {_G}, {_PL} SELECT chrom, pos, string_agg(CASE WHEN p0 > 0 OR p1 <> p0 OR p2 <> p0 OR p1 > 0 OR p2 > 0 THEN '0/0' ELSE './.' END, ' ' ORDER BY sample) AS gt FROM pl GROUP BY chrom, pos""")
def reference_genotypes(spark, sf_dir):
    rows = likelihoods(spark, sf_dir).groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample", "pl"))).alias("s"))
    return rows.select(*SITE, F.array_join(calling.reference_genotypes(F.transform("s", lambda x: x["pl"])), " ").alias("gt"))


@query(f"""WITH {_G}, c AS (SELECT chrom, pos, count(*) AS n, CAST(sum(a + b) AS DOUBLE) AS alt, 2.0 * count(*) - sum(a + b) AS ref, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS hets FROM g GROUP BY chrom, pos),
 q AS (SELECT *, 2 * ref * alt / ((ref + alt) * (ref + alt)) AS q, CAST(floor(2 * ref * alt / ((ref + alt) * (ref + alt)) * n) AS INTEGER) AS mid FROM c),
 r AS (SELECT *, CASE WHEN hets >= mid THEN 1 ELSE -1 END * list_sum(list_transform(range(least(mid, hets) + 1, greatest(mid, hets) + 1), lambda k: ln((n - k + 1) / CAST(k AS DOUBLE) * q / (1 - q)))) AS lr FROM q)
 SELECT chrom, pos, CASE WHEN ref > 0 AND alt > 0 THEN round(exp(coalesce(lr, 0)), 6) END AS icb, CASE WHEN ref > 0 AND alt > 0 THEN round(abs(hets / CAST(n AS DOUBLE) - q), 6) END AS hob FROM r""")
def inbreeding(spark, sf_dir):
    d = F.col("a") + F.col("b")
    c = genotypes(spark, sf_dir).groupBy(*SITE).agg(F.count("*").alias("n"), F.sum(d).alias("alt"), (2 * F.count("*") - F.sum(d)).alias("ref"), F.count_if(F.col("a") != F.col("b")).alias("hets"))
    icb, hob = calling.inbreeding(F.col("ref"), F.col("alt"), F.col("hets"), F.col("n"))
    return c.select(*SITE, F.round(icb, 6).alias("icb"), F.round(hob, 6).alias("hob"))


_TRIOS = ", ".join(f"({f}, {m}, {c}, {p}::DOUBLE)" for f, m, c, p in calling.trio_table(2))


@query(f"""WITH {_P}, l AS (SELECT chrom, pos, sample, [ln(x), ln(y), ln(z)] AS g FROM w), t AS (SELECT f.chrom AS chrom, f.pos AS pos, f.g AS f, m.g AS m, c.g AS c FROM l f JOIN l m ON f.chrom = m.chrom AND f.pos = m.pos AND m.sample = 2
 JOIN l c ON f.chrom = c.chrom AND f.pos = c.pos AND c.sample = 3 WHERE f.sample = 1), v AS (SELECT * FROM (VALUES {_TRIOS}) v(vf, vm, vc, p)),
 s AS (SELECT chrom, pos, vf, vm, vc, round(f[vf + 1] + m[vm + 1] + c[vc + 1] + ln(1 - 0.9 * (1 - p)), 9) AS lk FROM t, v),
 b AS (SELECT chrom, pos, arg_max(vf || '' || vm || vc, (lk, -vf, -vm, -vc)) AS best, max(lk) AS lk FROM s GROUP BY chrom, pos),
 u AS (SELECT chrom, pos, list_position(f, list_max(f)) - 1 AS uf, list_position(m, list_max(m)) - 1 AS um, list_position(c, list_max(c)) - 1 AS uc, list_max(f) + list_max(m) + list_max(c) + ln(1 - 0.9) AS lk FROM t)
 SELECT u.chrom AS chrom, u.pos AS pos, uf || '' || um || uc AS unconstrained, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE vf = uf AND vm = um AND vc = uc) AND u.lk > b.lk THEN uf || '' || um || uc ELSE best END AS constrained,
 NOT EXISTS (SELECT 1 FROM v WHERE vf = uf AND vm = um AND vc = uc) AND u.lk > b.lk AS de_novo FROM u JOIN b ON u.chrom = b.chrom AND u.pos = b.pos""")
def trio_calls(spark, sf_dir):
    """Samples 1 to 3 as father, mother and child, with Mendel trusted to nine tenths."""
    p = calling.pl_to_prob(F.col("pl"))
    g = likelihoods(spark, sf_dir).filter("sample <= 3").select(*SITE, "sample", F.transform(p, F.ln).alias("g"))
    rows = g.groupBy(*SITE).agg(*[F.max(F.when(F.col("sample") == k, F.col("g"))).alias(n) for k, n in enumerate(("father", "mother", "child"), 1)])
    out = calling.call_trios(rows.filter("father is not null and mother is not null and child is not null"), mendel=0.9)
    return out.select(*SITE, F.array_join("unconstrained", "").alias("unconstrained"), F.array_join("constrained", "").alias("constrained"), "de_novo")


@query()
def consensus_calls(spark, sf_dir):
    """Frequencies, their posterior, departure from Hardy-Weinberg and genotypes; tests hold it against sums over all genotypes."""
    rows = likelihoods(spark, sf_dir).groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample", "pl"))).alias("s"))
    out = calling.consensus_call(rows.select(F.struct(*SITE).alias("key"), F.transform("s", lambda x: x["pl"]).alias("pls")))
    return out.select("key.*", F.round("af1", 6).alias("af1"), "ac1", F.round("qual", 4).alias("qual"), F.round("fq", 4).alias("fq"), "is_variant", F.array_join("genotypes", " ").alias("genotypes"))


@query(f"""WITH RECURSIVE {_P}, d AS (SELECT chrom, pos, list(x ORDER BY sample) AS x, list(y ORDER BY sample) AS y, list(z ORDER BY sample) AS z, CAST(count(*) AS INTEGER) AS n FROM w GROUP BY chrom, pos),
 r AS (SELECT chrom, pos, n, 0 AS t, [CAST(1.0 AS DOUBLE)] AS l, x, y, z FROM d
  UNION ALL SELECT chrom, pos, n, t + 1, list_transform(range(1, len(l) + 3), lambda k: coalesce(l[k], 0) * x[t + 1] + CASE WHEN k > 1 THEN 2 * coalesce(l[k - 1], 0) * y[t + 1] ELSE 0 END + CASE WHEN k > 2 THEN l[k - 2] * z[t + 1] ELSE 0 END), x, y, z FROM r WHERE t < n),
 k AS (SELECT chrom, pos, 2 * n AS m, list_transform(l, lambda v, i: v * CAST(factorial(CAST(i - 1 AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(2 * n - i + 1 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(2 * n AS INTEGER)) AS DOUBLE)) AS l,
  1 - 0.001 * list_sum(list_transform(range(1, 2 * n + 1), lambda j: 1.0 / j)) AS p0 FROM r WHERE t = n),
 p AS (SELECT *, list_transform(l, lambda v, i: v * CASE WHEN i = 1 THEN p0 ELSE 0.001 / (i - 1) END) AS a,
  list_transform(l, lambda v, i: v * (CASE WHEN i = 1 THEN p0 ELSE 0.001 / (i - 1) END + CASE WHEN i = m + 1 THEN p0 ELSE 0.001 / (m + 1 - i) END) / 2) AS b FROM k),
 o AS (SELECT *, list_sum(a) AS s, (b[1] + b[m + 1]) / list_sum(b) AS alike FROM p)
 SELECT chrom, pos, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS ac1, round(a[1] / s, 8) AS p_ref, round(CASE WHEN alike < 0.5 THEN least(999, -4.343 * ln(alike)) ELSE -least(999, -4.343 * ln(1 - alike)) END, 4) AS fq,
 list_filter(range(0, m + 1), lambda i: list_sum(a[1:i + 1]) > 0.025 * s)[1] / m AS ci_low, list_filter(range(m, -1, -1), lambda i: list_sum(a[i + 1:]) > 0.025 * s)[1] / m AS ci_high FROM o""")
def allele_count_posterior(spark, sf_dir):
    """The best allele count, the chance of none, the folded quality and the interval of the frequency."""
    rows = likelihoods(spark, sf_dir).groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample", "pl"))).alias("s"))
    out = calling.consensus_call(rows.select(F.struct(*SITE).alias("key"), F.transform("s", lambda x: x["pl"]).alias("pls")))
    return out.select("key.*", "ac1", F.round("p_ref", 8).alias("p_ref"), F.round("fq", 4).alias("fq"), "ci_low", "ci_high")


@query()
def strand_bias(spark, sf_dir):
    """Counts by strand and sums of qualities of each site's rows; tests hold the tests against plain forms."""
    g = genotypes(spark, sf_dir)
    alt, forward = F.col("a") == 1, F.col("phased")
    count = lambda c: F.count_if(c).cast("double")
    sums = [count(~alt & forward), count(~alt & ~forward), count(alt & forward), count(alt & ~forward)]
    for value in (F.col("dp"), F.col("gq") / 1000, F.col("sample") * 10):
        v = value.cast("double")
        for side in (~alt, alt):
            sums += [F.sum(F.when(side, v).otherwise(0.0)), F.sum(F.when(side, v * v).otherwise(0.0))]
    rows = g.groupBy(*SITE).agg(F.array(*sums).alias("i16"))
    out = calling.bias_tests(rows)
    return out.select(*SITE, F.array_join("dp4", ",").alias("dp4"), "mq", *[F.round(F.get("pv4", F.lit(k)), 6).alias(f"p{k}") for k in range(4)])


def _carried(number: int) -> str:
    """How many sample alleles of a merged row have this number."""
    one = lambda k, j: f"((src + {k} + {j}) % 2 + CASE WHEN rec % 11 = 0 OR {j == 1} AND (src + {k}) % 5 = 0 THEN 0 ELSE (rec + {j} * {k}) % 2 END)"
    of = lambda k: f"{one(k, 0)} + {one(k, 1)}"
    first = f"CASE WHEN own = 3 THEN {of(3)} ELSE {of(0)} END"
    return " + ".join(f"CASE WHEN f{k} = 1 AND m{k} = {number} THEN {first if k == 0 else of(k)} ELSE 0 END" for k in range(3))


@query(f"""WITH {_S}, {MERGED_ROWS}, c AS (SELECT *, {_carried(1)} AS one, {_carried(2)} AS two FROM m)
 SELECT chrom, pos, CAST(row AS INTEGER) AS row, CAST(CASE WHEN one = 0 AND two = 0 THEN NULL WHEN two > one THEN 2 ELSE 1 END AS INTEGER) AS top_alt, CAST(one + two AS BIGINT) AS carried FROM c""")
def merged_top_alleles(spark, sf_dir):
    """The ALT that most samples carry, and how many ALT alleles there are, by the genotypes of the merged record."""
    out = merge.merge_files(files_of_samples(spark, sf_dir), {}, "both", order="line", recount=True)
    return out.select(*SITE, "row", "top_alt", F.aggregate("ac", F.lit(0), lambda t, n: t + n).cast("long").alias("carried"))


@query("""SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY user_id""")
def user_totals(spark, sf_dir):
    """What a stream keeps as state of each user, read off the whole table."""
    return ev.latest_totals(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
