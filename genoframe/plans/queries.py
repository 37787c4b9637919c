"""The registered queries over the warehouse tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions import genetics as gen
from genoframe.operators import annotate, calling, consensus, filters, genotype, homozygosity, joins, merge, ranges, reshape, sequence, som, stats
from genoframe.sources.views import GENOTYPES, INTERVALS, SITES, genotypes, intervals, sites
from genoframe.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_S = f"s AS ({SITES})"
_G = f"g AS ({GENOTYPES})"
_I = f"iv AS ({INTERVALS})"
SITE = ["chrom", "pos"]
#: One row for each ALT, numbered from 0.
_L = "l AS (SELECT *, 0 AS nth, alt AS one FROM s UNION ALL SELECT *, 1 AS nth, alt2 AS one FROM s WHERE alt2 IS NOT NULL)"
_MASK = "CASE WHEN kind IN (1, 2) THEN 2 ELSE 1 END"
_TS = "abs(instr('ACGT', ref) - instr('ACGT', one)) = 2"
_SNPS = "n AS (SELECT *, " + _TS + " AS ts FROM l WHERE length(ref) = 1 AND length(one) = 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with ``alts``, ``mask``, ``span``, ``rec``."""
    s = sites(spark, sf_dir)
    alts = F.array_compact(F.array("alt", "alt2"))
    s = s.withColumn("alts", alts).withColumn("mask", gen.type_mask(F.col("ref"), F.col("alts")))
    longest = F.array_max(F.transform("alts", lambda a: F.length("ref") - F.length(a)))
    return s.withColumn("span", 1 + F.greatest(longest, F.lit(0)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- projections -----------------------------------------------------------


@query(f"""WITH {_S} SELECT chrom, pos, chrom || ':' || pos || ' ' || coalesce(id, '.') || ' ' || ref || '>' || alt || coalesce(',' || alt2, '') || ' '
 || CASE WHEN kind IN (1, 2) THEN 'INDEL' ELSE 'SNP' END || ' ' || CASE WHEN length(ref) = 1 AND length(alt) = 1 AND abs(instr('ACGT', ref) - instr('ACGT', alt)) = 2 THEN '1' ELSE '0' END AS line FROM s""")
def format_sites(spark, sf_dir):
    v = variants(spark, sf_dir)
    ts = F.when(gen.is_transition(F.col("ref"), F.get("alts", F.lit(0))) & (F.length("alt") == 1) & (F.length("ref") == 1), "1").otherwise("0")
    line = F.concat(
        F.col("chrom").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit(" "), F.coalesce("id", F.lit(".")), F.lit(" "), F.col("ref"), F.lit(">"),
        F.array_join("alts", ","), F.lit(" "), gen.type_names(F.col("mask")), F.lit(" "), ts,
    )
    return v.select("chrom", "pos", line.alias("line"))


@query(f"""WITH {_S}, {_G} SELECT g.chrom AS chrom, g.pos AS pos, string_agg(sample || '=' || a || CASE WHEN phased THEN '|' ELSE '/' END || b, ' ' ORDER BY sample) AS gt,
 string_agg(CASE WHEN a = 0 THEN ref ELSE alt END || CASE WHEN phased THEN '|' ELSE '/' END || CASE WHEN b = 0 THEN ref ELSE alt END, ' ' ORDER BY sample) AS tgt
 FROM g JOIN s ON g.chrom = s.chrom AND g.pos = s.pos GROUP BY g.chrom, g.pos""")
def format_samples(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir)).join(variants(spark, sf_dir), SITE)
    both = lambda s: F.array(s["a"], s["b"])
    gt = F.transform("samples", lambda s: F.concat(s["sample"].cast("string"), F.lit("="), gen.genotype_string(both(s), s["phased"])))
    alleles = F.concat(F.array("ref"), F.col("alts"))
    tgt = F.transform("samples", lambda s: gen.translated_genotype(both(s), s["phased"], alleles))
    return m.select("chrom", "pos", F.array_join(gt, " ").alias("gt"), F.array_join(tgt, " ").alias("tgt"))


@query(f"""WITH {_G} SELECT chrom, pos, CAST(2 * count(*) AS INTEGER) AS an, CAST(sum(a + b) AS INTEGER) AS ac FROM g GROUP BY chrom, pos""")
def fill_an_ac(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir))
    return m.select("chrom", "pos", genotype.allele_number(F.col("samples")).alias("an"), F.get(genotype.allele_counts(F.col("samples"), F.lit(1)), F.lit(0)).alias("ac"))


@query(f"""WITH {_G} SELECT chrom, pos, string_agg(sample || ':' || dp, ',' ORDER BY CASE sample WHEN 3 THEN 0 ELSE 1 END) AS kept,
 CAST(count(*) AS INTEGER) AS n FROM g WHERE sample IN (3, 1) GROUP BY chrom, pos""")
def subset_samples(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir)).withColumn("samples", genotype.subset_samples(F.col("samples"), [3, 1])).filter(F.size("samples") > 0)
    shown = F.transform("samples", lambda s: F.concat_ws(":", s["sample"].cast("string"), s["dp"].cast("string")))
    return m.select("chrom", "pos", F.array_join(shown, ",").alias("kept"), F.size("samples").alias("n"))


@query(f"""WITH {_S}, {_G}, h AS (SELECT chrom, pos, max(a) AS one, max(b) AS two, string_agg(a || '/' || b * 2, ' ' ORDER BY sample) AS old, string_agg(a || '/' || b, ' ' ORDER BY sample) AS new FROM g GROUP BY chrom, pos)
 SELECT s.chrom AS chrom, s.pos AS pos, CASE WHEN one = 1 AND two = 1 THEN alt || ',' || alt2 WHEN one = 1 THEN alt WHEN two = 1 THEN alt2 ELSE '' END AS kept,
 CASE WHEN one = 0 AND two = 1 THEN new ELSE old END AS gt, CASE WHEN one = 1 AND two = 1 THEN '0,1,2' WHEN one = 1 THEN '0,1' WHEN two = 1 THEN '0,2' ELSE '0' END AS r,
 CASE WHEN one = 1 AND two = 1 THEN '0,1,2,3,4,5' WHEN one = 1 THEN '0,1,2' WHEN two = 1 THEN '0,3,5' ELSE '0' END AS g
 FROM s JOIN h ON s.chrom = h.chrom AND s.pos = h.pos WHERE alt2 IS NOT NULL""")
def trim_unused_alts(spark, sf_dir):
    """Sites with two ALTs, of which ``a`` has the first and ``b`` the second: without a carrier an ALT goes, and genotypes and vectors are renumbered."""
    g = genotypes(spark, sf_dir).withColumn("b", F.col("b") * 2)
    m = genotype.matrix(g).join(variants(spark, sf_dir).filter("alt2 is not null"), SITE)
    m = m.withColumns({"r": F.array(*[F.lit(k) for k in range(3)]), "g": F.array(*[F.lit(k) for k in range(6)])})
    out = reshape.trim_unused(m, genotype.allele_counts(F.col("samples"), F.size("alts")), {"r": "R", "g": "G"})
    gt = F.transform("samples", lambda s: gen.genotype_string(F.array(s["a"], s["b"]), F.lit(False)))
    return out.select("chrom", "pos", F.array_join("alts", ",").alias("kept"), F.array_join(gt, " ").alias("gt"), F.array_join("r", ",").alias("r"), F.array_join("g", ",").alias("g"))


# --- filters ---------------------------------------------------------------


@query(f"""WITH {_S} SELECT chrom, pos, ref, alt, qual FROM s WHERE qual > 100 AND filter <> 'P' AND kind IN (0, 3) AND id IS NOT NULL""")
def filter_expression(spark, sf_dir):
    v = variants(spark, sf_dir)
    keep = (F.col("qual") > 100) & (F.col("filter") != "P") & (F.col("mask") == gen.SNP) & F.col("id").isNotNull()
    return filters.include(v, keep).select("chrom", "pos", "ref", "alt", "qual")


@query(f"""WITH {_S} SELECT count(*) AS n, count(*) FILTER (id IS NULL) AS unknown FROM s WHERE NOT coalesce(id LIKE '%7', false)""")
def exclude_keeps_missing(spark, sf_dir):
    v = filters.exclude(variants(spark, sf_dir), F.col("id").endswith("7"))
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("unknown"))


@query(f"""WITH {_G} SELECT chrom, pos, CAST(min(dp) AS DOUBLE) AS low, CAST(max(dp) AS DOUBLE) AS high, CAST(avg(dp) AS DOUBLE) AS mean FROM g GROUP BY chrom, pos
 HAVING max(CASE WHEN dp > 40 AND a <> b THEN 1 ELSE 0 END) = 1""")
def filter_any_sample(spark, sf_dir):
    m = filters.include(
        genotype.matrix(genotypes(spark, sf_dir)), filters.any_sample(F.col("samples"), lambda s: (s["dp"] > 40) & (s["a"] != s["b"]))
    )
    dp = lambda s: s["dp"]
    x = F.col("samples")
    return m.select("chrom", "pos", filters.minimum(x, dp).alias("low"), filters.maximum(x, dp).alias("high"), filters.average(x, dp).alias("mean"))


@query(f"""WITH {_G}, c AS (SELECT chrom, pos, sum(a + b) AS ac, 2 * count(*) AS an FROM g GROUP BY chrom, pos)
 SELECT chrom, pos, CAST(ac AS INTEGER) AS nref, CAST(an AS INTEGER) AS an FROM c WHERE ac >= 2 AND ac * 1.0 / an <= 0.6 AND least(ac, an - ac) >= 1""")
def filter_allele_counts(spark, sf_dir):
    c = genotype.with_counts(genotype.matrix(genotypes(spark, sf_dir)))
    minor = F.least("nref", F.col("an") - F.col("nref"))
    return c.filter((F.col("nref") >= 2) & (F.col("nref") / F.col("an") <= 0.6) & (minor >= 1)).select("chrom", "pos", "nref", "an")


@query(f"""WITH {_G} SELECT chrom, pos FROM g GROUP BY chrom, pos HAVING sum(CASE WHEN a + b > 0 AND sample IN (1, 2) THEN 1 ELSE 0 END) > 0
 AND sum(CASE WHEN a + b > 0 AND sample NOT IN (1, 2) THEN 1 ELSE 0 END) = 0""")
def filter_private(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir))
    return m.filter(filters.private(F.col("samples"), [1, 2])).select("chrom", "pos")


@query(f"""WITH {_G} SELECT chrom, pos, min(CASE WHEN phased THEN 1 ELSE 0 END) = 1 AS phased, max(CASE WHEN a <> b THEN 1 ELSE 0 END) = 1 AS any_het,
 max(CASE WHEN a = b THEN 1 ELSE 0 END) = 1 AS any_hom FROM g GROUP BY chrom, pos""")
def genotype_classes(spark, sf_dir):
    x = F.col("samples")
    return genotype.matrix(genotypes(spark, sf_dir)).select(
        "chrom", "pos",
        F.forall(x, lambda s: s["phased"]).alias("phased"),
        F.exists(x, genotype.is_het).alias("any_het"),
        F.exists(x, genotype.is_hom).alias("any_hom"),
    )


@query(f"""WITH {_S} SELECT chrom, pos, CASE WHEN qual > 50 THEN CASE WHEN filter = 'O' THEN 'PASS' ELSE filter END ELSE CASE WHEN filter = 'O' THEN 'low' ELSE filter || ';low' END END AS filters FROM s""")
def soft_filter(spark, sf_dir):
    """``O`` stands for an unset FILTER."""
    v = variants(spark, sf_dir).withColumn("filters", F.when(F.col("filter") != "O", F.array("filter")))
    out = filters.soft_filter(v, F.col("qual") > 50, "low", append=True)
    return out.select("chrom", "pos", F.array_join("filters", ";").alias("filters"))


@query(f"""WITH {_G} SELECT chrom, pos, string_agg(CASE WHEN dp >= 10 THEN a || '/' || b ELSE './.' END, ' ' ORDER BY sample) AS gt FROM g GROUP BY chrom, pos""")
def set_failed_genotypes(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir)).withColumn("samples", genotype.set_failed(F.col("samples"), lambda s: s["dp"] >= 10, None))
    return m.select("chrom", "pos", F.array_join(F.transform("samples", lambda s: gen.genotype_string(F.array(s["a"], s["b"]), F.lit(False))), " ").alias("gt"))


@query(f"""WITH {_S}, x AS (SELECT chrom, pos, kind, CASE WHEN kind = 2 THEN length(ref) ELSE 1 END AS span FROM s)
 SELECT chrom, pos FROM x WHERE kind IN (0, 3) AND EXISTS (SELECT 1 FROM x i WHERE i.chrom = x.chrom AND i.kind IN (1, 2)
 AND ((i.pos <= x.pos AND i.pos + i.span - 1 + 5 >= x.pos) OR (i.pos >= x.pos AND x.pos + 5 >= i.pos)))""")
def snp_gap(spark, sf_dir):
    v = variants(spark, sf_dir).withColumns({"is_snp": F.col("mask") == gen.SNP, "is_indel": F.col("mask") == gen.INDEL})
    return filters.with_snp_gap(v, 5).filter("near").select("chrom", "pos")


@query(f"""WITH {_S}, {_G}, c AS (SELECT chrom, pos, sum(a + b) AS ac FROM g GROUP BY chrom, pos),
 x AS (SELECT s.chrom AS chrom, s.pos AS pos, CASE WHEN kind = 2 THEN length(ref) ELSE 1 END AS span, ac FROM s LEFT JOIN c ON s.chrom = c.chrom AND s.pos = c.pos WHERE kind IN (1, 2)),
 y AS (SELECT *, CASE WHEN pos <= lag(pos + span - 1 + 4) OVER (PARTITION BY chrom ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM x),
 z AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS chain FROM y)
 SELECT chrom, pos FROM (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom, chain ORDER BY ac DESC NULLS LAST, pos) AS r FROM z) t WHERE r = 1""")
def indel_gap(spark, sf_dir):
    v = variants(spark, sf_dir).filter(F.col("mask") == gen.INDEL)
    counts = genotype.with_counts(genotype.matrix(genotypes(spark, sf_dir))).select("chrom", "pos", F.col("nref").alias("ac"))
    return filters.indel_gap(v.join(counts, SITE, "left"), 4).select("chrom", "pos")


@query(f"""WITH {_S}, {_I} SELECT chrom, pos FROM s WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = s.chrom AND pos <= to1 AND pos + length(ref) - 1 >= from1)""")
def regions(spark, sf_dir):
    """The span of a record, a deletion's whole one, overlaps a region."""
    chosen = intervals(spark, sf_dir)
    return joins.select_regions(variants(spark, sf_dir), chosen, start=F.col("pos"), end=F.col("pos") + F.length("ref") - 1).select("chrom", "pos")


@query(f"""WITH {_S}, {_I} SELECT chrom, pos FROM s WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = s.chrom AND pos BETWEEN from1 AND to1)""")
def targets(spark, sf_dir):
    """The first position of a record lies in a region."""
    chosen = intervals(spark, sf_dir)
    return joins.select_regions(variants(spark, sf_dir), chosen, start=F.col("pos"), end=F.col("pos")).select("chrom", "pos")


# --- joins -----------------------------------------------------------------

_COLUMNS = ("chrom", "pos", "id", "ref", "alts", "qual", "filter", "mask")


def three_files(spark, sf_dir) -> list[DataFrame]:
    v = variants(spark, sf_dir).select(*_COLUMNS)
    return [v.filter("pos % 2 = 0"), v.filter("pos % 3 = 0"), v.filter("pos % 5 = 0")]


_ABC = "m AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS x, CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS z FROM s)"


@query(f"""WITH {_S}, {_ABC} SELECT chrom, pos, ref, x || '' || y || z AS present, qual FROM m WHERE x + y + z >= 2""")
def isec_at_least_two(spark, sf_dir):
    return joins.intersect(three_files(spark, sf_dir), 2, "+").select("chrom", "pos", "first.ref", "present", "first.qual")


@query(f"""WITH {_S}, {_ABC} SELECT x || '' || y || z AS present, count(*) AS n FROM m WHERE x + y + z > 0 GROUP BY 1""")
def isec_venn(spark, sf_dir):
    return joins.presence(three_files(spark, sf_dir)).groupBy("present").agg(F.count("*").alias("n"))


@query(f"""WITH {_S} SELECT a.chrom AS chrom, a.pos AS pos, a.ref AS ref FROM s a JOIN s b ON b.pos = a.pos + 2 AND b.chrom = a.chrom WHERE (a.kind IN (1, 2)) = (b.kind IN (1, 2))""")
def isec_by_class(spark, sf_dir):
    """Records of two files at one position match if both are SNPs or both indels; the second file is the first moved by two."""
    v = variants(spark, sf_dir).select(*_COLUMNS)
    moved = v.withColumn("pos", F.col("pos") - 2)
    return joins.intersect([v, moved], 2, "=", "both").select("chrom", "pos", "first.ref")


@query(f"""WITH {_S}, {_I}, h AS (SELECT s.chrom AS chrom, pos, min(name) AS name FROM s JOIN iv ON s.chrom = iv.chrom AND pos <= to1 AND pos + length(ref) - 1 >= from1 GROUP BY s.chrom, pos)
 SELECT s.chrom AS chrom, s.pos AS pos, label FROM s LEFT JOIN h ON s.chrom = h.chrom AND s.pos = h.pos LEFT JOIN iv ON h.name = iv.name""")
def annotate_regions(spark, sf_dir):
    end = F.col("pos") + F.length("ref") - 1
    return joins.annotate_intervals(variants(spark, sf_dir), intervals(spark, sf_dir), start=F.col("pos"), end=end, value="label", order="name").select("chrom", "pos", "label")


@query(f"""WITH {_S}, {_L}, t AS (SELECT chrom, pos, ref, one, src FROM l WHERE pos % 4 <> 1),
 h AS (SELECT l.chrom AS chrom, l.pos AS pos, arg_min(t.src, l.nth) AS t_int FROM l JOIN t ON l.chrom = t.chrom AND l.pos = t.pos AND l.ref = t.ref AND l.one = t.one GROUP BY l.chrom, l.pos)
 SELECT s.chrom AS chrom, s.pos AS pos, t_int FROM s LEFT JOIN h ON s.chrom = h.chrom AND s.pos = h.pos""")
def annotate_alleles(spark, sf_dir):
    v = variants(spark, sf_dir)
    side = v.filter("pos % 4 <> 1").select("chrom", "pos", "ref", F.explode("alts").alias("alt"), F.col("src").alias("t_int"))
    return joins.annotate_alleles(v.select("chrom", "pos", "ref", "alts"), side, ["t_int"]).select("chrom", "pos", "t_int")


def files_of_samples(spark, sf_dir) -> list[DataFrame]:
    """Three files of all sites, each with two samples, haploid and diploid.

    The first has the site's record with its first ALT and, at even ``rec``, a SNP of its
    own; the second lacks every third site and has another ALT at SNPs, and at indels the
    same one with a base more; the third lacks every fifth and has a SNP, with a base
    more in REF and ALT where the first file has a SNP.
    """
    v = variants(spark, sf_dir).select(*SITE, "id", "ref", "alts", "qual", "filter", "src", "rec", "kind").withColumn("snp", F.col("kind").isin(0, 3))
    base, alt = F.substr("ref", F.lit(1), F.lit(1)), F.get("alts", F.lit(0))
    other, third = F.translate(base, "ACGT", "GTAC"), F.translate(base, "ACGT", "CATG")
    haploid = lambda k, j: (F.col("rec") % 11 == 0) | (F.lit(j == 1) & ((F.col("src") + k) % 5 == 0))

    def sample(k, j):
        a, b = ((F.col("src") + k + j) % 2).cast("int"), ((F.col("rec") + j * k) % 2).cast("int")
        low, mid, high = (F.col("src") % 7).cast("int") + k, F.lit(10 + j), F.lit(20 + k)
        return F.struct(F.when(haploid(k, j), F.array(a)).otherwise(F.array(a, b)).alias("gt"), F.when(haploid(k, j), F.array(low, mid)).otherwise(F.array(low, mid, high)).alias("pl"))

    def file(rows, k, ref, alt, line=0):
        more = {"dp": F.col("src") + k, "ad": F.array(F.lit(10 * k), F.lit(10 * k + 1)), "cnt": F.array(F.lit(k + 1)), "line": F.lit(line), "samples": F.array(sample(k, 0), sample(k, 1))}
        more |= {"id": F.lit(None).cast("string"), "filter": F.lit("PASS"), "qual": F.lit(0.5).cast("double")} if line else {}
        rows = rows.withColumns({"ref": ref, "alts": F.array(alt)} | more)
        return rows.withColumn("mask", gen.type_mask(F.col("ref"), F.col("alts"))).drop("kind", "src", "rec", "snp")

    v = v.withColumn("qual", F.col("qual").cast("double"))
    v = v.withColumns({"b": base, "o": other, "t": third, "r": F.col("ref"), "x": alt})
    more_a = lambda c: F.concat(c, F.lit("A"))
    first = file(v, 0, F.col("r"), F.col("x")).unionByName(file(v.filter("rec % 2 = 0"), 3, F.col("b"), F.col("t"), line=1))
    second = v.filter("rec % 3 <> 0").withColumns({"id": F.when(F.col("rec") % 4 == 0, F.concat("id", F.lit("b"))).otherwise(F.col("id")), "filter": F.lit("PASS")})
    second = file(second, 1, F.when(F.col("snp"), F.col("r")).otherwise(more_a(F.col("r"))), F.when(F.col("snp"), F.col("o")).otherwise(more_a(F.col("x"))))
    last = v.filter("rec % 5 <> 0").withColumn("qual", F.col("qual") + 1)
    last = file(last, 2, F.when(F.col("snp"), more_a(F.col("b"))).otherwise(F.col("b")), F.when(F.col("snp"), more_a(F.col("x"))).otherwise(F.col("o")))
    return [f.drop("b", "o", "t", "r", "x") for f in (first, second, last)]


#: The merged rows: whose records they have (f0 to f2; ``own`` 3 if the first file's second one), their alleles, and the number that each file's ALT gets.
MERGED_ROWS = """v AS (SELECT *, kind IN (0, 3) AS snp, substr(ref, 1, 1) AS base, translate(substr(ref, 1, 1), 'ACGT', 'GTAC') AS o, translate(substr(ref, 1, 1), 'ACGT', 'CATG') AS t,
 CAST(rec % 2 = 0 AS INT) AS h0, CAST(rec % 3 <> 0 AS INT) AS h1, CAST(rec % 5 <> 0 AS INT) AS h2 FROM s),
 m AS (SELECT chrom, pos, 0 AS row, rec, src, 0 AS own, 1 AS f0, h1 AS f1, CASE WHEN snp THEN h2 ELSE 0 END AS f2, ref AS r, alt AS x, CASE WHEN snp AND h1 = 1 AND o <> alt THEN o END AS y, 1 AS m0,
   CASE WHEN snp AND o <> alt THEN 2 ELSE 1 END AS m1, 1 AS m2, id AS id0, qual AS q0, filter AS w0, id, qual, filter FROM v
  UNION ALL SELECT chrom, pos, 1, rec, src, 3, 1, 0, 0, base, t, NULL, 1, 1, 1, NULL, 0.5, 'PASS', id, qual, filter FROM v WHERE snp AND h0 = 1
  UNION ALL SELECT chrom, pos, 1, rec, src, 3, h0, 0, h2, base, CASE WHEN h0 = 1 THEN t ELSE o END, CASE WHEN h0 = 1 AND h2 = 1 THEN o END, 1, 1, CASE WHEN h0 = 1 THEN 2 ELSE 1 END,
   NULL, 0.5, 'PASS', id, qual, filter FROM v WHERE NOT snp AND (h0 = 1 OR h2 = 1))"""


def _merged_sql() -> str:
    """Case by case: row 0 of a SNP has all three files and row 1 the first file's second record; row 0 of an indel has two files, and row 1 the SNPs beside it."""

    def sample(k, j, at):
        """A sample of record ``k`` (3: the second one of the first file); ``at``: the number of its ALT."""
        hap = f"(rec % 11 = 0 OR {j == 1} AND (src + {k}) % 5 = 0)"
        code = lambda x: f"CASE WHEN {x} = 1 THEN {at} ELSE 0 END"
        a, b = code(f"(src + {k + j}) % 2"), code(f"(rec + {j * k}) % 2")
        low, mid, high = f"CAST(src % 7 + {k} AS VARCHAR)", 10 + j, 20 + k
        two = f"CASE WHEN {hap} THEN {low} || ',{mid}' ELSE {low} || ',{mid},{high}' END"
        first = f"CASE WHEN {hap} THEN {low} || ',{mid},.' ELSE {low} || ',{mid},{high},.,.,.' END"
        second = f"CASE WHEN {hap} THEN {low} || ',.,{mid}' ELSE {low} || ',.,.,{mid},.,{high}' END"
        pl = f"CASE WHEN n = 1 THEN {two} WHEN {at} = 1 THEN {first} ELSE {second} END"
        return f"CASE WHEN {hap} THEN CAST({a} AS VARCHAR) ELSE {a} || '/' || {b} END || ':' || {pl}"

    none = "CASE WHEN rec % 11 = 0 OR (f0 + f1 + f2 = 1 AND one_hap) THEN '.' ELSE './.' END || ':.'"
    cell = lambda f, k, j, at: f"CASE WHEN {f} = 0 THEN {none} WHEN own = 3 AND {k} = 0 THEN {sample(3, j, at)} ELSE {sample(k, j, at)} END"
    cells = " || ' ' || ".join(f"({cell(f'f{k}', k, j, f'm{k}')})" for k in range(3) for j in range(2))
    value = lambda k, what: f"CASE WHEN f{k} = 1 THEN {what} END"
    of = lambda k: "CASE WHEN own = 3 THEN 3 ELSE 0 END" if k == 0 else str(k)
    ad0 = ", ".join(value(k, f"10 * {of(k)}") for k in range(3))
    ad = lambda m: ", ".join(f"CASE WHEN f{k} = 1 AND m{k} = {m} THEN 10 * {of(k)} + 1 END" for k in range(3))
    cnt = lambda m: " + ".join(f"CASE WHEN f{k} = 1 AND m{k} = {m} THEN {of(k)} + 1 ELSE 0 END" for k in range(3))
    dp = " + ".join(f"CASE WHEN f{k} = 1 THEN src + {of(k)} ELSE 0 END" for k in range(3))
    return f"""WITH {_S}, {MERGED_ROWS},
 z AS (SELECT *, CASE WHEN y IS NULL THEN 1 ELSE 2 END AS n, false AS one_hap,
  list_distinct(list_filter([CASE WHEN f0 = 1 THEN w0 END, CASE WHEN f1 = 1 THEN 'PASS' END, CASE WHEN f2 = 1 THEN filter END], lambda w: w IS NOT NULL)) AS ws,
  CASE WHEN f0 = 1 THEN id0 END AS i0, CASE WHEN f1 = 1 THEN CASE WHEN rec % 4 = 0 THEN id || 'b' ELSE id END END AS i1, CASE WHEN f2 = 1 THEN id END AS i2 FROM m)
 SELECT chrom, pos, CAST(row AS INTEGER) AS row, r AS ref, x || coalesce(',' || y, '') AS alts,
 nullif(concat_ws(';', i0, CASE WHEN i1 IS DISTINCT FROM i0 THEN i1 END, CASE WHEN i2 IS DISTINCT FROM i0 AND i2 IS DISTINCT FROM i1 THEN i2 END), '') AS id,
 CAST(greatest(CASE WHEN f0 = 1 THEN q0 END, CASE WHEN f1 = 1 THEN qual END, CASE WHEN f2 = 1 THEN qual + 1 END) AS DOUBLE) AS qual,
 CASE WHEN len(list_filter(ws, lambda w: w <> 'PASS')) > 0 THEN list_aggregate(list_sort(list_filter(ws, lambda w: w <> 'PASS')), 'string_agg', ',') ELSE 'PASS' END AS filters,
 CAST({dp} AS DOUBLE) AS dp, CAST(greatest({ad0}) AS VARCHAR) || ',' || CAST(greatest({ad(1)}) AS VARCHAR) || CASE WHEN y IS NULL THEN '' ELSE ',' || CAST(greatest({ad(2)}) AS VARCHAR) END AS ad,
 CAST({cnt(1)} AS VARCHAR) || '.0' || CASE WHEN y IS NULL THEN '' ELSE ',' || CAST({cnt(2)} AS VARCHAR) || '.0' END AS cnt, {cells} AS samples FROM z"""


@query(_merged_sql())
def merge_three(spark, sf_dir):
    """Three files, SNPs with SNPs and indels with indels, two records of a file at a site; genotypes and likelihoods of haploid and diploid samples are renumbered."""
    rules = {"dp": "sum", "ad": ("max", "R"), "cnt": ("sum", "A")}
    out = merge.merge_files(files_of_samples(spark, sf_dir), rules, "both", [2, 2, 2], order="line", sample_vectors={"pl": "G"})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", ".")
    gt = lambda s: F.array_join(F.transform(s["gt"], lambda a: a.cast("string")), "/", ".")
    shown = F.array_join(F.transform("samples", lambda s: F.concat(gt(s), F.lit(":"), F.coalesce(text(s["pl"]), F.lit(".")))), " ")
    filters_text = F.array_join(F.array_sort("filters"), ",")
    return out.select(*SITE, "row", "ref", F.array_join("alts", ",").alias("alts"), "id", F.col("qual").cast("double").alias("qual"), filters_text.alias("filters"), "dp", text("ad").alias("ad"), text("cnt").alias("cnt"), shown.alias("samples"))


_PARTS = """t AS (SELECT *, CASE WHEN kind = 3 THEN 'two' ELSE 'one' END AS k FROM s WHERE kind IN (0, 3)), u AS (SELECT chrom, pos, ref, alt, coalesce(alt2, '') AS alt2, translate(ref, 'ACGT', 'GTAC') AS y FROM t)"""


@query(f"""WITH {_S}, {_PARTS} SELECT chrom, pos, ref, CASE WHEN y = alt OR y = alt2 THEN '11' ELSE '10' END AS present FROM u
 UNION ALL SELECT chrom, pos, ref, '01' FROM u WHERE y <> alt AND y <> alt2""")
def isec_some(spark, sf_dir):
    """Records that share any ALT match; the second file has one ALT of its own."""
    v = variants(spark, sf_dir).filter("kind in (0, 3)").select(*_COLUMNS)
    other = v.withColumn("alts", F.array(F.translate("ref", "ACGT", "GTAC")))
    return joins.presence([v, other], "some").select("chrom", "pos", "first.ref", "present")


@query(f"""WITH {_S} SELECT chrom, pos, ref FROM s WHERE id IN (SELECT 'rs' || (p_partkey * 2) FROM part)""")
def id_list(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("rs"), (F.col("p_partkey") * 2).cast("string")).alias("id"))
    return variants(spark, sf_dir).join(wanted, "id", "left_semi").select("chrom", "pos", "ref")


@query(f"""WITH {_G} SELECT x.sample AS i, y.sample AS j, count(*) AS sites, CAST(sum(abs(x.a + x.b - y.a - y.b)) AS BIGINT) AS difference
 FROM g x JOIN g y ON x.chrom = y.chrom AND x.pos = y.pos AND y.sample < x.sample GROUP BY 1, 2""")
def sample_pairs(spark, sf_dir):
    return stats.pair_discordance(genotypes(spark, sf_dir))


_TWO = """h AS (SELECT chrom, pos, sample, a, CASE WHEN (pos + sample) % 3 = 0 THEN 1 - b ELSE b END AS b FROM g WHERE pos % 4 <> 0)"""
_PAIR = "p AS (SELECT g.chrom AS chrom, g.pos AS pos, g.sample AS sample, g.a + g.b AS gx, h.a + h.b AS gy FROM g JOIN h ON g.chrom = h.chrom AND g.pos = h.pos AND g.sample = h.sample)"


def two_sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    g = genotypes(spark, sf_dir)
    b = F.when((F.col("pos") + F.col("sample")) % 3 == 0, 1 - F.col("b")).otherwise(F.col("b"))
    return g, g.filter("pos % 4 <> 0").select("chrom", "pos", "sample", "a", b.alias("b"))


@query(f"""WITH {_G}, {_TWO}, {_PAIR}, c AS (SELECT sample, count(*) FILTER (gx = gy AND gx = 0) AS rr, count(*) FILTER (gx = gy AND gx = 1) AS ra,
 count(*) FILTER (gx = gy AND gx = 2) AS aa, count(*) FILTER (gx <> gy) AS mismatch FROM p GROUP BY sample)
 SELECT *, CASE WHEN ra + aa + mismatch = 0 THEN 0.0 ELSE 100.0 * mismatch / CAST(ra + aa + mismatch AS DOUBLE) END AS nrd FROM c""")
def concordance_by_sample(spark, sf_dir):
    x, y = two_sets(spark, sf_dir)
    return stats.concordance(x, y, ["sample"]).withColumn("nrd", F.col("nrd").cast("double"))


@query(f"""WITH {_G}, {_TWO}, {_PAIR}, t AS (SELECT chrom, pos, count(*) AS n, sum(gx) AS sx, sum(gy) AS sy, sum(gx * gx) AS sxx, sum(gy * gy) AS syy, sum(gx * gy) AS sxy FROM p GROUP BY chrom, pos)
 SELECT chrom, pos, n, CASE WHEN n * sxx = sx * sx OR n * syy = sy * sy THEN 1.0 ELSE CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE) END AS r2 FROM t""")
def dosage_correlation(spark, sf_dir):
    return stats.dosage_r2(*two_sets(spark, sf_dir)).withColumn("r2", F.col("r2").cast("double"))


@query(f"""WITH {_G}, t AS (SELECT f.chrom AS chrom, f.pos AS pos, f.a AS fa, f.b AS fb, m.a AS ma, m.b AS mb, c.a AS ca, c.b AS cb FROM g f JOIN g m ON f.chrom = m.chrom AND f.pos = m.pos AND m.sample = 2
 JOIN g c ON f.chrom = c.chrom AND f.pos = c.pos AND c.sample = 3 WHERE f.sample = 1)
 SELECT chrom, pos, (ca IN (fa, fb) AND cb IN (ma, mb)) OR (cb IN (fa, fb) AND ca IN (ma, mb)) AS consistent FROM t""")
def trio_consistency(spark, sf_dir):
    m = genotype.matrix(genotypes(spark, sf_dir))
    pick = lambda k: F.get(F.filter("samples", lambda s: s["sample"] == k), F.lit(0))
    t = m.select("chrom", "pos", pick(1).alias("f"), pick(2).alias("m"), pick(3).alias("c")).filter("f is not null and m is not null and c is not null")
    t = t.select("chrom", "pos", *[F.col(f"{p}.{x}").alias(f"{p}{x}") for p in "fmc" for x in "ab"])
    return calling.mendel_errors(t).select("chrom", "pos", "consistent")


@query(f"""WITH {_S}, k AS (SELECT chrom, pos, pos * 0.001 + chrom AS cm FROM s WHERE pos % 97 = 0),
 e AS (SELECT s.chrom AS chrom, s.pos AS pos, (SELECT max(k.pos) FROM k WHERE k.chrom = s.chrom AND k.pos <= s.pos) AS lo, (SELECT min(k.pos) FROM k WHERE k.chrom = s.chrom AND k.pos >= s.pos) AS hi FROM s)
 SELECT chrom, pos, round(CASE WHEN lo IS NULL THEN hi * 0.001 + chrom WHEN hi IS NULL THEN lo * 0.001 + chrom ELSE pos * 0.001 + chrom END, 6) AS cm FROM e""")
def genetic_map(spark, sf_dir):
    v = variants(spark, sf_dir).select("chrom", "pos")
    points = v.filter("pos % 97 = 0").withColumn("cm", F.col("pos") * F.lit(0.001) + F.col("chrom"))
    return sequence.map_position(v, points).select("chrom", "pos", F.round("cm", 6).alias("cm"))


# --- grouped statistics ----------------------------------------------------


@query(f"""WITH {_S} SELECT filter, count(*) AS records, count(*) FILTER (kind IN (0, 3)) AS snps, count(*) FILTER (kind IN (1, 2)) AS indels, CAST(0 AS BIGINT) AS mnps,
 CAST(0 AS BIGINT) AS others, count(*) FILTER (kind = 3) AS multiallelic, count(*) FILTER (kind = 3) AS multiallelic_snps FROM s GROUP BY filter""")
def stats_summary(spark, sf_dir):
    return stats.summary(variants(spark, sf_dir), "filter")


@query(f"""WITH {_S}, {_L}, {_SNPS}, c AS (SELECT CASE WHEN id IS NULL THEN 'novel' ELSE 'known' END AS grp, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv,
 count(*) FILTER (ts AND nth = 0) AS ts_first, count(*) FILTER (NOT ts AND nth = 0) AS tv_first FROM n WHERE qual > 100 GROUP BY 1)
 SELECT *, CAST(ts AS DOUBLE) / tv AS ratio, CAST(ts_first AS DOUBLE) / tv_first AS ratio_first FROM c""")
def tstv_by_set(spark, sf_dir):
    """The flagship: sites by an expression, then transitions and transversions of known and novel ones."""
    v = filters.include(variants(spark, sf_dir), (F.col("qual") > 100) & (F.col("mask") == gen.SNP))
    return stats.tstv(v.withColumn("grp", F.when(F.col("id").isNull(), "novel").otherwise("known")), "grp")


@query(f"""WITH {_S}, {_L}, {_SNPS}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x) SELECT p.x AS ref, q.x AS alt, count(n.pos) AS n FROM b p JOIN b q ON p.x <> q.x
 LEFT JOIN n ON n.ref = p.x AND n.one = q.x GROUP BY 1, 2""")
def substitution_matrix(spark, sf_dir):
    return stats.substitutions(spark, variants(spark, sf_dir))


@query(f"""WITH {_G}, c AS (SELECT chrom, pos, sum(a + b) AS ac, 2 * count(*) AS an FROM g GROUP BY chrom, pos)
 SELECT CAST(CASE WHEN ac = 1 THEN 0 ELSE 1 + (ac * 99) // an END AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY 1""")
def frequency_histogram(spark, sf_dir):
    c = genotype.with_counts(genotype.matrix(genotypes(spark, sf_dir))).withColumn("ac", F.col("nref"))
    return stats.frequency_histogram(c, 101)


@query(f"""WITH {_S} SELECT CAST(least(floor(qual), 998) AS INTEGER) AS qual_bin, count(*) AS n FROM s GROUP BY 1""")
def quality_histogram(spark, sf_dir):
    return stats.quality_histogram(variants(spark, sf_dir))


@query(f"""WITH {_S}, {_L}, {_SNPS} SELECT CAST(floor((least(greatest(qual, 50), 400) - 50) / 350.0 * 19) AS INTEGER) AS bin, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv
 FROM n WHERE nth = 0 GROUP BY 1""")
def user_tstv(spark, sf_dir):
    return stats.user_tstv(variants(spark, sf_dir), F.col("qual"), 50.0, 400.0, 20)


@query(f"""WITH {_S}, {_L} SELECT CAST(length(one) - length(ref) AS INTEGER) AS length, count(*) AS n FROM l WHERE length(one) <> length(ref) GROUP BY 1""")
def indel_lengths(spark, sf_dir):
    return stats.indel_lengths(variants(spark, sf_dir))


@query(f"""WITH {_S}, {_G}, j AS (SELECT g.*, kind, abs(instr('ACGT', ref) - instr('ACGT', alt)) = 2 AS ts,
 sum(CASE WHEN a + b > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g.chrom, g.pos) AS carriers FROM g JOIN s ON g.chrom = s.chrom AND g.pos = s.pos)
 SELECT sample, count(*) FILTER (kind IN (0, 3) AND a = 0 AND b = 0) AS hom_ref, count(*) FILTER (kind IN (0, 3) AND a = 1 AND b = 1) AS hom_alt,
 count(*) FILTER (kind IN (0, 3) AND a <> b) AS het, count(*) FILTER (kind IN (0, 3) AND a + b > 0 AND ts) AS ts, count(*) FILTER (kind IN (0, 3) AND a + b > 0 AND NOT ts) AS tv,
 count(*) FILTER (kind IN (1, 2) AND a + b > 0) AS indels, count(*) FILTER (a + b > 0 AND carriers = 1) AS singletons, CAST(sum(dp) AS BIGINT) AS depth, count(dp) AS n_depth FROM j GROUP BY sample""")
def per_sample_counts(spark, sf_dir):
    return stats.per_sample(genotypes(spark, sf_dir), variants(spark, sf_dir))


@query(f"""WITH {_G}, b AS (SELECT CAST(CASE WHEN dp < 5 THEN -1 WHEN dp >= 45 THEN 45 ELSE 5 + ((dp - 5) // 4) * 4 END AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY 1)
 SELECT bin, n, n * CAST(100 AS DOUBLE) / (SELECT sum(n) FROM b) AS percent FROM b""")
def depth_distribution(spark, sf_dir):
    return stats.depth_distribution(genotypes(spark, sf_dir), "dp", 5, 45, 4).withColumn("percent", F.col("percent").cast("double"))


@query(f"""WITH {_G}, c AS (SELECT CAST((sum(a + b) * 10) // (2 * count(*)) AS INTEGER) AS af_bin, CAST((sum(CASE WHEN a <> b THEN 1 ELSE 0 END) * 100) // count(*) AS INTEGER) AS het_bin FROM g GROUP BY chrom, pos),
 h AS (SELECT af_bin, het_bin, count(*) AS n FROM c GROUP BY 1, 2),
 r AS (SELECT *, sum(n) OVER (PARTITION BY af_bin) AS total, sum(n) OVER (PARTITION BY af_bin ORDER BY het_bin) AS upto FROM h)
 SELECT af_bin, CAST(max(total) AS BIGINT) AS sites, min(het_bin) FILTER (upto * 100 >= total * 25) AS p25, min(het_bin) FILTER (upto * 100 >= total * 50) AS p50, min(het_bin) FILTER (upto * 100 >= total * 75) AS p75
 FROM r GROUP BY af_bin""")
def het_percentiles(spark, sf_dir):
    g = genotypes(spark, sf_dir).groupBy(*SITE).agg(F.sum(F.col("a") + F.col("b")).alias("ac"), F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("het"))
    c = g.select(F.expr("cast(ac * 10 div (2 * n) as int)").alias("af_bin"), F.expr("cast(het * 100 div n as int)").alias("het_bin"))
    return stats.het_percentiles(c)


@query(f"""WITH {_S}, {_L}, {_SNPS}, f AS (SELECT * FROM n WHERE nth = 0), r AS (SELECT qual, count(*) OVER (ORDER BY qual DESC) AS cum,
 count(*) FILTER (ts) OVER (ORDER BY qual DESC) AS ts, count(*) FILTER (NOT ts) OVER (ORDER BY qual DESC) AS tv, count(*) OVER () AS total FROM f)
 SELECT CAST(ceil(cum * 50.0 / total) AS INTEGER) AS step, min(qual) AS qual, max(ts) AS ts, max(tv) AS tv FROM r GROUP BY 1""")
def cumulative_tstv(spark, sf_dir):
    return stats.cumulative_tstv(variants(spark, sf_dir), 50)


@query(f"""WITH {_S}, {_L} SELECT count(DISTINCT (chrom, pos)) AS sites, count(*) FILTER (length(one) <> length(ref)) AS indel_alts, count(*) FILTER (length(one) <> length(ref) AND abs(length(one) - length(ref)) % 3 = 0) AS in_frame,
 CAST(sum(CASE WHEN length(one) <> length(ref) THEN 1.0 / (CASE WHEN alt2 IS NULL THEN 1 ELSE 2 END) ELSE 0 END) AS DOUBLE) AS weighted FROM l""")
def gap_statistics(spark, sf_dir):
    v = variants(spark, sf_dir)
    size = lambda a: F.length(a) - F.length("ref")
    long = v.select("*", F.explode("alts").alias("one"))
    indel = size(F.col("one")) != 0
    per_site = long.groupBy(*SITE).agg(
        F.count_if(indel).alias("i"), F.count_if(indel & (F.abs(size(F.col("one"))) % 3 == 0)).alias("f"), F.sum(F.when(indel, 1.0 / F.size("alts")).otherwise(0.0)).alias("w")
    )
    return per_site.agg(F.count("*").alias("sites"), F.sum("i").alias("indel_alts"), F.sum("f").alias("in_frame"), F.sum("w").cast("double").alias("weighted"))


@query(f"""WITH {_S}, d AS (SELECT chrom, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS gap, qual FROM s)
 SELECT chrom, count(gap) AS n, CAST(sum(gap) AS BIGINT) AS total, max(gap) AS largest FROM d WHERE qual > 200 GROUP BY chrom""")
def neighbour_distances(spark, sf_dir):
    v = variants(spark, sf_dir).select("chrom", "pos", "qual", F.col("pos").alias("at"))
    d = ranges.with_previous(v, "at", [F.col("pos")], size=5000).withColumn("gap", F.col("pos") - F.col("previous")).filter("qual > 200")
    return d.groupBy("chrom").agg(F.count("gap").alias("n"), F.sum("gap").alias("total"), F.max("gap").alias("largest"))


@query(f"""WITH {_S} SELECT filter, count(*) AS records, count(*) FILTER (kind IN (1, 2)) AS indels FROM s GROUP BY filter""")
def merged_statistics(spark, sf_dir):
    """Partial results of three parts of the sites, added up."""
    v = variants(spark, sf_dir)
    parts = [stats.summary(v.filter(F.col("pos") % 3 == k), "filter").select("filter", "records", "indels") for k in range(3)]
    return stats.merge_counts(parts, ["filter"])


@query(f"""WITH {_S}, {_G}, c AS (SELECT g.chrom AS chrom, g.pos AS pos, count(*) FILTER (a + b = 0) AS n0, count(*) FILTER (a + b = 1) AS n1, count(*) FILTER (a + b = 2) AS n2 FROM g GROUP BY g.chrom, g.pos),
 p AS (SELECT *, CAST(n0 + n1 + n2 AS DOUBLE) AS n, (2 * n0 + n1) / (2.0 * (n0 + n1 + n2)) AS p FROM c)
 SELECT chrom, pos, round(coalesce((n0 - n * p * p) * (n0 - n * p * p) / nullif(n * p * p, 0) + (n1 - 2 * n * p * (1 - p)) * (n1 - 2 * n * p * (1 - p)) / nullif(2 * n * p * (1 - p), 0)
 + (n2 - n * (1 - p) * (1 - p)) * (n2 - n * (1 - p) * (1 - p)) / nullif(n * (1 - p) * (1 - p), 0), 0), 6) AS chi2 FROM p""")
def hardy_weinberg(spark, sf_dir):
    d = F.col("a") + F.col("b")
    c = genotypes(spark, sf_dir).groupBy(*SITE).agg(*[F.count_if(d == k).alias(f"n{k}") for k in range(3)])
    return c.select("chrom", "pos", F.round(calling.hardy_weinberg_chi2(F.col("n0"), F.col("n1"), F.col("n2")), 6).alias("chi2"))


# --- order, windows, reshaping ---------------------------------------------


@query(f"""WITH {_S} SELECT chrom, pos, ref, nth + 1 AS nth, one AS alt, CASE WHEN alt2 IS NULL THEN id END AS id FROM (SELECT *, 0 AS nth, alt AS one FROM s UNION ALL SELECT *, 1, alt2 FROM s WHERE alt2 IS NOT NULL) t""")
def split_multiallelics(spark, sf_dir):
    out = reshape.split_alleles(variants(spark, sf_dir).select("chrom", "pos", "ref", "alts", "id"))
    return out.select("chrom", "pos", "ref", "nth", F.get("alts", F.lit(0)).alias("alt"), "id")


_SPLIT = f"""{_S}, {_G}, h AS (SELECT chrom, pos, string_agg(CASE WHEN a = 1 THEN 1 + (pos + sample) % 2 ELSE 0 END || '/' || CASE WHEN b = 1 THEN 1 + sample % 2 ELSE 0 END, ' ' ORDER BY sample) AS gt FROM g GROUP BY chrom, pos)"""


def two_alts(spark, sf_dir) -> DataFrame:
    """Sites with two ALTs, genotypes of both, and vectors by ALT, allele and genotype."""
    g = genotypes(spark, sf_dir).select(*SITE, "sample", "a", "b")
    pick = lambda c, k: F.when(F.col(c) == 1, (1 + k % 2).cast("int")).otherwise(0)
    g = g.withColumns({"a": pick("a", F.col("pos") + F.col("sample")), "b": pick("b", F.col("sample"))})
    v = variants(spark, sf_dir).filter("kind = 3").select(*SITE, "rec", "ref", "alts", "qual", "mask", "src")
    names = {c: F.array(*[F.concat(F.lit(c), (F.col("src") + k).cast("string")) for k in range(n)]) for c, n in (("va", 2), ("vr", 3), ("vg", 6))}
    return v.join(genotype.matrix(g), SITE).withColumns(names)


@query(f"""WITH {_SPLIT} SELECT s.chrom AS chrom, s.pos AS pos, ref, alt || ',' || alt2 AS alts, gt, 'va' || src || ',va' || (src + 1) AS va, 'vr' || src || ',vr' || (src + 1) || ',vr' || (src + 2) AS vr,
 'vg' || src || ',vg' || (src + 1) || ',vg' || (src + 2) || ',vg' || (src + 3) || ',.,vg' || (src + 5) AS vg, qual
 FROM s JOIN h ON s.chrom = h.chrom AND s.pos = h.pos WHERE kind = 3""")
def join_multiallelics(spark, sf_dir):
    """Sites with two ALTs are split and joined again: all comes back but for the genotype of both ALTs' value, which no part has."""
    parts = reshape.split_alleles(two_alts(spark, sf_dir), ["va"], ["vr"], ["vg"])
    out = reshape.join_alleles(parts.withColumn("rec", F.col("rec") * 10 + F.col("nth")), F.col("mask"), {"va": "A", "vr": "R", "vg": "G"})
    gt = F.transform("samples", lambda s: gen.genotype_string(F.array(s["a"], s["b"]), F.lit(False)))
    text = lambda c: F.array_join(c, ",", ".")
    return out.select("chrom", "pos", "ref", text("alts").alias("alts"), F.array_join(gt, " ").alias("gt"), *[text(c).alias(c) for c in ("va", "vr", "vg")], "qual")


@query(f"""WITH {_S} SELECT chrom, pos, CASE WHEN kind = 2 THEN ref || 'CA' WHEN kind = 1 THEN ref || 'C' ELSE ref END AS ref, CASE WHEN kind = 2 THEN alt || 'CA' WHEN kind = 1 THEN alt || 'G' ELSE alt END AS alt FROM s""")
def trim_alleles(spark, sf_dir):
    """A shared ending is trimmed off; ALTs of deletions also get a base that REF lacks, those of insertions end in another base."""
    ref = F.when(F.col("kind") == 2, F.concat("ref", F.lit("CACA"))).when(F.col("kind") == 1, F.concat("ref", F.lit("CT"))).otherwise(F.concat("ref", F.lit("CA")))
    alt = F.when(F.col("kind") == 2, F.concat("alt", F.lit("CACA"))).when(F.col("kind") == 1, F.concat("alt", F.lit("GT"))).otherwise(F.concat("alt", F.lit("CA")))
    v = variants(spark, sf_dir).withColumns({"ref": ref, "alts": F.array(alt)})
    extra = F.when(F.col("kind") == 2, F.lit("CA")).otherwise(F.lit(""))
    out = v.select("chrom", "pos", extra.alias("x"), reshape.trim(F.col("ref"), F.col("alts")).alias("t"))
    return out.select("chrom", "pos", F.concat(F.get("t", F.lit(0)), "x").alias("ref"), F.concat(F.get("t", F.lit(1)), "x").alias("alt"))


@query(f"""WITH {_S} SELECT chrom, pos, ref FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos // 10, kind IN (1, 2) ORDER BY pos) AS r FROM s) t WHERE r = 1""")
def remove_duplicates(spark, sf_dir):
    """The first record of each position (here ten at a time) and type."""
    v = variants(spark, sf_dir).withColumns({"at": F.col("pos"), "pos": F.expr("pos div 10")})
    return reshape.remove_duplicates(v).select("chrom", F.col("at").alias("pos"), "ref")


@query(f"""WITH {_S} SELECT chrom, pos, ref FROM s WHERE pos % 2 = 0 UNION ALL SELECT chrom, pos, ref FROM s WHERE pos % 3 = 0""")
def concat_files(spark, sf_dir):
    a, b, _ = three_files(spark, sf_dir)
    return reshape.concat_files([a, b]).select("chrom", "pos", "ref")


@query("""SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM
 (SELECT *, CASE WHEN f = coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, event_id, event_type <> 'error' AS f FROM events) a) b) c WHERE f GROUP BY user_id, run""")
def flagged_runs(spark, sf_dir):
    return sequence.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") != "error")


@query(f"""WITH {_S}, c AS (SELECT chrom, max(pos) AS length FROM s GROUP BY 1), n AS (SELECT *, CAST(greatest(1, floor(length / 2000.0 + 0.9)) AS INTEGER) AS n FROM c),
 k AS (SELECT *, unnest(range(0, n)) AS k FROM n) SELECT chrom, CAST(k * 2000 + 1 AS BIGINT) AS from1, CAST(CASE WHEN k = n - 1 THEN length ELSE (k + 1) * 2000 END AS BIGINT) AS to1 FROM k""")
def genome_tiles(spark, sf_dir):
    lengths = variants(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("length"))
    return sequence.tiles(lengths, 2000).select("chrom", F.col("from1").cast("long").alias("from1"), F.col("to1").cast("long").alias("to1"))


# --- calling and models ----------------------------------------------------

_PL = "pl AS (SELECT chrom, pos, sample, dp * 3 % 50 AS p0, dp * 7 % 60 AS p1, dp * 11 % 70 AS p2 FROM g)"


def likelihoods(spark, sf_dir) -> DataFrame:
    dp = F.col("dp")
    return genotypes(spark, sf_dir).select("chrom", "pos", "sample", F.array(*[(dp * m % k).cast("double") for m, k in ((3, 50), (7, 60), (11, 70))]).alias("pl"))


@query(f"""WITH {_G}, {_PL}, e AS (SELECT *, pow(10, -p0 / 10.0) AS x, pow(10, -p1 / 10.0) AS y, pow(10, -p2 / 10.0) AS z FROM pl)
 SELECT chrom, pos, sample, round(x / (x + y + z), 9) AS p0, round(y / (x + y + z), 9) AS p1, round(z / (x + y + z), 9) AS p2 FROM e""")
def genotype_probabilities(spark, sf_dir):
    p = calling.pl_to_prob(F.col("pl"))
    return likelihoods(spark, sf_dir).select("chrom", "pos", "sample", *[F.round(F.get(p, F.lit(k)), 9).alias(f"p{k}") for k in range(3)])


@query(f"""WITH {_G}, {_PL}, e AS (SELECT *, exp(-0.1 * p0) AS x, exp(-0.1 * p1) AS y, exp(-0.1 * p2) AS z FROM pl) SELECT chrom, pos, sample, round((y + 2 * z) / (x + y + z), 9) AS dosage FROM e""")
def dosages(spark, sf_dir):
    return likelihoods(spark, sf_dir).select("chrom", "pos", "sample", F.round(genotype.likelihood_dosage(F.col("pl")), 9).alias("dosage"))


#: Likelihoods of each sample's three genotypes, scaled to add up to 1, and the site's quality sums.
_P = f"""{_G}, {_PL}, e AS (SELECT *, pow(10, -p0 / 10.0) AS x, pow(10, -p1 / 10.0) AS y, pow(10, -p2 / 10.0) AS z FROM pl),
 w AS (SELECT chrom, pos, sample, x / (x + y + z) AS x, y / (x + y + z) AS y, z / (x + y + z) AS z FROM e)"""
_QS = "q AS (SELECT chrom, pos, CASE WHEN sum(greatest(30 - dp, 0)) = 0 THEN CASE WHEN sum(dp) > 2 THEN 32.0 ELSE 0.001 END ELSE CAST(sum(greatest(30 - dp, 0)) AS DOUBLE) END AS q0, CAST(sum(dp) AS DOUBLE) AS q1, count(*) AS n FROM g GROUP BY chrom, pos), f AS (SELECT chrom, pos, n, q0 / (q0 + q1) AS r, q1 / (q0 + q1) AS a FROM q)"
_THETA = "ln(least(0.99, 0.001 * list_sum(list_transform(range(1, 2 * n), lambda i: 1.0 / i))))"


@query(f"""WITH {_P}, {_QS}, v AS (SELECT w.chrom AS chrom, w.pos AS pos, any_value(n) AS n, any_value(r) AS r, any_value(a) AS a, sum(ln(x)) AS l0, sum(ln(z)) + {_THETA.replace('n)', 'any_value(n))')} AS l1,
 sum(ln(r * r * x + 2 * r * a * y + a * a * z)) + {_THETA.replace('n)', 'any_value(n))')} AS l2 FROM w JOIN f ON w.chrom = f.chrom AND w.pos = f.pos GROUP BY w.chrom, w.pos),
 t AS (SELECT *, greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS total, CASE WHEN l0 > l1 AND l0 > l2 THEN 0 ELSE 1 END AS variant FROM v)
 SELECT t.chrom AS chrom, t.pos AS pos, CASE WHEN variant = 1 THEN '0,1' ELSE '0' END AS alleles, round(least(999.0, greatest(0.0, 4.343 * CASE WHEN variant = 1 THEN total - l0 ELSE total - greatest(l1, l2) END)), 4) AS qual,
 o.genotypes AS genotypes, o.gq AS gq, o.gp AS gp, o.pl AS pl FROM t JOIN (SELECT chrom, pos, string_agg(gt, ' ' ORDER BY sample) AS genotypes, string_agg(gq, ' ' ORDER BY sample) AS gq, string_agg(gp, ' ' ORDER BY sample) AS gp, string_agg(pl, ' ' ORDER BY sample) AS pl FROM (
  SELECT chrom, pos, sample, CASE WHEN variant = 0 OR (p >= h AND p >= q) THEN '0/0' WHEN q >= h THEN '1/1' ELSE '0/1' END AS gt,
  CAST(CASE WHEN variant = 0 THEN 127 ELSE least(127, trunc(-4.34294 * ln(greatest(1e-300, 1 - greatest(p, h, q) / (p + h + q))))) END AS VARCHAR).replace('.0', '') AS gq,
  CASE WHEN variant = 0 THEN '0' ELSE concat_ws(',', CAST(trunc(-4.34294 * ln(p / (p + h + q))) AS INTEGER), CAST(trunc(-4.34294 * ln(h / (p + h + q))) AS INTEGER), CAST(trunc(-4.34294 * ln(q / (p + h + q))) AS INTEGER)) END AS gp,
  CASE WHEN variant = 0 THEN p0 || '.0' ELSE concat_ws(',', p0 || '.0', p1 || '.0', p2 || '.0') END AS pl
  FROM (SELECT w.chrom AS chrom, w.pos AS pos, w.sample AS sample, variant, r * r * x AS p, 2 * r * a * y AS h, a * a * z AS q, p0, p1, p2 FROM w JOIN t ON w.chrom = t.chrom AND w.pos = t.pos JOIN pl ON w.chrom = pl.chrom AND w.pos = pl.pos AND w.sample = pl.sample) i) j GROUP BY chrom, pos) o ON o.chrom = t.chrom AND o.pos = t.pos""")
def call_genotypes(spark, sf_dir):
    """Best allele sets and genotypes over all sites; quality sums from depths."""
    g = genotypes(spark, sf_dir).select(*SITE, "sample", "dp", F.array(*[(F.col("dp") * m % k).cast("double") for m, k in ((3, 50), (7, 60), (11, 70))]).alias("pl"))
    rows = g.groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample", "pl"))).alias("s"), F.array(F.sum(F.greatest(30 - F.col("dp"), F.lit(0))), F.sum("dp")).cast("array<double>").alias("sums"))
    rows = rows.select(F.struct(*SITE).alias("key"), F.transform("s", lambda x: x["pl"]).alias("pls"), calling.normalised_quality_sums(F.col("sums")).alias("qs"))
    out = calling.call_sites(rows)
    each = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), ",")), " ")
    shown = {"alleles": F.array_join("alleles", ","), "qual": F.round("qual", 4), "genotypes": F.array_join("genotypes", " "), "gq": F.array_join(F.transform("gq", lambda x: x.cast("string")), " "), "gp": each("gp"), "pl": each("pl")}
    return out.select("key.*", *[v.alias(c) for c, v in shown.items()])


@query(f"""WITH RECURSIVE {_P}, s AS (SELECT chrom, pos, list(x ORDER BY x, y, z) AS x, list(y ORDER BY x, y, z) AS y, list(z ORDER BY x, y, z) AS z, CAST(count(*) AS INTEGER) AS samples FROM w GROUP BY chrom, pos),
 r AS (SELECT *, 0 AS t, CAST(0.2 AS DOUBLE) AS f FROM s UNION ALL
 SELECT chrom, pos, x, y, z, samples, t + 1, list_sum(list_transform(range(1, samples + 1), lambda i: (2 * f * (1 - f) * y[i] + 2 * f * f * z[i]) / ((1 - f) * (1 - f) * x[i] + 2 * f * (1 - f) * y[i] + f * f * z[i]))) / (2 * samples) FROM r WHERE t < 20)
 SELECT chrom, pos, round(f, 8) AS af, samples FROM r WHERE t = 20""")
def frequency_em(spark, sf_dir):
    p = calling.pl_to_prob(F.col("pl"))
    g = likelihoods(spark, sf_dir).select("chrom", "pos", *[F.get(p, F.lit(k)).alias(f"g{k}") for k in range(3)])
    return calling.allele_frequency_em(g, SITE).select("chrom", "pos", F.round("af", 8).alias("af"), "samples")


_TAZ, _THW = 1e-4, 1e-3


@query(f"""WITH RECURSIVE {_S}, {_G}, {_PL}, k AS (SELECT chrom, pos AS kp, pow(pos, 1.1) AS cm FROM s WHERE pos % 97 = 0),
 ends AS (SELECT chrom, min(kp) AS lo, max(kp) AS hi, min(cm) AS locm, max(cm) AS hicm FROM k GROUP BY chrom),
 e AS (SELECT pl.chrom AS chrom, pl.pos AS pos, sample, (1 + src % 98) / 100.0 AS f, pow(10, -p0 / 10.0) AS x, pow(10, -p1 / 10.0) AS y, pow(10, -p2 / 10.0) AS z
   FROM pl JOIN s ON pl.chrom = s.chrom AND pl.pos = s.pos WHERE kind <> 3 AND rec % 3 <> 0 AND p1 + p2 > 0),
 o AS (SELECT chrom, pos, sample, (x * (1 - f) + z * f) / (x + y + z) AS az, (x * (1 - f) * (1 - f) + 2 * y * f * (1 - f) + z * f * f) / (x + y + z) AS hw,
   row_number() OVER w AS i, coalesce(lag(pos) OVER w, pos - 1) AS start, coalesce(lag(pos) OVER w, pos) AS here FROM e WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
 b AS (SELECT o.*, coalesce(k.kp, lo) AS x0, coalesce(k.cm, locm) AS c0, hi, hicm FROM o JOIN ends ON o.chrom = ends.chrom ASOF LEFT JOIN k ON o.chrom = k.chrom AND o.here >= k.kp),
 q AS (SELECT b.*, coalesce(k.kp, hi) AS x1, coalesce(k.cm, hicm) AS c1 FROM b ASOF LEFT JOIN k ON b.chrom = k.chrom AND b.pos <= k.kp),
 c AS (SELECT sample, chrom, pos, i, az, hw, CASE WHEN x1 > x0 THEN greatest(0, least(1, (c1 - c0) / hicm / (x1 - x0) * (least(pos, x1) - greatest(start, x0)))) ELSE 0 END AS r FROM q),
 fw AS (SELECT DISTINCT sample, chrom, CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS f, CAST(0.5 AS DOUBLE) AS v, false AS from_az, false AS stay_az FROM c
  UNION ALL SELECT sample, chrom, i, fa / (fa + fh), va / (va + vh), az_hw, az_az FROM (SELECT c.sample, c.chrom, c.i,
   az * ({1 - _THW} * (1 - r) * f + {_TAZ} * r * (1 - f)) AS fa, hw * ({1 - _TAZ} * (1 - r) * (1 - f) + {_THW} * r * f) AS fh,
   az * greatest({1 - _THW} * (1 - r) * v, {_TAZ} * r * (1 - v)) AS va, hw * greatest({1 - _TAZ} * (1 - r) * (1 - v), {_THW} * r * v) AS vh,
   {_THW} * r * v > {1 - _TAZ} * (1 - r) * (1 - v) AS az_hw, {1 - _THW} * (1 - r) * v > {_TAZ} * r * (1 - v) AS az_az
   FROM fw JOIN c ON fw.sample = c.sample AND fw.chrom = c.chrom AND c.i = fw.i + 1) t),
 last AS (SELECT sample, chrom, max(i) AS i FROM c GROUP BY sample, chrom),
 bw AS (SELECT fw.sample AS sample, fw.chrom AS chrom, fw.i AS i, f, CAST(0.5 AS DOUBLE) AS a, v > 0.5 AS s, from_az, stay_az FROM fw JOIN last ON fw.sample = last.sample AND fw.chrom = last.chrom AND fw.i = last.i
  UNION ALL SELECT sample, chrom, i, f, ba / (ba + bh), s, from_az, stay_az FROM (SELECT fw.sample, fw.chrom, fw.i, fw.f, fw.from_az, fw.stay_az, CASE WHEN bw.s THEN bw.stay_az ELSE bw.from_az END AS s,
   {1 - _THW} * (1 - r) * az * a + {_THW} * r * hw * (1 - a) AS ba, {1 - _TAZ} * (1 - r) * hw * (1 - a) + {_TAZ} * r * az * a AS bh
   FROM bw JOIN c ON bw.sample = c.sample AND bw.chrom = c.chrom AND bw.i = c.i JOIN fw ON fw.sample = bw.sample AND fw.chrom = bw.chrom AND fw.i = bw.i - 1 WHERE fw.i > 0) t)
 SELECT c.sample AS sample, c.chrom AS chrom, c.pos AS pos, CAST(bw.s AS INTEGER) AS state, round(f * a / (f * a + (1 - f) * (1 - a)), 6) AS p_az
 FROM bw JOIN c ON bw.sample = c.sample AND bw.chrom = c.chrom AND bw.i = c.i""")
def homozygous_runs(spark, sf_dir):
    """Likelihoods, frequencies of a source with the same alleles, a genetic map; the SQL goes forward and back along each chain, site by site."""
    v = variants(spark, sf_dir)
    source = v.filter("rec % 3 <> 0 and kind <> 3").select(*SITE, "ref", "alts", F.array((1 + F.col("src") % 98) / F.lit(100.0)).alias("af"))
    sites = joins.allele_frequencies(v.select(*SITE, "ref", "alts"), source).select(*SITE, homozygosity.frequencies_of_tag(F.col("af"), F.size("alts")).alias("af"))
    rows = likelihoods(spark, sf_dir).join(sites, SITE).withColumn("e", homozygosity.likelihood_emissions(F.col("pl"), F.col("af")))
    points = v.filter("pos % 97 = 0").select(*SITE, F.pow("pos", F.lit(1.1)).alias("cm"))
    runs = homozygosity.homozygous_runs(rows.select(*SITE, "sample", "e.p_hw", "e.p_az"), to_az=_TAZ, to_hw=_THW, genetic_map=points)
    return runs.withColumn("p_az", F.round("p_az", 6))


@query(f"""WITH {_G} SELECT sample, chrom, CAST(pos // 1000 AS BIGINT) AS window, min(pos) AS from1, max(pos) AS to1, count(*) AS sites, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS hets,
 sum(CASE WHEN a <> b THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS rate FROM g GROUP BY sample, chrom, pos // 1000""")
def heterozygous_rates(spark, sf_dir):
    rows = genotypes(spark, sf_dir).select("sample", "chrom", "pos", (F.col("a") != F.col("b")).alias("het"))
    return homozygosity.window_rates(rows, 1000)


def phased_files(spark, sf_dir) -> DataFrame:
    """Files of 500 positions, each with the next one's sites too, but for some that only one of the two has; some files have turned phases, and some sites of them have not."""
    g = genotypes(spark, sf_dir).join(variants(spark, sf_dir).select(*SITE), SITE).withColumns({"own": F.expr("pos div 500"), "phased": F.col("pos") % 13 != 0})
    own = g.filter("pos % 11 <> 0").withColumn("chunk", F.col("own"))
    copy = g.filter("pos % 7 <> 0").withColumn("chunk", F.col("own") - 1)
    noise = (F.col("own") != F.col("chunk")) & ((F.col("pos") + F.col("sample")) % (2 + F.col("own") % 5) == 0)
    rows = own.unionByName(copy).withColumn("turn", ((F.col("sample") + F.col("chunk") + 1) % 3 == 0) != noise)
    pick = lambda x, y: F.when(F.col("turn"), F.col(y)).otherwise(F.col(x))
    return rows.select("sample", "chrom", "chunk", "pos", pick("a", "b").alias("a"), pick("b", "a").alias("b"), "phased")


#: The joins file by file: ``st`` carries swap state and phase set on from each file to the next.
LIGATED = f"""{_S}, {_G}, f AS (SELECT sample, g.chrom AS chrom, CAST(g.pos // 500 AS BIGINT) AS own, g.pos AS pos, a, b, g.pos % 13 <> 0 AS phased FROM g JOIN s ON g.chrom = s.chrom AND g.pos = s.pos),
 t AS (SELECT *, own AS chunk, (sample + own + 1) % 3 = 0 AS turn FROM f WHERE pos % 11 <> 0
  UNION ALL SELECT *, own - 1, ((sample + own) % 3 = 0) <> ((pos + sample) % (2 + own % 5) = 0) FROM f WHERE pos % 7 <> 0),
 c AS (SELECT sample, chrom, chunk, pos, CASE WHEN turn THEN b ELSE a END AS a, CASE WHEN turn THEN a ELSE b END AS b, phased FROM t),
 ends AS (SELECT chrom, chunk, min(pos) AS lo, max(pos) AS hi FROM c GROUP BY chrom, chunk),
 nums AS (SELECT *, row_number() OVER w AS k, lag(hi) OVER w AS phi, lead(lo) OVER w AS nlo, lead(hi) OVER w AS nhi FROM ends WINDOW w AS (PARTITION BY chrom ORDER BY chunk)),
 site AS (SELECT DISTINCT c.chrom AS chrom, k, pos, pos <= phi AS before, pos BETWEEN nlo AND nhi AS after FROM c JOIN nums ON c.chrom = nums.chrom AND c.chunk = nums.chunk),
 pairs AS (SELECT x.chrom AS chrom, x.k AS k, x.pos AS pos, row_number() OVER (PARTITION BY x.chrom, x.k ORDER BY x.pos) * 2 > count(*) OVER (PARTITION BY x.chrom, x.k) + 1 AS later
  FROM site x JOIN site y ON x.chrom = y.chrom AND x.pos = y.pos AND y.k = x.k + 1 WHERE x.after AND y.before),
 half AS (SELECT chrom, k, count(*) AS n, min(pos) FILTER (later) AS second FROM pairs GROUP BY chrom, k),
 num AS (SELECT c.*, k FROM c JOIN nums ON c.chrom = nums.chrom AND c.chunk = nums.chunk),
 vote AS (SELECT x.sample AS sample, x.chrom AS chrom, x.k AS k, count(*) FILTER (x.a = y.a AND x.b = y.b) AS m, count(*) FILTER (x.a = y.b AND x.b = y.a) AS o
  FROM num x JOIN num y ON x.sample = y.sample AND x.chrom = y.chrom AND x.pos = y.pos AND y.k = x.k + 1 WHERE x.a <> x.b AND y.a <> y.b AND x.phased AND y.phased GROUP BY 1, 2, 3),
 files AS (SELECT DISTINCT sample, num.chrom AS chrom, num.chunk AS chunk, k FROM num),
 j AS (SELECT files.*, coalesce(n, 0) AS n, second, coalesce(m, 0) AS m, coalesce(o, 0) AS o,
  CASE WHEN n > 0 THEN CASE WHEN m > 0 AND o > 0 THEN CAST(trunc(99 * (0.7 + m / (m + o) * ln(m / (m + o)) + o / (m + o) * ln(o / (m + o))) / 0.7) AS INTEGER) ELSE 99 END END AS q
  FROM files LEFT JOIN half ON files.chrom = half.chrom AND files.k = half.k + 1 LEFT JOIN vote ON files.sample = vote.sample AND files.chrom = vote.chrom AND files.k = vote.k + 1),
 st AS (SELECT sample, chrom, chunk, k, m, o, q, second, false AS swapped, (SELECT min(lo) FROM ends WHERE ends.chrom = j.chrom) AS ps FROM j WHERE k = 1
  UNION ALL SELECT j.sample, j.chrom, j.chunk, j.k, j.m, j.o, j.q, j.second, CASE WHEN j.n = 0 THEN st.swapped WHEN j.m = j.o THEN false ELSE st.swapped <> (j.o > j.m) END,
   CASE WHEN j.q < 30 AND j.second IS NOT NULL THEN j.second ELSE st.ps END FROM st JOIN j ON st.sample = j.sample AND st.chrom = j.chrom AND j.k = st.k + 1)"""


@query(f"""WITH RECURSIVE {LIGATED} SELECT sample, chrom, chunk, m AS matches, o AS mismatches, swapped, q AS quality, ps AS phase_set FROM st""")
def ligate_phase(spark, sf_dir):
    """How phased files join: votes, swap states, qualities and phase sets."""
    return sequence.ligate_phase(phased_files(spark, sf_dir))


_UNITS = [[round(((i * 37 + k * 11) % 100) / 100 - 0.5, 2) for k in range(64)] for i in range(9)]


@query(f"""WITH u AS (SELECT * FROM (VALUES {', '.join(f'({i}, {u})' for i, u in enumerate(_UNITS))}) t(unit, w)),
 d AS (SELECT vec_id, unit, list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - w[i]) * (CAST(embedding[i] AS DOUBLE) - w[i]))) AS d2 FROM embeddings, u)
 SELECT vec_id, CAST(arg_min(unit, d2) AS INTEGER) AS unit, round(min(d2), 6) AS distance2 FROM d GROUP BY vec_id""")
def nearest_unit(spark, sf_dir):
    out = som.nearest_unit(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _UNITS)
    return out.select("vec_id", "unit", F.round("distance2", 6).alias("distance2"))


# --- annotations, gates, consensus -----------------------------------------


@query(f"""WITH {_S} SELECT chrom, pos, '.' AS id, CASE WHEN filter = 'P' THEN '.' ELSE filter END AS filters, '{{"kind":' || kind || '}}' AS info FROM s""")
def drop_annotations(spark, sf_dir):
    v = variants(spark, sf_dir).select("chrom", "pos", "id", F.array("filter").alias("filters"), F.struct("src", "kind").alias("info"))
    out = annotate.drop_annotations(v, ["ID", "FILTER/P", "INFO/src"])
    return out.select("chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), F.coalesce(F.array_join("filters", ";"), F.lit(".")).alias("filters"), F.to_json("info").alias("info"))


@query(f"""WITH {_S}, {_I} SELECT chrom, pos, CAST(CASE WHEN kind IN (1, 2) AND EXISTS (SELECT 1 FROM iv WHERE iv.chrom = s.chrom AND pos <= to1 AND pos + length(ref) - 1 >= from1)
 THEN CASE WHEN (length(alt) - length(ref)) % 3 <> 0 THEN 1 ELSE 0 END ELSE -1 END AS INTEGER) AS oof FROM s""")
def out_of_frame(spark, sf_dir):
    return annotate.out_of_frame(variants(spark, sf_dir), intervals(spark, sf_dir)).select("chrom", "pos", "oof")


@query(f"""WITH {_S}, x AS (SELECT chrom, pos, kind, qual, src, CASE WHEN kind = 2 THEN length(ref) ELSE 1 END AS span FROM s), y AS (SELECT *, kind IN (0, 3) AND EXISTS (SELECT 1 FROM x i
 WHERE i.chrom = x.chrom AND i.kind IN (1, 2) AND ((i.pos <= x.pos AND i.pos + i.span - 1 + 3 >= x.pos) OR (i.pos >= x.pos AND x.pos + 3 >= i.pos))) AS near FROM x)
 SELECT CASE WHEN qual < 40 THEN 'Q' WHEN src % 50 < 3 THEN 'd' WHEN src % 50 > 45 THEN 'D' WHEN near THEN 'G' ELSE '-' END AS letter, count(*) AS n FROM y GROUP BY 1""")
def site_gates(spark, sf_dir):
    """Quality, least and most depth, then an indel within three bases; ``src`` stands for the depth."""
    v = variants(spark, sf_dir).withColumns({"is_snp": F.col("mask") == gen.SNP, "is_indel": F.col("mask") == gen.INDEL})
    v = filters.with_snp_gap(v, 3).withColumn("depth", F.col("src") % 50)
    gates = [("Q", F.col("qual") < 40), ("d", F.col("depth") < 3), ("D", F.col("depth") > 45), ("G", F.col("near"))]
    return v.groupBy(filters.first_gate(gates).alias("letter")).agg(F.count("*").alias("n"))


@query(f"""WITH {_S}, b AS (SELECT chrom, pos, CASE WHEN src % 2 = 1 THEN alt ELSE CASE concat(least(ref, alt), greatest(ref, alt)) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W'
 WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' END END AS base, qual < 50 AS low FROM s WHERE kind IN (0, 3)),
 m AS (SELECT chrom, pos + d AS pos, CAST(NULL AS VARCHAR) AS base, true AS low FROM s, (SELECT unnest(range(-3, 4)) AS d) t WHERE kind IN (1, 2)),
 u AS (SELECT chrom, pos, max(base) AS base, bool_or(low) AS low FROM (SELECT * FROM b UNION ALL SELECT * FROM m) t GROUP BY 1, 2),
 k AS (SELECT DISTINCT chrom, pos // 500 AS chunk FROM u WHERE base IS NOT NULL), x AS (SELECT chrom, chunk, unnest(range(0, 500)) AS o FROM k)
 SELECT x.chrom AS chrom, x.chunk AS chunk, string_agg(CASE WHEN base IS NULL THEN 'n' WHEN low THEN lower(base) ELSE base END, '' ORDER BY o) AS seq
 FROM x LEFT JOIN u ON u.chrom = x.chrom AND u.pos = x.chunk * 500 + o GROUP BY 1, 2""")
def consensus_sequence(spark, sf_dir):
    """SNPs of an even ``src`` are heterozygous; letters within three bases of an indel are in lower case."""
    v = variants(spark, sf_dir)
    base = F.when(F.col("src") % 2 == 1, F.col("alt")).otherwise(gen.iupac(F.col("ref"), F.col("alt")))
    bases = v.filter(F.col("mask") == gen.SNP).select("chrom", "pos", base.alias("base"), (F.col("qual") < 50).alias("low"))
    masks = v.filter(F.col("mask") == gen.INDEL).select("chrom", (F.col("pos") - 3).alias("from1"), (F.col("pos") + 3).alias("to1"))
    return consensus.consensus(bases, masks, size=500)


@query(f"""WITH {_G}, {_PL}, e AS (SELECT *, pow(10, -p0 / 10.0) AS x, pow(10, -p1 / 10.0) AS y, pow(10, -p2 / 10.0) AS z FROM pl), q AS (SELECT chrom, pos, a + b AS d FROM g WHERE sample = 1)
 SELECT sample, round(-sum(ln(CASE d WHEN 0 THEN x WHEN 1 THEN y ELSE z END / (x + y + z))), 4) AS lk, count(*) AS sites FROM e JOIN q ON e.chrom = q.chrom AND e.pos = q.pos GROUP BY sample""")
def sample_likelihood(spark, sf_dir):
    asked = genotypes(spark, sf_dir).filter("sample = 1").select("chrom", "pos", (F.col("a") + F.col("b")).alias("dosage"))
    out = consensus.sample_likelihood(asked, likelihoods(spark, sf_dir))
    return out.select("sample", F.round("lk", 4).alias("lk"), "sites")


# --- events ----------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    return ev.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH h AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS h FROM events) SELECT start, count(*) AS n FROM (SELECT h AS start FROM h UNION ALL SELECT h - INTERVAL '1 hour' FROM h) t GROUP BY start""")
def event_sliding(spark, sf_dir):
    return ev.sliding(table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run""")
def event_sessions(spark, sf_dir):
    return ev.sessions(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
