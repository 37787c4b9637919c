"""Variant-call text files as tables, and tables as such files.

The header is small and read to the driver; it types the INFO columns. Records are
parsed with built-in functions over ``spark.read.text``. ``rec`` keeps their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.sources.blocks import SPLIT_BYTES, read_block_lines

_KIND = {"Integer": "int", "Float": "float", "String": "string", "Character": "string", "Flag": "boolean"}
_FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


@dataclass
class Header:
    lines: list[str] = field(default_factory=list)
    info: dict[str, tuple[str, str]] = field(default_factory=dict)
    format: dict[str, tuple[str, str]] = field(default_factory=dict)
    contigs: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, lines: list[str]) -> "Header":
        h = cls()
        for line in lines:
            m = re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)", line)
            if m:
                (h.info if m[1] == "INFO" else h.format)[m[2]] = (m[3], m[4])
            elif c := re.match(r"##contig=<ID=([^,>]+)", line):
                h.contigs.append(c[1])
            if line.startswith("#CHROM"):
                h.samples = line.split("\t")[9:]
            else:
                h.lines.append(line)
        return h


def read_header(spark: SparkSession, path: str | list[str], lines: DataFrame | None = None) -> Header:
    """The lines that begin with ``#`` of the first file, by name, of a path or of the first path of a list, or of its ``lines``.

    Reading stops at the first record, so no more than a batch of each split is looked at.
    """
    first = lines is None and spark.read.format("binaryFile").load(path if isinstance(path, str) else path[0]).agg(F.min("path")).first()[0]

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b[b["value"].str.startswith("#")]
            yield own
            if len(own) < len(b):
                return

    return Header.of([r["value"] for r in (spark.read.text(first) if lines is None else lines).mapInPandas(head, "value string").collect()])


def _dot(c: Column) -> Column:
    return F.nullif(c, F.lit("."))


def read_vcf(spark: SparkSession, path: str | list[str], header: Header | None = None, *, blocks: bool = False, split_bytes: int = SPLIT_BYTES) -> tuple[Header, DataFrame]:
    """(header, records): chrom, contig, pos, id, ref, alts, qual, filters, info (struct), samples, rec.

    With ``blocks``, files are block-gzipped text, read by many tasks, or binary; see :mod:`genoframe.sources.blocks`.

    ``samples``: an array in header order of maps FORMAT tag -> text; ``.`` and absent
    values are null, absent flags false, filters null where ``.``, alts empty where ``.``.
    """
    lines = read_block_lines(spark, path, split_bytes) if blocks else spark.read.text(path)
    header = header or (read_header(spark, path, read_block_lines(spark, path if isinstance(path, str) else path[0], split_bytes)) if blocks else read_header(spark, path))
    cells = F.split("value", "\t")
    at = {n: F.get(cells, F.lit(k)) for k, n in enumerate(_FIXED)}
    info = F.str_to_map(at["INFO"], F.lit(";"), F.lit("="))

    def typed(tag: str, number: str, kind: str) -> Column:
        value = F.try_element_at(F.col("_info"), F.lit(tag))
        if kind == "Flag":
            return F.array_contains(F.map_keys("_info"), tag).alias(tag)
        if number == "1":
            return _dot(value).try_cast(_KIND[kind]).alias(tag)
        return F.transform(F.split(value, ","), lambda v: _dot(v).try_cast(_KIND[kind])).alias(tag)

    contigs = F.array(*[F.lit(c) for c in header.contigs]) if header.contigs else F.expr("cast(array() as array<string>)")
    tags = F.split(F.get(cells, F.lit(8)), ":")
    per_sample = F.transform(
        F.slice(cells, 10, F.greatest(F.size(cells), F.lit(9))),
        lambda s: F.map_from_arrays(F.slice(tags, 1, F.size(F.split(s, ":"))), F.transform(F.split(s, ":"), _dot)),
    )
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.withColumns({"rec": F.monotonically_increasing_id(), "_info": info})
    out = rows.select(
        at["CHROM"].alias("chrom"),
        (F.array_position(contigs, at["CHROM"]).cast("int") - 1).alias("contig"),
        at["POS"].cast("long").alias("pos"),
        _dot(at["ID"]).alias("id"),
        at["REF"].alias("ref"),
        F.filter(F.split(at["ALT"], ","), lambda a: a != ".").alias("alts"),
        _dot(at["QUAL"]).try_cast("float").alias("qual"),
        F.when(at["FILTER"] != ".", F.split(at["FILTER"], ";")).alias("filters"),
        F.struct(*[typed(t, n, k) for t, (n, k) in header.info.items()]).alias("info") if header.info else F.lit(None).cast("string").alias("info"),
        F.when(F.size(cells) > 9, per_sample).otherwise(F.expr("cast(array() as array<map<string,string>>)")).alias("samples"),
        "rec",
    )
    return header, out


def number_text(c: Column) -> Column:
    """A float as C prints it with %g: six significant digits, no trailing zeros."""
    d = c.cast("double")
    digits = F.floor(F.log10(F.nullif(F.abs(d), F.lit(0.0)))).cast("int")
    places = F.greatest(F.lit(0), F.lit(5) - digits)
    scaled = F.rint(d * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
    plain = F.regexp_replace(F.regexp_replace(scaled.cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", d), r"(\.[0-9]*?)0*e", "$1e"), r"\.e", "e")
    return F.when(d == 0, "0").when(digits.between(-4, 5), plain).when(d.isNotNull(), power)


def line_of(header: Header) -> Column:
    """A record as a tab-separated line (columns of :func:`read_vcf`)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("."))

    def shown(tag: str, number: str, kind: str) -> Column:
        v = F.col(f"info.{tag}")
        if kind == "Flag":
            return F.when(v, tag)
        one = number_text if kind == "Float" else (lambda c: c.cast("string"))
        value = one(v) if number == "1" else F.array_join(F.transform(v, one), ",", ".")
        return F.concat(F.lit(f"{tag}="), value)

    info = F.concat_ws(";", *[shown(t, n, k) for t, (n, k) in header.info.items()]) if header.info else F.lit("")
    cells = [
        F.col("chrom"), F.col("pos").cast("string"), text(F.col("id")), F.col("ref"),
        F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."),
        F.coalesce(number_text(F.col("qual")), F.lit(".")), F.coalesce(F.array_join("filters", ";"), F.lit(".")),
        F.when(info == "", ".").otherwise(info),
    ]
    if header.samples:
        keys = F.map_keys(F.get("samples", F.lit(0)))
        cells.append(F.array_join(keys, ":"))
        cells.append(F.array_join(F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(s, k), F.lit("."))), ":")), "\t"))
    return F.concat_ws("\t", *cells)


def write_vcf(header: Header, records: DataFrame, path: str) -> None:
    """Sorted by contig, position and record; the header is the first part's first lines."""
    spark = records.sparkSession
    columns = _FIXED + (["FORMAT", *header.samples] if header.samples else [])
    head = spark.createDataFrame([("\n".join([*header.lines, "#" + "\t".join(columns)]), -1, 0, 0)], "value string, contig int, pos long, rec long")
    body = records.select(line_of(header).alias("value"), F.coalesce("contig", F.lit(1 << 30)).alias("contig"), "pos", "rec")
    ordered = head.unionByName(body).orderBy("contig", "pos", "rec")
    ordered.select("value").write.text(path)
