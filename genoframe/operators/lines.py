"""Records as text lines: what to print, the heading, and provenance lines of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genetics import type_names

#: The columns that a list of annotations begins with.
LISTED = ("CHROM", "POS", "MASK", "REF", "ALT")


def shown(name: str, df: DataFrame) -> Column:
    """A named column as text: ``CHROM POS ID REF ALT QUAL FILTER TYPE MASK`` or any other of the table; missing is ``.``, a set flag ``1``.

    ``NAME{i}`` is element i of an array, ``.`` beyond its end.
    """
    name, _, at = name.rstrip("}").partition("{")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    fixed = {"CHROM": "chrom", "POS": "pos", "ID": "id", "REF": "ref", "QUAL": "qual", "MASK": "present"}
    if name == "ALT":
        return F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    if name == "FILTER":
        return F.coalesce(F.array_join("filters", ";"), F.lit("."))
    if name == "TYPE":
        return type_names(F.col("mask"))
    column = fixed.get(name, name)
    kind = df.select(column).schema[0].dataType.typeName()
    if kind == "array":
        values = F.transform(column, lambda v: F.coalesce(v.cast("string"), F.lit(".")))
        return text(F.get(values, F.lit(int(at)))) if at else F.coalesce(F.nullif(F.array_join(values, ","), F.lit("")), F.lit("."))
    if kind == "boolean":
        return F.when(F.col(column), "1").otherwise(".")
    return text(F.col(column)) if at in ("", "0") else F.lit(".")


def format_lines(df: DataFrame, parts: list[str | Column], per_sample=None, separator: str = "\t") -> DataFrame:
    """(chrom, pos, line): named columns and texts in order, then what ``per_sample`` (a sample's struct -> Column) gives for each sample."""
    cells = [shown(p, df) if isinstance(p, str) else p for p in parts]
    if per_sample is not None:
        cells.append(F.array_join(F.transform("samples", per_sample), separator))
    return df.select("chrom", "pos", F.concat_ws(separator, *cells).alias("line"))


def listed(names: list[str]) -> list[str]:
    """The parts of a line of annotations: the fixed first columns, then ``names``."""
    return [*LISTED, *names]


def heading(parts: list[str], samples: list[str] = (), fields: list[str] = ()) -> str:
    """``# [1]CHROM\t[2]POS`` and so on; each sample's fields as ``SAMPLE:FIELD``."""
    names = [*parts, *(f"{s}:{f}" for s in samples for f in fields)]
    return "# " + "\t".join(f"[{k}]{n}" for k, n in enumerate(names, 1))


def appended(lines: list[str], more: list[str]) -> list[str]:
    """A header's ``##`` lines with others at the end; a line that is there already, or whose INFO, FORMAT, FILTER or contig id is, is passed over."""
    key = lambda line: line.split(",")[0] if "=<ID=" in line else line
    have = {key(x) for x in lines}
    out = list(lines)
    for line in more:
        if not line.startswith("##"):
            raise ValueError(f"no header line: {line}")
        if key(line) not in have:
            have.add(key(line))
            out.append(line)
    return out


def with_provenance(lines: list[str], command: str, version: str, arguments: str) -> list[str]:
    """Two more lines, which a comparison of outputs leaves out: the version and the call that made the file."""
    return [*lines, f"##{command}Version={version}", f"##{command}Command={arguments}"]
