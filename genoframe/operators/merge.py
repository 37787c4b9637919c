"""Merging files: which records of a site become one record, and what that one holds."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genetics import INDEL, SNP, let
from genoframe.functions.keys import site_key
from genoframe.operators.reshape import by_rule, collected

MODES = {"none": 0, "snps": SNP, "indels": INDEL, "both": SNP | INDEL, "all": -1}


def merged_sample_names(files: list[list[str]], force: bool = False) -> list[str]:
    """All files' samples in order. A name seen before is an error, or with ``force`` gets the file's number from 1 before it."""
    names: list[str] = []
    for k, own in enumerate(files, 1):
        for name in own:
            if name in names and not force:
                raise ValueError(f"two files have a sample {name}")
            names.append(f"{k}:{name}" if name in names else name)
    return names


# --- which records become one ------------------------------------------------


def _bare(ref: str, alt: str) -> tuple[str, str]:
    """REF and ALT without the bases both end in: equal for alleles that say the same at one position."""
    n = 0
    while n < min(len(ref), len(alt)) and ref[-1 - n] == alt[-1 - n] and not alt.startswith("<"):
        n += 1
    return (ref[: len(ref) - n], alt[: len(alt) - n]) if not alt.startswith("<") else ("", alt)


def _may_join(mask: int, seed: int, mode: str) -> bool:
    """Whether a record of class ``mask`` can be with one of class ``seed``: a record without ALT can be with any."""
    if mode == "all" or mask == 0:
        return True
    return all(mask & kind or not seed & kind for kind in (SNP, INDEL))


def _stands_in(mask: int, seed: int, mode: str) -> bool:
    """Whether a record without the allele asked for may take its file's place in a merged record."""
    allowed = MODES[mode]
    if allowed < 0:
        return True
    either = (seed or SNP | INDEL) & (mask or SNP | INDEL)
    return bool(allowed & either) and bool(seed or mask)


def assigned(files: list[int], masks: list[int], refs: list[str], alts: list[list[str]], mode: str) -> list[tuple[int, int]]:
    """For each record of a site (in order of file and line): the merged record and the group that it goes to.

    A group begins with the first record left and takes every record that can be with
    it; in mode ``none`` those of the same class that share an ALT with what the group has so
    far. Inside it the commonest allele, REF first, the earlier of equals, takes a record
    of each file that has it, or else, but in mode ``none``, one that may stand in; that
    is a merged record. It ends when no record is taken; the rest begin a new group.
    """
    bare = [[_bare(r, a) for a in own] for r, own in zip(refs, alts)]
    to: list[tuple[int, int]] = [(-1, -1)] * len(files)
    left, n_merged, group = list(range(len(files))), 0, 0
    while left:
        seed = left[0]
        pool, known = [seed], list(dict.fromkeys(bare[seed]))
        for k in left[1:]:
            together = refs[k].startswith(refs[seed]) or refs[seed].startswith(refs[k])
            if mode == "none":
                together = together and masks[k] == masks[seed] and any(a in known for a in bare[k])
            if together and _may_join(masks[k], masks[seed], mode):
                pool.append(k)
                known += [a for a in bare[k] if a not in known]
        times = {a: sum(a in bare[k] for k in pool) for a in known}
        order = [None, *sorted(known, key=lambda a: -times[a])]  # a stable sort: the earlier of equals first
        for allele in order:
            taken = []
            for f in dict.fromkeys(files[k] for k in pool):
                own = [k for k in pool if files[k] == f and to[k][0] < 0]
                found = [k for k in own if allele is None or allele in bare[k]]
                if not found and mode != "none":
                    found = [k for k in own if _stands_in(masks[k], masks[seed], mode)]
                taken += found[:1]
            if not taken:
                break
            for k in taken:
                to[k] = (n_merged, group)
            n_merged += 1
        left = [k for k in left if to[k][0] < 0]
        group += 1
    return to


#: What separates records, their fields and ALTs in the text of a site that a task looks at.
_RECORD, _FIELD, _ALT = "\x1e", "\x1f", "\x1d"
#: A record of a merged one: its place among the site's, for each new allele its old number (``src``), for each old one
#: its new number (``to``), for each new genotype its old place among likelihoods (``g``).
_TAKEN = pa.struct([("k", pa.int32()), ("src", pa.list_(pa.int32())), ("to", pa.list_(pa.int32())), ("g", pa.list_(pa.int32()))])
_MERGED = pa.list_(pa.struct([("row", pa.int32()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("taken", pa.list_(_TAKEN))]))
_MERGED_DDL = "array<struct<row:int,ref:string,alts:array<string>,taken:array<struct<k:int,src:array<int>,to:array<int>,g:array<int>>>>>"


def _united(own: list[int], near: list[int], refs: list[str], alts: list[list[str]]) -> tuple[list[str], list[list[int | None]]]:
    """The alleles of the records ``own`` together, without the bases that all end in, and each record's ``src``.

    As :func:`reshape.united_alleles`: the longest REF, ALTs extended to it, in order of the records ``near``.
    """
    ref = max((refs[k] for k in own), key=len)
    longer = {k: [a if set(a) & set("<>[]*") else a + ref[len(refs[k]) :] for a in alts[k]] for k in near}
    known = {a for k in own for a in longer[k]}
    named = [ref, *(a for a in dict.fromkeys(a for k in near for a in longer[k]) if a in known)]
    src = [[0, *(longer[k].index(a) + 1 if a in longer[k] else None for a in named[1:])] for k in own]
    n = 0
    while n + 1 < min(map(len, named)) and len({a[-1 - n] for a in named}) == 1:
        n += 1
    return [a[: len(a) - n] for a in named], src


@lru_cache(maxsize=1 << 16)
def _merged_text(site: str, mode: str, genotypes: bool) -> list[dict]:
    """The merged records of a site given as text; many sites have the same alleles."""
    files, masks, refs, alts = zip(*(r.split(_FIELD) for r in site.split(_RECORD)))
    alts = [a.split(_ALT) if a else [] for a in alts]
    to = assigned(list(map(int, files)), list(map(int, masks)), list(refs), alts, mode)
    out = []
    for row, group in dict.fromkeys(to):
        own, near = [k for k, t in enumerate(to) if t[0] == row], [k for k, t in enumerate(to) if t[1] == group]
        named, srcs = _united(own, near, refs, alts)
        taken = []
        for k, src in zip(own, srcs):
            new = {o: j for j, o in reversed(list(enumerate(src))) if o is not None}
            g = [None if x is None or y is None else max(x, y) * (max(x, y) + 1) // 2 + min(x, y) for j, y in enumerate(src) for x in src[: j + 1]] if genotypes else []
            taken.append({"k": k, "src": src, "to": [new.get(o) for o in range(len(alts[k]) + 1)], "g": g})
        out.append({"row": row, "ref": named[0], "alts": named[1:], "taken": taken})
    return out


def _merge(mode: str, genotypes: bool):
    @F.arrow_udf(_MERGED_DDL)
    def merge(sites: pa.Array) -> pa.Array:
        seen = sites.dictionary_encode()
        return pa.array([_merged_text(t, mode, genotypes) for t in seen.dictionary.to_pylist()], _MERGED).take(seen.indices)

    return merge


def merged_records(files: list[DataFrame], mode: str, order: str | None = None, *, genotypes: bool = True) -> DataFrame:
    """(site, row, ref, alts, taken, rows): a row for each merged record, with its alleles; ``rows`` are all records of the site.

    ``taken`` are its own records in file order: ``k``, the place in ``rows``, and ``src``, ``to``
    and ``g``, by which alleles and, unless ``genotypes`` is false, vectors with a value for
    each genotype are renumbered. ``order`` is
    the column of a file's line order; without it records of one file and site go by ``ref``
    and ``alts``. A task looks at the alleles of a site only, not at its samples, and once
    at all sites of a batch that have the same.
    """
    by = site_key(*files)
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    line = [order] if order else ["ref", "alts"]
    rows = reduce(union, [f.withColumns({"file": F.lit(k), "_line": F.struct(F.lit(k), *line)}) for k, f in enumerate(files)])
    sites = collected(rows, by, "_line")
    record = lambda r: F.concat_ws(_FIELD, r["file"].cast("string"), r["mask"].cast("string"), r["ref"], F.coalesce(F.array_join(r["alts"], _ALT), F.lit("")))
    told = sites.withColumn("_told", _merge(mode, genotypes)(F.array_join(F.transform("rows", record), _RECORD)))
    return told.select(*by, "rows", F.explode("_told").alias("_m")).select(*by, "_m.row", "_m.ref", "_m.alts", "_m.taken", "rows")


# --- what the merged record holds --------------------------------------------


def merge_files(
    files: list[DataFrame],
    rules: dict[str, str | tuple[str, str]],
    mode: str = "both",
    sizes: list[int] | None = None,
    *,
    order: str | None = None,
    sample_vectors: dict[str, str] = {},  # noqa: B006
    recount: bool = False,
) -> DataFrame:
    """Full outer merge of files, one record of each file to a merged record; alleles are gathered and renumbered.

    ``rules``: INFO column -> rule, or (rule, number): ``1`` a single value; ``A``, ``R``,
    ``G`` an array with a value for each ALT, allele or diploid genotype, which is put in
    order of the merged alleles before files meet element by element; ``.`` an array as it
    is. Rules: sum, avg, min, max, first, last, join (values of all files, comma-joined).

    REF and ALTs lose the bases that all end in. IDs are joined without repeats in file
    order, QUAL is the largest (0 if all are missing), filters are united with PASS
    dropped where others occur. ``samples``, where files have it, is an array of structs
    with allele numbers ``a`` and ``b`` or an array ``gt`` of any ploidy, and with vectors
    named in ``sample_vectors`` (field -> A, R or G; G has a value for each allele in
    haploid samples). Samples are renumbered and concatenated in file order; with
    ``sizes``, the files' numbers of samples, a file without the record gives so many
    samples without values, whose ``gt`` is as wide as the widest of the record.
    ``recount`` adds ``an`` and ``ac`` from the genotypes.
    """
    by = site_key(*files)
    columns = {c for f in files for c in f.columns}
    kinds = next((f.schema["samples"].dataType.elementType for f in files if "samples" in f.columns), None)
    numbers = [rule[1] for rule in rules.values() if not isinstance(rule, str)] + list(sample_vectors.values())
    found = merged_records(files, mode, order, genotypes="G" in numbers)
    rest = [c for c in dict.fromkeys(["id", "qual", "filter", "filters", *rules]) if c in columns]
    record = lambda t: let(F.get("rows", t["k"]), lambda r: F.struct(*[r[c].alias(c) for c in rest], t.alias("_taken")))
    own = F.transform("taken", record).alias("_own")
    listed = lambda c: F.transform("_own", lambda r: r[c])
    united = F.array_distinct(F.array_compact(listed("filter") if "filter" in columns else F.flatten(F.array_compact(listed("filters")))))
    out = {
        "ref": F.col("ref"),
        "alts": F.col("alts"),
        "id": F.nullif(F.array_join(F.array_distinct(F.array_compact(listed("id"))), ";"), F.lit("")),
        "qual": F.greatest(F.lit(0.0), F.coalesce(F.array_max(listed("qual")), F.lit(0.0))),
        "filters": let(united, lambda u: let(F.array_remove(u, "PASS"), lambda others: F.when(F.size(others) > 0, others).otherwise(u))),
    }
    for c, rule in rules.items():
        rule, number = (rule, "1") if isinstance(rule, str) else rule
        if rule == "join":
            out[c] = F.array_join(F.transform(listed(c), lambda v: v.cast("string")), ",")
        elif number == "1":
            out[c] = F.get(by_rule(rule, F.transform(listed(c), lambda v: F.when(v.isNotNull(), F.array(v)))), F.lit(0))
        elif number == ".":
            out[c] = by_rule(rule, listed(c))
        else:
            out[c] = by_rule(rule, F.transform("_own", lambda r: F.when(r[c].isNotNull(), _renumbered(r[c], r["_taken"], number))))
    if kinds is None:
        whole = found.select(*by, "row", "ref", "alts", own)
        return whole.select(*by, "row", *[v.alias(c) for c, v in out.items()], F.lit(None).cast("int").alias("top_alt"))

    def new(s: Column, r: Column) -> Column:
        fields = {c: s[c] for c in kinds.names}
        if "gt" in kinds.names:
            fields["gt"] = F.transform(s["gt"], lambda a: F.get(r["to"], a))
        else:
            fields |= {c: F.get(r["to"], s[c]) for c in ("a", "b")}
        fields |= {c: F.when(s[c].isNotNull(), _renumbered(s[c], r, number)) for c, number in sample_vectors.items()}
        return F.when(s.isNotNull(), F.struct(*[v.alias(c) for c, v in fields.items()]))

    recoded = F.transform("taken", lambda t: let(F.get("rows", t["k"]), lambda r: F.struct(r["file"].alias("file"), F.transform(r["samples"], lambda s: new(s, t)).alias("s"))))
    whole = found.select(*by, "row", "ref", "alts", own, recoded.alias("_samples"))
    absent = F.lit(None).cast(kinds)
    if "gt" in kinds.names:
        widest = F.array_max(F.flatten(F.transform("_samples", lambda r: F.transform(r["s"], lambda s: F.size(s["gt"])))))
        width = F.greatest(F.lit(0), F.coalesce(widest, F.lit(0)))
        absent = F.struct(*[(F.array_repeat(F.lit(None).cast("int"), width) if f.name == "gt" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])
    of = lambda k: F.get(F.filter("_samples", lambda r: r["file"] == k), F.lit(0))["s"]
    some = lambda k: F.array_repeat(absent, sizes[k] if sizes else 0)
    out["samples"] = F.concat(*[F.coalesce(of(k), some(k)) for k in range(len(files))])
    codes = F.flatten(F.transform("_samples", lambda r: F.flatten(F.transform(r["s"], lambda s: s["gt"] if "gt" in kinds.names else F.array(s["a"], s["b"])))))
    out["top_alt"] = top_allele(codes)
    whole = whole.select(*by, "row", *[v.alias(c) for c, v in out.items()], codes.alias("_codes"))
    if recount:
        count = lambda k: F.size(F.filter("_codes", lambda a: a == k))
        whole = whole.withColumns({"an": F.size(F.array_compact("_codes")), "ac": F.transform(F.sequence(F.lit(1), F.size("alts")), count)})
    return whole.drop("_codes")


def _renumbered(values: Column, t: Column, number: str) -> Column:
    """A record's vector in order of the merged alleles, as :func:`reshape.renumber`; ``t`` is the record's entry in ``taken``."""
    each = lambda places: F.transform(places, lambda o: F.get(values, o))
    if number == "A":
        return F.transform(F.slice(t["src"], 2, F.size(t["src"])), lambda o: F.get(values, o - 1))
    if number == "R":
        return each(t["src"])
    haploid = (F.size(values) == F.size(t["to"])) & (F.size(t["to"]) > 1)
    return each(F.when(haploid, t["src"]).otherwise(t["g"]))


def top_allele(codes: Column) -> Column:
    """The ALT number that most of the sample alleles are, the first of equals; null if there is none."""

    def most(carried: Column) -> Column:
        counted = F.transform(F.array_distinct(carried), lambda k: F.struct(F.size(F.filter(carried, lambda a: a == k)).alias("n"), (-k).alias("k")))
        return -F.array_max(counted)["k"]

    return let(F.filter(codes, lambda a: a > 0), most)
