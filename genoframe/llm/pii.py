"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Labelers vote on candidate spans (``personal`` / ``not personal`` / no vote):

* patterns: the exact base patterns of the four kinds, and looser forms of them;
* a gazetteer: words that stand for an address or a number ("mail", "tel", ...);
* context: what stands right before and after a candidate.

The vote patterns of all candidates are counted (their number is bounded by the
labelers), expectation-maximisation on these counts estimates each labeler's
reliability and the share of personal spans, and the expected labels train a
final span classifier, naive Bayes over the span's own features. Base spans
always stay; further candidates stay where the classifier is sure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import cut, let

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match can begin only where a run of its first
#: class begins or the match before ended: any later place in a run fails as its first
#: does. Said so, a run is walked once and not once from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser forms: a number without its plus sign; an address with spelt marks.
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])"
LOOSE_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{2,63}){1,3}"
#: Cue words by kind.
GAZETTEER = {
    "email": ["mail", "email", "e-mail", "contact", "correo", "courriel", "write"],
    "ip": ["ip", "host", "server", "address", "login"],
    "card": ["card", "visa", "mastercard", "amex", "tarjeta", "karte", "carte", "payment"],
    "phone": ["tel", "phone", "call", "mobile", "fax", "telefon", "cell", "whatsapp", "sms"],
}
CONTEXT = 40
SURE = 0.9
RUN = 128
PIECE = 1024


def running(values: Column, step, start: Column) -> Column:
    """For each value, ``step`` folded over ``start`` and all values before it.

    Runs of RUN values are folded on their own and then moved on by what comes before
    them, so no long array grows one by one. ``step`` must be associative.
    """
    none = F.slice(F.array(start), 1, 0)

    def fold(xs: Column, of) -> Column:
        grown = lambda acc, x: F.struct(step(acc["top"], of(x)).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("top"), none.alias("out")), grown)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: fold(F.slice(values, b * RUN + 1, F.lit(RUN)), lambda x: x))
    moved = lambda rs: F.flatten(
        F.zip_with(rs, fold(rs, lambda r: r["top"])["out"], lambda r, before: F.transform(r["out"], lambda x: step(before, x)))
    )
    return F.when(F.size(values) == 0, none).otherwise(let(runs, moved))


def spans_of(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), code points.

    The pieces between matches and the matches themselves add up to the places.
    ``gate``: a cheap condition that every text with a match meets.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def places(gaps: Column, found: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: g + F.length(v))
        before = running(both, lambda a, x: a + x, F.lit(0))
        return let(
            before,
            lambda at: F.transform(
                found,
                lambda v, i: F.struct(
                    (F.get(at, i) + F.get(gaps, i)).alias("start"), (F.get(at, i) + F.get(gaps, i) + F.length(v)).alias("end"), v.alias("value")
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(gate, let(found, lambda f: let(gaps, lambda g: places(g, f)))).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc
        + let(
            F.substr(F.reverse(number), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: d - F.when(d > 9, 9).otherwise(0),
        ),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: let(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) <= 2) | ((F.length(n) == 3) & (n <= "255"))),
        )
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.length(digits(value)).between(9, 15)


_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _gates(text: Column) -> dict[str, Column]:
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
        "phone": text.rlike(r"\+[0-9]"),
    }


def _tagged(text: Column) -> Column:
    """All matches of base and looser patterns: (start, end, value, kind number, base)."""
    gates = _gates(text)
    parts = [_marked(spans_of(text, _PATTERN[k], gates[k]), n, lambda v, k=k: _valid(k, v)) for n, k in enumerate(KINDS)]
    spelt_at, grouped = text.rlike(r"(?i)[\[(]\x20?at\x20?[\])]"), text.rlike(r"[0-9)][\x20.-][0-9]{3,4}[\x20.-]")
    parts.append(_marked(spans_of(text, LOOSE_EMAIL, spelt_at), 0, lambda v: F.lit(False)))
    parts.append(_marked(spans_of(text, LOOSE_PHONE, grouped), 3, lambda v: F.lit(False)))
    return F.concat(*parts)


def _marked(spans: Column, kind: int, is_base) -> Column:
    """Spans with kind and base; of the others those with a likely number of digits."""
    marked = F.transform(
        spans,
        lambda s: F.struct(s["start"], s["end"], s["value"], F.lit(kind).alias("kind"), is_base(s["value"]).alias("base")),
    )
    few, many = ((0, 64), (0, 0), (12, 19), (7, 16))[kind]
    return F.filter(marked, lambda s: s["base"] | F.length(digits(s["value"])).between(few, many))


def _free(spans: Column, among) -> Column:
    """Of spans by (start, kind): those not in ``among`` that overlap none of ``among`` before them, and those of ``among``.

    A span overlaps one before it if the largest end so far lies beyond its start.
    """
    ends = F.transform(spans, lambda s: F.when(among(s), s["end"]).otherwise(0))
    reach = running(ends, lambda a, x: F.greatest(a, x), F.lit(0))
    return let(reach, lambda r: F.filter(spans, lambda s, i: among(s) | (F.get(r, i) <= s["start"])))


def _candidates(tagged: Column) -> Column:
    """Base spans, and what is not base and overlaps none of them nor an earlier further one; by (start, kind).

    Sorted neighbours decide, so a text of many candidates costs no comparison of all with all.
    """
    far = F.lit(2**31 - 1)
    plain = F.transform(tagged, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["base"].alias("base"), s["end"].alias("end"), s["value"].alias("value")))

    def none_follows(spans: Column) -> Column:
        """Without what is not base and ends beyond the start of a base span after it."""
        begins = F.transform(F.reverse(spans), lambda s: F.when(s["base"], s["start"]).otherwise(far))
        after = F.reverse(running(begins, lambda a, x: F.least(a, x), far))
        return let(after, lambda r: F.filter(spans, lambda s, i: s["base"] | (F.get(r, i) >= s["end"])))

    def first_of_more(spans: Column) -> Column:
        """Without what is not base and overlaps an earlier such span, kept or not."""
        ends = F.transform(spans, lambda s: F.when(s["base"], 0).otherwise(s["end"]))
        reach = running(ends, lambda a, x: F.greatest(a, x), F.lit(0))
        return let(reach, lambda r: F.filter(spans, lambda s, i: s["base"] | (F.get(r, i) <= s["start"])))

    few = F.size(tagged) < 2
    whole = let(F.array_sort(plain), lambda t: let(_free(t, lambda s: s["base"]), lambda t: let(none_follows(t), first_of_more)))
    return F.when(few, plain).otherwise(whole)


def _votes(c: Column, before: Column, after: Column) -> list[Column]:
    """One column for each labeler: 1 personal, 0 not, 2 no vote."""
    low = F.lower(before)
    value, kind = c["value"], c["kind"]
    own_cue, other_cue = F.lit(False), F.lit(False)
    for n, k in enumerate(KINDS):
        cue = low.rlike(r"(?:^|[^\p{L}])(?:" + "|".join(GAZETTEER[k]) + r")[^\p{L}]{0,6}$")
        own_cue, other_cue = own_cue | ((kind == n) & cue), other_cue | ((kind != n) & cue)
    number = before.rlike(r"(?i)(?:no|nr|id|order|isbn|version|page|art|ref|sku|[#$€£=/._-])[.:]?\x20?$")
    joined = before.rlike(r"[\p{L}0-9_/=-]$") | after.rlike(r"^[\p{L}0-9_/=]")
    uniform = (kind != 0) & (digits(value).rlike(r"^([0-9])\1*$") | digits(value).rlike("^0"))
    n_digits = F.length(digits(value))
    shape = (
        F.when(kind == 0, value.rlike(r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$"))
        .when(kind == 1, F.lit(True))
        .when(kind == 2, n_digits.isin(13, 15, 16))
        .otherwise(n_digits.between(10, 12))
    )
    return [
        F.when(c["base"], 1).otherwise(F.when(kind.isin(1, 2), 0).otherwise(2)),  # the exact pattern
        F.when(own_cue, 1).when(other_cue, 0).otherwise(2),  # the gazetteer
        F.when(number, 0).otherwise(2),  # what stands before
        F.when(joined, 0).otherwise(1),  # whether it stands alone
        F.when(uniform, 0).otherwise(2),  # made-up digits
        F.when(shape, 1).otherwise(0),  # the kind's usual length or ending
    ]


def _features(c: Column, before: Column, after: Column) -> list[Column]:
    """Small whole numbers that the final classifier looks at."""
    value = c["value"]
    return [
        c["kind"] * 2 + c["base"].cast("int"),
        c["kind"] * 32 + F.least(F.lit(31), F.length(digits(value))),
        c["kind"] * 8 + F.least(F.lit(7), F.size(F.split(value, r"[^\p{L}0-9]+", -1))),
        F.when(before.rlike(r"[\x20\n]$") | (before == ""), 0).when(before.rlike(r"[(\[<\"':,;]$"), 1).otherwise(2),
        F.when(after.rlike(r"^[\x20\n]") | (after == ""), 0).when(after.rlike(r"^[)\]>\"':,;.!?]"), 1).otherwise(2),
        F.when(F.lower(before).rlike(r"\p{L}[^\p{L}]{0,3}$"), 1).otherwise(0),
    ]


N_VOTES, N_FEATURES = 6, 6


def estimate(patterns: list[tuple[list[int], float]], rounds: int = 60) -> tuple[float, list[tuple[list[float], list[float]]], list[float]]:
    """Expectation-maximisation on (votes, count): prior, chances of votes by class, posteriors.

    ``chances[j] = (p(vote | not personal), p(vote | personal))`` over the votes 0, 1, 2.
    The start holds that labelers are better than chance; counts are smoothed.
    """
    if not patterns:
        return 0.5, [], []
    n_votes = len(patterns[0][0])
    prior = 0.5
    chances = [([0.5, 0.2, 0.3], [0.2, 0.5, 0.3]) for _ in range(n_votes)]
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chances[j][1][v] / chances[j][0][v]) for j, v in enumerate(votes))
            posterior.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
        total = sum(n for _, n in patterns)
        prior = (sum(n * p for (_, n), p in zip(patterns, posterior)) + 1) / (total + 2)
        for j in range(n_votes):
            seen = [[1.0, 0.4, 0.6], [0.4, 1.0, 0.6]]
            for (votes, n), p in zip(patterns, posterior):
                seen[0][votes[j]] += n * (1 - p)
                seen[1][votes[j]] += n * p
            chances[j] = tuple([x / sum(side) for x in side] for side in seen)
    return prior, chances, posterior


def classifier(rows: list[tuple[int, int, float, float]]) -> list[dict[int, float]]:
    """(feature, value, personal, not personal) expected counts -> log odds by value.

    Naive Bayes: a span's score adds up the log odds of its features as if they were
    independent; counts are smoothed by a half.
    """
    totals: dict[int, list[float]] = {}
    for f, _, yes, no in rows:
        t = totals.setdefault(f, [0.0, 0.0])
        t[0] += yes
        t[1] += no
    out: list[dict[int, float]] = [{} for _ in range(N_FEATURES)]
    for f, v, yes, no in rows:
        t = totals[f]
        out[f][v] = math.log((yes + 0.5) / (t[0] + 1)) - math.log((no + 0.5) / (t[1] + 1))
    return out


def _looked_up(weights: dict[int, float], at: Column) -> Column:
    if not weights:
        return F.lit(0.0)
    known = F.create_map(*[F.lit(x) for v, w in sorted(weights.items()) for x in (v, w)])
    return F.coalesce(F.try_element_at(known, at), F.lit(0.0))


_FOUND = "array<struct<start:int,end:int,kind:int,base:boolean,value:string,before:string,after:string>>"


def _piece(pieces: Column, at: Column, n: Column) -> Column:
    """``n`` code points from place ``at`` of a text cut into pieces of PIECE."""
    k = F.floor(at / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substr(both, at - k * PIECE + 1, n)


def find_pii(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row for each row of ``documents``: doc_id and ``spans``.

    ``spans``: array of (start, end, kind, base), by start and kind; code points, end
    exclusive; ``kind`` an index into :data:`KINDS`. Base spans are all kept; others
    where the final classifier gives at least ``sure``. Null texts are empty texts
    and have no spans; repeated rows each give a row; other columns are not looked
    at; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))

    def near(spans: Column) -> Column:
        """Spans with the text right before and after them, out of pieces of PIECE code points: a place in a long text is not looked up from its start."""
        around = lambda ps: F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
                s["base"].alias("base"),
                s["value"].alias("value"),
                _piece(ps, F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT))).alias("before"),
                _piece(ps, s["end"], F.lit(8)).alias("after"),
            ),
        )
        pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.when(F.size(spans) > 0, let(pieces, around)).otherwise(F.expr(f"cast(array() as {_FOUND})"))

    found = cut(docs.select("doc_id", let(let(_tagged(F.col("text")), _candidates), near).alias("found")))
    one = found.select(F.explode("found").alias("c"))
    c, before, after = F.col("c"), F.col("c.before"), F.col("c.after")
    # Votes and features are small numbers, so their patterns are few: count them.
    counted = one.groupBy(F.array(*_votes(c, before, after)).alias("v"), F.array(*_features(c, before, after)).alias("f")).count()
    counted = cut(counted)
    patterns = [(list(r["v"]), float(r["n"])) for r in counted.groupBy("v").agg(F.sum("count").alias("n")).orderBy("v").collect()]
    _, _, posterior = estimate(patterns)
    share = {tuple(v): p for (v, _), p in zip(patterns, posterior)}
    by_value: dict[tuple[int, int], list[float]] = {}
    sums = [0.0, 0.0]
    for r in counted.select("v", F.posexplode("f").alias("k", "x"), "count").groupBy("v", "k", "x").agg(F.sum("count").alias("n")).collect():
        p = share[tuple(r["v"])]
        cell = by_value.setdefault((r["k"], r["x"]), [0.0, 0.0])
        cell[0] += p * r["n"]
        cell[1] += (1 - p) * r["n"]
        if r["k"] == 0:
            sums[0] += p * r["n"]
            sums[1] += (1 - p) * r["n"]
    weights = classifier([(k, x, a, b) for (k, x), (a, b) in sorted(by_value.items())])
    start = math.log((sums[0] + 1) / (sums[1] + 1))

    def chance(s: Column) -> Column:
        score = F.lit(start)
        for w, at in zip(weights, _features(s, s["before"], s["after"])):
            score = score + _looked_up(w, at)
        return 1 / (1 + F.exp(-score))

    kept = F.filter("found", lambda s: s["base"] | (chance(s) >= sure))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("doc_id", F.array_sort(plain).alias("spans"))


def spelt(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def pii_report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the base spans, and all spans, for each row."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelt(base).cast("binary"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in square brackets; overlapping spans merge."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def parts(reach: Column) -> Column:
        # What stands before a span that begins beyond all spans before it, and its kind; the rest of the text at the end.
        shown = F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= F.get(reach, i),
                F.concat(F.substr(text, F.get(reach, i) + 1, s["start"] - F.get(reach, i)), F.element_at(names, s["kind"] + 1)),
            ).otherwise(""),
        )
        last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(shown, ""), F.substr(text, last + 1, F.length(text)))

    return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), parts)
