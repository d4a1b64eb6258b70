"""Personal data by weak supervision, with built-in functions only.

Candidates of four kinds (email, ip, card, phone) are the matches of the base
patterns, valid or not, and of wider patterns: bracketed ``at`` and ``dot``,
IPv6, card numbers that stand next to other numbers, phone numbers inside
longer digit runs or without a country code.  Six labelers vote for, against
or not at all on each candidate: two by regex (shape, check digits or ranges),
one by gazetteer (endings of mail domains, issuer ranges, calling codes,
address classes) and three by context (words before it that name the kind,
words that name something else, neighbouring characters).

The votes are counted by pattern over all documents.  Expectation-maximisation
on these counts estimates how reliable each labeler is for each kind; its
probabilities are the targets of a logistic regression on the candidate's
features (votes and surroundings), the span classifier.  Valid base matches
are spans as they are; of the other candidates those are added that overlap
none of them and that the classifier accepts.

Positions come from ``split`` and ``regexp_extract_all`` with the same
pattern: the pieces between matches and the matches give running sums, taken
in blocks of the square root of their number.  Everything happens inside the
document's row; only pattern counts are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone"]

# Base patterns.  Quantifiers are possessive where nothing can be given back, and a match starts at the
# previous match's end or where its first run of characters starts, so that a long run is read once.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:[\[({] ?(?i:at) ?[\])}]|@)", r"(?:[\[({] ?(?i:dot) ?[\])}]|\.)"
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?{_AT} ?[A-Za-z0-9-]++(?: ?{_DOT} ?[A-Za-z0-9-]++){{1,8}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20.-])[0-9]{6}\2[0-9]{5}"
            r"|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}"
             r"|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9A-Za-z])",
}
TRIGGER = {"email": r"@|[\[({] ?(?i:at) ?[\])}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{2}|[0-9][ -][0-9]",
           "phone": "[+][0-9]|[0-9]{3}"}

LABELERS = ["shape", "check", "known", "cue", "other", "edge"]
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,7}\.[A-Za-z]{2,24}$",
    "ip": rf"^(?:{_OCTET}(?:\.{_OCTET}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}})$",
    "card": r"^(?:[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20.-]?)[0-9]{6}\2[0-9]{5})$",
    "phone": r"^(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])(?:[0-9]{2,4}[\x20.-]?){1,3}[0-9]{2,4}$",
}
# Gazetteers: endings of mail domains, card issuer ranges, country calling codes, first parts of unicast addresses.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|uk|us|ca|ch|at|be|nl|pl|pt|se|no|fi|dk|ie|mx|ar|br|jp|cn|in|au)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[01][0-9]|12[0-689]|1[3-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|30|36|38)",
    "phone": r"^(?:\+|00)(?:1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01])",
}
# Context: words before a candidate that name its kind, and words that name something else.
CUE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|addr|client|adresse|direcci.n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pan|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|handy|t.l.phone|tel.fono)\b",
}
OTHER = r"(?i)\b(?:version|ver|v|isbn|issn|order|invoice|ref|reference|token|hash|sha1|sha256|md5|key|serial|page|section|id|doi)\b[^A-Za-z]{0,6}$"
GLUED_LEFT, GLUED_RIGHT = r"[\p{L}\p{N}_=/\\#@+\"-]$", r"^(?:[\p{L}\p{N}_=/\\#@\"-]|[.,][0-9])"

LEFT, RIGHT = 40, 12           # characters of context
DIGITS_OF_A_FAILED_CARD = 7    # shorter digit runs are no candidates
THRESHOLD = 0.9
EM_STEPS, NEWTON_STEPS = 15, 10
PSEUDO, RIDGE = 20.0, 1.0
START = {1: (0.1, 0.3, 0.6), 0: (0.5, 0.3, 0.2)}  # share of votes against, none, for: of spans and of others
FEATURES = 1 + 2 * len(LABELERS) + 5


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(numbers: Column) -> Column:
    """Array of the sums of all earlier entries; n entries cost n ** 1.5 steps."""
    def blocks(s):
        def within(before):
            return F.transform(s["x"], lambda _, i: F.get(before, F.floor(i / s["b"]).cast("int")) + _total(
                F.slice(s["x"], (F.floor(i / s["b"]) * s["b"] + 1).cast("int"), i % s["b"])))

        def cumulated(sums):
            return F.transform(sums, lambda _, k: _total(F.slice(sums, F.lit(1), k)))

        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["x"]) - 1) / s["b"]).cast("int")),
                           lambda k: _total(F.slice(s["x"], k * s["b"] + 1, s["b"])))
        return let(let(sums, cumulated), within)

    return F.when(F.size(numbers) > 0, let(F.struct(
        numbers.alias("x"), F.ceil(F.sqrt(F.size(numbers))).cast("int").alias("b")), blocks)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, trigger: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, m, left, right); code points, end exclusive.
    ``left`` and ``right`` are the text around it up to its neighbours' nearest characters."""
    kind = "array<struct<start int, end int, m string, left string, right string>>"

    def placed(s):
        def all_of(before):
            def one(m, i):
                piece, after = F.get(s["p"], i), F.get(s["p"], i + 1)
                start = F.get(before, i) + F.length(piece)
                return F.struct(
                    start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"),
                    F.right(F.concat(F.coalesce(F.right(F.get(s["m"], i - 1), F.lit(1)), F.lit("")), piece), F.lit(LEFT)).alias("left"),
                    F.left(F.concat(after, F.coalesce(F.left(F.get(s["m"], i + 1), F.lit(1)), F.lit(""))), F.lit(RIGHT)).alias("right"))

            return F.transform(s["m"], one)

        sizes = F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["p"], i)))
        return let(running_sums(sizes), all_of)

    found = let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), placed)
    return F.when(text.rlike(trigger), found).otherwise(F.array().cast(kind))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_valid(kind: str, m: Column) -> Column:
    """The base rule's condition on a match."""
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no=None) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).otherwise(-1 if no is None else F.when(no, -1).otherwise(0))


def _votes(kind: str, c: Column) -> Column:
    """The labelers' votes (1, 0, -1) on a candidate, in the order of LABELERS."""
    m, never = c["m"], F.lit(False)
    if kind == "email":  # as it would be written plainly
        m = F.regexp_replace(F.regexp_replace(m, f"\\x20?{_AT}\\x20?", "@"), f"\\x20?{_DOT}\\x20?", ".")
    check = {
        "email": ~m.rlike(r"\.\.|^[.-]|-\.|\.-|-$"),
        "ip": F.when(m.contains(":"), F.lit(True)).otherwise(is_valid("ip", m)),
        "card": is_valid("card", m),
        "phone": F.length(digits(m)).between(9, 15),
    }[kind]
    known = m.rlike(KNOWN[kind])
    return F.array(
        _vote(m.rlike(SHAPE[kind])), _vote(check), _vote(known, None if kind in ("card", "ip") else never),
        _vote(c["left"].rlike(CUE[kind]), never), _vote(never, c["left"].rlike(OTHER)),
        F.when(c["left"].rlike(GLUED_LEFT) | c["right"].rlike(GLUED_RIGHT), -1).otherwise(1)).cast("array<int>")


def _active(c: Column, votes: Column) -> Column:
    """Numbers of the candidate's features that are on."""
    at = [F.lit(0)]
    for k in range(len(LABELERS)):
        v = F.get(votes, F.lit(k))
        at.append(F.when(v == 1, 2 * k + 1).when(v == -1, 2 * k + 2))
    extra = [c["left"].rlike(r"(?:^|\s)$"), c["right"].rlike(r"^(?:$|\s)"), c["m"].rlike("[ .-]"), F.length(digits(c["m"])) > 12,
             c["m"].rlike("[A-Za-z]")]
    at += [F.when(x, 2 * len(LABELERS) + 1 + k) for k, x in enumerate(extra)]
    return F.filter(F.array(*at), lambda x: x.isNotNull())


def _described(kind: str, found: Column, base: bool) -> Column:
    """Candidates as (start, kind, end, value, base, votes, active); kind by its place in KINDS."""
    def one(c):
        ok = F.coalesce(is_valid(kind, c["m"]), F.lit(False)) if base else F.lit(False)
        return let(_votes(kind, c), lambda v: F.struct(
            c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"), c["m"].alias("value"),
            ok.alias("base"), v.alias("votes"), _active(c, v).alias("active")))

    if base and kind == "card":
        found = F.filter(found, lambda c: F.length(digits(c["m"])) >= DIGITS_OF_A_FAILED_CARD)
    return F.transform(found, one)


def _apart(wide: Column, spans: Column) -> Column:
    """The candidates of ``wide`` that overlap no span; spans are searched in blocks of the square root of their number."""
    def check(s):
        b = F.ceil(F.sqrt(F.size(s))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / b).cast("int")), lambda k: F.slice(s, k * b + 1, b))
        bounded = F.transform(parts, lambda p: F.struct(
            p.alias("s"), F.get(p, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(p, lambda x: x["end"])).alias("hi")))
        return let(bounded, lambda blocks: F.filter(wide, lambda w: ~F.exists(blocks, lambda q: (
            (q["lo"] < w["end"]) & (q["hi"] > w["start"])
            & F.exists(q["s"], lambda x: (x["start"] < w["end"]) & (x["end"] > w["start"]))))))

    return let(spans, lambda s: F.when(F.size(s) > 0, check(s)).otherwise(wide))


def candidates(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The chosen columns as ``row``, plus ``spans`` (valid base matches, by start, kind and end) and ``others``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text.alias("_text"))
    text = F.col("_text")
    found = found.select(
        "row", F.concat(*[_described(k, matches(text, BASE[k], TRIGGER[k]), True) for k in KINDS]).alias("b"),
        F.concat(*[_described(k, matches(text, WIDE[k], TRIGGER[k]), False) for k in KINDS]).alias("w"))
    parts = let(F.struct(F.sort_array(F.filter("b", lambda c: c["base"])).alias("spans"),
                         F.filter("b", lambda c: ~c["base"]).alias("failed"), F.col("w").alias("w")),
                lambda s: F.struct(s["spans"].alias("spans"), F.concat(s["failed"], _apart(s["w"], s["spans"])).alias("others"),
                                   F.size(s["failed"]).alias("failed")))
    return stored(found.select("row", parts.alias("p")).select("row", "p.spans", "p.others", "p.failed"), "span-candidates")


def patterns(found: DataFrame) -> DataFrame:
    """(kind, votes, active, n): the distinct candidates as labelers and classifier see them; their number is
    bounded by the number of vote and feature combinations, not by the documents."""
    every = found.select(F.explode(F.concat("spans", "others")).alias("c"))
    return stored(every.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.active").alias("active"))
                  .agg(F.count(F.lit(1)).alias("n")), "vote-patterns")


class LabelModel:
    """Reliability of each labeler by kind: log odds of a span for a vote against, none, for; and the prior's."""

    def __init__(self):
        rows = [math.log(a / b) for a, b in zip(START[1], START[0])]
        self.votes = {k: [list(rows) for _ in LABELERS] for k in range(len(KINDS))}
        self.prior = {k: 0.0 for k in range(len(KINDS))}

    def probability(self, kind: Column, votes: Column) -> Column:
        """Probability that a candidate is a span."""
        out = None
        for k in self.votes:
            odds = F.lit(self.prior[k])
            for i, row in enumerate(self.votes[k]):
                odds = odds + F.get(F.array(*[F.lit(x) for x in row]), F.get(votes, F.lit(i)) + 1)
            out = F.when(kind == k, odds) if out is None else out.when(kind == k, odds)
        return 1 / (1 + F.exp(-out))

    def improve(self, counted: DataFrame) -> float:
        """One step of expectation-maximisation over the patterns; the largest change of a log odds."""
        p = self.probability(F.col("kind"), F.col("votes"))
        each = counted.select("kind", "n", p.alias("p"), F.posexplode("votes").alias("l", "v"))
        sums = {(r["kind"], r["l"], r["v"]): (r["one"], r["zero"]) for r in each.groupBy("kind", "l", "v").agg(
            F.sum(F.col("n") * F.col("p")).alias("one"), F.sum(F.col("n") * (1 - F.col("p"))).alias("zero")).collect()}
        change = 0.0
        for k in {x[0] for x in sums}:
            one, zero = (sum(sums.get((k, 0, v), (0, 0))[y] for v in (-1, 0, 1)) for y in (0, 1))
            new = math.log((one + PSEUDO) / (zero + PSEUDO))
            change, self.prior[k] = max(change, abs(new - self.prior[k])), new
            for i in range(len(LABELERS)):
                for v in (-1, 0, 1):
                    a, b = sums.get((k, i, v), (0, 0))
                    new = math.log((a + PSEUDO * START[1][v + 1]) / (one + PSEUDO) * (zero + PSEUDO) / (b + PSEUDO * START[0][v + 1]))
                    change = max(change, abs(new - self.votes[k][i][v + 1]))
                    self.votes[k][i][v + 1] = new
        return change


def fit_labelers(counted: DataFrame, steps: int = EM_STEPS) -> LabelModel:
    model = LabelModel()
    for _ in range(steps):
        if model.improve(counted) < 1e-3:
            break
    return model


def _score(kind: Column, active: Column, weights: dict[int, list[float]]) -> Column:
    """The classifier's probability."""
    own = None
    for k, w in weights.items():
        table = F.array(*[F.lit(float(x)) for x in w])
        own = F.when(kind == k, table) if own is None else own.when(kind == k, table)
    return 1 / (1 + F.exp(-F.aggregate(active, F.lit(0.0), lambda a, i: a + F.get(own, i))))


def fit_classifier(counted: DataFrame, model: LabelModel, steps: int = NEWTON_STEPS) -> dict[int, list[float]]:
    """Weights of the features by kind: logistic regression on the label model's probabilities, by Newton's
    method; a step's sums are one aggregate, its 18 equations for each kind are solved on the driver."""
    data = stored(counted.withColumn("target", model.probability(F.col("kind"), F.col("votes"))), "vote-targets")
    weights = {k: [0.0] * FEATURES for k in range(len(KINDS))}
    for _ in range(steps):
        p = _score(F.col("kind"), F.col("active"), weights)
        each = data.select("kind", "active", (F.col("n") * (F.col("target") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        each = each.select("kind", "active", "g", "h", F.explode("active").alias("i")).select(
            "kind", "g", "h", "i", F.explode("active").alias("j"))
        sums = each.groupBy("kind", "i", "j").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        change = 0.0
        for k in {r["kind"] for r in sums}:
            w = np.array(weights[k])
            slope, curve = -RIDGE * w, RIDGE * np.eye(FEATURES)
            for r in sums:
                if r["kind"] == k:
                    curve[r["i"], r["j"]] += r["h"]
                    if r["i"] == r["j"]:
                        slope[r["i"]] += r["g"]
            step = np.linalg.solve(curve, slope)
            step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
            change = max(change, float(np.abs(step).max()))
            weights[k] = (w + step).tolist()
        if change < 1e-4:
            break
    return weights


def find_spans(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The chosen columns (default: all) plus ``spans``: array of (start, end, kind, value, base, probability),
    by start, then kind in the order of KINDS, then end.

    Positions are code points of the whole text, the end exclusive; ``probability`` is the classifier's;
    ``base`` spans are kept at any probability, others from ``threshold`` on.  One row per input row.  Null
    and empty texts have no spans; null or repeated ids and other columns pass through; an input column
    called spans is replaced; an empty table gives an empty result.  The models are fitted, on all
    candidates of all rows, when this is called; the candidates (not the texts) are stored.
    """
    names = [c for c in (columns if columns is not None else docs.columns) if c.lower() != "spans"]
    found = candidates(docs, names, text_col)
    counted = patterns(found)
    weights = fit_classifier(counted, fit_labelers(counted))

    def scored(c):
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value"),
                        c["base"].alias("base"), _score(c["kind"], c["active"], weights).alias("probability"))

    # failed base matches come first among the others; they are counted but only wider candidates are added
    wide = F.slice(F.col("others"), F.col("failed") + 1, F.size("others"))
    spans = F.sort_array(F.concat(F.transform("spans", scored), F.filter(
        F.transform(wide, scored), lambda c: c["probability"] >= threshold)))
    named = F.transform(spans, lambda c: F.struct(
        c["start"], c["end"], F.get(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).alias("kind"), c["value"], c["base"], c["probability"]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], named.alias("spans"))
