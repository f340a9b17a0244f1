"""Personal data by weak supervision.

Patterns propose spans. Five labelers vote on each: the pattern's own check, a gazetteer, words before it, the characters
around it, and words that speak against it; each may abstain. How often a labeler is right is nowhere known: it is
estimated by expectation-maximisation from how the votes agree, over counts of vote combinations, whose number doesn't
depend on the input. A logistic classifier over votes and features of the span's form, which no labeler looks at, is
trained on the resulting probabilities and compiled into a column. Spans
of the base kinds that pass their checks always stay; the classifier decides about the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch

#: The base kinds. Possessive runs and the look-behind at a run's start find what the plain patterns
#: (e.g. [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+) find, in linear time and without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds.
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mail": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}\x20?[(\[]?\x20?(?:\bat\b)\x20?[)\]]?\x20?[a-z0-9-]{2,64}\x20?[(\[]?\x20?(?:\bdot\b)\x20?[)\]]?\x20?[a-z]{2,10}(?![a-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Fixed values, the gazetteer: top-level domains; calling codes of two digits, and what those of three begin with; IBAN
#: lengths by country; networks of cards as (first prefix, last prefix, lengths); special networks; prefixes of keys.
DOMAINS = (
    "com org net edu gov mil int info biz name pro io dev app ai co me tv eu de fr es uk ch at it us ca nl be se no fi dk pl pt ie cz sk si hu ro bg gr tr ru ua lt lv ee "
    "lu jp cn kr in id my sg th vn ph au nz br mx ar cl pe za ng ke eg il ae sa example test"
).split()
CALLING_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CALLING_THREE = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
CARDS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 17, 18, 19)),
    ("644", "659", (16, 17, 18, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)),
)
NETWORKS = ("10.", "127.", "169.254.", "192.168.", "192.0.2.", "198.51.100.", "203.0.113.", *(f"172.{k}." for k in range(16, 32)))
KEYS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
#: Words whose nearness speaks for a kind, and words that speak against any.
CONTEXT = {
    "email": r"(?i)mail|contact|write|schreib|kontakt|courriel|correo|contacto",
    "ip": r"(?i)\bip\b|host|server|address|adresse|login|from",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"(?i)call|phone|tel|mobile|fax|ruf|appel|llam|contact",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
    "mail": r"(?i)mail|contact|write|reach|schreib|kontakt",
    "secret": r"(?i)token|key|secret|password|passwd|api|auth|credential",
    "ssn": r"(?i)ssn|social|security|tax",
    "tel": r"(?i)call|phone|tel|mobile|fax|contact",
}
AGAINST = r"(?i)version|isbn|issn|doi|order|invoice|figure|section|commit|sha1?|checksum|serial|part no|sku|page"
KINDS = [*BASE, *MORE]
#: Kinds that have a check which can fail.
CHECKED = ("ip", "card", "phone", "iban", "secret")
LABELERS = ("check", "gazetteer", "context", "edges", "against")
#: Labelers that vote one way only: that they abstain tells something too.
ONE_WAY = {2, 4}
#: What the classifier sees besides the votes.
FEATURES = ("length", "digits", "line")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(place: Column) -> Column:
        d = F.substring(digits, n - place + 1, F.lit(1)).cast("int")
        return F.when(place % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, place: acc + worth(place)) % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    """The check of a kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    small = F.forall(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", F.char_length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[A-Za-z]"))
        .otherwise(F.lit(True))
    )


def _by_kind(patterns: dict[str, str], kind: Column, text: Column) -> Column:
    whole = F.lit(False)
    for k, p in patterns.items():
        whole = F.when(kind == k, text.rlike(p)).otherwise(whole)
    return whole


def _gazetteer(kind: Column, match: Column) -> Column:
    """1 if the gazetteer knows what the match names, -1 if it has no such thing, 0 if it can't tell."""
    sign = lambda yes: F.when(yes, 1).otherwise(-1)
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    two = F.substring(digits, 1, 2)
    card = F.lit(False)
    for first, last, lengths in CARDS:
        card = card | (F.substring(digits, 1, len(first)).between(first, last) & n.isin(*lengths))
    country = F.substring(match, 1, 2)
    length = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), country)
    octet = F.regexp_extract(match, "^[0-9]+", 0)
    starts = lambda prefixes: match.rlike("^(?:" + "|".join(p.replace(".", "[.]") for p in prefixes) + ")")
    domain = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
    return (
        F.when(kind.isin("email", "mail"), sign(domain))
        .when(kind == "ip", F.when(starts(NETWORKS), 1).when(octet.isin("0", *map(str, range(224, 256))), -1).otherwise(0))
        .when(kind == "card", sign(card))
        .when(kind == "phone", sign(digits.rlike("^[17]") | two.isin(*CALLING_TWO, *CALLING_THREE)))
        .when(kind == "iban", sign(F.coalesce(length == F.char_length(F.replace(match, F.lit(" "), F.lit(""))), F.lit(False))))
        .when(kind == "secret", F.when(starts(KEYS), 1).otherwise(0))
        .when(kind == "ssn", sign(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")))
        .when(kind == "tel", sign(digits.rlike("^[2-9](?!11)[0-8][0-9][2-9]")))
        .otherwise(0)
    )


def _votes(kind: Column, match: Column, ahead: Column, behind: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 abstains."""
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    checked = _passes(kind, match)
    glued = ahead.rlike(r"[\p{L}\p{N}_]$") | behind.rlike(r"^[\p{L}\p{N}_]")
    return {
        "check": F.when(kind.isin(*CHECKED), sign(checked, ~checked)).otherwise(0),  # of other kinds it says nothing
        "gazetteer": _gazetteer(kind, match),
        "context": sign(_by_kind(CONTEXT, kind, ahead), F.lit(False)),
        "edges": sign(~glued, glued),
        "against": sign(F.lit(False), ahead.rlike(AGAINST)),
    }


def _features(match: Column, ahead: Column) -> dict[str, Column]:
    """Small whole numbers: the length in eights, the share of digits in quarters, and whether a line begins."""
    n = F.char_length(match)
    digits = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    return {
        "length": F.least(F.lit(5), F.floor(n / 8)).cast("int"),
        "digits": F.floor(4 * digits / n).cast("int"),
        "line": ahead.rlike(r"(?:^|\n)\s*$").cast("int"),
    }


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(true) of each (kind, votes) by expectation-maximisation. A labeler has, for true and for false spans, one
    probability for each of its votes; a kind has a share of true spans. Starts from the majority of votes. Whether a
    labeler abstains is no evidence, unless that is all it can do but vote one way."""
    heard = [[(i, x) for i, x in enumerate(v) if x or i in ONE_WAY] for _, v, _ in counts]
    prob = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in counts}
    for _ in range(rounds):
        share: dict[str, list[float]] = {}
        told: dict[tuple[int, bool], list[float]] = {}
        for (k, v, n), own in zip(counts, heard, strict=True):
            p = prob[k, v]
            s = share.setdefault(k, [1.0, 1.0])
            s[0] += n * p
            s[1] += n * (1 - p)
            for i, x in own:
                for true, weight in ((True, p), (False, 1 - p)):
                    told.setdefault((i, true), [1.0, 1.0, 1.0])[x + 1] += n * weight
        for (k, v, _), own in zip(counts, heard, strict=True):
            odds = math.log(share[k][0] / share[k][1])
            for i, x in own:
                yes, no = told[i, True], told[i, False]
                odds += math.log(yes[x + 1] / sum(yes)) - math.log(no[x + 1] / sum(no))
            prob[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prob


def fit(tally: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], prob: dict, steps: int = 300) -> tuple[float, dict[tuple[str, object], float]]:
    """Logistic weights of bias, and of (column, value) for kinds, votes and features, fitted to the probabilities of
    (kind, votes); each kind weighs the same in all. tally: kind, votes, features, rows."""
    cells = [[("kind", k), *zip(LABELERS, v, strict=True), *zip(FEATURES, f, strict=True)] for k, v, f, _ in tally]
    names = sorted({c for row in cells for c in row}, key=str)
    place = {c: i for i, c in enumerate(names)}
    x = np.zeros((len(tally), len(names)))
    for i, row in enumerate(cells):
        x[i, [place[c] for c in row]] = 1
    total: dict[str, int] = {}
    for k, _, _, n in tally:
        total[k] = total.get(k, 0) + n
    share = np.array([n / total[k] for k, _, _, n in tally])
    want = np.array([prob[k, v] for k, v, _, _ in tally])
    bias, w = 0.0, np.zeros(len(names))
    for _ in range(steps):
        d = (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - want) * share
        bias -= 0.5 * float(d.sum())
        w -= 0.5 * (x.T @ d + 0.001 * w)
    return bias, {c: float(w[i]) for c, i in place.items()}


def _pieces(kind: str, pattern: str) -> Column:
    """What lies between matches, each with the match that ends it; the last piece has none."""
    pieces = F.transform(
        F.split("text", pattern, -1),
        lambda p: F.struct(F.char_length(p).alias("gap"), F.right(p, F.lit(40)).alias("ahead"), F.left(p, F.lit(8)).alias("behind")),
    )
    both = F.zip_with(pieces, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.transform(both, lambda s, at: F.struct(
        F.lit(kind).alias("kind"), at.alias("at"), s["p"]["gap"].alias("gap"), s["m"].alias("match"), s["p"]["ahead"].alias("ahead"), s["p"]["behind"].alias("behind")
    ))


def find_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of each row, and the proposed spans: row, kind, start, end in code points, match, ahead, behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,at:int,gap:int,match:string,ahead:string,behind:string>>")
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    arrays = [F.when(F.col("text").rlike(pattern), _pieces(kind, pattern)).otherwise(none) for kind, pattern in (BASE | MORE).items()]
    table = scratch.store(found.select("row", "doc_id", F.concat(*arrays).alias("spans")))
    parts = table.select("row", F.inline("spans"))
    # a document's own pieces: their number is bounded by its length
    order = Window.partitionBy("row", "kind").orderBy("at")
    length = F.coalesce(F.char_length("match"), F.lit(0))
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = parts.select("row", "kind", "match", "ahead", F.lead("behind").over(order).alias("behind"), (end - length).alias("start"), end.alias("end")).where("match IS NOT NULL")
    return table.select("row", "doc_id"), spans


def find_private(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end, in code points with the end exclusive, by kind as listed in ``KINDS``, then start. Those
    of the base kinds are all that pass their checks. Of the others those stay whose score reaches ``threshold`` and
    that touch no base span. A null or empty text has no spans: counts of 0 and the digest of the empty text. Repeated
    rows each have their row; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "private")
    rows, spans = find_spans(docs, scratch)
    ahead = F.coalesce("ahead", F.lit(""))
    seen = _votes(F.col("kind"), F.col("match"), ahead, F.coalesce("behind", F.lit(""))) | _features(F.col("match"), ahead)
    voted = scratch.store(spans.select("row", "kind", "start", "end", *(c.alias(n) for n, c in seen.items())))
    # at most a row for each kind, vote and feature: a few thousand
    tally = voted.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    score = _score([(r["kind"], tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), r["n"]) for r in sorted(tally, key=str)])
    base = F.col("kind").isin(*BASE)
    judged = voted.select("row", "kind", "start", "end", base.alias("base"), F.when(base, F.col("check") >= 0).otherwise(score >= threshold).alias("stays")).where("stays")
    by_place = Window.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = judged.withColumn("before", before).withColumn("after", after).where(
        F.col("base") | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    )
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    by_row = free.groupBy("row").agg(*map(count, BASE), F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end"))).alias("all"))
    show = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["place"].cast("int")), s["start"], s["end"])), ",")
    empty = F.array().cast("array<struct<place:bigint,start:bigint,end:bigint>>")
    joined = rows.join(by_row, "row", "left").withColumn("all", F.coalesce("all", empty))
    return joined.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(show(F.filter("all", lambda s: s["place"] <= len(BASE))), 256).alias("base_sha256"), show(F.col("all")).alias("spans"),
    )


def _score(tally: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> Column:
    """The classifier's probability as a column; it is trained on what the votes say, and sees the features as well."""
    if not tally:
        return F.lit(0.0)
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for k, v, _, n in tally:
        counts[k, v] = counts.get((k, v), 0) + n
    bias, weights = fit(tally, estimate([(k, v, n) for (k, v), n in counts.items()]))
    total = F.lit(bias)
    for (name, value), w in sorted(weights.items(), key=str):
        total = total + F.when(F.col(name) == value, w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))
