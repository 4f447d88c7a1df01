"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Kinds: email, ip, card, phone.  The contract's patterns give the *base* spans, which always
stay.  Wider patterns (other spellings, failed checksums, masked addresses) give more
candidates, which count only if the model says so.  Five labelers look at each candidate,
each saying yes, no or nothing: the format (pattern), the value (checksum, ranges), a
gazetteer (top-level domains, card issuers, calling codes, address blocks), the words
before it (context), and what it touches (boundary).  Expectation-maximisation over the
counted vote patterns estimates how reliable every labeler is; base spans are known to be
right.  The posteriors are soft labels of a log-linear span classifier (votes, shape,
length, neighbours, word before), whose weights are one grouped sum, and a candidate that
reaches ``ACCEPT`` becomes a span unless it overlaps another.

All of it is DataFrame functions.  Offsets, for which Spark has no function, come from
splitting a text at the pattern: lengths of the parts and the matches, added up.  Each text
is read once; what is kept is a row of spans per document.  The driver gets the counts of
at most 4 * 2 * 3^5 vote patterns; the classifier's weights are at most 4 kinds x 10
features x ``BINS`` values and are broadcast.

Patterns are written so that no text makes them slow or deep: possessive repeats, and no
start inside a run that a start at its beginning has already failed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, saved
from .registry import query

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9               # probability from which a candidate becomes a span
ROUNDS = 30                # of expectation-maximisation
# How a labeler starts: odds of being right, and spans of experience that this counts for.
# A failed checksum or range is nearly a fact; the others are rules of thumb.
TRUST = ((4.0, 2.0), (19.0, 20.0), (4.0, 2.0), (4.0, 2.0), (4.0, 2.0))
BINS = 1024                # values of a hashed feature
LEFT, RIGHT = 24, 2        # characters of context

# Fixed values of the contract, in the notation that never backtracks: \G is the end of the
# match before, from which a match may start in mid-word.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns; a text is only searched when it has the hint.
WIDE = {
    "email": (r"(?i)[(\[{]\x20?(?:at|@)\x20?[)\]}]",
              r"(?i)(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?[\p{L}0-9-]{1,63}+"
              r"(?:(?:\.|\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?)[\p{L}0-9-]{2,63}+){1,4}+"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:.])"),
    "card": None,          # its base pattern already finds all runs of 12 to 19 digits
    "phone": (r"[0-9][\x20.)-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}",
              r"(?<![0-9A-Za-z.+/=-])(?:\([0-9]{2,4}\)|0[0-9]{1,3}|[0-9]{3})[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z/=-]|\.[0-9])"),
}

# Gazetteers and cue words.
TLDS = ("com org net edu gov mil int info biz io co eu de fr es it nl be uk us ca ch at pl se no dk fi pt ie gr cz hu ro ru ua tr "
        "cn jp kr in au nz br mx ar za").split()
ISSUERS = (r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
           r"|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$")
CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|adresse|correo|courriel|kontakt)\W*$",
    "ip": r"(?i)(?:ip|ipv[46]|host|server|address|client|gateway|dns)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)(?:\W+(?:number|no|nr))?\W*$",
    "phone": r"(?i)(?:tel|telephone|phone|call|mobile|fax|cell|telefon|telefono|t[ée]l[ée]phone|whatsapp)\W*$",
}
AGAINST = (r"(?i)(?:version|v|ver|release|token|password|passwd|pwd|secret|key|sha[0-9]*|md5|hash|uuid|isbn|issn|doi|order|invoice|ref|"
           r"id|no|nr|sku|part|serial)\W*$|[=#/]\W?$")

FOUND = "array<struct<start:int,end:int,m:string,left:string,right:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern in order, with code point offsets and what stands around them."""
    def laid(m: Column, p: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(p, i))
            end = start + F.length(F.get(m, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("m"),
                           F.right(F.get(p, i), F.lit(LEFT)).alias("left"), F.left(F.get(p, i + 1), F.lit(RIGHT)).alias("right"))
            return F.struct(end.alias("at"), F.array_append(s["out"], one).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), state, step, lambda s: s["out"])

    none = F.array().cast(FOUND)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda p: laid(m, p))))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The checksum of a string of digits (at most 19)."""
    at = F.split(F.reverse(d), "")
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + let(
        F.get(at, i).try_cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return total % 10 == 0


OCTETS = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"


def is_base(kind: str, m: Column) -> Column:
    """The contract's test of a match of ``BASE[kind]``."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return luhn(digits(m))
    return F.length(digits(m)).between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), 0).otherwise(-1)


def votes(kind: str, c: Column) -> list[Column]:
    """What the labelers say of a candidate (1 yes, 0 no, -1 nothing): format, value, gazetteer, context, boundary."""
    m, d, never = c["m"], digits(c["m"]), F.lit(False)
    if kind == "email":
        plain = m.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$")
        out = [_vote(plain, m.contains("@") & ~plain), _vote(m.rlike(r"^[\p{L}0-9]"), m.rlike(r"^[._%+-]|\.\.|--")),
               let(F.lower(F.regexp_extract(m, r"([\p{L}0-9-]+)$", 1)), lambda t: _vote(t.isin(TLDS), t.rlike(r"[0-9-]")))]
    elif kind == "ip":
        six, ok = m.contains(":"), m.rlike(OCTETS)
        out = [_vote(m.rlike(r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$") | six, m.rlike(r"[0-9]{4}|(?:^|\.)0[0-9]")), _vote(six | ok, ~ok),
               _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), m.rlike(r"^0|^(?:[3-9][0-9]{2}|[0-9]{4})"))]
    elif kind == "card":
        out = [_vote(m.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$"), ~never),
               let(luhn(d), lambda ok: _vote(ok, ~ok)), _vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS))]
    else:
        out = [_vote(m.rlike(r"^\+|^\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}$"), never),
               _vote(F.length(d).between(9, 15), ~F.length(d).between(7, 15)),
               _vote(m.rlike(CALLING), m.startswith("+"))]
    context = _vote(c["left"].rlike(CUES[kind]), c["left"].rlike(AGAINST))
    touches = c["left"].rlike(r"[\p{L}0-9_=/@#-]$") | c["right"].rlike(r"^[\p{L}0-9_=/@]|^[.:-][0-9]")
    return [*out, context, _vote(~touches, touches)]


def features(kind: str, c: Column, v: list[Column]) -> list[Column]:
    """Values (below ``BINS``) of the classifier's features: the votes, shape, length, neighbours, word before."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c["m"], r"[0-9]{2,}", "99"), "[0-9]", "9"), r"\p{L}+", "a")
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(BINS)).cast("int")
    word = F.lower(F.regexp_extract(c["left"], r"(\p{L}+)\W*$", 1))
    return [*[x + 1 for x in v], hashed(shape), F.least(F.length(c["m"]), F.lit(BINS - 1)),
            hashed(F.regexp_replace(F.right(c["left"], F.lit(1)), r"[\p{L}]", "a")),
            hashed(F.regexp_replace(F.left(c["right"], F.lit(1)), r"[\p{L}]", "a")), hashed(word)]


def _spans(kind: str, text: Column) -> Column:
    """Candidates of a kind as structs (start, end, kind, base, votes, features); those off base never overlap a base span."""
    number = KINDS.index(kind)

    def judged(found: Column, base) -> Column:
        def one(c: Column) -> Column:
            v = votes(kind, c)
            return F.struct(c["start"], c["end"], F.lit(number).alias("kind"), base(c).alias("base"),
                            F.array(*v).alias("votes"), F.array(*features(kind, c, v)).alias("features"))
        return F.transform(found, one)

    strict = judged(matches(text, BASE[kind]), lambda c: is_base(kind, c["m"]))
    hint = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind)
    none = F.array().cast(SPANS)
    if hint is not None:
        strict = F.when(hint, strict).otherwise(none)
    if WIDE[kind] is None:
        return strict
    cue, pattern = WIDE[kind]
    return F.concat(strict, F.when(text.rlike(cue), judged(matches(text, pattern), lambda c: F.lit(False))).otherwise(none))


SPANS = "array<struct<start:int,end:int,kind:int,base:boolean,votes:array<int>,features:array<int>>>"
FINAL = "array<struct<start:int,kind:int,end:int>>"


def _free(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``."""
    return F.filter(spans, lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row, id, base, more): base spans and other candidates of every row of ``docs``, kept in the shared folder."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("id", F.flatten(F.array(*[_spans(k, F.col("text")) for k in KINDS])).alias("spans"))
    return saved(d.select(F.monotonically_increasing_id().alias("row"), "id", F.filter("spans", lambda c: c["base"]).alias("base"),
                          F.filter("spans", lambda c: ~c["base"]).alias("more"))
                 .withColumn("more", _free(F.col("more"), F.col("base"))))


def reliabilities(patterns: list[tuple[int, bool, tuple, int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """(kind, base, votes) -> probability that such a span is personal data.

    EM for labelers that err independently of each other, for each kind: every labeler has a
    distribution of votes for true and for false spans.  It starts with the labelers' ``TRUST`` and
    with one true span in ten off base, as the base patterns have taken the clear ones; base
    spans are true."""
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        own = sorted(p[1:] for p in patterns if p[0] == kind)
        n_labelers = len(own[0][1])
        p = [1.0 if base else 1 / (1 + 9 * math.prod({1: 1 / t, 0: t, -1: 1.0}[x] for x, (t, _) in zip(v, TRUST))) for base, v, _ in own]
        for _ in range(rounds):
            share = (1 + sum(q * n for q, (_, _, n) in zip(p, own))) / (2 + sum(n for _, _, n in own))
            tables = []
            for k in range(n_labelers):
                t, e = TRUST[k]
                yes, no = {1: e * t / (1 + t), 0: e / (1 + t), -1: 1.0}, {1: e / (1 + t), 0: e * t / (1 + t), -1: 1.0}
                for q, (_, v, n) in zip(p, own):
                    yes[v[k]] += q * n
                    no[v[k]] += (1 - q) * n
                tables.append({x: math.log(yes[x] / sum(yes.values())) - math.log(no[x] / sum(no.values())) for x in yes})
            odds = [math.log(share / (1 - share)) + sum(t[x] for t, x in zip(tables, v)) for _, v, _ in own]
            p = [1.0 if base else 1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for (base, _, _), o in zip(own, odds)]
        out |= {(kind, base, v): q for q, (base, v, _) in zip(p, own)}
    return out


def classifier(each: DataFrame, posterior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, feature, value, weight) and (kind, prior) of the log-linear classifier that soft labels give."""
    soft = each.join(F.broadcast(posterior), ["kind", "base", "votes"])       # at most 4 * 2 * 3^5 rows
    totals = soft.groupBy("kind").agg(F.sum("p").alias("yes_all"), F.sum(1 - F.col("p")).alias("no_all"))
    counts = (soft.select("kind", "p", F.posexplode("features").alias("feature", "value")).groupBy("kind", "feature", "value")
              .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")))
    weight = F.log((F.col("yes") + 0.5) / (F.col("yes_all") + 1)) - F.log((F.col("no") + 0.5) / (F.col("no_all") + 1))
    return (counts.join(F.broadcast(totals), "kind").select("kind", "feature", "value", weight.alias("weight")),
            totals.select("kind", F.log((F.col("yes_all") + 1) / (F.col("no_all") + 1)).alias("prior")))


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: id, base and spans, arrays of (start, kind, end) in the order of
    start and kind (an index of ``KINDS``); offsets are code points, end exclusive.

    A null text is empty.  Rows are searched one by one, so repeats get equal spans; empty tables
    give no rows, and without a candidate off base nothing is added."""
    spark = docs.sparkSession
    found = candidates(docs, id_col, text)
    each = saved(found.select("row", F.explode(F.concat("base", "more")).alias("c")).select("row", "c.*"))
    counted = [(r[0], r[1], tuple(r[2]), r[3]) for r in each.groupBy("kind", "base", "votes").count().collect()]
    posterior = spark.createDataFrame([(k, b, list(v), float(p)) for (k, b, v), p in reliabilities(counted).items()],
                                      "kind int, base boolean, votes array<int>, p double")
    weights, priors = classifier(each, posterior)
    open_ = each.where(~F.col("base"))
    score = (open_.select("row", "kind", "start", "end", F.posexplode("features").alias("feature", "value"))
             .join(F.broadcast(weights), ["kind", "feature", "value"]).groupBy("row", "kind", "start", "end").agg(F.sum("weight").alias("score"))
             .join(F.broadcast(priors), "kind").where(F.col("score") + F.col("prior") >= math.log(accept / (1 - accept))))
    added = score.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    # of added spans that overlap, the one that starts first stays
    apart = F.aggregate("added", F.array().cast(FINAL), lambda acc, c: F.when(
        (F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= c["start"]), F.array_append(acc, c)).otherwise(acc))
    base = F.sort_array(F.transform("base", lambda c: F.struct(c["start"], c["kind"], c["end"])))
    return (found.select("row", F.col("id").alias(id_col), base.alias("base"))
            .join(added.select("row", apart.alias("added")), "row", "left")
            .select(id_col, "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("spans")))


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mask: str = "[{}]", **kw) -> DataFrame:
    """``docs`` with every span of its text replaced by the name of its kind; other columns as they
    are.  Of overlapping spans the one that starts first is replaced."""
    names = F.array(*[F.lit(mask.format(k)) for k in KINDS])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("text"))
    d = detect(whole, "doc", "text", **kw)
    t = F.col(f"doc.`{text}`")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, c: F.when(c["start"] < s["at"], s).otherwise(F.struct(
        c["end"].alias("at"), F.concat(s["out"], F.array(F.substring(t, s["at"] + 1, c["start"] - s["at"]), F.get(names, c["kind"]))).alias("out")))
    new = F.aggregate("spans", state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t))))
    out = d.select("doc", F.when(F.size("spans") == 0, t).otherwise(new).alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


@query("op11_pii")
def op11_pii(spark, sf_dir):
    """Personal data of all documents: counts and hash of the base spans, and all spans."""
    d = detect(read(spark, sf_dir, "documents", "doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda c: c["kind"] == KINDS.index(k))).cast("long")
    return d.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
                    digest(F.col("spans")).alias("spans"))
