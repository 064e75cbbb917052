"""Personal data by weak supervision, in DataFrame functions only.

Four patterns give base spans. They and looser patterns (numbers without a country code, disguised addresses, bank
accounts, secrets) give candidates, on which five labelers vote: the pattern's own checks, the shape, a gazetteer, the
words before, and the characters around. Expectation maximisation over the counts of vote patterns (a few hundred
rows, whatever the corpus) estimates how far each labeler can be trusted for each kind; a logistic classifier of
spans is trained on the resulting soft labels and adds the candidates that it accepts.

No step takes more than linear time in a text or in its candidates: patterns are possessive, what stands around a
match is read from the piece before or after it, and running sums and maxima go by parts of ``PART``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise

#: The kinds with a base pattern, and those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
#: The base patterns, written so that no text takes more than linear time: runs are possessive, and a match starts
#: only where a run starts (or where the last match ended), which is where the leftmost match starts anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
_KEY = r"(?i:api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|token|secret|passw(?:or)?d|pwd|contraseña|passwort|kennwort)"
#: Patterns of candidates only, by a name: (kind, what a text must hold, pattern).
LOOSE = {
    "local": ("phone", r"[0-9][)\x20./-]", r"(?<![0-9+)(.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/.-][0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3})(?![0-9])"),
    "disguised": ("email", r"(?i)[\[({]at[\])}]|\x20dot\x20", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]{2,63}+)++|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+)++)"),
    "iban": ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": ("secret", rf"{_KEY}|AKIA|gh[pousr]_|sk-|xox[abprs]-", rf"(?<![A-Za-z0-9]){_KEY}[\"']?\x20{{0,2}}[:=]\x20{{0,2}}[\"']?[A-Za-z0-9+/_=.~-]{{8,}}+|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{12,}}+|gh[pousr]_[A-Za-z0-9]{{20,}}+|sk-[A-Za-z0-9]{{20,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+)"),
}
#: Gazetteers. Fixed values.
DOMAINS = "com|org|net|edu|gov|io|info|biz|co|uk|de|fr|es|it|nl|eu|ch|at|be|us|ca|au|jp|cn|in|br|ru"
ACCOUNTS = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
BEFORE = {
    "email": r"(?i)(?:mail|contact|write to|reply|correo|courriel)\W*+$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|direcci[oó]n)\W*+$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W*+$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\W*+$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)\W*+$",
    "secret": r"(?i)(?:key|login|credentials|env|export|set)\W*+$",
}
AGAINST = r"(?i)(?:\bv|version|isbn|section|release|id|no)[.:#\x20]*+$"
LABELERS = ("check", "shape", "gazetteer", "context", "around")
#: Characters before a match that are read; elements of an array that are folded together.
_LEFT, PART = 24, 256


def _most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _running(of: Column, value, step, start: Column) -> Column:
    """For each element of the array ``of``: ``step`` over the values of those before it, from ``start``.

    By parts: each is folded, then the folds of the parts, and then each part again from there, so that no array
    longer than a part (or than the number of parts) is ever built up by one.
    """

    def scan(values: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, none, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / PART).cast("int")), lambda k: F.transform(F.slice(of, k * PART + 1, F.lit(PART)), value))
    tops = F.transform(parts, lambda p: F.aggregate(p, start, step))
    return F.when(F.size(of) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.zip_with(parts, scan(tops, start), scan)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number has the remainder 1 that its check digits give it."""
    s = F.replace(m, F.lit(" "))
    turned = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + digit(c)).otherwise(a * 100 + digit(c)) % 97) == 1


def _span(name: str, m: Column, piece: Column, after: Column, start: Column) -> Column:
    """A candidate with its votes and features; ``piece`` and ``after`` are the text between it and its neighbours."""
    kind = LOOSE[name][0] if name in LOOSE else name
    digits = _digits(m)
    n = F.length(digits)
    before, right = F.substring(piece, -_LEFT, _LEFT), F.substring(after, 1, 1)
    left = F.substring(piece, -1, 1)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    b, e, context = start, start + F.length(m), _vote(before.rlike(BEFORE[kind]), before.rlike(AGAINST))
    if kind == "email":
        check, shape = F.lit(True), _vote(F.length(m) <= 254, F.length(m) > 254)
        gazetteer = _vote(m.rlike(rf"(?i)(?:\.|dot[\])}}\x20]\x20?)(?:{DOMAINS})$"), F.lit(False))
    elif kind == "ip":
        check = m.rlike(rf"^{part}(?:\.{part}){{3}}$")
        shape = _vote(m.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), F.lit(True))
        gazetteer = _vote(m.rlike(r"^(?:10|127|172|192)\.") | m.rlike(r"[0-9]{2}"), m.rlike(r"^0|^[0-9](?:\.[0-9]){3}$"))
    elif kind == "card":
        check = (n >= 13) & (n <= 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
        shape = _vote(m.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), F.lit(True))
        gazetteer = _vote(digits.rlike(r"^[3-6]"), F.lit(True))
    elif kind == "phone":
        check = F.lit(name == "phone") & (n >= 9) & (n <= 15)
        shape = _vote(m.rlike(r"[0-9]{3}[\x20.-]?[0-9]{4}$"), ~n.between(7, 15))
        gazetteer = _vote(m.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), m.rlike(r"^\+0"))
    elif kind == "iban":
        check, shape, gazetteer = _mod97(m), _vote(F.length(F.replace(m, F.lit(" "))).between(15, 34), F.lit(True)), _vote(m.rlike(f"^(?:{ACCOUNTS})"), F.lit(True))
    else:  # the span is the value, without the name before it
        value = F.regexp_extract(m, r"[A-Za-z0-9+/_.~-]++=*$", 0)
        b = e - F.length(value)
        check = value.rlike(r"[0-9]") & value.rlike(r"[A-Za-z]") & (F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) >= 7)
        shape = _vote(value.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Za-z0-9+/_-]{20,}=*)$") | value.rlike(r"^(?:AKIA|gh[pousr]_|sk-|xox)"), F.length(value) < 10)
        gazetteer, context = _vote(m.rlike(rf"^{_KEY}|^(?:AKIA|gh[pousr]_|sk-|xox)"), F.lit(False)), _vote((b > start) | before.rlike(BEFORE[kind]), F.lit(False))
    odd = r"[A-Za-z0-9_]"
    votes = {"check": _vote(check, F.lit(True)), "shape": shape, "gazetteer": gazetteer, "context": context, "around": _vote(~left.rlike(odd) & ~right.rlike(odd), F.lit(True))}
    base = check if name in BASE else F.lit(False)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), b.alias("b"), e.alias("e"), base.alias("base"), F.least(n, F.lit(20)).alias("digits"), *[v.cast("int").alias(k) for k, v in votes.items()])


def _spans(name: str, found: Column, pieces: Column) -> Column:
    """The candidates of a pattern from its matches and the pieces of text between them."""
    zipped = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"), F.slice(pieces, 2, F.size(found)).alias("q"))
    at = _running(zipped, lambda x: F.length(x["p"]) + F.length(x["m"]), lambda a, x: a + x, F.lit(0))
    both = F.arrays_zip(zipped.alias("z"), at.alias("at"))
    if name == "card":  # other numbers are no candidates
        both = F.filter(both, lambda x: F.length(_digits(x["z"]["m"])).between(13, 19))
    return F.transform(both, lambda x: _span(name, x["z"]["m"], x["z"]["p"], x["z"]["q"], x["at"] + F.length(x["z"]["p"])))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (null text: empty) with ``pii_spans``: its candidates, by pattern and then start."""
    has = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {k: (text.contains(has[k]) if has[k] else F.lit(True), p) for k, p in PATTERNS.items()} | {k: (text.rlike(has_), p) for k, (_, has_, p) in LOOSE.items()}
    none = F.array().cast("array<string>")
    out = docs.withColumns({f"pii_m_{k}": F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (may, p) in patterns.items()})
    out = out.withColumns({f"pii_p_{k}": F.when(F.size(f"pii_m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, (_, p) in patterns.items()})
    empty = _spans("email", none, none)
    found = [F.when(F.size(f"pii_m_{k}") > 0, _spans(k, F.col(f"pii_m_{k}"), F.col(f"pii_p_{k}"))).otherwise(empty) for k in patterns]
    return out.withColumn("pii_spans", F.concat(*found)).drop(*[f"pii_{x}_{k}" for k in patterns for x in "mp"])


@dataclass
class Model:
    """What was learned: for each kind, the trust in each labeler, and the weights of the span classifier."""

    reliability: dict[str, dict[str, dict[int, float]]]
    weights: dict[str, float]


def _features(kind: int, digits: int, votes: tuple[int, ...]) -> list[str]:
    return [f"{kind}", f"{kind}:digits:{digits}", *[f"{kind}:{name}:{v}" for name, v in zip(LABELERS, votes, strict=True)]]


def fit(found: DataFrame, rounds: int = 30) -> Model:
    """Expectation maximisation over vote patterns, then the classifier on its soft labels.

    Only counts of patterns leave the executors: at most 6 kinds x 21 digit counts x 3**5 votes rows.
    """
    return learned(found.select(F.inline("pii_spans")).groupBy("kind", "digits", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", "digits", *LABELERS).collect(), rounds)


def learned(rows: list, rounds: int = 30) -> Model:
    """The model of counted vote patterns: rows with kind, digits, a vote of each labeler, and n."""
    reliability: dict[str, dict[str, dict[int, float]]] = {}
    names: dict[str, int] = {}
    xs, ys, ns = [], [], []
    for kind in range(len(KINDS)):
        own = [r for r in rows if r.kind == kind]
        if not own:
            continue
        votes = np.array([[getattr(r, x) for x in LABELERS] for r in own])
        n = np.array([r.n for r in own], float)
        # a labeler is held for right in four of five cases until the votes say otherwise
        prior = {1: np.array([1.0, 2.0, 8.0]), 0: np.array([8.0, 2.0, 1.0])}
        true = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
        for _ in range(rounds):
            share = ((true * n).sum() + 1) / (n.sum() + 2)
            table = {y: np.array([[(w * n)[votes[:, j] == v].sum() for v in (-1, 0, 1)] + prior[y] for j in range(len(LABELERS))]) for y, w in ((1, true), (0, 1 - true))}
            chance = {y: t / t.sum(1, keepdims=True) for y, t in table.items()}
            odds = np.log(share / (1 - share)) + sum(np.log(chance[1][j][votes[:, j] + 1] / chance[0][j][votes[:, j] + 1]) for j in range(len(LABELERS)))
            true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        reliability[KINDS[kind]] = {x: {y: float(chance[y][j][1 + (1 if y else -1)]) for y in (0, 1)} for j, x in enumerate(LABELERS)}
        for r, y, v in zip(own, true, votes.tolist(), strict=True):
            xs.append([names.setdefault(f, len(names)) for f in _features(kind, r.digits, tuple(v))])
            ys.append(y)
            ns.append(float(r.n))
    if not xs:
        return Model(reliability, {})
    x = np.zeros((len(xs), len(names)))
    for i, f in enumerate(xs):
        x[i, f] = 1
    y, n, w = np.array(ys), np.array(ns), np.zeros(len(names))
    for _ in range(25):  # Newton's method with a quadratic penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + w
        w -= np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w)), slope)
    return Model(reliability, {f: float(w[i]) for f, i in names.items()})


def spans(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``pii_base`` and ``pii_all``, arrays of (kind, b, e): the base spans, and with what the classifier adds.

    What is added overlaps neither a base span nor a candidate that was accepted further left (of those with one
    start, the longest stays).
    """
    short = lambda s: F.struct(s["kind"].alias("kind"), s["b"].alias("b"), s["e"].alias("e"))
    weights = F.create_map(*[x for f, w in sorted(model.weights.items()) for x in (F.lit(f), F.lit(w))]) if model.weights else F.lit(None).cast("map<string,double>")
    weight = lambda key: F.coalesce(F.try_element_at(weights, key), F.lit(0.0))

    def score(s: Column) -> Column:
        kind = s["kind"].cast("string")
        return weight(kind) + weight(F.concat(kind, F.lit(":digits:"), s["digits"].cast("string"))) + sum((weight(F.concat(kind, F.lit(f":{x}:"), s[x].cast("string"))) for x in LABELERS), F.lit(0.0))

    last = F.lit((1 << 31) - 1)
    order = lambda s: F.struct(s["b"].alias("b"), (-s["e"]).alias("back"), s["e"].alias("e"), s["kind"].alias("kind"), s["base"].alias("base"))
    out = found.withColumn("pii_sorted", F.array_sort(F.transform(F.filter("pii_spans", lambda s: s["base"] | (score(s) > 0)), order))).drop("pii_spans")
    # the furthest end of a base span before each, and the nearest start of one after
    out = out.withColumns({"pii_base": F.transform(F.filter("pii_sorted", lambda s: s["base"]), short), "pii_left": _running(F.col("pii_sorted"), lambda s: F.when(s["base"], s["e"]).otherwise(0), _most, F.lit(0)), "pii_right": F.reverse(_running(F.reverse("pii_sorted"), lambda s: F.when(s["base"], s["b"]).otherwise(last), lambda a, x: F.least(a, x), last))})
    free = F.filter(F.arrays_zip(F.col("pii_sorted").alias("s"), F.col("pii_left").alias("left"), F.col("pii_right").alias("right")), lambda x: ~x["s"]["base"] & (x["left"] <= x["s"]["b"]) & (x["right"] >= x["s"]["e"]))
    out = out.withColumn("pii_free", F.transform(free, lambda x: x["s"])).drop("pii_sorted", "pii_left", "pii_right")
    out = out.withColumn("pii_left", _running(F.col("pii_free"), lambda s: s["e"], _most, F.lit(0)))
    added = F.filter(F.arrays_zip(F.col("pii_free").alias("s"), F.col("pii_left").alias("left")), lambda x: x["left"] <= x["s"]["b"])
    return out.withColumn("pii_all", F.array_sort(F.concat("pii_base", F.transform(added, lambda x: short(x["s"]))))).withColumn("pii_base", F.array_sort("pii_base")).drop("pii_free", "pii_left")


def _listed(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["b"].cast("string"), s["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256, spans, and n_spans (how many those are) of the result of ``spans``."""

    def count(k: int) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_all").alias("spans"), F.size("pii_all").cast("long").alias("n_spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets.

    All columns stay, whatever their names; null texts stay null. Overlapping spans are masked as a whole.
    """
    marked = materialise(candidates(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))), "pii")
    found = spans(marked, fit(marked))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("pii_all", lambda s: F.struct(s["b"].alias("b"), (-s["e"]).alias("back"), s["e"].alias("e"), s["kind"].alias("kind"))))
    found = found.withColumn("pii_sorted", ordered)
    found = found.withColumn("pii_done", _running(F.col("pii_sorted"), lambda s: s["e"], _most, F.lit(0)))
    # a span that overlaps one before it only moves on where the text resumes
    apart = F.filter(F.arrays_zip(F.col("pii_sorted").alias("s"), F.col("pii_done").alias("done")), lambda x: x["s"]["b"] >= x["done"])
    text = F.col("text")
    # blocks of the text, so that a piece is cut from a few of them: a substring counts from the start of its string
    blocks = F.when(F.size("pii_all") > 0, F.regexp_extract_all(text, F.lit(r"(?s).{1,4096}"), F.lit(0)))
    found = found.withColumns({"pii_end": F.aggregate("pii_sorted", F.lit(0), lambda a, s: F.greatest(a, s["e"])), "pii_apart": apart, "pii_blocks": blocks})
    last = F.struct(F.col("pii_end").alias("a"), F.length(text).alias("b"), F.lit("").alias("m"))
    zipped = F.concat(F.transform("pii_apart", lambda x: F.struct(x["done"].alias("a"), x["s"]["b"].alias("b"), F.element_at(names, x["s"]["kind"] + 1).alias("m"))), F.array(last))

    def piece(x: Column) -> Column:
        low = F.floor(x["a"] / 4096).cast("int")
        many = F.floor(F.greatest(x["b"] - 1, x["a"]) / 4096).cast("int") - low + 1
        return F.concat(F.substring(F.array_join(F.slice("pii_blocks", low + 1, many), ""), x["a"] % 4096 + 1, x["b"] - x["a"]), x["m"])

    whole = F.array_join(F.transform(zipped, piece), "")
    clean = F.when(F.size("pii_all") > 0, whole).otherwise(text)
    return found.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text is empty (no span). Repeated rows come back each; other columns are left aside; an empty table
    gives an empty table. Offsets are in code points, ends exclusive. One pass over the texts, whose candidates are
    written; no shuffle but that of the pattern counts. A text of any length is read whole, in linear time.
    """
    marked = materialise(candidates(docs.select("doc_id", "text")).drop("text"), "pii")
    return digest(spans(marked, fit(marked)))
