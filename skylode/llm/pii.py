"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap: e-mail addresses, IP addresses, card numbers and phone
numbers (the base), and numbers and secrets in looser formats. A base span that passes its kind's test always counts.
All other candidates are scored by boosted trees over features of their format and context; those whose margin reaches
the calibrated threshold count as well. The trees are fitted by the driver on candidates drawn from format rules
(``examples``; a fixed number) and become CASE expressions, so all rows are handled by built-in functions.

Positions: Spark gives a pattern's matches and the pieces between them; the running sum of their lengths is where each
match starts, in code points. The patterns are the base ones with possessive quantifiers and with a look behind that
only keeps a search from starting inside a run where it started before: same matches, linear time, no deep recursion.

A secret's value has no upper length. Its key name may follow anything (client_secret, DB_PASSWORD, authToken); the span
starts at the key name itself, so what stands before it stays. An IBAN has any of its lengths, in one run or in groups of
4; a capital word of up to 4 characters that follows the groups may be taken along.

Cases: a null or empty text has no spans; rows stay as they are, repeated or not; a text of any length is one row; an
empty table gives an empty result; all columns are kept, whatever their names, but find() refuses one named pii, which it
adds. No row is shuffled.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE_KINDS = KINDS[:4]
_LOCAL = "A-Za-z0-9._%+-"
# The 11 to 30 characters after an IBAN's check digits: groups of 4 and a shorter last one after spaces (29 or 30, 13 to
# 27, 11), groups of 4 with or without spaces, or any number in a run.
_BBAN = "|".join((
    "(?:[ ]?[A-Z0-9]{4}){6}[ ][A-Z0-9]{4}[ ][A-Z0-9]{1,2}", "(?:[ ]?[A-Z0-9]{4}){2,5}[ ][A-Z0-9]{4}[ ][A-Z0-9]{1,3}",
    "[ ]?[A-Z0-9]{4}[ ][A-Z0-9]{4}[ ][A-Z0-9]{3}", "(?:[ ]?[A-Z0-9]{4}){3,7}", "[ ]?[A-Z0-9]{11,30}",
))
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^\s\"',;]{6,}+",
    "number": r"(?<![0-9A-Za-z.-])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:" + _BBAN + r"))(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be worth a search; a match always holds it.
HOLDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None, "number": None}
CONTEXT = 32
# Fixed values, for examples: IBANs as they are after the check digits; d is a digit, a a capital, c either.
IBANS = ("GB:aaaa" + "d" * 14, "DE:" + "d" * 18, "FR:" + "d" * 10 + "c" * 11 + "dd", "ES:" + "d" * 20, "NL:aaaa" + "d" * 10, "IT:a" + "d" * 10 + "c" * 12, "NO:" + "d" * 11, "PL:" + "d" * 24, "CH:" + "d" * 5 + "c" * 12, "MT:aaaa" + "d" * 5 + "c" * 18, "RU:" + "d" * 14 + "c" * 15)
# Words that announce personal data.
CUES = "(?i)(?:tel|phone|call|fax|mobile|ssn|social|security|iban|account|konto|card|karte|carte|password|token|secret|key|login|contact)[^0-9A-Za-z]{0,12}$"
FEATURES = ("kind", "length", "digits", "letters", "upper", "separators", "distinct", "cue", "luhn")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p).between(1, 3), p.cast("int")).otherwise(0) <= 255))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(match))
    return n.between(9, 15) if kind == "phone" else F.lit(False)


SPAN = "struct<kind:int,start:int,end:int,match:string>"


def _spans(matches: Column, gaps: Column, kind: int) -> Column:
    pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("match")))).cast(f"array<{SPAN}>").alias("out"))

    return F.aggregate(pairs, first, step, lambda acc: acc["out"])


# --- the model ------------------------------------------------------------------------------------------------------


def features(kind: int, match: str, before: str) -> list[float]:
    """The features of a candidate, as feature_columns has them in Columns."""
    n = len(match)
    d = re.sub("[^0-9]", "", match)
    odd = [int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))]
    return [
        float(kind), float(n), len(d) / n, len(re.sub("[^A-Za-z]", "", match)) / n, len(re.sub("[^A-Z]", "", match)) / n,
        float(len(re.sub("[^ ().-]", "", match))), float(len(set(match))), float(bool(re.search(CUES, before))), float(bool(d) and sum(odd) % 10 == 0),
    ]


def feature_columns(span: Column, before: Column) -> list[Column]:
    m = span["match"]
    n, d = F.length(m), _digits(m)
    kept = lambda p: F.length(F.regexp_replace(m, p, ""))
    return [
        span["kind"].cast("double"), n.cast("double"), F.length(d) / n, kept("[^A-Za-z]") / n, kept("[^A-Z]") / n,
        kept("[^ ().-]").cast("double"), F.size(F.array_distinct(F.split(m, ""))).cast("double"), F.regexp_like(before, F.lit(CUES)).cast("double"), ((F.length(d) > 0) & luhn(d)).cast("double"),
    ]


def examples(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n candidates drawn from format rules, with their labels: personal numbers and secrets against look-alikes."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def iban() -> str:
        country, form = rng.choice(IBANS).split(":")
        every = country + digits(2) + "".join(rng.choice({"d": "0123456789", "a": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "c": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}[f]) for f in form)
        return rng.choice(("", " ")).join(every[i : i + 4] for i in range(0, len(every), 4))

    x, y = [], []
    for _ in range(n):
        kind, good = rng.choice((2, 3, 4, 4, 5, 5)), rng.random() < 0.5
        before = rng.choice(("call ", "tel: ", "account ", "SSN ", "card no. ")) if rng.random() < (0.6 if good else 0.1) else rng.choice(("the order ", "see line ", "in ", "", "of part "))
        if kind == 2:
            sep = rng.choice(("", " ", "-"))
            match = sep.join(digits(4) for _ in range(4)) if good else digits(rng.choice((13, 20, 24, 30)))
            good = good and bool(features(2, match, "")[8])
        elif kind == 3:
            match = f"+{digits(rng.choice((7, 8)))}" if good else f"+{digits(rng.choice((2, 3, 18, 22)))}"
            good = good and bool(re.search(CUES, before))
        elif kind == 4:
            key = rng.choice(("password", "token", "secret", "api_key", "pwd"))
            signs = rng.choice(("0123456789abcdef", "0123456789abcdefghijkmnpqrstuvwxyz", "0123456789abcdefABCDEFghijkXYZ", "0123456789ABCDEF"))
            value = "".join(rng.choice(signs) for _ in range(rng.randint(8, 40)))
            plain = "".join(rng.choice("aeinrst") for _ in range(rng.randint(6, 9)))
            match = (rng.choice((f"{key}={value}", f'{key} = "{value}', "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))))) if good else f"{key}{rng.choice((': ', '='))}{plain}"
        else:
            a, b, c = digits(3), digits(3), digits(4)
            match = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{digits(2)}-{c}", iban())) if good else a + b + c
            good = good or bool(re.search(CUES, before)) and rng.random() < 0.9
        x.append(features(kind, match, before))
        y.append(float(good))
    return np.array(x), np.array(y)


@cache
def model(n: int = 4000, precision: float = 0.95) -> tuple[boosting.Boosted, float]:
    """Boosted trees, and the smallest margin from which on that precision is kept on examples not fitted on."""
    x, y = examples(n)
    half = n // 2
    trees = boosting.fit(x[:half], y[:half], trees=15, depth=3, rate=0.4)
    m, t = trees.margin(x[half:]), y[half:]
    order = np.argsort(-m, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(right >= precision)
    return trees, float(m[order][ok[-1]]) if len(ok) else float("inf")


# --- the operator ---------------------------------------------------------------------------------------------------


def _found(rows: DataFrame) -> DataFrame:
    """rows (row, text) -> row, text and pii, as find() has it."""
    trees, threshold = model()
    text = F.coalesce(F.col("text"), F.lit(""))
    d = rows.select("row", "text", text.alias("__t"), F.regexp_like(text, F.lit("[0-9]")).alias("__n"))
    for k in KINDS:  # a search for a kind only where the text can hold one
        may = F.col("__n") if k in ("ip", "card", "phone", "number") else F.lit(True)
        may = may & F.contains("__t", F.lit(HOLDS[k])) if HOLDS[k] else may
        may = (F.contains("__t", F.lit("=")) | F.contains("__t", F.lit(":")) | F.contains("__t", F.lit("AKIA")) | F.contains("__t", F.lit("ASIA"))) if k == "secret" else may
        d = d.withColumn(f"__m_{k}", F.when(may, F.regexp_extract_all("__t", F.lit(PATTERNS[k]), F.lit(0))))
    for k in KINDS:
        d = d.withColumn(f"__g_{k}", F.when(F.size(f"__m_{k}") > 0, F.transform(F.split("__t", PATTERNS[k], -1), F.length)))
    every = [F.when(F.size(f"__m_{k}") > 0, _spans(F.col(f"__m_{k}"), F.col(f"__g_{k}"), i)).otherwise(F.array().cast(f"array<{SPAN}>")) for i, k in enumerate(KINDS)]
    d = d.withColumn("__c", F.concat(*every)).drop(*[f"__{x}_{k}" for x in "mg" for k in KINDS])

    def judge(span):
        before = F.substr(F.col("__t"), F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
        base = F.lit(False)
        for i, k in enumerate(BASE_KINDS):
            base = F.when(span["kind"] == i, _passes(k, span["match"])).otherwise(base)
        score = F.when(base, F.lit(None)).otherwise(trees.column(feature_columns(span, before)))
        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), base.alias("base"), score.alias("score"))

    judged = F.filter(F.transform("__c", judge), lambda s: s["base"] | (s["score"] >= F.lit(threshold)))
    d = d.withColumn("__j", F.when(F.size("__c") > 0, judged).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,score:double>>")))
    name = F.array(*[F.lit(k) for k in KINDS])
    # A candidate of the method that lies within a base span says nothing new.
    inside = lambda s: F.exists("__j", lambda b: b["base"] & ~s["base"] & (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    chosen = F.transform(F.array_sort(F.filter("__j", lambda s: ~inside(s))), lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return d.withColumn("pii", F.when(F.size("__j") > 0, chosen).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"))).select("row", "text", "pii")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")


def find(documents: DataFrame) -> DataFrame:
    """Adds pii: array<struct<kind, start, end, base>>, by kind as in KINDS, then start; kind is a name."""
    if "pii" in documents.columns:
        raise ValueError("the column pii is added")
    return _found(_rows(documents)).select("row.*", "pii")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(found: DataFrame) -> DataFrame:
    """What find() gives, as the columns of the query op10."""
    n = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(listed(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with every found span of text replaced by its kind in capitals and brackets; same columns.

    Spans that overlap become one mark for each, the later one covering what the earlier one left.
    """
    found, text = _found(_rows(documents)), F.col("text")
    by_start = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).cast("array<string>").alias("out"))

    done = F.aggregate(by_start, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    out = found.select("row", F.when(F.size("pii") > 0, done).otherwise(text).alias("text"), (F.size("pii") > 0).alias("changed"))
    own = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[(own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
