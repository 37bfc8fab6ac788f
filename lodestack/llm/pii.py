"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base patterns (email, ip, card, phone) always count. High-recall generators propose more, overlapping
spans: written-out mail addresses, national phone numbers, card-like numbers that fail the check digit,
account and identity numbers. Each candidate gets format features (also whether the number could be issued:
area codes, serials, the account's check number) and context features; boosted trees, trained on the driver
from sentences labelled by stated rules, score it; thresholds by kind, calibrated on sentences that training
leaves out, select the redactions. Trees are CASE expressions, so scoring stays inside the scan.

Defined cases: null text counts as empty; null ids and repeated rows are kept, one row out per row in;
other columns are ignored. An added span inside a base span or inside another added one is not reported;
spans that overlap in part are. Long runs are matched with possessive quantifiers and positions are running
sums in blocks, so no text overflows the matcher's stack or takes quadratic time.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import _spans as S
from lodestack.llm._spark import table

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beyond the base patterns: number, kind, expression.
GENERATORS = [
    (1, "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}+)++"),
    (2, "phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-][0-9])(?![0-9])"),
    (3, "identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (4, "account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
]
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "account": 4, "identity": 5}
#: Words before a candidate, by feature; the last ones speak against it.
CONTEXT = [
    r"(?i)\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|adresse)",
    r"(?i)\b(?:phone|telephone|tel\b|telef|call|mobile|fax|whatsapp|ring|cell)",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay with|karte|tarjeta)",
    r"(?i)\b(?:ssn|social|iban|account|passport|identity|konto|cuenta|compte|tax id)",
    r"(?i)\b(?:version|order|ref|reference|isbn|build|invoice|page|doi|part|serial|ticket|item|sku|model|batch|tracking|release)\b",
]
NAMES = ["generator", "length", "digits", "marks", "distinct", "glued_before", "glued_after", "valid", *(f"context_{i}" for i in range(len(CONTEXT)))]


def _base(text: Column) -> dict[str, Column]:
    n = lambda x: F.char_length(S.digits(x["m"]))
    when = lambda test, regex: F.when(test, S.matches(text, regex)).otherwise(S.none())
    number = text.rlike("[0-9]")
    return {
        "email": when(text.contains("@"), EMAIL),
        "ip": F.filter(when(text.rlike(r"[0-9]\.[0-9]"), IP), lambda x: F.forall(F.split(x["m"], r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))),
        "card": when(number, CARD),
        "phone": F.filter(when(text.rlike(r"\+[0-9]"), PHONE), lambda x: n(x).between(9, 15)),
    }


def _good_card(x: Column) -> Column:
    d = S.digits(x["m"])
    return F.when(F.char_length(d).between(12, 19), S.luhn(d)).otherwise(False)


def _check97(m: Column) -> Column:
    """Whether an account number passes its check: the first four characters go last, letters count from 10, the rest by 97 is 1."""
    plain = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.left(plain, F.lit(4))), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return rest == 1


def _valid(gen: int, m: Column, d: Column) -> Column:
    """Whether the number could be issued, or the address be one."""
    if gen == 1:
        return m.rlike(r"[\].)}\x20][A-Za-z]{2,6}$")
    if gen == 2:
        return d.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$")
    if gen == 3:
        return d.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return _check97(m) if gen == 4 else F.lit(False)


def _candidates(text: Column, cards: Column) -> Column:
    """array<struct<s, e, k, o, f>> with f the features."""

    def shaped(spans: Column, gen: int, kind: str) -> Column:
        def one(x: Column) -> Column:
            m, before, after = x["m"], x["b"], x["a"]
            d = S.digits(m)
            f = [F.lit(float(gen)), F.char_length(m), F.char_length(d), F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.size(F.array_distinct(F.split(d, "")))]
            f += [c.cast("int") for c in (before.rlike(r"[A-Za-z0-9_/#=.-]$"), after.rlike(r"^[A-Za-z0-9_/=-]"), _valid(gen, m, d), *(before.rlike(w) for w in CONTEXT))]
            return F.struct(x["s"].alias("s"), F.lit(ORDER[kind]).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k"), F.array(*(c.cast("double") for c in f)).alias("f"))

        return F.transform(spans, one)

    failing = F.filter(cards, lambda x: F.char_length(S.digits(x["m"])).between(13, 19) & ~_good_card(x))
    gates = {1: text.rlike(r"[\[({]at[\])}]"), 2: text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), 3: text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), 4: text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")}
    return F.concat(shaped(failing, 5, "card"), *(shaped(F.when(gates[g], S.matches(text, regex)).otherwise(S.none()), g, kind) for g, kind, regex in GENERATORS))


# Training: sentences labelled by rule, trees grown in numpy.

#: Carrier words: for training and calibration, and others that only the report on quality uses. Cues by generator, then words against.
TRAINING = (
    {1: ["Mail me:", "contact", "write to"], 2: ["call", "phone:", "tel.", "mobile"], 3: ["SSN", "social security no."], 4: ["IBAN", "account", "Konto"], 5: ["card", "visa", "credit card no."]},
    ["version", "order", "ref", "isbn", "build", "invoice", "part", "serial", "ticket", "item"],
)
HELD_OUT = (
    {1: ["You can reach her by e-mail at", "Courriel :", "Adresse:"], 2: ["Ring us on", "Cell", "Telefon:", "his fax is"], 3: ["Her social security number is", "tax id"], 4: ["Please pay to account number", "Cuenta:", "my compte"], 5: ["charged to his mastercard", "Tarjeta", "debit card"]},
    ["tracking number", "batch", "model", "release", "reference", "sku"],
)


def _account(r: random.Random, valid: bool) -> str:
    """An account number whose check number is right, or surely wrong."""
    land = "".join(r.choice("ABCDEFGHILMNPRST") for _ in range(2))
    body = "".join(r.choice("0123456789") for _ in range(4 * r.randint(3, 5)))
    value = int("".join(str(int(c, 36)) for c in body + land + "00"))
    check = 98 - value % 97
    text = f"{land}{(check if valid else (check + r.randint(1, 90)) % 97):02d}{body}"
    return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if r.random() < 0.5 else text


def sentences(n: int, seed: int, words=TRAINING) -> list[tuple[str, int]]:
    """(text with one candidate, 1 if it is personal data by the rules below).

    A word against (an order or part number) makes a candidate none, whatever its form, but for addresses and for
    account numbers whose check number is right; otherwise a cue of its kind makes it one; without either, a form that
    could have been issued does, save for card numbers, whose check digit fails by then.
    """
    r = random.Random(seed)
    cues, against = words
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))

    def phone(valid: bool) -> str:
        a, b = (r.choice("23456789") + num(2), r.choice("23456789") + num(2)) if valid else (r.choice("01") + num(2), num(3))
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(a, b, num(4))

    def identity(valid: bool) -> str:
        return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if valid else f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}"

    def address(valid: bool) -> str:
        end = r.choice(["com", "org", "net", "de", "info"]) if valid else num(2)
        return f"{word()}.{word()} {r.choice(['[at]', '(at)'])} {word()}{r.choice([' [dot] ', ' (dot) ', '.'])}{end}"

    def card(_: bool) -> str:
        while True:
            d = r.choice("3456") + num(r.choice([14, 15, 15]))
            if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10:
                return d if r.random() < 0.5 else " ".join(d[i : i + 4] for i in range(0, len(d), 4))

    forms = {1: address, 2: phone, 3: identity, 4: lambda v: _account(r, v), 5: card}
    out = []
    for i in range(n):
        g, valid, about = i % 5 + 1, r.random() < 0.6, r.random()
        text = forms[g](valid)
        if about < 0.35:
            out.append((f"{word()} {r.choice(cues[g])} {text} {word()}", int(g != 1 or valid)))
        elif about < 0.45:  # a cue of another kind says nothing
            out.append((f"{word()} {r.choice(cues[r.choice([k for k in cues if k != g and {k, g} != {3, 4}])])} {text} {word()}", int(valid and g != 5)))
        elif about < 0.7:
            out.append((f"{word()} {r.choice(against)} {r.choice(['', '#', 'no. '])}{text} {word()}", int(valid and g in (1, 4))))
        else:
            out.append((f"{word()} {word()} {text} {word()}", int(valid and g != 5)))
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 48, rate: float = 0.4) -> tuple[float, list]:
    """Boosted trees of depth two on the logistic loss: bias, and (feature, cut, left, right) with (feature, cut, low, high) below."""
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12))) for j in range(x.shape[1])]

    def split(rows, g, h):
        best = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            for c in cuts[j]:
                low = x[rows, j] <= c
                a, b = g[rows][low].sum(), g[rows][~low].sum()
                ha, hb = h[rows][low].sum() + 1, h[rows][~low].sum() + 1
                gain = a * a / ha + b * b / hb
                if gain > best[0] + 1e-12:
                    best = (gain, j, float(c))
        return best[1], best[2]

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        rows = np.arange(len(y))
        j, c = split(rows, g, h)
        node = [j, c]
        for side in (rows[x[:, j] <= c], rows[x[:, j] > c]):
            if not len(side):
                node.append((0, 0.0, 0.0, 0.0))
                continue
            k, d = split(side, g, h)
            low = x[side, k] <= d
            leaf = [rate * g[s].sum() / (h[s].sum() + 1) for s in (side[low], side[~low])]
            z[side] += np.where(low, leaf[0], leaf[1])
            node.append((k, d, float(leaf[0]), float(leaf[1])))
        out.append(tuple(node))
    return bias, out


def _margin(f: Column, model: tuple[float, list]) -> Column:
    bias, trees = model
    leaf = lambda n: F.when(f[n[0]] <= n[1], F.lit(n[2])).otherwise(F.lit(n[3]))
    total = F.lit(bias)
    for j, c, low, high in trees:
        total = total + F.when(f[j] <= c, leaf(low)).otherwise(leaf(high))
    return total


def features_of(spark: SparkSession, rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Features, labels, sentence numbers and kinds of all candidates of labelled sentences, by the expressions that scoring uses."""
    data = [{"i": i, "t": t, "y": y} for i, (t, y) in enumerate(rows)]
    df = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(data)), "array<struct<i:int,t:string,y:int>>")).alias("r")).select("r.*")
    cards = F.when(F.col("t").rlike("[0-9]"), S.matches(F.col("t"), CARD)).otherwise(S.none())
    got = df.select("i", "y", F.explode(_candidates(F.col("t"), cards)).alias("c")).select("i", "y", "c.k", "c.f").collect()
    meant = [float(r["y"] and r["f"][0] == r["i"] % 5 + 1) for r in got]  # another generator's find inside a sentence's number is none of its kind
    return np.array([r["f"] for r in got]), np.array(meant), np.array([r["i"] for r in got]), [r["k"] for r in got]


@functools.lru_cache(1)
def _trained(app: str, n: int = 3000, seed: int = 11, precision: float = 0.95):
    """Trees from two thirds of the sentences; by kind the least threshold that keeps the precision on the rest."""
    x, y, i, kinds = features_of(SparkSession.getActiveSession(), sentences(n, seed))
    fit = i % 3 != 0
    model = grow(x[fit], y[fit])
    z = np.array([_score(v, model) for v in x])
    cut = {}
    for kind in ORDER:
        own = ~fit & np.array([k == kind for k in kinds])
        ok = [t for t in np.unique(z[own]) if y[own & (z >= t)].mean() >= precision]
        low = z[own & (z < min(ok))].max(initial=min(ok) - 1) if ok else 0.0
        cut[kind] = float((min(ok) + low) / 2) if ok else 1e9  # half way to the next score below
    return model, cut


def _score(v, model) -> float:
    bias, trees = model
    leaf = lambda n: n[2] if v[n[0]] <= n[1] else n[3]
    return bias + sum(leaf(low) if v[j] <= c else leaf(high) for j, c, low, high in trees)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, spans, n_added with the spans that the model adds, and n_spans with all."""
    model, cut = _trained(docs.sparkSession.sparkContext.applicationId)
    text = F.col("body")
    base = _base(text)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    t = t.select("doc_id", "body", *(c.alias(f"raw_{k}") for k, c in base.items()))
    t = t.select("doc_id", "raw_email", "raw_ip", "raw_phone", F.filter("raw_card", _good_card).alias("good_card"), F.when(text.rlike("[0-9]|[\\[({]at[\\])}]"), _candidates(text, F.col("raw_card"))).alias("cand"))
    named = {"email": "raw_email", "ip": "raw_ip", "card": "good_card", "phone": "raw_phone"}
    t = t.withColumn("base", F.concat(*(S.tagged(F.col(c), k, ORDER[k]) for k, c in named.items())))
    cuts = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv])
    scored = F.transform(F.coalesce("cand", F.array()), lambda c: F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"), c["k"].alias("k"), _margin(c["f"], model).alias("z")))
    t = t.withColumn("chosen", F.when(F.size("cand") > 0, F.filter(scored, lambda c: c["z"] >= cuts[c["k"]])))
    t = t.withColumn("added", F.coalesce(S.news(F.col("base"), F.col("chosen")), F.array().cast(S.TAGGED)))
    return t.select(
        "doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in named.items()), F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
