"""Secret scan: character Markov models of random strings and ordinary identifiers, in DataFrame expressions only.

Base patterns (assign, access, hex) always count. All other long tokens, and the parts of tokens that no base
span covers, are scored by the log-likelihood ratio per character of two first-order Markov models over
characters, trained on the driver from labelled samples: random strings over usual secret alphabets, and
identifiers, words, paths and plain numbers. Tokens above a threshold are added: it lies half way between the
ratio that one in a thousand held-out identifiers exceeds and the one that one in a hundred held-out secrets
stays under (at the former, should they cross).

Defined cases: null text counts as empty; null ids and repeated rows are kept, one row out per row in;
other columns are ignored; a token has 16 characters at least.
"""

from __future__ import annotations

import functools
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.arrays import let
from lodestack.llm import _spans as S
from lodestack.llm._spark import table

_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"(?:{_EITHER})[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST = 16
TOKEN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+"
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=.-"
K = len(ALPHABET) + 1
#: Words of which samples of identifiers are made: fixed values.
WORDS = ("get set user name file path index count value list map table query result error message create update delete find load save open close read write parse format config server client request "
         "response handler manager service factory builder test data model view controller helper util string number array object class function return default option param context session cache "
         "nacional trabajo ciudad gobierno persona tiempo entwicklung gesellschaft regierung zusammen arbeit menschen developpement gouvernement personne travail ensemble politique the of and in to "
         "information international communication administration www http com org html image article archive product category").split()


def _samples(n: int, seed: int) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), n of each."""
    r = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    secret = ["".join(r.choice(a) for _ in range(r.randint(16, 48))) for a in (r.choice(alphabets) for _ in range(n))]
    syllables = sorted({w[i : i + k] for w in WORDS for k in (2, 3) for i in range(len(w) - k + 1)})

    def plain() -> str:
        style, parts = r.randrange(7), [r.choice(WORDS) if r.random() < 0.7 else "".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(r.randint(3, 6))]
        s = [lambda: "_".join(parts), lambda: "-".join(parts), lambda: parts[0] + "".join(p.title() for p in parts[1:]), lambda: "/".join(parts), lambda: ".".join(parts), lambda: "".join(parts), lambda: "_".join(parts).upper()][style]()
        if r.random() < 0.2:
            s += r.choice(["2", "_v1", "01", "-2024", ".1.0", "_64", "-2024-01-31"])
        if r.random() < 0.05:
            s = r.choice("-=_.") * r.randint(16, 60)
        elif r.random() < 0.05:  # dates, versions, article numbers
            s = r.choice(["-", ".", "/", ""]).join("".join(r.choice(string.digits) for _ in range(r.randint(1, 6))) for _ in range(r.randint(4, 8))).ljust(16, "0")
        return s if len(s) >= 16 else s + "_" + r.choice(WORDS) + "_" + r.choice(WORDS)

    return secret, [plain() for _ in range(n)]


def _transitions(texts: list[str]) -> np.ndarray:
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = np.full((K, K), 0.5)
    for t in texts:
        for a, b in zip(t, t[1:]):
            counts[at[a], at[b]] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


@functools.lru_cache(1)
def trained(n: int = 6000, seed: int = 5, passing: float = 0.001) -> tuple[np.ndarray, float]:
    """Log-likelihood ratio of each pair of characters, and the threshold per character."""
    secret, plain = _samples(n, seed)
    ratio = _transitions(secret[n // 3 :]) - _transitions(plain[n // 3 :])
    low = float(np.quantile([llr(t, ratio) for t in plain[: n // 3]], 1 - passing))
    high = float(np.quantile([llr(t, ratio) for t in secret[: n // 3]], 10 * passing))
    return ratio, max(low, (low + high) / 2)


def llr(token: str, ratio: np.ndarray) -> float:
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    i = np.array([at.get(c, 0) for c in token])
    return float(ratio[i[:-1], i[1:]].sum() / max(1, len(token) - 1))


def _llr(token: Column, ratio: np.ndarray) -> Column:
    flat = F.split(F.lit(",".join(f"{v:.6f}" for v in ratio.ravel())), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))

    def mean(at: Column) -> Column:
        pairs = F.zip_with(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.element_at(flat, a * K + b + 1))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(at) - 1, F.lit(1))

    return let(codes, mean)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, spans, n_added."""
    ratio, least = trained()
    text = F.col("body")
    value = lambda x: F.regexp_extract(x["m"], ASSIGN_VALUE, 1)
    when = lambda test, regex: F.when(test, S.matches(text, regex)).otherwise(S.none())
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    t = t.select(
        "doc_id",
        F.filter(when(text.rlike(rf"(?:{_EITHER})[\"']?\x20*[:=]"), ASSIGN), lambda x: F.char_length(value(x)) >= 6).alias("assign"),
        when(text.contains("AKIA"), ACCESS).alias("access"),
        when(text.rlike(HEX), HEX).alias("hex"),
        when(text.rlike(TOKEN), TOKEN).alias("tokens"),
    )
    t = t.withColumn("base", F.concat(*(S.tagged(F.col(k), k, ORDER[k]) for k in ("assign", "access", "hex"))))
    free = S.outside(F.col("tokens"), F.col("base"), LEAST)
    t = t.withColumn("added", F.when(F.size("tokens") > 0, S.tagged(F.filter(free, lambda c: _llr(c["m"], ratio) > least), "random", ORDER["random"])).otherwise(F.array().cast(S.TAGGED)))
    return t.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
