"""Patterns that run only where they can match, against the same patterns run everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from tracework.functions import decision_patterns as DP
from tracework.functions import literals as L
from tracework.functions import patterns as P
from tracework.functions import text as T
from tracework.operators import codequality, steering

SECRETS = (
    "sk-ant-" + "a" * 22, "sk-proj-" + "b" * 24, "AKIA" + "C" * 16, "ghp_" + "d" * 22, "AIza" + "e" * 35, "eyJab.eyJcd.ef", "Bearer " + "f" * 24, "bearer=" + "g" * 24,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "postgresql://u:p@h/db", "mongodb+srv://a:b@c", "sk_live_" + "h" * 22, "xoxb-" + "1" * 12, "hf_" + "i" * 22, "npm_" + "j" * 32,
    "pypi-" + "k" * 24, "yk_" + "0" * 18, "AC" + "1" * 32, "SK" + "a" * 32, "1//0" + "l" * 24, "AccountKey=" + "m" * 44, "MY_API_TOKEN = abc", "DB_PASSWORD=x", "A_KEY= [REDACTED", "x.KEY=y", "sk-short", "Bearer x", "task-force", "AC", "KEY",
)


def chained(s):
    for pattern, mark in P.SECRETS:
        s = F.regexp_replace(s, pattern, mark)
    return s


def test_all_secrets_are_met_and_nothing_else(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "x ", "\n", "é"]) + rng.choice([" ", "", "=", "\n"]).join(rng.choice([*SECRETS, "plain", "words", "[REDACTED_NPM_TOKEN]", "="]) for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    rows += [(9000 + i, s) for i, s in enumerate(SECRETS)] + [(9900, None), (9901, "")]
    df = spark.createDataFrame(rows, "i int, s string")
    got = df.select("i", T.scrub(F.col("s")).alias("a"), chained(F.coalesce("s", F.lit(""))).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    marks = {m for _, m in P.SECRETS}
    alone = {r.i: r.a for r in got if r.i >= 9000}
    assert {m for m in marks if any(m.replace("$1", "") in a or m in a for a in alone.values())} >= {m for m in marks if "$1" not in m}
    assert alone[9022] == "DB_PASSWORD=[REDACTED]" and alone[9009] == "postgresql://[REDACTED]@host"


def _all_patterns():
    out = [*P.FLAGS.values(), *steering.ACTIONS.values(), *P.OPTIONS, *P.QUESTIONS, P.ERROR_LINE, P.FRUSTRATION, P.PYTEST, P.JEST, P.RSPEC, P.CARGO, *DP.DOMAINS.values(), DP.ONE_WAY, DP.REVERSIBLE, DP.RATIONALE, DP.REVERSAL, *DP.OPTION_REFERENCES]
    return out + [*codequality.SECURITY.values(), *codequality.PERFORMANCE.values(), *codequality.PRODUCTION_CONTENTS.values()]


def test_guards_change_no_result(spark):
    rng = random.Random(6)
    patterns = _all_patterns()
    pieces = [x for p in patterns for x in L.needs(p)[0]] + ["ſtop", "ſhould I", "Kill", "İs it", "fıx", "don’t", " ", "\n", ",", "1", "A", "ed", "ing"]
    rows = [(i, "".join(rng.choice([rng.choice(pieces), rng.choice(pieces).upper(), rng.choice([" ", " ", "\n", "x"])]) for _ in range(rng.randint(0, 12)))) for i in range(1200)] + [(9999, None)]
    df = spark.createDataFrame(rows, "i int, s string").persist()
    s = F.col("s")
    for at in range(0, len(patterns), 12):
        some = patterns[at : at + 12]
        wrong = [F.count_if(~L.matches(s, p).eqNullSafe(s.rlike(p)) | ~L.count(s, p).eqNullSafe(F.regexp_count(s, F.lit(p)).cast("long"))).alias(f"n{i}") for i, p in enumerate(some)]
        got = df.agg(*wrong).first()
        assert not any(got), [p for p, n in zip(some, got, strict=True) if n]
    df.unpersist()


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", (("abc",), False)), ("(?i)ABC|de+f", (("abc", "d"), True)), ("a?b", (("b",), False)), ("[ab]c{2}d", (("a", "b"), False)), (r"\d+", ((), False)), ("x*|y", ((), False)), ("(?:a|)b", (("ab", "b"), False)),
        ("[^a]b", (("b",), False)), ("(?<=q)abc", (("abc",), False)), ("a(?i)b", ((), False)), ("(?x)a b", ((), False)), ("(?i)é", ((), False)), (r"\p{L}x", ((), False)), (r"end\z", (("end",), False)), ("(ab)+", (("ab",), False)), ("(ab)*c", (("c",), False)),
    ],
)
def test_needs(pattern, want):
    assert L.needs(pattern) == want
