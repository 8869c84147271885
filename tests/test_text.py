"""X1, X2, E1, E2, E5 against Python's own string semantics."""

import random
import re

from pyspark.sql import functions as F

from conflictlake.functions import text as T

ALPHABET = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f",
            "\x85", "\xa0", "\u2028", "\u2029", "\u3000", "\u2003", "\u00e9", "/", "*", "`", "x"]


def _rand_texts(n=300, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", "\n", "a"]


def _universal(s):
    return s.replace("\r\n", "\n").replace("\r", "\n")


def test_split_lines_matches_python(spark):
    texts = _rand_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.split_lines_keepends("t").alias("k"), T.split_lines("t").alias("p")).collect()
    for r in rows:
        u = _universal(texts[r.i])
        assert list(r.k) == u.splitlines(keepends=True), repr(texts[r.i])
        assert list(r.p) == u.splitlines(), repr(texts[r.i])


def test_strip_and_normalize_match_python(spark):
    texts = _rand_texts(200, 11) + ["  /* c */ int x; // tail\n  y  ", "http://a.b/c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.py_strip("t").alias("s"), T.normalize_code("t").alias("n")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == t.strip()
        exp = re.sub(r"\s+", " ", re.sub(r"//.*", "", re.sub(r"/\*[\s\S]*?\*/", "", t))).strip()
        assert r.n == exp, repr(t)


def test_extract_code_block(spark):
    cases = ["x\n```java\n  int a;\n```\n", "```python\nx\n```", "```java\nA\n```\n```java\nB\n```", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.extract_code_block("t").alias("c")).collect()}
    pat = re.compile(r"```java\n(.*?)\n```", re.DOTALL)
    for i, t in enumerate(cases):
        m = pat.search(t)
        assert got[i] == (m.group(1).strip() if m else None)


def test_cache_key_is_md5(spark):
    import hashlib
    df = spark.createDataFrame([("héllo",)], "p string")
    assert df.select(T.cache_key("p")).first()[0] == hashlib.md5("héllo".encode()).hexdigest()


def test_question_token_count_is_additive(spark):
    from conflictlake.operators.metrics import build_question, question_token_count
    texts = _rand_texts(150, 23) + ["```x```", "\n", "", "a\n```"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(question_token_count(F.col("t")).alias("a"),
                     T.token_count_proxy(build_question(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
