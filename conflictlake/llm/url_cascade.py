"""URL filters: exact membership in a block list by a cascade of Bloom filters.

The keys are (host, path) pairs.  Level 1 holds the listed keys; level 2 the
unlisted keys of the corpus that level 1 wrongly reports; level 3 the listed keys
that level 2 wrongly reports; and so on until a level reports nothing wrongly.
Over the corpus's whole key universe the answer is therefore exact, and a page is
judged by hashing alone, without a join and without the list.

All of it is DataFrame expressions.  A level is an array of 64-bit words kept in
``parts`` arrays by a hash of the key.  Levels of up to LITERAL_BITS bits in all
(a bound on what is sent to every task) are constants of the expression; a larger
level is a table of parts that meets the keys by an equi-join on the part, so no
task needs more than a part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import refuse_clash, settled

BITS_PER_KEY, HASHES = 12, 6
PART_BITS = 1 << 20
LITERAL_BITS = 1 << 23

#: Host and path rules of the production query: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    u = F.col(url).cast("string")
    rest = F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule overrides
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    number: int
    bits: int  # of one part
    parts: int
    words: list[list[int]] | None  # one array a part, or
    table: DataFrame | None  # (part, words)


def _hashes(level: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(level), "host", "path"), F.xxhash64(F.lit(-1 - level), "host", "path")


def _part(level: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1 << 20), F.lit(level), "host", "path"), F.lit(parts)).cast("int")


def _positions(level: int, bits: int) -> list[Column]:
    a, b = _hashes(level)
    a, b = F.shiftrightunsigned(a, 2), F.shiftrightunsigned(b, 6)  # sums stay within a long
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def _built(keys: DataFrame, number: int) -> Level | None:
    """The Bloom filter of (host, path) rows; None if there are none."""
    n = keys.count()
    if not n:
        return None
    total = max(64, BITS_PER_KEY * n)
    parts = -(-total // PART_BITS)
    bits = -(-(-(-total // parts)) // 64) * 64
    at = keys.select(_part(number, parts).alias("part"), F.explode(F.array(*_positions(number, bits))).alias("at"))
    words = at.groupBy("part", F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    if bits * parts <= LITERAL_BITS:
        arrays = [[0] * (bits // 64) for _ in range(parts)]
        for r in words.collect():  # at most LITERAL_BITS / 64 rows
            arrays[r["part"]][r["word"]] = r["value"]
        return Level(number, bits, parts, arrays, None)
    filled = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("m"))  # at most PART_BITS / 64 entries
    array = F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return Level(number, bits, parts, None, settled(filled.select("part", array.alias("words")), f"level{number}"))


def _holds(words: Column, level: Level) -> Column:
    """Whether all bits of the row's key are set in ``words``."""
    hit = F.lit(True)
    for at in _positions(level.number, level.bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return hit


def tested(df: DataFrame, level: Level, name: str) -> DataFrame:
    """``df`` (with host and path) and a boolean column: whether the level reports the key."""
    if level.table is not None:
        have = level.table.select(F.col("part").alias("__part"), F.col("words").alias("__words"))
        met = df.withColumn("__part", _part(level.number, level.parts)).join(have, "__part", "left")
        return met.withColumn(name, F.coalesce(_holds(F.col("__words"), level), F.lit(False))).drop("__part", "__words")
    arrays = [F.split(F.lit(",".join(map(str, a))), ",").cast("array<bigint>") for a in level.words]
    if level.parts == 1:
        return df.withColumn(name, _holds(arrays[0], level))
    part = _part(level.number, level.parts)
    hit = F.lit(False)
    for i, a in enumerate(arrays):
        hit = F.when(part == i, _holds(a, level)).otherwise(hit)
    return df.withColumn(name, hit)


def build(keys: DataFrame) -> list[Level]:
    """The cascade of ``keys``: distinct (host, path, listed) rows, the whole universe."""
    levels: list[Level] = []
    holders = keys.where("listed").select("host", "path")
    others = keys.where("not listed").select("host", "path")
    while (level := _built(holders, len(levels) + 1)) is not None:
        levels.append(level)
        wrong = settled(tested(others, level, "hit").where("hit").select("host", "path"), f"wrong{len(levels)}")
        holders, others = wrong, holders
    return levels


def member(df: DataFrame, levels: list[Level], name: str) -> DataFrame:
    """``df`` with whether its key is listed: the first level that does not report it decides."""
    for level in levels:
        df = tested(df, level, f"__hit{level.number}")
    listed = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        listed = F.when(F.col(f"__hit{level.number}"), listed).otherwise(F.lit(level.number % 2 == 0))
    return df.withColumn(name, listed).drop(*[f"__hit{lv.number}" for lv in levels])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Per row: ``keep``, host, path, rule (null if none fits) and verdict.

    The listed keys are those that a block rule decides.  The verdict of every
    row comes from the cascade; a key no rule fits is not listed, so allowed.  A
    null url or one without ``://`` has an empty host and path.  Repeated rows
    are judged alike; an empty table gives an empty table.  A ``keep`` column of a
    name that is made here is refused (ValueError).
    """
    keep = keep or []
    refuse_clash(keep, "host", "path", "rule", "verdict", "listed", "__listed")
    rows = pages.select(*keep, host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    keys = settled(rows.select("host", "path").distinct().withColumn("listed", F.coalesce(verdict == "block", F.lit(False))), "keys")
    out = member(rows, build(keys), "__listed")
    return out.select(*keep, "host", "path", rule.alias("rule"), F.when(F.col("__listed"), "block").otherwise("allow").alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(position('://' IN url), 0) AS p, url FROM pages),
q AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
r(verdict, rule, name, start) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
      ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN r
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
