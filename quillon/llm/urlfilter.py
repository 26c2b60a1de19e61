"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 is a Bloom filter of the listed keys; level 2 encodes the keys of the corpus that level 1 takes wrongly for
listed; level 3 the listed keys that level 2 takes wrongly, and so on until a level has no false positives. Over the
corpus's complete key universe the cascade's answer is then exact, and judging a URL needs no join: the words of each
level are an array in the plan. Level 1 gets log2(universe / listed) * 1.44 bits a key (at least 8), so the number of false
positives it leaves is near the number of listed keys: the cascade grows with the list, and with the corpus's logarithm.

A key is `host || path prefix` of a rule. A rule fits its host and all subdomains if the path starts with the rule's path;
the longest rule wins, at equal length that with the longer host. URLs that no rule fits get the verdict `default`. Which
verdict a listed key has is told by one more cascade for each verdict but the most frequent one, whose universe is the list.
The way is the same for lists of every length; a list that the driver holds, as rules, has a cascade that it can hold.

Defined results: a null URL, or one without `://`, has empty host and path; extra columns pass through, those named like a
result column with their names lengthened by "_"; an empty rule list gives `default` everywhere; rules repeated with one
verdict count once, with two verdicts they are refused; URLs repeated are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import col, free, lower_ascii, set_aside, shared_dir, table

RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: 64-bit words, the number of probes, and the seed of its hashes (each level has its own, or what one
    takes wrongly the next could again)."""

    words: tuple[int, ...]
    probes: int
    seed: int = 0

    def holds(self, key: Column) -> Column:
        if not self.words:
            return F.lit(False)
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        return F.forall(
            F.sequence(F.lit(0), F.lit(self.probes - 1)),
            lambda i: F.getbit(F.element_at(words, (_slot(key, i, len(self.words), self.seed) / 64).cast("int") + 1), (_slot(key, i, len(self.words), self.seed) % 64).cast("int")) == 1,
        )


def _slot(key: Column, i: Column, n_words: int, seed: int) -> Column:
    """The i-th bit position of a key, by double hashing."""
    bits = F.lit(n_words * 64)
    step = F.pmod(F.xxhash64(F.lit("step"), F.lit(seed), key), bits - 1) + 1
    return F.pmod(F.pmod(F.xxhash64(F.lit(seed), key), bits) + i * step, bits)


def _level(keys: DataFrame, n: int, bits_per_key: float, seed: int) -> Level:
    """A filter of the column `key`; bits are set by one hash aggregation over its words."""
    n_words = max(2, math.ceil(n * bits_per_key / 64))
    probes = max(1, round(bits_per_key * math.log(2)))
    slots = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: _slot(F.col("key"), i, n_words, seed))).alias("slot"))
    found = (
        slots.select((F.col("slot") / 64).cast("int").alias("word"), (F.col("slot") % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()  # at most n_words rows, bounded by the rule list
    )
    words = [0] * n_words
    for r in found:
        words[r["word"]] = r["bits"]
    return Level(tuple(words), probes, seed)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.when(F.startswith(tail, F.lit("/")), F.regexp_extract(tail, r"^([^?#]*)", 1)).otherwise("")


def _last_labels(host: Column, n: Column) -> Column:
    """The last n labels of a host; n varies by row, which substring_index's own wrapper doesn't take."""
    return F.array_join(F.slice(F.split(host, r"\."), -n, n), ".")


def candidates(host: Column, path: Column, rules: list[Rule]) -> Column:
    """An array of structs (n: length of the key, labels of its host, key), one for each shape of a rule that the URL is long
    enough for. The shapes are an array in the plan, whatever their number."""
    shapes = sorted({(len(r.path), r.host.count(".") + 1) for r in rules})
    given = F.from_json(F.lit(json.dumps([{"length": a, "labels": b} for a, b in shapes])), "array<struct<length:int,labels:int>>")
    long = F.filter(given, lambda x: (F.size(F.split(host, r"\.")) >= x["labels"]) & (F.length(path) >= x["length"]))

    def made(x: Column) -> Column:
        key = F.concat(_last_labels(host, x["labels"]), F.lit("\0"), F.substring(path, F.lit(1), x["length"]))
        return F.struct((F.length(key) - 1).alias("n"), x["labels"].alias("labels"), key.alias("key"))

    return F.transform(long, made)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        """Exact for the listed keys and for every key of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[depth].holds(key), answer).otherwise(F.lit(depth % 2 == 1))
        return answer

    @property
    def bits(self) -> int:
        return sum(64 * len(x.words) for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: float | None = None) -> Cascade:
    """listed, universe: frames with a column `key`. The universe's false positives shrink at each level; it is read once
    for its size and once for the first level's false positives, which are few and are kept."""
    listed = listed.select("key").distinct()
    n_listed = listed.count()
    if not n_listed:
        return Cascade([])
    others = universe.select("key").filter(F.col("key").isNotNull()).distinct()
    n_others = others.count()
    first = bits_per_key or max(8.0, 1.44 * math.log2(max(2, n_others / n_listed)))
    levels = [_level(listed, n_listed, first, 0)]
    wrong = others.filter(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti").checkpoint()
    right, n = listed, wrong.count()
    while n:
        levels.append(_level(wrong, n, bits_per_key or 8.0, len(levels)))
        right, wrong = wrong, right.filter(levels[-1].holds(F.col("key"))).checkpoint()
        n = wrong.count()
        if len(levels) > 64:
            raise RuntimeError("the cascade doesn't end: a listed key and a key of the universe have equal hashes")
    return Cascade(levels)


def _checked(rules: list[Rule]) -> list[Rule]:
    kept: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if kept.setdefault((r.host, r.path), r).verdict != r.verdict:
            raise ValueError(f"two verdicts for {r.text}")
    return list(kept.values())


def _verdicts(spark: SparkSession, rules: list[Rule], bits_per_key: float | None) -> list[tuple[str, Cascade]]:
    """The most frequent verdict with no cascade, and each other with a cascade of its keys over all rules' keys."""
    keys: dict[str, list[str]] = {}
    for r in rules:
        keys.setdefault(r.verdict, []).append(f"{r.host}\0{r.path}")
    first, *others = sorted(keys, key=lambda v: (-len(keys[v]), v))
    frame = spark.createDataFrame([(k, v) for v in keys for k in keys[v]], "key string, verdict string")
    return [(first, Cascade([]))] + [(v, build_cascade(frame.filter(F.col("verdict") == v), frame, bits_per_key)) for v in others]


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", bits_per_key: float | None = None) -> DataFrame:
    """df with host, path, rule and verdict."""
    rules = _checked(rules)
    h, p, best = free("_host", df), free("_path", df), free("_best", df)
    host, path = parts(col(url))
    split = df.withColumns({h: host, p: path})
    taken: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(default)
    if rules:
        spark = df.sparkSession
        shared_dir(spark)
        listed = spark.createDataFrame([(f"{r.host}\0{r.path}",) for r in rules], "key string")
        found = candidates(F.col(h), F.col(p), rules)
        cascade = build_cascade(listed, split.select(F.explode(found["key"]).alias("key")), bits_per_key)
        taken = F.array_max(F.filter(found, lambda x: cascade.listed(x["key"])))["key"]
        (most, _), *others = _verdicts(spark, rules, bits_per_key)
        verdict = F.lit(most)
        for v, own in others:
            verdict = F.when(own.listed(F.col(best)), v).otherwise(verdict)
        verdict = F.when(F.col(best).isNull(), default).otherwise(verdict)
    return split.withColumn(best, taken).select(
        *(col(c).alias(x) for c, x in zip(df.columns, set_aside(df.columns, RESULTS), strict=True)),
        F.col(h).alias("host"),
        F.col(p).alias("path"),
        F.translate(best, "\0", "").alias("rule"),
        verdict.alias("verdict"),
    )


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_SQL_RULE = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
OP5_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN substr(rest, length(raw) + 1, 1) = '/' THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_SQL_RULE.format(h=r.host, p=r.path)} THEN '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text)))} END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES)} ELSE 'allow' END AS verdict FROM ruled
"""
