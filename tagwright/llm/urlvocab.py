"""Page addresses judged by a weighted vocabulary.

An Aho-Corasick automaton finds the terms in the address, with ASCII letters lower-cased. A hit counts where no ASCII
letter or digit stands directly before or after it. One strict term rejects; so do at least ``min_soft`` different soft
terms whose weights add up to ``min_weight``: two of them if one is telling by itself, three if all are common words. Rules on host and path come first.

Null, empty or malformed addresses have an empty host and path and match no rule; what text they have is still searched.
Repeated rows are judged alike, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("casino", "porn", "xxx", "viagra", "escort", "adult", "warez", "malware", "phishing")
SOFT = {
    "bet": 1.0, "bets": 1.0, "betting": 1.0, "poker": 1.0, "slots": 1.0, "jackpot": 1.0, "win": 0.5, "free": 0.5,
    "cheap": 1.0, "pills": 1.0, "pharmacy": 0.5, "loan": 1.0, "loans": 1.0, "credit": 0.5, "spam": 1.0, "farm": 0.5,
    "ads": 1.0, "track": 0.5, "tracker": 0.5, "click": 0.5, "bonus": 1.0, "crack": 1.0, "keygen": 1.0, "sex": 1.0,
    "dating": 1.0, "replica": 1.0, "outlet": 0.5,
}
# rule, verdict: the longest rule that fits decides
RULES = (
    ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class UrlVocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    min_soft: int = 2
    min_weight: float = 1.5
    rules: tuple[tuple[str, str], ...] = RULES


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path of an address, both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    return rest[:cut].translate(_LOWER), path


class UrlJudge:
    def __init__(self, vocabulary: UrlVocabulary):
        self.v = vocabulary
        self.machine = ahocorasick.Automaton()
        for t in vocabulary.strict:
            self.machine.add_word(t, (t, None))
        for t, w in vocabulary.soft:
            self.machine.add_word(t, (t, w))
        self.machine.make_automaton()
        self.rules = sorted(
            ((r, *r.partition("/")[::2], v) for r, v in vocabulary.rules), key=lambda r: -len(r[0])
        )

    def hits(self, url: str) -> tuple[set[str], dict[str, float]]:
        text = url.translate(_LOWER)
        strict, soft = set(), {}
        for last, (term, weight) in self.machine.iter(text):
            first = last - len(term) + 1
            if (first and text[first - 1] in _WORD) or (last + 1 < len(text) and text[last + 1] in _WORD):
                continue
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        return strict, soft

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        for rule, of, start, verdict in self.rules:
            if (host == of or host.endswith("." + of)) and path.startswith("/" + start):
                return rule, verdict
        return None, None

    def __call__(self, url: str | None) -> tuple:
        host, path = host_and_path(url)
        strict, soft = self.hits(url or "")
        rule, verdict = self.rule(host, path)
        if verdict is None:
            weight = sum(soft.values())
            bad = strict or (len(soft) >= self.v.min_soft and weight >= self.v.min_weight)
            verdict = "block" if bad else "allow"
        return host, path, rule, verdict, len(strict), len(soft), float(sum(soft.values()))


def judge_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", vocabulary: UrlVocabulary = UrlVocabulary()
) -> DataFrame:
    """Host, path, rule and verdict of every address, with its counts of distinct strict and soft terms."""
    given = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"))
    names = [id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(vocabulary)
        types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [judge(u) for u in batch.column("_url").to_pylist()]
            columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=names)

    id_type = given.schema["_id"].dataType.simpleString()
    return given.mapInArrow(
        run,
        f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, n_strict long, n_soft long, "
        "soft_weight double",
    )


def verdict_sql(table: str = "pages", vocabulary: UrlVocabulary = UrlVocabulary()) -> str:
    """The same rows in DuckDB: a pattern per term, a case per rule from the longest to the shortest."""
    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = sorted((r for r, _ in vocabulary.rules), key=len, reverse=True)
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{h}/{p}'"
        for h, _, p in (r.partition("/") for r in rules)
    )
    verdicts = " ".join(f"when rule = '{r}' then '{v}'" for r, v in vocabulary.rules)
    return f"""
with parts as (
  select page_id, translate(coalesce(url, ''), '{upper}', '{lower}') as low,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from {table}),
counted as (
  select page_id, host, path,
         cast({" + ".join(f"cast({hit(t)} as bigint)" for t in vocabulary.strict)} as bigint) as n_strict,
         cast({" + ".join(f"cast({hit(t)} as bigint)" for t, _ in vocabulary.soft)} as bigint) as n_soft,
         cast({" + ".join(f"cast({hit(t)} as double) * {w}" for t, w in vocabulary.soft)} as double) as soft_weight,
         case {cases} end as rule
  from parts)
select page_id, host, path, rule,
       case {verdicts}
            when n_strict > 0 or (n_soft >= {vocabulary.min_soft} and soft_weight >= {vocabulary.min_weight}) then 'block'
            else 'allow' end as verdict,
       n_strict, n_soft, soft_weight
from counted"""
