"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that the workers hold at once; more are applied in as many passes as it takes.
RULES_AT_ONCE = 100_000

_TOKEN = re.compile(r"[a-z0-9]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def tokens_of(text: str) -> list[str]:
    """ASCII letters and digits in runs, A-Z as a-z. No other sign is folded, as some become letters and would join a run."""
    return _TOKEN.findall(text.translate(_FOLD))


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path, lower case in the host.

    `||` at the start binds it to the start of the host or of one of its labels, `|` to the start
    or end of the whole; `*` stands for anything, `^` for a separator or the end. Of the rules
    that match, the one with the highest rank wins, then the longest pattern, then the first
    pattern by code point.
    """

    action: str
    pattern: str
    rank: int = 0

    def regex(self) -> str:
        body, head, tail = self.pattern, "", ""
        if body.startswith("||"):
            head, body = r"^(?:[^/]*\.)?", body[2:]
        elif body.startswith("|"):
            head, body = "^", body[1:]
        if body.endswith("|"):
            tail, body = r"\Z", body[:-1]
        return head + re.sub(r"\\\*", ".*", re.escape(body)).replace(r"\^", r"(?:[^A-Za-z0-9_.%-]|\Z)") + tail

    def tokens(self) -> list[str]:
        """Literal runs that any URL matching this has as whole tokens: those closed on both sides."""
        bound, out = re.match(r"\|*", self.pattern).end(), []
        end = len(self.pattern) - self.pattern.endswith("|") * (len(self.pattern) > bound)
        for m in _TOKEN.finditer(self.pattern.translate(_FOLD)):
            before, after = self.pattern[m.start() - 1 : m.start()], self.pattern[m.end() : m.end() + 1]
            closed = (m.start() == bound and bound > 0 or before not in ("", "*")) and (after not in ("", "*") or m.end() == end < len(self.pattern))
            out += [m.group()] * closed
        return out


class RuleIndex:
    """Rules by their rarest token; those without a token stand apart and are always tried."""

    def __init__(self, rules: Iterable[Rule], seen: Counter) -> None:
        self.by_token, self.always = defaultdict(list), []
        for r in sorted(set(rules), key=lambda r: (-r.rank, -len(r.pattern), r.pattern, r.action)):
            entry = ((-r.rank, -len(r.pattern), r.pattern, r.action), re.compile(r.regex(), re.S), r)
            if tokens := r.tokens():
                self.by_token[min(tokens, key=lambda t: (seen[t], t))].append(entry)
            else:
                self.always.append(entry)

    def best(self, url: str) -> Rule | None:
        found = [*self.always]
        for t in set(tokens_of(url)):
            found += self.by_token.get(t, ())
        return next((rule for _, regex, rule in sorted(found, key=lambda e: e[0]) if regex.search(url)), None)


def host_and_path(url):
    """(host, path) columns. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; path: from there up to `?`, `#` or the end. Null or no `://`: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`__url`"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", rules_at_once: int = RULES_AT_ONCE) -> DataFrame:
    """pages with host, path, pattern (of the rule that decides, else null), rank and verdict.

    Columns of pages with these names are replaced. Each URL is judged where it lies, with no
    shuffle, so one frequent host or URL burdens no task more than its rows do. Workers hold at most
    `rules_at_once` rules; longer lists take a pass for each such part, which carries the best
    rule so far. Rarity is counted over all URLs, for the tokens of the rules at hand only.
    """
    host, path = host_and_path(F.col("__url"))
    base = pages.drop("host", "path", "pattern", "rank", "verdict").withColumn("__url", F.col(url_col).cast("string"))
    base = base.withColumns({"host": host, "path": path}).drop("__url")
    best = base.withColumns({"pattern": F.lit(None).cast("string"), "rank": F.lit(None).cast("int"), "verdict": F.lit(default)})
    for at in range(0, len(rules), rules_at_once):
        part = rules[at : at + rules_at_once]
        index = RuleIndex(part, token_counts(base, {t for r in part for t in r.tokens()}))
        best = _apply(best, index)
    return best


def token_counts(base: DataFrame, wanted: set[str]) -> Counter:
    """URLs that hold each wanted token, over all rows; at most a row for each token and task is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for url in b["url"]:
                n.update(wanted.intersection(tokens_of(url)))
        yield pd.DataFrame({"token": list(n), "n": list(n.values())}).astype({"token": "object", "n": "int64"})

    rows = base.select(F.concat("host", "path").alias("url")).mapInPandas(count, "token string, n long")
    return Counter({r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()})


def _apply(base: DataFrame, index: RuleIndex) -> DataFrame:
    @F.pandas_udf("action string, pattern string, rank int")
    def best(urls: pd.Series) -> pd.DataFrame:
        known: dict[str, Rule | None] = {}
        for u in urls:
            if u not in known:
                known[u] = index.best(u)
        found = [known[u] for u in urls]
        return pd.DataFrame([(None, None, None) if r is None else (r.action, r.pattern, r.rank) for r in found], columns=["action", "pattern", "rank"]).astype({"rank": "Int32", "action": "object", "pattern": "object"})

    out = base.withColumn("__r", best(F.concat("host", "path")))
    key = lambda rank, pattern: F.struct((-rank), -F.length(pattern), pattern)
    wins = F.col("__r.action").isNotNull() & (F.col("pattern").isNull() | (key(F.col("__r.rank"), F.col("__r.pattern")) < key(F.col("rank"), F.col("pattern"))))
    return out.withColumns({c: F.when(wins, F.col(f"__r.{s}")).otherwise(F.col(c)) for c, s in (("pattern", "pattern"), ("rank", "rank"), ("verdict", "action"))}).drop("__r")
