"""Chat formatting: quoted passages linked to the messages they come from, and conversations in reply order."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

_MARK = re.compile(r"^[\x20\t]*((?:>[\x20\t]?)+)(.*)$", re.S)
_SAID_BY = re.compile(r"^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$")
_BLANK = re.compile(r"\s+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")
_WORD = re.compile(r"\w")

_PASSAGES = "array<struct<level:int,hash:string,ways:array<array<string>>>>"


def normal(text: str) -> str:
    """Lower case, white space as single blanks."""
    return _BLANK.sub(" ", text).strip().lower()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def sentences(texts: set[str]) -> list[str]:
    """Hashes of the sentences of normal texts, which differ from those of the same texts as a whole; those without a word are left out."""
    found = {s for t in texts for s in _END.split(t)}
    return sorted(digest("\0" + s)[:16] for s in found if _WORD.search(s))


def parse(text: str | None) -> tuple[str, int, list[tuple[int, str]], list[str]]:
    """(text without quotes, deepest level, quoted passages as (level, hash), hashes of what it says itself).

    A line that starts with n marks `>` is quoted at level n; runs of one level are a passage. A
    line like `... wrote:` right before a quote is part of the quote. A message says its whole own
    text, its paragraphs, its lines and the sentences of both, so any of these can be quoted. A null text is empty.
    """
    own, runs = _split(text)
    return "\n".join(own).strip("\n"), _depth(runs), [(p["level"], p["hash"]) for p in _passages(runs)], _said(own)


def _split(text: str | None) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """(own lines, runs of quoted lines with their level)."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        if m := _MARK.match(line):
            level = m[1].count(">")
            if last == 0 and own and _SAID_BY.match(own[-1]):
                own.pop()
            if level != last:
                runs.append((level, []))
            runs[-1][1].append(m[2])
            last = level
        else:
            own.append(line)
            last = 0
    return own, runs


def _depth(runs: list[tuple[int, list[str]]]) -> int:
    return max((level for level, _ in runs), default=0)


def _passages(runs: list[tuple[int, list[str]]]) -> list[dict]:
    """Level and hash of each run with text, and its sentences by lines and, where those differ, by paragraphs."""
    passages = []
    for level, lines in runs:
        text = "\n".join(lines)
        if whole := normal(text):
            ways = [sentences(set(map(normal, lines)))]
            if (by_paragraph := sentences(set(map(normal, _PARAGRAPH.split(text))))) not in ways:
                ways.append(by_paragraph)
            passages.append({"level": level, "hash": digest(whole), "ways": ways})
    return passages


def _said(own: list[str]) -> list[str]:
    rest = "\n".join(own).strip("\n")
    pieces = {normal(p) for p in [*_PARAGRAPH.split(rest), *own]}
    return sorted([*map(digest, (pieces | {normal(rest)}) - {""}), *sentences(pieces)])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """messages with own_text, quote_depth, n_quotes, n_linked, parent_turn, thread_turn and thread_place.

    A quoted passage belongs to the first message of its conversation that says it as its own text,
    a paragraph or a line, if that comes before. A passage without one (trimmed, or put together
    from several places) is linked if earlier messages say more than half of its different
    sentences, taken by lines or across the lines of a paragraph, whichever finds the larger
    share; it belongs to the first of those that say the most of them. parent_turn: of the links at the lowest level the latest turn (null: none).
    thread_turn: the turn at the end of the chain of parents, the message's own without one.
    thread_place: how many turns of its thread come before it (0: it starts the thread), so
    conversation, thread_turn and thread_place are the reply order, in which what is answered
    stands before the answer; it holds however rows are stored (`in_reply_order` sorts them).
    Rows that repeat a conversation and turn are linked by all their quotes together and share parent and place.
    Turns are numbers. Null conversations or turns link with nothing, a null text is empty, texts of
    any length are read whole, an empty table gives an empty one. Columns of these names are replaced.
    """
    added = ("own_text", "quote_depth", "n_quotes", "n_linked", "parent_turn", "thread_turn", "thread_place")
    base = messages.drop(*added)

    @F.pandas_udf(f"own string, depth int, n int, quoted {_PASSAGES}, said array<string>")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own, runs = _split(None if t is None else str(t))
            quoted = _passages(runs)
            rows.append(("\n".join(own).strip("\n"), _depth(runs), len(quoted), quoted, _said(own)))
        return pd.DataFrame(rows, columns=["own", "depth", "n", "quoted", "said"])

    # each text is parsed once; all that follows reads what is written here
    every = stable(base.withColumn("__p", parsed(F.col(text_col).cast("string"))))
    rows = every.withColumns({"own_text": F.col("__p.own"), "quote_depth": F.col("__p.depth"), "n_quotes": F.col("__p.n")})
    keys = [F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn")]
    quoted = every.select(*keys, F.explode("__p.quoted").alias("q"))
    quoted = stable(quoted.select("conv", "turn", "q.*").distinct())
    # only what is quoted at all is looked up; of messages that say the same, the first is enough
    wanted = quoted.select("conv", F.explode(F.concat(F.array("hash"), F.flatten("ways"))).alias("hash")).distinct()
    said = every.select(*keys, F.xxhash64("__p.said").alias("same"), F.explode("__p.said").alias("hash"))
    said = stable(said.join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash", "same").agg(F.min("turn").alias("source")))
    first = said.groupBy("conv", "hash").agg(F.min("source").alias("source"))
    passage = ["conv", "turn", "level", "hash"]
    whole = stable(quoted.select(*passage).distinct().join(first, ["conv", "hash"]).where("source < turn").select(*passage, "source"))
    links = whole.unionByName(_trimmed(quoted.join(whole, passage, "left_anti"), said))
    parent = links.groupBy("conv", "turn").agg(F.countDistinct("level", "hash").alias("n_linked"), F.max_by("source", F.struct(-F.col("level"), "source")).alias("parent_turn"))
    parent = stable(parent)
    return _threads(rows.drop("__p"), parent, conv_col, turn_col).select(*base.columns, *added)


def in_reply_order(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Linked messages sorted by conversation, thread and place."""
    return linked.orderBy(conv_col, "thread_turn", "thread_place")


def _trimmed(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, source) of passages that no message says as a whole, by their sentences.

    What messages say is counted once for each different passage of a conversation. It keeps a
    first message for each sentence and for each number of sentences said at once, so passages
    that many messages quote never meet every message that says a part of them.
    """
    asked = stable(quoted.select("conv", "turn", "level", "hash", F.explode("ways").alias("way")).where(F.size("way") > 0))
    parts = asked.select("conv", "way").distinct().select("conv", "way", F.explode("way").alias("hash"))
    hits = stable(parts.join(said, ["conv", "hash"]))
    firsts = hits.groupBy("conv", "way", "hash").agg(F.min("source").alias("source")).groupBy("conv", "way").agg(F.collect_list("source").alias("firsts"))
    most = hits.groupBy("conv", "way", "same").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"))
    most = most.groupBy("conv", "way", "n").agg(F.min("source").alias("source")).groupBy("conv", "way").agg(F.collect_list(F.struct("n", (-F.col("source")).alias("at"))).alias("most"))
    share = F.size(F.filter("firsts", lambda t: t < F.col("turn"))) / F.size("way")
    best = F.array_max(F.filter("most", lambda m: -m["at"] < F.col("turn")))
    found = asked.join(firsts, ["conv", "way"]).join(most, ["conv", "way"]).withColumns({"share": share, "best": best}).where(F.col("share") > 0.5)
    rank = F.struct("share", F.col("best.n") / F.size("way"), "best.at")
    return found.groupBy("conv", "turn", "level", "hash").agg((-F.max_by("best.at", rank)).alias("source"))


def _threads(rows: DataFrame, parent: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """rows with their parent's columns and thread_turn; chains of parents are halved in each round."""
    jump, moved = parent.select("conv", "turn", F.col("parent_turn").alias("thread_turn")), True
    while moved:
        step = jump.select(F.col("conv"), F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("__to"))
        after = stable(jump.join(step, ["conv", "thread_turn"], "left").select("conv", "turn", F.coalesce("__to", "thread_turn").alias("thread_turn"), F.col("__to").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count() > 0
        jump = after.drop("moved")
    known = parent.join(_placed(jump), ["conv", "turn"]).withColumnsRenamed({"conv": "__conv", "turn": "__turn"})
    out = rows.join(known, (F.col(conv_col) == F.col("__conv")) & (F.col(turn_col) == F.col("__turn")), "left").drop("__conv", "__turn")
    return out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "thread_turn": F.coalesce("thread_turn", F.col(turn_col)), "thread_place": F.coalesce("thread_place", F.lit(0).cast("long"))})


#: Turns of a thread that are numbered in one group.
STRETCH = 1024


def _placed(answers: DataFrame) -> DataFrame:
    """answers (conv, turn, thread_turn) with thread_place, from 1: the turn that starts a thread is no answer.

    Stretches of turns are numbered apart and start where the ones before them end, so a thread of any length is spread.
    """
    d = answers.withColumn("__s", F.floor(F.col("turn") / STRETCH))
    thread = ["conv", "thread_turn"]
    starts = d.groupBy(*thread, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*thread).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*thread, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*thread, "__s").orderBy("turn")
    return d.join(starts, [*thread, "__s"]).select("conv", "turn", "thread_turn", (F.col("__before") + F.row_number().over(within)).alias("thread_place"))
