"""Secret scans: credentials in texts, and weak candidates linked to the parts that go with them.

Everything here is made of DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, stable

_CASED = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Spans of these kinds are reported wherever they are; the order is the order of kinds at one start.
BASE = {
    # a name that promises a secret, and a value of 8 characters or more (group 2)
    "assign": "(" + _CASED(["password", "passwd", "secret", "token"]) + "|" + _CASED(["api"]) + "_?" + _CASED(["key"]) + ")" + _VALUE,
    # runs of 16 characters or more; shorter runs can't hold such a run, so the pattern may ask for them at once
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
}
#: Weak candidates: reported only beside the parts that complete them.
WEAK = {
    "login": "(" + _CASED(["username", "user", "login"]) + "|" + _CASED(["client"]) + "_?" + _CASED(["id"]) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""",
    "value": "[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""",
}
KINDS = [*BASE, *WEAK]
#: A scope ends at a blank line.
BREAK = r"\n[\x20\x09\x0D]*\n"
#: Code points between two parts of one credential at most.
REACH = 200
#: Spans listed in up to this many characters may be handed to every task, if many rows have their text.
SMALL = 1024

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: str, pattern: str, kind: str, rank: int, keep: str = "true") -> str:
    """SQL for the matches of pattern in the column `text`: leftmost, not overlapping, as spans of code points.

    keep may use g, a match's group 2, and m, the match. Places are sums over what stands before: of blocks of
    64 matches first, then within the block, so that thousands of matches in a text stay cheap.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    groups = f"regexp_extract_all({text}, '{p}', 2)" if "g" in keep else "m"
    prefix = """transform(array(transform(sequence(0, (size(s) - 1) div 64), b -> aggregate(slice(s, b * 64 + 1, 64), 0, (a, x) -> a + x))), t ->
      transform(array(aggregate(t, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))), u ->
        transform(s, (x, i) -> u[i div 64] + aggregate(slice(s, (i div 64) * 64 + 1, i % 64), 0, (a, y) -> a + y)))[0])[0]"""
    body = f"""transform(array(transform(m, (x, i) -> length(x) + length(c[i]))), s -> transform(array({prefix}), at ->
      filter(transform(m, (x, i) -> named_struct('start', at[i] + length(c[i]), 'rank', {rank}, 'kind', '{kind}', 'end', at[i] + length(c[i]) + length(x), 'm', x, 'g', g[i])), z -> {keep})))[0][0]"""
    found = f"""transform(array(regexp_extract_all({text}, '{p}', 0)), m -> transform(array(split({text}, '{p}', -1)), c -> transform(array({groups}), g -> {body})))[0][0][0]"""
    small = f"transform({found}, z -> named_struct('start', z.start, 'rank', z.rank, 'kind', z.kind, 'end', z.end))"
    return f"CASE WHEN {text} RLIKE '{p}' THEN {small} ELSE cast(array() AS {_SPANS}) END"


_KEEP = {"assign": "length(z.g) >= 8", "login": "length(z.g) >= 3", "value": "z.m RLIKE '[0-9]' AND z.m RLIKE '[a-z]' AND z.m RLIKE '[A-Z]'"}


def _found(kinds: dict[str, str]) -> Column:
    """All spans of the kinds in `__text`, by start, then kind."""
    parts = [_spans("__text", p, k, KINDS.index(k), _KEEP.get(k, "true")) for k, p in kinds.items()]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """(key, weak): for distinct texts (key, parts) the weak candidates that their neighbours complete.

    A login needs a secret (assign, hex or value) within reach in its scope, a value needs an
    identifier (access or login), an endpoint needs both. A candidate that
    overlaps a base span says nothing new and is left out. The join is on text, scope and ranges of `reach` code points,
    so a pair of parts far apart never meets, and a range of a text bounds what meets.
    """
    parts = found.select("key", F.explode("parts").alias("p")).select("key", "p.*")
    scope = F.expr("count_if(kind = 'break') OVER (PARTITION BY key ORDER BY start, rank)")
    parts = stable(parts.withColumn("scope", scope).where("kind <> 'break'"))
    ranges = lambda d, by: d.withColumn("range", F.explode(F.expr(f"sequence((start - {by}) div {reach} - 1, (end + {by}) div {reach})")))
    far, near = ranges(parts, reach), ranges(parts, 0).select(*[F.col(c).alias(f"o_{c}") for c in ("key", "scope", "range", "start", "end", "kind")])
    same = (F.col("key") == F.col("o_key")) & (F.col("range") == F.col("o_range"))
    within = same & (F.col("scope") == F.col("o_scope")) & (F.col("o_start") <= F.col("end") + reach) & (F.col("start") <= F.col("o_end") + reach)
    overlaps = same & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    span = ["key", "start", "rank", "kind", "end"]
    fresh = ranges(parts.where(F.col("kind").isin(*WEAK)), 0).join(near.where(F.col("o_kind").isin(*BASE)), overlaps, "left_semi").select(*span).distinct()
    weak = far.where(F.col("kind").isin(*WEAK)).join(fresh, span, "left_anti")
    # values inside base spans are those spans over again: no link to themselves
    role = lambda c: F.when(c.isin("access", "login"), "identifier").when(c.isin("assign", "hex", "value"), "secret").otherwise("endpoint")
    other = near.join(fresh.select(*[F.col(c).alias(f"f_{c}") for c in ("key", "start", "end", "kind")]), (F.col("o_key") == F.col("f_key")) & (F.col("o_start") == F.col("f_start")) & (F.col("o_end") == F.col("f_end")) & (F.col("o_kind") == F.col("f_kind")), "left_anti")
    met = weak.join(other, within & (role(F.col("kind")) != role(F.col("o_kind")))).groupBy(*span).agg(F.bool_or(role(F.col("o_kind")) == "identifier").alias("i"), F.bool_or(role(F.col("o_kind")) == "secret").alias("s"))
    done = met.where(F.expr("CASE kind WHEN 'login' THEN s WHEN 'value' THEN i ELSE i AND s END"))
    return done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*span[1:]))).cast(_SPANS).alias("weak"))


def _read(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __key and __parts: a name of the text, and all spans and breaks in it, where it has a base span or a login; else null."""
    base = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hinted = " OR ".join("__text RLIKE '" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in (*BASE.values(), WEAK["login"]))
    base = base.withColumn("__key", F.when(F.expr(hinted), F.sha2(F.col("__text").cast("binary"), 256)))
    breaks = F.expr(_spans("__text", BREAK, "break", -1))
    return base.withColumn("__parts", F.when(F.col("__key").isNotNull(), F.concat(_found(BASE | WEAK), breaks))).drop("__text")


def _by_text(read: DataFrame, reach: int) -> DataFrame:
    """(key, rows, base, weak): for each different text how many rows have it, and its spans in order."""
    found = stable(read.where("__key IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.first("__parts").alias("parts")))
    kinds = ", ".join(f"'{k}'" for k in BASE)
    weak = F.coalesce("weak", F.expr(f"cast(array() AS {_SPANS})"))
    return found.join(_linked(found, reach), "key", "left").select("key", "rows", F.expr(f"array_sort(filter(parts, s -> s.kind IN ({kinds})))").alias("base"), weak.alias("weak"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _handed(size: Column) -> Column:
    """Rows of a text, as by_size asks for them; 0 for one with so much to hand out that its rows are better shuffled."""
    return F.when(size <= SMALL, F.col("rows")).otherwise(F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row: kind:start:end, end exclusive, in code points.

    Base spans are reported wherever they are, weak ones beside what completes them. A text without
    any, or null, has zeros, the digest of the empty string and empty spans. Equal texts have equal values.
    Texts are read once, where they lie; what is joined and shuffled is places of those few that have a
    base span or a login, each different text once.
    """
    rows = stable(_read(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "__key", "__parts"))
    facts = _by_text(rows, reach)
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long)") for k in BASE}
    spans = _listed(F.array_sort(F.concat("base", "weak")))
    facts = facts.select(F.col("key").alias("__key"), _handed(F.length(spans)).alias("rows"), *[c.alias(n) for n, c in counts.items()], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
    keyed, narrow = stable(facts), rows.drop("__parts")
    total = keyed.agg(F.sum("rows")).first()[0] or 0
    some = by_size(narrow.where("__key IS NOT NULL"), keyed, "__key", "rows", total).drop("__key")
    none = narrow.where("__key IS NULL").select("doc_id", *[F.lit(0).cast("long").alias(n) for n in counts], F.sha2(F.lit(b""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return none.unionByName(some)


def _cuts(facts: DataFrame) -> DataFrame:
    """(__key, rows, __cut): what to cut as (start, end) pairs in order; spans that touch become one. Null where nothing is cut."""
    spans = facts.select("key", "rows", F.explode_outer(F.concat("base", "weak")).alias("s")).select("key", "rows", "s.*")
    order = Window.partitionBy("key").orderBy("start", "rank")
    new = (F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    spans = spans.withColumn("new", F.coalesce(new, F.lit(0)))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("key", "rows", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = runs.groupBy("key", "rows").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("__cut"))
    return cut.select(F.col("key").alias("__key"), _handed(F.size("__cut") * 8).alias("rows"), F.when(F.size("__cut") > 0, F.col("__cut")).alias("__cut"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """docs with every span in text_col, base or linked, replaced by mark; overlapping spans by one. Other columns stay.

    Rows without a base span or login stay where they are; of the others, those of one text meet its
    spans. The text is cut in stretches of 64 spans first, so many spans in a long one stay cheap.
    """
    facts = _by_text(stable(_read(docs.select(text_col), text_col).where("__key IS NOT NULL").select("__key", "__parts")), reach)
    cuts, read = stable(_cuts(facts)), _read(docs, text_col).drop("__parts")
    total = cuts.agg(F.sum("rows")).first()[0] or 0
    some = by_size(read.where("__key IS NOT NULL"), cuts, "__key", "rows", total)
    t = f"`{text_col}`"
    begin = "if(b = 0, 0, __cut[b * 64 - 1].end)"
    stretch = f"transform(sequence(0, (size(__cut) - 1) div 64), b -> named_struct('b', b, 'at', {begin}, 't', substring({t}, {begin} + 1, __cut[least(b * 64 + 63, size(__cut) - 1)].end - {begin})))"
    before = "if(i = z.b * 64, z.at, __cut[i - 1].end)"
    put = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pieces = f"transform({stretch}, z -> array_join(transform(sequence(z.b * 64, least(z.b * 64 + 63, size(__cut) - 1)), i -> concat(substring(z.t, {before} - z.at + 1, __cut[i].start - {before}), {put})), ''))"
    clean = F.expr(f"concat(array_join({pieces}, ''), substring({t}, element_at(__cut, -1).end + 1))")
    some = some.withColumn(text_col, F.when(F.col("__cut").isNotNull(), clean).otherwise(F.col(text_col)))
    return read.where("__key IS NULL").select(*docs.columns).union(some.select(*docs.columns))
