"""Secret scans with column expressions only (operator 1).

Three fixed kinds of pattern, and one found by randomness: candidate strings whose Shannon entropy in
some window of 20 characters is over the limit of the string's character class. The entropy of each
window follows from that of the window before: the counts of the character that leaves and of the one
that enters change the running sum of c*log2(c). Strings on the allow list are suppressed, and so are
candidates that touch a span of another kind. Placeholder words cut a candidate into pieces, each of
which is judged by itself, so that a random token behind such a word in a path is found.

Places come from cutting the text at all matches: gaps and matches alternate, and their lengths add up.

Defined results: a null text counts as the empty one; texts without a match have zero counts, empty
``spans`` and the digest of the empty string; places are code points, ends exclusive; repeated rows have
a row each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, text_or_empty, unused

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Longer strings of these characters are candidates.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy, in bits, of a window by character class. Random windows of 20 have about 3.3 bits
#: over 16 characters, and about 4.0 over 64.
HEX_BITS, BASE64_BITS = 2.9, 3.6
#: What is no secret: words and numbers joined by signs (paths, slugs), UUIDs, runs of letters or digits.
ALLOW = (
    r"^[-/_+]*([A-Za-z]+|[0-9]+)([-/_+]+([A-Za-z]+|[0-9]+))*[-/_+]*=*$",
    r"^[A-Za-z]+=*$",
    r"^[0-9]+=*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Words that stand for a secret, or for no secret; they are no part of what is judged.
PLACEHOLDER = r"([xX]{6}|[eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|0123456789|1234567890|[aA][bB][cC][dD][eE][fF][gG])"
#: Candidates are examined in pieces of so many windows, so that long ones take linear time.
PIECE = 200
#: Matches of a text are walked through in stretches of so many, so that many of them take linear time;
#: a shorter text than would hold a stretch of the shortest matches is one.
STRETCH, SHORTEST = 4096, 7
REDACTED = "[SECRET]"


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Array of (start, ord, end) of the kept matches; ``keep`` gets a match and its second group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.zip_with(whole, second, lambda w, g: F.struct(F.length(w).alias("n"), keep(w, g).alias("ok")))
    # One gap more than matches; the padded match at the end is no span.
    steps = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.n.alias("n"), m.ok.alias("ok")))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    ord_ = F.lit(KINDS.index(kind))

    def walked(part: Column) -> Column:
        """Length of a stretch of steps, and its spans, counted from its begin."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), empty.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x.gap + F.coalesce(x.n, F.lit(0))).cast("int").alias("at"),
                F.when(x.ok, F.concat(acc.spans, F.array(F.struct((acc["at"] + x.gap).cast("int").alias("start"), ord_.alias("ord"), (acc["at"] + x.gap + x.n).cast("int").alias("end"))))).otherwise(acc.spans).alias("spans"),
            ),
        )

    def begins(parts: Column) -> Column:
        """Where each stretch begins."""
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array((F.element_at(acc, -1) + p["at"]).cast("int"))))

    def moved(p: Column, by: Column) -> Column:
        return F.transform(p.spans, lambda s: F.struct((s.start + by).cast("int").alias("start"), s.ord.alias("ord"), (s.end + by).cast("int").alias("end")))

    # An array that grows is copied for each match, so matches are taken in stretches of a fixed number.
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int")), lambda k: walked(F.slice(steps, k * STRETCH + 1, F.lit(STRETCH))))
    joined = F.flatten(F.zip_with(stretches, F.slice(begins(stretches), F.lit(1), F.size(stretches)), moved))
    few = F.length(text) < STRETCH * SHORTEST
    return F.when(~F.rlike(text, F.lit(pattern)), empty).when(few, walked(steps).spans).otherwise(joined)


def _weight(count: Column) -> Column:
    """c * log2(c), zero for none."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def window_bits(text: Column, window: int = WINDOW) -> Column:
    """Largest entropy of all windows of an ASCII string; -1 if it is shorter than one."""

    def step(acc: Column, i: Column, piece: Column) -> Column:
        held = F.substring(piece, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window)))
        leaving, entering = F.substring(piece, i - window, F.lit(1)), F.substring(piece, i, F.lit(1))
        out = _count(held, leaving)
        less = F.when(i > window, _weight(out) - _weight(out - 1)).otherwise(F.lit(0.0))
        rest = F.when(i > window, F.substring(held, F.lit(2), F.lit(window - 1))).otherwise(held)
        into = _count(rest, entering)
        sum_ = acc["sum"] - less + _weight(into + 1) - _weight(into)
        bits = F.when(i >= window, F.log2(F.lit(float(window))) - sum_ / window).otherwise(F.lit(-1.0))
        return F.struct(sum_.alias("sum"), F.greatest(acc.best, bits).alias("best"))

    def of(piece: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), begin, lambda acc, i: step(acc, i, piece), lambda acc: acc.best)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE + window - 1)))
    return F.array_max(F.transform(pieces, of))


def _random(candidate: Column) -> Column:
    def judged(piece: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | F.rlike(piece, F.lit(pattern))
        limit = F.when(F.rlike(piece, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
        return ~allowed & F.rlike(piece, F.lit("[0-9]")) & F.rlike(piece, F.lit("[A-Za-z]")) & (window_bits(piece) >= limit)

    return F.exists(F.split(candidate, PLACEHOLDER, -1), judged)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans (in order, maybe overlapping)."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s.end).alias("at"),
            F.when(s.end > acc["at"], F.concat(acc.out, F.array(F.substring(text, acc["at"] + 1, F.greatest(s.start - acc["at"], F.lit(0))), F.repeat(F.lit(" "), s.end - F.greatest(acc["at"], s.start))))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc.out, F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def scanned(df: DataFrame, text: str = "text", out: str = "found", cut: bool = False) -> DataFrame:
    """``df`` with ``out``: struct of ``base`` and ``all``, arrays of (start, ord, end) in order. With
    ``cut``, a candidate that touches a base span is not suppressed: what is left of it is examined."""
    t = text_or_empty(text)
    base = F.array_sort(F.concat(_spans(t, ASSIGN, "assign", lambda w, g: F.length(g) >= 6), _spans(t, ACCESS, "access", lambda w, g: F.length(w) >= 20), _spans(t, HEX, "hex", lambda w, g: F.lit(True))))
    if cut:
        return _scanned_apart(df, t, base, out)
    more = _spans(t, CANDIDATE, "entropy", lambda w, g: _random(w))
    # The columns of one step are computed once for the next one.
    step = df.withColumn(out, F.struct(base.alias("base"), more.alias("more")))
    fresh = F.filter(F.col(out).more, lambda m: ~F.exists(F.col(out).base, lambda b: (b.start < m.end) & (m.start < b.end)))
    return step.withColumn(out, F.struct(F.col(out).base.alias("base"), F.when(F.size(F.col(out).more) > 0, F.array_sort(F.concat(F.col(out).base, fresh))).otherwise(F.col(out).base).alias("all")))


def _scanned_apart(df: DataFrame, t: Column, base: Column, out: str) -> DataFrame:
    step = df.withColumn(out, base)
    step = step.withColumn(out, F.struct(F.col(out).alias("base"), _blanked(t, F.col(out)).alias("rest")))
    step = step.withColumn(out, F.struct(F.col(out).base.alias("base"), _spans(F.col(out).rest, CANDIDATE, "entropy", lambda w, g: _random(w)).alias("more")))
    return step.withColumn(out, F.struct(F.col(out).base.alias("base"), F.array_sort(F.concat(F.col(out).base, F.col(out).more)).alias("all")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.ord], s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each secret in ``text`` replaced by ``REDACTED``; overlapping spans are replaced
    as one. Other columns, names and order stay; a null text stays null. What a candidate has besides a
    span of another kind is examined too, unlike in the query, whose SQL suppresses all of it."""
    found = unused(df, "found")
    t = F.col(text)
    walked = F.aggregate(
        F.col(found).all,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s.end).alias("at"),
            F.when(s.start >= acc["at"], F.concat(acc.out, F.array(F.substring(t, acc["at"] + 1, s.start - acc["at"]), F.lit(REDACTED)))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc.out, F.array(F.substring(t, acc["at"] + 1, F.length(t)))), ""),
    )
    return scanned(df, text, found, cut=True).withColumn(text, F.when(F.size(F.col(found).all) > 0, walked).otherwise(t)).drop(found)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.col("found.base").alias("base"), F.col("found.all").alias("all"))
    n = lambda k: F.size(F.filter("base", lambda s: s.ord == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


def _duck_spans(kind: str, pattern: str, keep: str) -> str:
    """List of (start, ord, end); gaps before a match are the cut pieces, added up."""
    return f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{_duck(pattern)}')) + 1), lambda i: {keep}),
      lambda i: {{'start': CAST(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w_{kind}[1:i-1], lambda x: length(x))), 0) AS INTEGER), 'ord': {KINDS.index(kind)}, 'end': CAST(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))) + list_sum(list_transform(w_{kind}[1:i], lambda x: length(x))) AS INTEGER)}})"""


def _duck_sql() -> str:
    parts = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    lists = ",\n".join(f"string_split_regex(t, '{_duck(p)}') AS g_{k}, regexp_extract_all(t, '{_duck(p)}') AS w_{k}" for k, p in parts.items())
    allow = " OR ".join(f"regexp_matches(x, '{_duck(p)}')" for p in ALLOW)
    bits = f"list_max(list_transform(range(1, length(x) - {WINDOW - 2}), lambda j: list_aggregate(string_split(substr(x, j, {WINDOW}), ''), 'entropy')))"
    limit = f"CASE WHEN regexp_matches(x, '^([0-9a-f]+|[0-9A-F]+)$') THEN {HEX_BITS} ELSE {BASE64_BITS} END"
    judged = f"NOT ({allow}) AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND {bits} >= {limit}"
    keep = {
        "assign": "length(v_assign[i]) >= 6", "access": "length(w_access[i]) >= 20", "hex": "true",
        "entropy": f"len(list_filter(string_split_regex(w_entropy[i], '{_duck(PLACEHOLDER)}'), lambda x: {judged})) > 0",
    }
    spans = ",\n".join(f"{_duck_spans(k, p, keep[k])} AS s_{k}" for k, p in parts.items())
    listed = lambda s: f"array_to_string(list_transform({s}, lambda s: (['assign','access','hex','entropy'])[s.ord + 1] || ':' || s.start || ':' || s.end), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cuts AS (SELECT doc_id, t, regexp_extract_all(t, '{_duck(ASSIGN)}', 2) AS v_assign, {lists} FROM d),
found AS (SELECT doc_id, {spans} FROM cuts),
base AS (SELECT *, list_sort(list_concat(list_concat(s_assign, s_access), s_hex)) AS b FROM found),
every AS (SELECT *, list_sort(list_concat(b, list_filter(s_entropy, lambda m: len(list_filter(b, lambda o: o.start < m.end AND m.start < o.end)) = 0))) AS a FROM base)
SELECT doc_id, CAST(len(s_assign) AS BIGINT) AS n_assign, CAST(len(s_access) AS BIGINT) AS n_access, CAST(len(s_hex) AS BIGINT) AS n_hex,
sha256(coalesce({listed('b')}, '')) AS base_sha256, coalesce({listed('a')}, '') AS spans FROM every"""


ORACLE_SQL = {"op1_secrets": _duck_sql()}
