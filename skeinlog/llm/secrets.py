"""Secret scan with multipart credential linking, as DataFrame expressions only.

Base detectors report spans on their own. Weak detectors (identifiers, bare tokens, endpoints) would flag too
much alone; a weak candidate is reported only where complementary parts stand beside it in the same scope: an
identifier needs a secret, a bare token needs an identifier, an endpoint needs both. Scopes are paragraphs
(text between blank lines) and the parts must lie within ``reach`` characters.

The spans of a pattern come from splitting at its matches: gaps and matches alternate, so running sums of their
lengths give all starts. The link is an interval join in sorted order: within a scope the nearest part before
and after each candidate are running maxima and minima, so no pairs are formed. Only documents with a weak candidate
beside a base span or another candidate are shuffled, as spans, never as text.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._tables import write_table

#: The base detectors. Group 2 of an assignment is its value.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Weak detectors.
IDENTIFIER = r"(?:[Aa]ccess_?[Kk]ey_?[Ii][Dd]|[Cc]lient_?[Ii][Dd]|[Aa]ccount_?[Ii][Dd]|[Uu]ser_?[Nn]ame)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}|\b(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}"
BARE_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+"

KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
_ASSIGN, _ACCESS, _HEX, _IDENTIFIER, _TOKEN, _ENDPOINT, _BREAK = range(7)
REACH = 400
_BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once; lambdas would compute an expression anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix_sums(lengths: Column) -> Column:
    """Sums of all values up to each place of a bound array, in blocks, so that long arrays take few steps an element."""
    whole = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")))
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = F.transform(whole, lambda b: add(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = let(sums, lambda blocks: F.transform(whole, lambda b: add(F.slice(blocks, F.lit(1), b))))
    return let(
        starts,
        lambda before: F.transform(
            lengths, lambda x, i: F.element_at(before, block(i) + 1) + add(F.slice(lengths, block(i) * _BLOCK + 1, i % _BLOCK + 1))
        ),
    )


def spans_of(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost matches of ``pattern`` for which ``keep(text, matches)`` holds, as (start, kind, end)."""

    def places(lengths: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        shifted = F.slice(F.concat(F.array(F.lit(0)), lengths), F.lit(1), F.size(lengths))
        return let(F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), shifted, lambda g, m: g + m), prefix_sums)

    def spans(matches: Column) -> Column:
        lengths = F.transform(matches, lambda m: F.length(m))
        sized = F.zip_with(lengths, keep(text, matches), lambda m, k: F.struct(m.alias("n"), k.alias("k")))
        found = F.zip_with(
            let(lengths, places), sized, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + m["n"]).alias("end"), m["k"].alias("k"))
        )
        return F.transform(
            F.filter(found, lambda f: f["k"]), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"))
        )

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array()).cast(_SPANS)


def _value_long_enough(text: Column, _matches: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)


def _mixed(_text: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))


def _any(_text: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.lit(True))


def find_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: __row, id, ``base`` spans and ``weak`` candidates with paragraph breaks; a map over the texts.

    Runs of hexadecimal digits that are long enough are the maximal runs of that length, so the pattern asks for
    the length at once; the same holds for access identifiers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), text.alias("__text"))
    t = F.col("__text")
    base = F.concat(
        spans_of(t, ASSIGN, _ASSIGN, _value_long_enough),
        spans_of(t, rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", _ACCESS, _any),
        spans_of(t, rf"[0-9a-f]{{{LEAST_HEX},}}", _HEX, _any),
    )
    weak = F.concat(
        spans_of(t, IDENTIFIER, _IDENTIFIER, _any),
        spans_of(t, BARE_TOKEN, _TOKEN, _mixed),
        F.when(t.contains("://"), spans_of(t, ENDPOINT, _ENDPOINT, _any)).otherwise(F.array().cast(_SPANS)),
    )
    rows = rows.select("__row", id_col, "__text", F.array_sort(base).alias("base"), weak.alias("weak"))
    linkable = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    breaks = F.when(linkable, spans_of(t, r"\n[\x20\t\r]*\n", _BREAK, _any)).otherwise(F.array().cast(_SPANS))
    return rows.select("__row", id_col, "base", F.when(linkable, F.concat("weak", breaks)).otherwise(F.array().cast(_SPANS)).alias("weak"))


def link(candidates: DataFrame, id_col: str, reach: int = REACH) -> DataFrame:
    """Rows with candidates: ``spans`` holds the base spans and the weak ones that complementary parts confirm."""
    rows = candidates.select("__row", id_col, F.explode(F.concat("base", "weak")).alias("s"))
    rows = rows.select("__row", id_col, "s.start", "s.kind", "s.end")
    order = Window.partitionBy("__row").orderBy("start", "kind")
    scope = F.sum((F.col("kind") == _BREAK).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("scope", scope).where(F.col("kind") != _BREAK)
    inside = Window.partitionBy("__row", "scope").orderBy("start", "kind")
    before, after = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    own_end = F.col("end")

    def near(kinds: tuple[int, ...]) -> Column:
        of = F.col("kind").isin(*kinds)
        back = F.col("start") - F.max(F.when(of, own_end)).over(before)
        ahead = F.min(F.when(of, F.col("start"))).over(after) - own_end
        return F.coalesce(back <= reach, F.lit(False)) | F.coalesce(ahead <= reach, F.lit(False))

    covered = F.coalesce(F.max(F.when(F.col("kind") <= _HEX, own_end)).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(F.col("kind") <= _HEX, F.col("start"))).over(after) < own_end, F.lit(False)
    )
    identifiers, secrets = near((_ACCESS, _IDENTIFIER)), near((_ASSIGN, _HEX, _TOKEN))
    kept = (
        F.when(F.col("kind") <= _HEX, F.lit(True))
        .when(covered, F.lit(False))
        .when(F.col("kind") == _IDENTIFIER, secrets)
        .when(F.col("kind") == _TOKEN, identifiers)
        .otherwise(identifiers & secrets)
    )
    rows = rows.withColumn("__kept", kept)
    span = F.struct("start", "kind", "end")
    # collect_list skips nulls, so a document all of whose candidates fall away still has its (empty) row
    return rows.groupBy("__row").agg(
        F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.when(F.col("__kept"), span))).cast(_SPANS).alias("spans")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: id, ``base`` and ``spans`` (start, kind, end), sorted by start and then kind."""
    found = write_table(find_spans(docs, id_col, text_col), "secret-spans")
    plain = found.where(F.size("weak") == 0).select(id_col, "base", F.col("base").alias("spans"))
    linked = link(found.where(F.size("weak") > 0), id_col, reach)
    base = F.filter("spans", lambda s: s["kind"] <= _HEX)
    return plain.unionByName(linked.select(id_col, base.alias("base"), "spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
