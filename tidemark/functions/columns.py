"""Column functions: tolerant casts, ratios, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bool(c: Column) -> Column:
    """True for 1, true, yes and y in any case and padding; false for all else, null included."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def strict_bool(c: Column) -> Column:
    """True only for the text true."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def bool_text(c: Column) -> Column:
    return F.when(parse_bool(c), "true").otherwise("false")


def numeric(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(float(default)))


def rounded(c: Column, places: int) -> Column:
    """A double to so many places, half away from zero, as SQL engines do it in floating point; Spark's own round takes the printed digits.

    -0.5330078125 printed is -533007812.49999994 billionths, and so -0.533007812.  Zeros keep their sign.
    """
    ten = float(10**places)
    out = F.round(c * ten) / ten
    return F.when(F.abs(out) < float("inf"), F.when(out == 0, c * 0.0).otherwise(out)).otherwise(c)


def nonblank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def either(a: Column, b: Column) -> Column:
    """a unless it is null or blank, then b."""
    return F.when(nonblank(a), a).otherwise(b)


def clean(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def integer_text(c: Column) -> Column:
    """The integer that a decimal text denotes, null for blanks and for fractions."""
    d = F.trim(c).try_cast("decimal(38,10)")
    return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string"))


def rounded_integer_text(c: Column) -> Column:
    """Half-up rounding of a decimal text to an integer; null for blanks, NaN and infinities."""
    return F.round(F.trim(c).try_cast("decimal(38,10)"), 0).cast("decimal(38,0)").cast("string")


def percent(part: Column, whole: Column, digits: int = 3, empty: float | None = 0.0) -> Column:
    """100 * part / whole rounded; `empty` where whole is 0."""
    value = F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    return F.try_divide(shared.cast("double"), (left + right - shared).cast("double"))


def density(edges: Column, nodes: Column) -> Column:
    return F.try_divide(edges.cast("double"), (nodes * (nodes - 1) / 2).cast("double"))


def slug(c: Column, most: int | None = None) -> Column:
    """Upper-cased, other runs than A-Z and 0-9 become one underscore, none at the ends."""
    made = F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return made if most is None else F.substring(made, 1, most)


def short_hash(c: Column, length: int = 14) -> Column:
    return F.upper(F.substring(F.sha1(c), 1, length))


def span_key(span: Column) -> Column:
    """What tells spans apart: words only, lower case."""
    return F.trim(F.lower(F.regexp_replace(span, r"(?U)[^\w]+", " ")))


def mention_id(article_id: Column, span: Column) -> Column:
    return F.concat(F.lit("EVT_"), short_hash(F.concat(article_id.cast("string"), F.lit("\n"), span_key(span))))


def canonical_id(members: Column) -> Column:
    """The id of a set of mention ids, whatever their order and repeats."""
    return F.concat(F.lit("CEVT_"), short_hash(F.array_join(F.array_sort(F.array_distinct(members)), "|")))


def market_link_id(event_id: Column, company_id: Column) -> Column:
    return F.concat(F.lit("EML_"), short_hash(F.concat_ws("|", event_id.cast("string"), company_id.cast("string"))))


def observation_id(link_id: Column, window: Column) -> Column:
    return F.concat_ws("-", link_id, window.cast("string"))


def dimension_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), slug(name, 48), F.lit("_"), short_hash(F.lower(name), 8))


def cache_key(model: Column, task: Column, text: Column, labels: Column, template: Column) -> Column:
    """A prediction's identity: SHA-256 of its inputs as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(labels.alias("labels"), model.alias("model"), task.alias("task"), template.alias("template"), text.alias("text"))), 256)


def parse_list(c: Column) -> Column:
    """The texts of a JSON list; empty for anything else; blanks dropped."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: nonblank(x))


def sorted_json(c: Column) -> Column:
    """A map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def scalar_kind(c: Column) -> Column:
    """What a text stands for: null, boolean, integer, number, json or text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    return (
        F.when(low.isin("", "null", "none", "nan"), "null")
        .when(low.isin("true", "false"), "boolean")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .when(t.rlike(r"^-?(0|[1-9]\d*)$"), "integer")
        .when(t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), "number")
        .otherwise("text")
    )


def typed_json(c: Column) -> Column:
    """The value that a text stands for, as JSON: null, boolean, number, list or object, else the text itself.

    Scalars within lists and objects are taken in the same way; JSON inside a nested text is not opened.
    """
    t, kind = F.trim(F.coalesce(c, F.lit(""))), scalar_kind(c)
    nested = F.to_json(F.try_parse_json(t))
    value = lambda pattern: rf'(?<=[:\[,])"\s*{pattern}\s*"(?=[,\]}}])'  # noqa: E731  a text that is no key
    for _ in range(2):  # neighbours in a list share a comma
        nested = F.regexp_replace(nested, value(r"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)"), "$1")
        for word in ("true", "false"):
            nested = F.regexp_replace(nested, "(?i)" + value(word), word)
        nested = F.regexp_replace(nested, "(?i)" + value("(?:null|none|nan)?"), "null")
    plain = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.when(kind == "null", "null").when(kind == "boolean", F.lower(t)).when(kind == "json", nested).when(kind.isin("integer", "number"), t).otherwise(plain)


def average_rank(over_value: Column, partition: list[str] | None = None, descending: bool = False) -> Column:
    """Mid-rank: ties share the mean of their places."""
    from pyspark.sql import Window as W

    by = W.partitionBy(*(partition or []))
    ordered = by.orderBy(over_value.desc() if descending else over_value.asc())
    ties = W.partitionBy(*(partition or []), over_value)
    return (F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2).cast("double")


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null with fewer than two rows or no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-15, spread)))
