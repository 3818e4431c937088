"""Row rules: date evidence, gated values, decisions, codebooks and governed columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(*items: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in items]))


def grade_dates(evidence: Column) -> Column:
    """Confirmed by two agreeing pieces, Probable from one, Uncertain where pieces differ, Missing without any; nulls are no evidence."""
    found = F.array_compact(evidence)
    kinds = F.size(F.array_distinct(found))
    return F.when(kinds == 0, "Missing").when(kinds > 1, "Uncertain").when(F.size(found) > 1, "Confirmed").otherwise("Probable")


def resolve_date(evidence: Column, boundary: Column) -> Column:
    """struct(date, how): one distinct date as it is; several on one side of the boundary by the earliest; several that
    straddle it are refused, as the choice would decide the side."""
    found = F.array_distinct(F.array_compact(evidence))
    low, high = F.array_min(found), F.array_max(found)
    how = F.when(F.size(found) == 0, "missing").when(F.size(found) == 1, "single").when((low < boundary) & (high >= boundary), "boundary_conflict").otherwise("earliest_of_side")
    return F.struct(F.when(how.isin("single", "earliest_of_side"), low).alias("date"), how.alias("how"))


def staged(*stages: tuple[str, Column]) -> Column:
    """struct(value, stage): the first stage that has a value, or null and "unresolved"."""
    pick = [F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("stage"))) for name, c in stages]
    return F.coalesce(*pick, F.struct(F.lit(None).alias("value"), F.lit("unresolved").alias("stage")))


def flexible_date(text: Column) -> Column:
    """"2013-05-02" or "2 May 2013" as a date; null for anything else."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(t.rlike(r"^\d{1,2} [A-Z][a-z]+ \d{4}$"), F.try_to_date(t, "d MMMM yyyy")))


def timestamp_form(text: Column) -> Column:
    """struct(kind, day): a date, fourteen digits, an ISO moment (with offset or not), or unparsed."""
    t = F.trim(text)
    kind = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(t.rlike(r"^\d{14}$"), "compact")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), "iso_offset")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"), "iso_local").otherwise("unparsed")
    )
    digits = F.when(kind == "compact", F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).when(kind != "unparsed", F.substring(t, 1, 10))
    return F.struct(kind.alias("kind"), F.try_to_date(digits, "yyyy-MM-dd").alias("day"))


def standard_name(name: Column) -> Column:
    """"SMITH, John" becomes "John Smith": parts around one comma are turned, names all in capitals are title-cased."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    turned = F.when(one.rlike(r"^[^,]+, ?[^,]+$"), F.concat_ws(" ", F.trim(F.substring_index(one, ",", -1)), F.trim(F.substring_index(one, ",", 1)))).otherwise(one)
    return F.when(turned == F.upper(turned), F.initcap(F.lower(turned))).otherwise(turned)


def gated_change(now: Column, before: Column, approved: Column, seats: Column) -> Column:
    """struct(change, status): a change of shares is given only for approved, comparable values."""
    status = (
        F.when(now.isNull(), "current_missing").when(before.isNull(), "previous_missing").when(~approved, "not_approved")
        .when(seats > 1, "not_comparable").otherwise("available")
    )
    return F.struct(F.when(status == "available", F.round(now - before, 6)).alias("change"), status.alias("status"))


def combine_decisions(*verdicts: Column) -> Column:
    """exclude if any rule excludes, review if any is unclear or unanswered, include otherwise."""
    v = F.array(*[F.coalesce(x, F.lit("unclear")) for x in verdicts])
    return F.when(F.array_contains(v, "no"), "exclude").when(F.array_contains(v, "unclear"), "review").otherwise("include")


def mapped(value: Column, table: dict[str, str], other: str) -> Column:
    """A fixed mapping table over values."""
    pick = [F.when(value == k, F.lit(v)) for k, v in table.items()]
    return F.coalesce(*pick, F.lit(other))


def formulas(df: DataFrame, rules: list[tuple[str, str, list[str]]], allowed: set[str]) -> DataFrame:
    """Adds each rule's column (name, SQL expression, the columns that it reads); rules that name a column outside ``allowed``
    or that the table lacks are refused. A null input gives a null value."""
    for name, expression, inputs in rules:
        strange = [c for c in inputs if c not in allowed or c not in df.columns]
        if strange or name in df.columns:
            raise ValueError(f"rule {name} reads or overwrites {strange or [name]}")
        known = F.lit(True)
        for c in inputs:
            known = known & F.col(c).isNotNull()
        df = df.withColumn(name, F.when(known, F.expr(expression)))
    return df


def without_outcomes(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """``df`` without the outcome columns; refuses if a column that names an outcome is left."""
    out = df.drop(*outcomes)
    left = [c for c in out.columns if any(c.lower().endswith(o.lower()) or c.lower().startswith(o.lower()) for o in outcomes)]
    if left:
        raise ValueError(f"outcome columns are left: {left}")
    return out


def permitted(df: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """The columns that a governed dictionary marks "predictor" or "key"; a column that it does not classify is refused."""
    unknown = [c for c in df.columns if c not in dictionary]
    if unknown:
        raise ValueError(f"unclassified columns: {unknown}")
    return df.select(*[c for c in df.columns if dictionary[c] in ("predictor", "key")])


def canonical_json(columns: dict[str, Column]) -> Column:
    """One JSON text of the named values by sorted names, as strings, nulls included: equal values give equal text."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}":'), quoted(columns[k])) for k in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
