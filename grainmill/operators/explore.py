"""The query surface over findings: filters, order, pages, suggestions, search, checked batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.graphs import _cut

TEXT = ("title", "file", "rule_id", "snippet", "project_root", "language", "engine")
TIES = ("project_root", "file", "line", "rule_id", "seq")


@dataclass(frozen=True)
class FilterSpec:
    """Values of one category are alternatives; categories must all hold; an empty category holds always."""

    text: str = ""
    values: dict[str, tuple] = field(default_factory=dict)
    baseline: str = "all"
    sort: str = "file"
    descending: bool = False
    page: int = 1
    size: int = 25


def filtered(findings: DataFrame, spec: FilterSpec) -> DataFrame:
    """QS02, QS03, QS05: plain predicates, which Spark pushes to the scan."""
    out = findings
    if spec.text:
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", *[c for c in TEXT if c in findings.columns])), F.lit(spec.text.lower())))
    for column, values in sorted(spec.values.items()):
        if values:
            out = out.filter(F.col(column).isin(*values))
    if spec.baseline != "all":
        out = out.filter(F.col("state") == ("new" if spec.baseline == "new" else "unchanged"))
    return out


def ordered(rows: DataFrame, spec: FilterSpec) -> DataFrame:
    """WN09: by the chosen column, ties always ascending."""
    first = F.col(spec.sort).desc_nulls_last() if spec.descending else F.col(spec.sort).asc_nulls_last()
    return rows.orderBy(first, *[c for c in TIES if c != spec.sort])


def page(rows: DataFrame, spec: FilterSpec) -> DataFrame:
    """WN10: one page; a number out of range is moved to the nearest page. The plan takes the top rows, it doesn't sort them all."""
    rows = _cut(rows)  # counted and then read: the filters run once
    pages = -(-rows.count() // spec.size)
    at = min(max(1, spec.page), max(1, pages))
    return ordered(rows, spec).limit(at * spec.size).offset((at - 1) * spec.size)


def path_suggestions(findings: DataFrame) -> DataFrame:
    """QS06: every directory above a finding."""
    steps = F.split("file", "/")
    return findings.filter(F.size(steps) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path")).distinct()


def search(lines: DataFrame, needle: str, symbol: bool = False, most: int = 20) -> DataFrame:
    """QS09: the first hits in order of file and line: the text itself, or the whole symbol."""
    import re

    hit = F.col("text").rlike(rf"\b{re.escape(needle)}\b") if symbol else F.contains("text", F.lit(needle))
    return lines.filter(hit).orderBy("doc_id", "line").limit(most)


def check_batch(batch: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """QS08: one row: why a batch of reviews can't be taken as a whole, or null. `batch`: seq, status, confirmed; `known`: seq, level."""
    counts = batch.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"))
    strange = batch.join(known, "seq", "left_anti").agg(F.count("*").alias("unknown"))
    errors = batch.join(known.filter("level = 'error'"), "seq").agg(F.count_if((F.col("status") == "dismissed") & ~F.col("confirmed")).alias("unconfirmed"))
    row = counts.crossJoin(strange).crossJoin(errors)
    reason = F.when(F.col("n") > most, "too_many").when(F.col("d") < F.col("n"), "duplicate").when(F.col("unknown") > 0, "unknown").when(F.col("unconfirmed") > 0, "unconfirmed_error")
    return row.select("n", "unknown", reason.alias("reason"))


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """SNK04: the latest row of each key; a change with a null status deletes."""
    from grainmill.operators.windows import last_write

    return last_write(table.unionByName(changes), [key], seq).filter("status IS NOT NULL")
