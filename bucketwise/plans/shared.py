"""Several grouped queries over one table in one pass."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketwise.operators.filters import as_utc, where_all
from bucketwise.plans.spec import Compiled, Query, QuerySpec, RunContext, bucket_width, compile_query
from bucketwise.session import checkpointed

_DISTINCT = re.compile(r"\bdistinct\b", re.IGNORECASE)


def compile_together(queries: Sequence[Query], ctx: RunContext) -> list[Compiled]:
    """Like :func:`compile_query` for each of them, but queries that group one table read it once.

    They become one aggregate over grouping sets, which is combined before the shuffle and checkpointed; each query is a
    part of its rows, so what is written is as small as the charts are. A query's own conditions are one more key of
    its set. Query texts, queries that list rows or count distinct values, and queries without a
    companion are compiled by themselves, and stay lazy.
    """
    out: list[Compiled | None] = [None] * len(queries)
    groups: dict[tuple, list[int]] = {}
    for i, query in enumerate(queries):
        if isinstance(query, QuerySpec) and query.table and query.group_by and not any(
                _DISTINCT.search(m.definition) for m in query.measures):
            groups.setdefault((query.table, query.catalog, query.skip_filters), []).append(i)
    for members in groups.values():
        if len(members) > 1:
            for i, result in zip(members, _together([queries[i] for i in members], ctx), strict=True):
                out[i] = result
    return [compile_query(q, ctx) if r is None else r for q, r in zip(queries, out, strict=True)]


@dataclass
class _Terms:
    """Distinct expressions as numbered columns."""

    prefix: str
    names: dict

    def name(self, key: object) -> str:
        return self.names.setdefault(key, f"{self.prefix}{len(self.names)}")


def _together(queries: Sequence[QuerySpec], ctx: RunContext) -> list[Compiled]:
    first = queries[0]
    span = None if first.skip_filters else ctx.range
    resolved = [q.resolve(span.seconds if span else None) for q in queries]
    clauses = () if first.skip_filters else ctx.filters.clauses(ctx.ts, as_utc(ctx.now), ctx.zone)
    df = where_all(ctx.table(first.table, first.catalog), clauses)
    keys, measures, conditions = _Terms("__k", {}), _Terms("__m", {}), _Terms("__c", {})
    sets: list[tuple[str, ...]] = []
    for q in resolved:
        own = [keys.name((f.definition, f.kind, f.bucket_ms)) for f in q.group_by]
        own += [conditions.name(q.where)] if q.where else []
        sets.append(tuple(dict.fromkeys(own)))
        for m in q.measures:
            measures.name(m.definition)
    df = _with_terms(df, resolved, keys, conditions)
    distinct = list(dict.fromkeys(sets))
    every = list(dict.fromkeys(name for s in distinct for name in s))
    number = F.grouping_id(*[F.col(c) for c in every])
    # A query without measures lists its groups.
    counted = [F.expr(text).alias(name) for text, name in measures.names.items()] or [F.count(F.lit(1)).alias("__n")]
    grouped = checkpointed(df.groupingSets([[F.col(c) for c in s] for s in distinct], *[F.col(c) for c in every])
                           .agg(number.alias("__set"), *counted))
    results = []
    for q, own in zip(resolved, sets, strict=True):
        mask = sum(1 << (len(every) - 1 - k) for k, c in enumerate(every) if c not in own)
        rows = grouped.where(F.col("__set") == mask)
        if q.where:
            rows = rows.where(F.col(conditions.name(q.where)))
        results.append(Compiled(q.finished(_selected(rows, q, keys, measures)), span, bucket_width(q)))
    return results


def _with_terms(df: DataFrame, queries: Sequence[QuerySpec], keys: _Terms, conditions: _Terms) -> DataFrame:
    """The keys and conditions as columns; each time bucket in a projection of its own, as Spark resolves one at a time."""
    done = set()
    for q in queries:
        for f in q.group_by:
            name = keys.name((f.definition, f.kind, f.bucket_ms))
            if name not in done:
                df = df.withColumn(name, f.column())
                done.add(name)
        if q.where:
            name = conditions.name(q.where)
            if name not in done:
                df = df.withColumn(name, F.coalesce(F.expr(" AND ".join(f"({c})" for c in q.where)), F.lit(False)))
                done.add(name)
    return df


def _selected(rows: DataFrame, q: QuerySpec, keys: _Terms, measures: _Terms) -> DataFrame:
    named = {f.alias: F.col(keys.name((f.definition, f.kind, f.bucket_ms))) for f in q.group_by}
    columns: list[Column] = []
    for f in q.select or q.group_by:
        columns.append((named[f.alias] if f.alias in named else F.col(measures.name(f.definition))).alias(f.alias))
    return rows.select(*columns)
