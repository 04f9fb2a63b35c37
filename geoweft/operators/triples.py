"""Linked data: rows to triples and back, set operations on graphs, and basic graph patterns as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPO = ["subject", "predicate", "object"]


def to_triples(nodes: DataFrame, predicates: dict[str, str], subject: str = "subject") -> DataFrame:
    """A triple for each value that isn't null; predicates maps columns to predicates. One pass, without a union per column; arrays give a triple for each item."""
    kinds = dict(nodes.dtypes)
    pairs = []
    for column, predicate in predicates.items():
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column))
        pairs.append(F.struct(F.lit(predicate).alias("predicate"), values.cast("array<string>").alias("objects"), F.lit(xsd(kinds[column])).alias("datatype")))
    rows = nodes.select(F.col(subject).alias("subject"), F.explode(F.array(*pairs)).alias("p"))
    return rows.select("subject", "p.predicate", F.explode("p.objects").alias("object"), "p.datatype").where("object IS NOT NULL")


def with_members(own: DataFrame, members: DataFrame, part: str = "hasPart", inner: DataFrame | None = None) -> DataFrame:
    """Triples of sets with a triple for each of their members (parent, child), and the members' own triples (inner) if they are to be written too."""
    links = members.select(F.col("parent").alias("subject"), F.lit(part).alias("predicate"), F.col("child").alias("object"))
    out = own.select(*SPO).union(links)
    return out if inner is None else out.union(inner.select(*SPO).join(members.select(F.col("child").alias("subject")).distinct(), "subject", "left_semi")).distinct()


def xsd(kind: str) -> str:
    inner = kind.removeprefix("array<").removesuffix(">")
    return {"int": "integer", "bigint": "integer", "double": "float", "float": "float", "timestamp": "dateTime", "boolean": "boolean"}.get(inner, "string")


def from_triples(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """A row per subject with a column for each predicate: the smallest object, one pass of conditional aggregates."""
    return triples.groupBy("subject").agg(*(F.min(F.when(F.col("predicate") == predicate, F.col("object"))).alias(column) for column, predicate in predicates.items()))


def graph_intersection(graphs: Sequence[DataFrame], type_predicate: str = "type") -> DataFrame:
    """All triples, in any graph, of the subjects whose type is stated in every one."""
    common = reduce(lambda a, b: a.intersect(b), (g.where(F.col("predicate") == type_predicate).select(*SPO) for g in graphs)).select("subject").distinct()
    return reduce(lambda a, b: a.union(b), (g.select(*SPO) for g in graphs)).distinct().join(common, "subject", "left_semi")


def match(triples: DataFrame, patterns: Sequence[tuple[str, str, str]], optional: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Solutions of a basic graph pattern: terms that begin with ? are variables. Each pattern is a filtered scan, shared variables are join keys, optional ones join left."""

    def scan(pattern: tuple[str, str, str]) -> DataFrame:
        rows, columns, seen = triples, [], {}
        for place, term in zip(SPO, pattern, strict=True):
            if not term.startswith("?"):
                rows = rows.where(F.col(place) == term)
            elif term in seen:
                rows = rows.where(F.col(place) == F.col(seen[term]))
            else:
                seen[term] = place
                columns.append(F.col(place).alias(term[1:]))
        return rows.select(*columns)

    out = None
    for how, group in (("inner", patterns), ("left", optional)):
        for pattern in group:
            part = scan(pattern)
            if out is None:
                out = part
            else:
                shared = [c for c in part.columns if c in out.columns]
                if not shared:
                    raise ValueError(f"the pattern {pattern} shares no variable with those before it")
                out = out.join(part, shared, how)
    return out


def subject_graph(triples: DataFrame, subject: str) -> DataFrame:
    return triples.where(F.col("subject") == subject)


def has_subject(triples: DataFrame, name: str) -> DataFrame:
    """One row, found: whether a subject's last path segment is the name."""
    return triples.agg(F.coalesce(F.max(F.regexp_extract("subject", r"([^/#]*)$", 1) == name), F.lit(False)).alias("found"))
