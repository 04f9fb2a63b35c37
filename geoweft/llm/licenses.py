"""License scans: ordered signature rules, gated by keywords, whose overlaps priority and containment resolve. DataFrame functions only.

A text becomes its words between single spaces, so rules are patterns over words and a match's place is the number of spaces before it.
Every row is scanned by itself; nothing is exploded, shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.license_rules import GATES, RULES

#: What stands between words: ASCII but for letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base: phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


#: Of rules, the highest first.
PRIORITIES = (4, 3, 2, 1)


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression over words with single spaces; keywords: strings that are all in every text it matches."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def rules() -> list[Rule]:
    """The rules of license_rules, in order."""
    out = []
    for line in RULES.strip().splitlines():
        head, _, pattern = line.partition(": ")
        label, priority, weight, keywords = head.split(" ", 3)
        out.append(Rule(label, pattern, tuple(keywords.split("+")), int(priority), float(weight)))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, although use names it often."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def places(words: Column, pattern: Column) -> Column:
    """Array of structs start, stop: the word numbers of every match of pattern, stop exclusive. words: " a b ... z "."""
    marked = F.split(F.trim(F.regexp_replace(words, F.concat(F.lit("(?i) ("), pattern, F.lit(")(?= )")), F.lit(" \x01$1\x02"))), " ")

    def paired(w: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(w) - 1)
        starts = F.filter(numbers, lambda k: F.startswith(F.get(w, k), F.lit("\x01")))
        ends = F.filter(numbers, lambda k: F.endswith(F.get(w, k), F.lit("\x02")))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    return let(marked, paired)


def distinct_labels(items: Column, start: Column) -> Column:
    """start and the labels of items, each once: a fold whose state has as many entries as there are labels."""
    return F.aggregate(items, start, lambda state, x: F.when(F.array_contains(state, x["label"]), state).otherwise(F.concat(state, F.array(x["label"]))))


def _table(items: list[Rule]) -> Column:
    """The rules as one constant array, which Spark's optimizer folds."""

    def quoted(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = (f"named_struct('label', {quoted(r.label)}, 'pattern', {quoted(r.pattern)}, 'keywords', array({', '.join(map(quoted, r.keywords))}), 'priority', {r.priority}, 'weight', {r.weight}D)" for r in items)
    return F.expr(f"array({', '.join(rows)})")


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Rule] | None = None) -> DataFrame:
    """One row per row of documents: its id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of letters, digits and all characters beyond ASCII; capital A-Z count as small. The base are all places of its phrases:
    n_base their number, first_word and last_word their smallest and largest start (null without any). Rules (hundreds, in order) run
    only where their keywords are. Of the detections sorted by start, then the longer, the higher priority and the earlier rule, one is
    suppressed if a kept or suppressed one before it of no lower priority reaches as far. labels has the labels of both, base_labels those of
    the base; distinct, sorted, comma-joined. score is the largest weight of a detection (1 for the base), 0 without any.
    A null or empty text has 0 words and no labels. Repeated rows stay; other columns are neither read nor returned; an empty table gives an empty one.
    """
    table = _table(rules() + (extra or []))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), GAP, " ").alias("words"))
    rows = rows.withColumn("n_words", F.greatest(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long"))
    rows = rows.withColumn("low", F.lower("words"))
    low = F.col("low")
    base_test = low.contains(BASE[0][0]) | low.contains(BASE[1][0]) | low.contains(BASE[2][0])
    none = F.array().cast("array<struct<start:int,stop:int,label:string>>")

    def based(phrase: str, label: str) -> Column:
        return F.transform(places(F.col("words"), F.lit(phrase)), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.lit(label).alias("label")))

    found = F.flatten(F.array(*(based(*x) for x in BASE)))
    gate = F.lit(False)
    for key in GATES:
        gate |= low.contains(key)
    rows = rows.withColumn("base", F.when(base_test, found).otherwise(none)).withColumn("gated", gate)
    ready = F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.contains(F.col("low"), k)))
    hits = F.flatten(F.transform(ready, lambda r: F.transform(places(F.col("words"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["weight"].alias("weight")))))
    rows = rows.withColumn("hits", F.when(F.col("gated"), F.array_sort(hits)).otherwise(F.array().cast("array<struct<start:int,back:int,rank:int,label:string,weight:double>>")))
    # the furthest stop so far of each priority; a detection is kept unless one of its own or a higher priority reached as far
    start = F.struct(*(F.lit(-1).alias(f"r{k}") for k in PRIORITIES), F.array().cast("array<struct<start:int,stop:int,label:string,weight:double>>").alias("kept"))

    def step(state: Column, h: Column) -> Column:
        stop = -h["back"]
        reach = F.lit(-1)
        for k in PRIORITIES:
            reach = F.when(-h["rank"] <= k, F.greatest(reach, state[f"r{k}"])).otherwise(reach)
        kept = F.when(reach >= stop, state["kept"]).otherwise(F.concat(state["kept"], F.array(F.struct(h["start"].alias("start"), stop.alias("stop"), h["label"].alias("label"), h["weight"].alias("weight")))))
        return F.struct(*(F.when(h["rank"] == -k, F.greatest(state[f"r{k}"], stop)).otherwise(state[f"r{k}"]).alias(f"r{k}") for k in PRIORITIES), kept.alias("kept"))

    rows = rows.withColumn("detections", F.when(F.size("hits") > 0, F.aggregate("hits", start, step, lambda s: s["kept"])).otherwise(F.array().cast("array<struct<start:int,stop:int,label:string,weight:double>>")))
    rows = rows.withColumn("base_set", distinct_labels(F.col("base"), F.array().cast("array<string>")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort(distinct_labels(F.col("detections"), F.col("base_set"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).when(F.size("detections") > 0, F.array_max(F.transform("detections", lambda d: d["weight"]))).otherwise(0.0).alias("score"),
        "detections",
    )
