"""What an ontology says, asked of its triples (subject, predicate, object): classes, datatypes, predicates, parsers; and properties that nodes are written with."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import literals as X
from geoweft.operators.triples import to_triples

# Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
PREFIXES = {
    "bot": "https://w3id.org/bot#", "dbp": "http://dbpedia.org/ontology/", "dcterms": "http://purl.org/dc/terms/", "dggs": "https://w3id.org/dggs/as", "fog": "https://w3id.org/fog#", "geo": "http://www.opengis.net/ont/geosparql#", "gom": "https://w3id.org/gom#",
    "ifc": "http://standards.buildingsmart.org/IFC/DEV/IFC2x3/TC1/OWL#", "omg": "https://w3id.org/omg#", "owl": OWL, "rdf": RDF, "rdfs": RDFS, "vann": "http://purl.org/vocab/vann/", "voaf": "http://purl.org/vocommons/voaf#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def shortened(uri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A URI as prefix:name where a namespace is known, the longest first; else as it is."""
    out = uri
    for prefix, space in sorted((prefixes or PREFIXES).items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(uri, F.lit(space)), F.concat(F.lit(f"{prefix}:"), F.substring(uri, len(space) + 1, 1 << 30))).otherwise(out)
    return out


def of_type(ontology: DataFrame, kind: str) -> DataFrame:
    """Subjects of a type."""
    return ontology.where((F.col("predicate") == f"{RDF}type") & (F.col("object") == kind)).select("subject").distinct()


def classes(ontology: DataFrame) -> DataFrame:
    return of_type(ontology, f"{OWL}Class")


def datatype_properties(ontology: DataFrame) -> DataFrame:
    return of_type(ontology, f"{OWL}DatatypeProperty")


def datatype_methods(ontology: DataFrame, method: str) -> DataFrame:
    """datatype and the name of the method that reads it, told by the predicate method."""
    told = ontology.where(F.col("predicate") == method).select(F.col("subject").alias("datatype"), F.col("object").alias("method"))
    return told.join(of_type(ontology, f"{RDFS}Datatype").withColumnRenamed("subject", "datatype"), "datatype", "left_semi")


def node_types(names: DataFrame, ontology: DataFrame) -> DataFrame:
    """Names (name) with the class whose last part equals it: name, type; null for none, the smallest of several."""
    known = classes(ontology).groupBy(X.subject_name(F.col("subject")).alias("name")).agg(F.min("subject").alias("type"))
    return names.join(known, "name", "left").select("name", "type")


def extensions(ontology: DataFrame, predicate: str = f"{PREFIXES['dbp']}extension") -> DataFrame:
    """Classes with the file types of their resources: type, extension."""
    return ontology.where(F.col("predicate") == predicate).select(F.col("subject").alias("type"), F.col("object").alias("extension")).distinct()


def attribute_predicates(names: DataFrame, ontology: DataFrame, namespace: str) -> DataFrame:
    """Attribute names (name) with predicate and datatype: the property whose last part equals it and its range, else the name in the namespace and null."""
    ranges = ontology.where(F.col("predicate") == f"{RDFS}range").groupBy(X.subject_name(F.col("subject")).alias("name")).agg(F.min(F.struct("subject", "object")).alias("_p"))
    found = names.join(ranges, "name", "left")
    return found.select("name", F.coalesce("_p.subject", F.concat(F.lit(namespace), F.col("name"))).alias("predicate"), F.col("_p.object").alias("datatype"))


def subclass_for(names: DataFrame, ontology: DataFrame, parent: str) -> DataFrame:
    """Names with the first direct subclass of the parent whose URI has the name in it, in either case: name, type; the parent for none."""
    children = ontology.where((F.col("predicate") == f"{RDFS}subClassOf") & (F.col("object") == parent)).select(F.col("subject").alias("_child")).distinct()
    # the direct subclasses of one class are few and written by hand; they stand in one row
    gathered = children.agg(F.array_sort(F.collect_list("_child")).alias("_children"))
    first = F.get(F.filter(F.col("_children"), lambda c: F.contains(F.lower(c), F.lower(F.col("name")))), F.lit(0))
    return names.join(F.broadcast(gathered)).select("name", F.coalesce(first, F.lit(parent)).alias("type"))


# parsers and properties

#: What reads the text of a datatype, by its last part; all else stays text.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "integer": X.to_long,
    "int": X.to_long,
    "long": X.to_long,
    "float": X.to_double,
    "double": X.to_double,
    "decimal": X.to_double,
    "boolean": lambda x: x.try_cast("boolean"),
    "dateTime": X.to_datetime,
    "matrix": X.to_matrix,
    "list": X.to_list,
}


def parsed(triples: DataFrame, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Triples with a struct value of a field for each parser, filled where the datatype's last part is its name: each object is read once, by static columns, nothing is imported from data."""
    own = PARSERS | (parsers or {})
    kind = X.subject_name(F.col("datatype"))
    return triples.withColumn("value", F.struct(*(F.when(kind == name, read(F.col("object"))).alias(name) for name, read in own.items())))


@dataclass(frozen=True)
class Property:
    """How an attribute is written: its predicate, datatype, and what makes text of it."""

    attribute: str
    predicate: str
    datatype: str = "string"
    serializer: Callable[[Column], Column] | None = None


def written(nodes: DataFrame, properties: Iterable[Property], extra: dict[str, str] | None = None, subject: str = "subject") -> DataFrame:
    """Triples of nodes by properties, and of the extra columns (column: predicate) of this export alone. Attributes that nodes haven't are passed over."""
    chosen = [p for p in properties if p.attribute in nodes.columns]
    made = nodes.withColumns({p.attribute: p.serializer(F.col(p.attribute)) for p in chosen if p.serializer})
    out = to_triples(made, {p.attribute: p.predicate for p in chosen} | (extra or {}), subject)
    for p in chosen:
        out = out.withColumn("datatype", F.when(F.col("predicate") == p.predicate, p.datatype).otherwise(F.col("datatype")))
    return out


def with_constants(rows: DataFrame, **values) -> DataFrame:
    """Rows with the same value of each name in all of them, as a reader's extra arguments."""
    return rows.withColumns({k: F.lit(v) for k, v in values.items()}) if values else rows
