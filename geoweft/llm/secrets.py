"""Secret scans: patterns of secrets, and multipart credentials whose parts are linked within a scope."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

#: Kinds in the order in which equal starts are listed; the first three are the base, the others weak candidates.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: named identifiers, words that look random, and addresses of services.
IDENTIFIER = re.compile(r"""(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.ASCII | re.IGNORECASE)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqps?)://[^\s\"'<>]{3,}", re.ASCII)
#: Strings one of which is in every text (in lower case) that the pattern can match.
ASSIGN_KEYS, IDENTIFIER_KEYS = ("passw", "secret", "token", "api_key", "apikey"), ("client_id", "clientid", "key_id", "keyid", "account_id", "accountid", "user", "login")

Span = tuple[int, int]


def within(parts: list[Span], others: list[Span], scope: int) -> list[Span]:
    """Those parts that lie at most scope characters from one of others, or overlap it: an interval join by sorted, merged scopes, without pairs."""
    merged: list[list[int]] = []
    for start, end in sorted((s - scope, e + scope) for s, e in others):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = [m[0] for m in merged]
    return [p for p in parts if (k := bisect_right(starts, p[1])) and merged[k - 1][1] >= p[0]]


def apart(parts: list[Span], taken: list[Span]) -> list[Span]:
    """Those parts that overlap none of taken."""
    near = {*within(parts, taken, -1)}
    return [p for p in parts if p not in near]


def base_spans(text: str, low: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {"assign": [], "access": [], "hex": []}
    if any(k in low for k in ASSIGN_KEYS):
        # a failing match still uses up its characters, so its length is tested only afterwards
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text)]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    return found


def mixed(word: str) -> bool:
    """Small and large letters and digits are all there, as in random keys."""
    return any(map(str.islower, word)) and any(map(str.isupper, word)) and any(map(str.isdigit, word))


def linked_spans(text: str, low: str, base: dict[str, list[Span]], scope: int) -> dict[str, list[Span]]:
    """Weak candidates with a complementary part in scope: identifiers with a secret, secrets with an identifier or endpoint, endpoints with any of them."""
    strong = base["assign"] + base["hex"]
    ids = [m.span() for m in IDENTIFIER.finditer(text)] if any(k in low for k in IDENTIFIER_KEYS) else []
    sites = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    keys = [m.span() for m in SECRET.finditer(text) if mixed(m[0])] if ids or sites or base["access"] else []
    every = strong + base["access"]
    keys = apart(keys, every + ids)
    ids, sites = apart(ids, every), apart(sites, every)
    # a word inside an address is no second part beside it
    beside = {*within(keys, ids + base["access"], scope), *within(apart(keys, sites), sites, scope)}
    out = {"identifier": within(ids, strong + keys, scope), "secret": [k for k in keys if k in beside]}
    return out | {"endpoint": within(sites, every + out["identifier"] + out["secret"], scope)}


def listed(found: dict[str, list[Span]]) -> str:
    rows = sorted((s, KINDS.index(kind), e) for kind, spans in found.items() for s, e in spans)
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in rows)


def scan(text: str, scope: int) -> tuple[int, int, int, str, str]:
    low = text.lower()
    base = base_spans(text, low)
    named = listed(base)
    return len(base["assign"]), len(base["access"]), len(base["hex"]), hashlib.sha256(named.encode()).hexdigest(), listed(base | linked_spans(text, low, base, scope))


FOUND = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per row of documents: its id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start, then kind (KINDS), in code points with the end exclusive. Base spans are the leftmost
    non-overlapping matches of each kind. Weak candidates (identifier, secret, endpoint) are added where a complementary part lies at most
    scope characters away, whatever their length; they never overlap a base span. A secret's own address (an endpoint that it stands in) is no
    complementary part. A null or empty text gives zeros and empty lists. Repeated rows stay; other
    columns are neither read nor returned; an empty table gives an empty one.
    """

    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [scan(x.as_py() or "", scope) for x in texts]
            yield pa.array([dict(zip(FOUND.names, r, strict=True)) for r in rows], to_arrow_type(FOUND))

    return documents.select(F.col(id_col), find(F.col(text_col)).alias("_f")).select(id_col, "_f.*")
