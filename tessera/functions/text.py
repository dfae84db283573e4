"""Text and path expressions of the ingest workload."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

DEFAULT_WINDOW, DEFAULT_OVERLAP = 1000, 200

# First path part, artifact type.
TYPE_OF_ROOT = {"docs": "doc", "tests": "test", "src": "code", ".codacy": "config"}
# Artifact type, node label.
LABEL_OF_TYPE = {"doc": "DesignDoc", "code": "SourceFile", "proto": "SourceFile", "test": "TestCase", "config": "ConfigFile"}
# Suffixes of document files.
DOCUMENT_SUFFIXES = (".md", ".docx", ".txt", ".doc", ".pdf")
# Fixed value: any character but white space, separators and the information separators.
NOT_BLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"


def mapped(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    """``values`` applied to a column."""
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def artifact_type(path: Column) -> Column:
    """Type by the first path part; generated sources are ``proto``."""
    parts = F.split(path, "/")
    plain = mapped(parts[0], TYPE_OF_ROOT, "other")
    return F.when((parts[0] == "src") & F.array_contains(parts, "_generated"), "proto").otherwise(plain)


def node_label(kind: Column) -> Column:
    """Graph label of an artifact type; labels pass through."""
    labels = sorted({*LABEL_OF_TYPE.values(), "Artifact"})
    return F.when(kind.isin(labels), kind).otherwise(mapped(kind, LABEL_OF_TYPE, "Artifact"))


def infer_subsystem(path: Column, prefixes: list[str]) -> Column:
    """Part after the longest source prefix that the path begins with, part by part."""
    parts = F.split(path, "/")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix in sorted({p.strip("/") for p in prefixes}, key=lambda p: (-p.count("/"), p)):
        n = prefix.count("/") + 1
        hit = (path == prefix) | path.startswith(prefix + "/")
        out = out.when(hit, F.coalesce(F.get(parts, F.lit(n)), F.lit(prefix.rpartition("/")[2])))
    return out.when((parts[0] == "src") & (F.size(parts) > 1), parts[1])


def normalise_name(name: Column) -> Column:
    """Trimmed; capitalised where all its letters are lower-case; null where blank."""

    def cased(t: Column) -> Column:
        lower = (F.lower(t) == t) & t.rlike(r"\p{L}")
        return F.when(t == "", None).when(lower, F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))).otherwise(t)

    # The lambda binds the trimmed text once, where a plain expression would repeat it.
    text = F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.get(F.transform(F.array(text), cased), F.lit(0))


def namespace(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((parts[0] == "src") & (F.size(parts) > 1), parts[1]).otherwise(parts[0])


def extract_entities(content: Column, pattern: str) -> Column:
    """Sorted distinct matches; word characters are Unicode ones."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit("(?U)" + pattern), F.lit(0))))


def message_entities(content: Column) -> Column:
    return extract_entities(content, r"[A-Z]\w*Message")


def telemetry_signals(content: Column) -> Column:
    return extract_entities(content, r"Telemetry\w+")


def build_tags(*lists: Column) -> Column:
    """Trimmed, distinct, sorted union of string lists, any of which may be null."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*(F.coalesce(x, empty) for x in lists))
    return F.array_sort(F.array_distinct(F.filter(F.transform(joined, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_BLANK)


def step_of(window: int, overlap: int) -> int:
    if window <= 0 or overlap < 0:
        raise ValueError("window must be positive and overlap not negative")
    return window - overlap if window > overlap else window


def estimate_chunks(text: Column, window: int = DEFAULT_WINDOW, overlap: int = DEFAULT_OVERLAP) -> Column:
    """0 for an empty text, else its length over the step, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / step_of(window, overlap)).cast("int")


def windows(text: Column, window: int, step: int) -> Column:
    """Parts of ``window`` characters (code points) that begin at every ``step``-th one, the last ones shorter.

    One walk cuts the text into steps; a window is its step and the beginning of those that follow, so the
    time is in proportion to the text.
    """
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = window - step
    if more <= 0:
        return F.transform(steps, lambda s: F.left(s, F.lit(window)))

    def joined(parts: Column) -> Column:
        following = lambda i: F.array_join(F.slice(parts, i + 2, F.lit(-(-more // step))), "")
        return F.transform(parts, lambda s, i: F.concat(s, F.left(following(i), F.lit(more))))

    # The lambda binds the steps once, where a plain expression would cut the text for each window.
    return F.get(F.transform(F.array(steps), joined), F.lit(0))


def point_id(digest: Column) -> Column:
    """The first 32 hex digits as a UUID."""
    return F.regexp_replace(F.substring(digest, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def lexical_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def query_tokens(query: Column) -> Column:
    """Tokens for the affinity to subsystems; an underscore splits here."""
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-zA-Z0-9]+"), lambda x: x != ""))


@F.pandas_udf(LongType())
def _code_points(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: int(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").sum(dtype="int64")) if t else 0)


def hash_embed(text: Column, dims: int = 8) -> Column:
    """Deterministic vector: the sum of code points (or 1) modulo 2, 3, ..."""
    seed = F.greatest(_code_points(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.array(*((seed % (i + 2)) / F.lit(i + 2) for i in range(dims)))


@F.pandas_udf(StringType())
def _ascii_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() if t else "")


def slug(text: Column, fallback: str = "document") -> Column:
    folded = F.regexp_replace(F.lower(_ascii_fold(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(folded, F.lit("-")), F.lit("")), F.lit(fallback))


def is_document_file(path: Column, target: str | None = None) -> Column:
    """Document suffix in any case, outside the target folder."""
    ok = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*DOCUMENT_SUFFIXES)
    return ok if target is None else ok & (F.split(path, "/")[0] != target)
