"""Text detectors and tool governance, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.gates import lowered, matches
from palisade.functions.patterns import DETECTOR_VERSIONS, DETECTORS, TOOL_CATEGORIES, TOOL_NAME_IN_TEXT, URL, URL_WITH_PARAMS, Pattern
from palisade.functions.text import first_bytes

#: Shorter user texts (in bytes) are not scanned in requests.
LEAST_BYTES = 10
MATCH_BYTES = 200
_FINDING = "struct<pattern_name:string,category:string,confidence:double,offset:int,matched_text:string>"


def truncate_match(text: Column) -> Column:
    """At most ``MATCH_BYTES`` bytes, cut on a character border, then dots."""
    return F.when(F.octet_length(text) > MATCH_BYTES, F.concat(first_bytes(text, MATCH_BYTES), F.lit("..."))).otherwise(text)


def long_enough(text: Column) -> Column:
    """Whether a request's user text is scanned at all."""
    return F.coalesce(F.octet_length(text) >= LEAST_BYTES, F.lit(False))


def _located(text: Column, named: tuple[Column, ...], first: Column) -> Column:
    return F.struct(*named, (F.instr(text, first) - 1).cast("int").alias("offset"), truncate_match(first).alias("matched_text"))


def findings(text: Column, patterns: Sequence[Pattern]) -> Column:
    """One finding for each matching pattern, with its first match; offsets count characters."""

    def found(low: Column) -> Column:
        rows = []
        for p in patterns:
            named = (F.lit(p.name).alias("pattern_name"), F.lit(p.category).alias("category"), F.lit(1.0).alias("confidence"))
            # The first match is bound, since several values are made of it.
            of = F.transform(F.array(F.regexp_substr(text, F.lit(p.regex))), partial(_located, text, named))
            rows.append(F.when(matches(text, p.regex, low), F.element_at(of, 1)))
        return F.array(*rows)

    return F.coalesce(F.filter(lowered(text, found), lambda x: x.isNotNull()), F.array().cast(f"array<{_FINDING}>"))


def names(text: Column, patterns: Sequence[Pattern]) -> Column:
    return F.filter(lowered(text, lambda low: F.array(*(F.when(matches(text, p.regex, low), F.lit(p.name)) for p in patterns))), lambda x: x.isNotNull())


def detected(text: Column, detector: str) -> Column:
    found = lowered(text, lambda low: reduce(lambda a, b: a | b, (matches(text, p.regex, low) for p in DETECTORS[detector]), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def first_category(text: Column, patterns: Sequence[Pattern]) -> Column:
    """Category of the first matching pattern in catalog order; no pattern after it is tried."""
    return F.coalesce(lowered(text, lambda low: F.coalesce(*(F.when(matches(text, p.regex, low), F.lit(p.category)) for p in patterns))), F.lit(""))


def detect(text: Column, detector: str) -> Column:
    """struct(detected, detector_type, confidence, findings)."""
    found = findings(text, DETECTORS[detector])
    any_ = F.size(found) > 0
    return F.struct(any_.alias("detected"), F.lit(detector).alias("detector_type"), F.when(any_, 1.0).otherwise(0.0).alias("confidence"), found.alias("findings"))


def signal(text: Column, detector: str) -> Column:
    """struct(detector, version, flag, score, metadata); exfiltration also tells about URLs."""
    kind = first_category(text, DETECTORS[detector])
    pairs = [F.lit("type"), kind]
    if detector == "exfiltration":
        pairs += [F.lit("url_count"), count_urls(text).cast("string"), F.lit("has_params"), has_params(text).cast("string")]
    flag = kind != ""
    return F.struct(F.lit(detector).alias("detector"), F.lit(DETECTOR_VERSIONS[detector]).alias("version"), flag.alias("flag"), F.when(flag, 1.0).otherwise(0.0).alias("score"), F.create_map(*pairs).alias("metadata"))


def count_urls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(URL)).cast("long")


def has_params(text: Column) -> Column:
    return text.rlike(URL_WITH_PARAMS)


def threat_score_pct(score: Column) -> Column:
    return F.round(score * 100).cast("long")


# --- tools ----------------------------------------------------------------------


def tool_categories(name: Column) -> Column:
    """Risk categories of a tool name: by the whole name, else by its words."""

    def of(x: Column) -> Column:
        return F.filter(F.array(*(F.when(x.rlike(c.regex), F.lit(c.name)) for c in TOOL_CATEGORIES)), lambda v: v.isNotNull())

    by_word = F.array_distinct(F.flatten(F.transform(F.split(name, "_"), of)))
    whole = of(name)
    return F.when(F.size(whole) > 0, whole).when(F.contains(name, F.lit("_")), by_word).otherwise(F.array().cast("array<string>"))


def tool_governance(tools: Column, allowed: Sequence[str] | None = None) -> Column:
    """struct(detected, unauthorized_names, categories, highest_risk_category, allowlist_mode).

    With an allowlist, whatever is not on it is flagged and there are no
    categories; otherwise risky names are flagged (the first ten are listed).
    """
    tools = F.coalesce(tools, F.array().cast("array<string>"))
    if allowed is not None:
        flagged = F.filter(tools, lambda t: ~t.isin(*allowed)) if allowed else tools
        cats, highest = F.array().cast("array<string>"), F.lit("")
    else:
        flagged = F.filter(tools, lambda t: F.size(tool_categories(t)) > 0)
        cats = F.array_sort(F.array_distinct(F.flatten(F.transform(tools, tool_categories))))
        highest = F.coalesce(*(F.when(F.array_contains(cats, c.name), F.lit(c.name)) for c in sorted(TOOL_CATEGORIES, key=lambda c: c.rank)), F.lit(""))
    return F.struct((F.size(flagged) > 0).alias("detected"), F.slice(flagged, 1, 10).alias("unauthorized_names"), cats.alias("categories"), highest.alias("highest_risk_category"), F.lit(allowed is not None).alias("allowlist_mode"))


def tools_in_text(text: Column) -> Column:
    """Tool names in text that holds tool-call JSON."""
    here = text.contains("tool_calls") | text.contains("function_call") | text.contains("tool_use")
    return F.when(here, F.regexp_extract_all(text, F.lit(TOOL_NAME_IN_TEXT), F.lit(1))).otherwise(F.array().cast("array<string>"))


def tool_text_findings(text: Column, allowed: Sequence[str] | None = None) -> Column:
    g = tool_governance(tools_in_text(text), allowed)
    category = F.when(g["allowlist_mode"], F.lit("not_in_allowlist")).otherwise(g["highest_risk_category"])
    return F.transform(g["unauthorized_names"], lambda n: F.struct(F.lit("unauthorized_tool").alias("pattern_name"), category.alias("category"), n.alias("matched_text")))


def scored(score: Column, detector: str, threshold: float = 0.5) -> Column:
    """A detection by a score of the caller's (a model's column, say), shaped as ``detect`` gives it; null scores detect nothing."""
    hit = F.coalesce(score >= threshold, F.lit(False))
    return F.struct(hit.alias("detected"), F.lit(detector).alias("detector_type"), F.coalesce(score, F.lit(0.0)).cast("double").alias("confidence"), F.array().cast(f"array<{_FINDING}>").alias("findings"))


def run_detectors(text: Column, which: Sequence[str] = tuple(DETECTORS), own: Mapping[str, Callable[[Column], Column]] | None = None) -> Column:
    """A detection for each name; ``own`` adds detectors of the caller's, functions from text to such a struct."""
    named = {d: detect(text, d) for d in which} | {d: f(text) for d, f in (own or {}).items()}
    return F.struct(*(c.alias(d) for d, c in named.items()))
