"""Personal-data scanning: counts on the original text, and sequential redaction."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.gates import gate, lowered, matches
from palisade.functions.patterns import PII, PII_PRESETS, PiiPattern

#: Shorter texts (in bytes) are not scanned.
LEAST_BYTES = 5
FINDING = "struct<pattern:string,redacted_to:string,count:int,location:string>"


def catalog(enabled: Sequence[str] = (), custom: Sequence[tuple[str, str, str]] = (), spark: SparkSession | None = None) -> tuple[PiiPattern, ...]:
    """Enabled patterns in scan order (none named: all), then custom (name, regex, token) ones.

    Custom patterns that do not compile (in the JVM where a session is given) are left out.
    """
    chosen = [p for p in PII if not enabled or p.name in enabled]
    for name, regex, token in custom:
        try:
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
            else:
                re.compile(regex)
        except Exception:  # noqa: BLE001  py4j and re raise their own kinds
            continue
        chosen.append(PiiPattern(name, regex, token))
    return tuple(chosen)


def preset(name: str) -> tuple[PiiPattern, ...]:
    return catalog(PII_PRESETS[name])


def has_pii(text: Column, patterns: Sequence[PiiPattern] = PII) -> Column:
    found = lowered(text, lambda low: reduce(lambda a, b: a | b, (matches(text, p.regex, low) for p in patterns), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def pattern_names(text: Column, patterns: Sequence[PiiPattern] = PII) -> Column:
    """Names of the patterns that match, in scan order."""
    hits = lowered(text, lambda low: F.array(*(F.when(matches(text, p.regex, low), F.lit(p.name)) for p in patterns)))
    return F.when(F.octet_length(text) >= LEAST_BYTES, F.filter(hits, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan_only(text: Column, location: str, patterns: Sequence[PiiPattern] = PII) -> Column:
    """Findings by count, most first (ties in scan order), all counted on the original text."""

    def counts(low: Column) -> Column:
        rows = []
        for i, p in enumerate(patterns):
            need, n = gate(low, p.regex), F.regexp_count(text, F.lit(p.regex))
            rows.append(F.struct((-(n if need is None else F.when(need, n).otherwise(0))).alias("k"), F.lit(i).alias("i"), F.lit(p.name).alias("pattern"), F.lit(p.token).alias("redacted_to")))
        return F.array(*rows)

    ordered = F.array_sort(F.filter(lowered(text, counts), lambda x: x["k"] < 0))
    findings = F.transform(ordered, lambda x: F.struct(x["pattern"], x["redacted_to"], (-x["k"]).cast("int").alias("count"), F.lit(location).alias("location")))
    return F.when(F.octet_length(text) >= LEAST_BYTES, findings).otherwise(F.array().cast(f"array<{FINDING}>"))


def _occurrences(text: Column, token: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)


def scan_and_redact(df: DataFrame, text: str, location: str, patterns: Sequence[PiiPattern] = PII, redacted: str = "redacted_text", findings: str = "findings") -> DataFrame:
    """Adds the text with matches replaced, pattern after pattern, and what each replaced.

    Patterns are chosen by the original text and replace in the running one, so an
    earlier pattern can use up what a later one would match.  A count is the growth
    in occurrences of the token, one at least where the text changed.
    """
    out = df.withColumns({"_r0": F.col(text), "_low": F.lower(text)})
    for i, p in enumerate(patterns):
        quoted = p.token.replace("\\", "\\\\").replace("$", "\\$")
        here = (F.octet_length(text) >= LEAST_BYTES) & matches(F.col(text), p.regex, F.col("_low"))
        out = out.withColumn(f"_r{i + 1}", F.when(here, F.regexp_replace(F.col(f"_r{i}"), p.regex, quoted)).otherwise(F.col(f"_r{i}")))
    rows = []
    for i, p in enumerate(patterns):
        a, b = F.col(f"_r{i}"), F.col(f"_r{i + 1}")
        grown = F.greatest(F.lit(1), (_occurrences(b, p.token) - _occurrences(a, p.token)).cast("int"))
        rows.append(F.when(a != b, F.struct(F.lit(p.name).alias("pattern"), F.lit(p.token).alias("redacted_to"), grown.alias("count"), F.lit(location).alias("location"))))
    out = out.withColumn(findings, F.filter(F.array(*rows), lambda x: x.isNotNull())).withColumn(redacted, F.col(f"_r{len(patterns)}"))
    return out.drop("_low", *(f"_r{i}" for i in range(len(patterns) + 1)))


#: A string value of a content or text field, with what is before it; the value ends before its closing quote.
_VALUE = r'(?s)"(?:content|text)": ?"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_HEAD = r'^"(?:content|text)": ?"'


def redact_text(text: Column, patterns: Sequence[PiiPattern] = PII) -> Column:
    """The text with matches replaced, pattern after pattern; patterns are chosen by the original text.

    A pattern's step is a fold over one value, so each is applied to the running
    text once and nothing is computed twice.
    """

    def of(low: Column) -> Column:
        out = text
        for p in patterns:
            quoted = p.token.replace("\\", "\\\\").replace("$", "\\$")
            out = F.element_at(F.transform(F.array(out), partial(_replaced, text, low, p.regex, quoted)), 1)
        return out

    return lowered(text, of)


def _replaced(text: Column, low: Column, regex: str, token: str, running: Column) -> Column:
    return F.when(matches(text, regex, low), F.regexp_replace(running, regex, token)).otherwise(running)


def redact_response(body: Column, patterns: Sequence[PiiPattern] = PII) -> Column:
    """A raw response body with the values of its content and text fields redacted.

    Fields are found in the bytes as they are, valid JSON or not; empty values and
    values under 7 bytes stay.  A body without such a field is redacted as a whole.
    The body is cut into fields and what lies between, and put together again.
    """

    def field(one: Column) -> Column:
        head = F.regexp_substr(one, F.lit(_HEAD))
        value = F.substring(one, F.length(head) + 1, F.length(one) - F.length(head) - 1)
        return F.when(F.octet_length(value) < 7, one).otherwise(F.concat(head, redact_text(value, patterns), F.lit('"')))

    between = F.split(body, _VALUE, -1)
    fields = F.transform(F.regexp_extract_all(body, F.lit(_VALUE), F.lit(0)), field)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("a"), fields.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    whole = F.when(F.octet_length(body) >= LEAST_BYTES, redact_text(body, patterns)).otherwise(body)
    return F.when(body.rlike(_VALUE), joined).otherwise(whole)


def scan_bytes(raw: Column, location: str, patterns: Sequence[PiiPattern] = PII) -> Column:
    """Findings of binary data; data that is not UTF-8 has none."""
    return F.coalesce(scan_only(F.try_validate_utf8(raw.cast("string")), location, patterns), F.array().cast(f"array<{FINDING}>"))
