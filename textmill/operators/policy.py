"""Which requests and documents are optimized: rules in order, the first that decides wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BODY, MAX_DOCUMENT = 8_000_000, 16_000_000
#: Endpoints by provider: prefixes that are denied first, then what is allowed, whole, by prefix or by suffix. Fixed values.
OPENAI = {
    "denied": ("files", "uploads", "audio/", "images/", "fine_tuning/", "batches", "embeddings", "moderations"),
    "whole": ("chat/completions", "responses", "assistants"),
    "prefixes": ("threads/",),
    "suffixes": (),
}
ANTHROPIC = {"denied": ("v1/files", "v1/models", "v1/messages/batches"), "whole": (), "prefixes": (), "suffixes": ("messages",)}
COMPATIBLE = {"denied": (), "whole": ("chat/completions",), "prefixes": (), "suffixes": ()}
ENDPOINTS = {"openai": OPENAI, "anthropic": ANTHROPIC, "groq": COMPATIBLE, "mistral": COMPATIBLE, "ollama": COMPATIBLE}


def path_of(c: Column) -> Column:
    p = F.lower(F.regexp_replace(c, "^/+|/+$", ""))
    return F.regexp_replace(p, "^v1/", "")


def permits(path: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    bare, p = F.lower(F.regexp_replace(path, "^/+|/+$", "")), path_of(path)
    denied, allowed = F.lit(False), p.isin(*rules["whole"]) if rules["whole"] else F.lit(False)
    for d in rules["denied"]:
        denied |= p.startswith(d) | bare.startswith(d)
    for a in rules["prefixes"]:
        allowed |= p.startswith(a)
    for x in rules["suffixes"]:
        allowed |= p.endswith(x)
    return ~denied & allowed


def endpoint_permits(path: Column, provider: Column | None = None) -> Column:
    """Whether a provider's endpoint carries prose; without a provider, whether any of them permits it and none denies it."""
    if provider is None:
        every = {k: tuple(dict.fromkeys(x for r in (OPENAI, ANTHROPIC, COMPATIBLE) for x in r[k])) for k in OPENAI}
        return permits(path, every)
    out = F.lit(False)
    for name, rules in ENDPOINTS.items():
        out = F.when(F.lower(provider) == name, permits(path, rules)).otherwise(out)
    return out


def route_adapter(path: Column) -> Column:
    """The payload shape of a path: first match wins, null where none fits."""
    p = path_of(path)
    return (
        F.when(p == "chat/completions", "chat").when(p == "responses", "responses").when((p == "assistants") | p.startswith("threads/"), "assistants")
        .when(p.endswith("messages") & ~F.contains(p, F.lit("batches")), "messages")
    )


def policy_decide(requests: DataFrame, enabled: bool = True, max_body: int = MAX_BODY) -> DataFrame:
    """requests (method, path, content_type, body and, for its own endpoints, provider) with skip_reason (null: go on) and optimize."""
    permitted = endpoint_permits(F.col("path"), F.col("provider") if "provider" in requests.columns else None)
    size = F.octet_length("body")
    essence = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
    reason = (
        F.when(F.lit(not enabled), "optimization_disabled").when(F.upper("method") != "POST", "method_not_eligible").when(F.coalesce(size, F.lit(0)) == 0, "empty_body")
        .when(size > max_body, "body_too_large").when(essence != "application/json", "content_type_not_eligible").when(~permitted, "endpoint_not_eligible")
    )
    return requests.withColumn("skip_reason", reason).withColumn("optimize", F.col("skip_reason").isNull())


def document_eligibility(docs: DataFrame, enabled: bool = True, limit: int = MAX_DOCUMENT, disabled: tuple[str, ...] = ()) -> DataFrame:
    """docs (data, format) with detail: null where the document can be extracted."""
    n = F.coalesce(F.octet_length("data"), F.lit(0))
    readable = F.col("format").isin("text", "markdown", "csv", "html", "xml")
    detail = F.when(F.lit(not enabled) | (n == 0), "disabled_or_empty").when(n > limit, "over_size_limit").when(F.col("format").isin("unknown", *disabled), "unsupported_format").when(~readable, "no_extractor")
    return docs.withColumn("detail", detail)


def auth_kind(headers: Column) -> Column:
    """The kind of credentials by header name; values are looked at for their scheme only and never kept."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.when(F.element_at(low, "x-api-key").isNotNull(), "api_key").when(F.element_at(low, "authorization").rlike(r"(?i)^bearer\s+\S"), "oauth_token")
