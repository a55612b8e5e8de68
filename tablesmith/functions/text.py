"""Text and JSON column functions: request-header parsing (E14, E15), usage-payload normalisation (E16),
name cleaning for ledgers (S11) and small text shaping (E17).  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Proxy headers scanned for the client address, in order; default address; OS tests in order.
IP_HEADERS = ["x-forwarded-for", "cf-connecting-ip", "x-real-ip", "client-ip", "true-client-ip", "x-client-ip",
              "forwarded"]
DEFAULT_IP = "127.0.0.1"
OS_RULES = [("Windows", ["windows"]), ("macOS", ["macintosh", "mac os x"]), ("Linux", ["linux"]),
            ("Android", ["android"]), ("iOS", ["iphone", "ipad"])]


def lower_keys(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, v: F.lower(k))


def client_ip(headers: Column) -> Column:
    """First non-empty proxy header (case-insensitive names), first hop of a comma list, trimmed."""
    h = lower_keys(headers)
    first = F.coalesce(*[F.when(F.try_element_at(h, F.lit(k)) != "", F.try_element_at(h, F.lit(k)))
                         for k in IP_HEADERS])
    return F.coalesce(F.trim(F.split(first, ",").getItem(0)), F.lit(DEFAULT_IP))


def header(headers: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(lower_keys(headers), F.lit(name.lower())), F.lit(default))


def browser_of(user_agent: Column) -> Column:
    """E15 browser class by ordered substring tests on the lower-cased agent."""
    ua = F.lower(user_agent)
    return (F.when(ua.contains("edg/") | ua.contains("edge"), "Edge")
            .when(ua.contains("chrome") & ua.contains("safari"), "Chrome")
            .when(ua.contains("safari") & ~ua.contains("chrome"), "Safari")
            .when(ua.contains("firefox"), "Firefox")
            .when(ua.contains("opera") | ua.contains("opr/"), "Opera")
            .otherwise("Other"))


def os_of(user_agent: Column) -> Column:
    """E15 OS class; the test order makes Android agents "Linux" and iPhone agents "macOS" (kept as is)."""
    ua = F.lower(user_agent)
    out = None
    for name, needles in OS_RULES:
        cond = None
        for n in needles:
            cond = ua.contains(n) if cond is None else (cond | ua.contains(n))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("Other")


def client_info(headers: Column) -> dict[str, Column]:
    """All request facts from a headers map: ip, user_agent, browser, os, language, referrer."""
    ua = header(headers, "user-agent", "unknown")
    lang = header(headers, "accept-language", "unknown")
    return {"ip": client_ip(headers), "user_agent": ua, "browser": browser_of(ua), "os": os_of(ua),
            "language": F.when(lang.contains(","), F.trim(F.split(lang, ",").getItem(0))).otherwise(lang),
            "referrer": header(headers, "referer", "direct")}


USAGE_SCHEMA = ("usage struct<input_tokens: long, output_tokens: long>, response struct<usage_metadata: "
                "struct<prompt_tokens: long, candidates_tokens: long>, token_usage: struct<prompt_tokens: long, "
                "completion_tokens: long>>")


def usage_tokens(payload: Column) -> dict[str, Column]:
    """input/output tokens from a raw payload: the usage object, else vendor shape 1, else shape 2, else 0/0."""
    j = F.from_json(payload, USAGE_SCHEMA)
    u, m, t = j["usage"], j["response"]["usage_metadata"], j["response"]["token_usage"]
    zero = F.lit(0).cast("long")
    inp = (F.when(u.isNotNull(), F.coalesce(u["input_tokens"], zero))
           .when(m.isNotNull(), F.coalesce(m["prompt_tokens"], zero))
           .when(t.isNotNull(), F.coalesce(t["prompt_tokens"], zero)).otherwise(zero))
    out = (F.when(u.isNotNull(), F.coalesce(u["output_tokens"], zero))
           .when(m.isNotNull(), F.coalesce(m["candidates_tokens"], zero))
           .when(t.isNotNull(), F.coalesce(t["completion_tokens"], zero)).otherwise(zero))
    return {"input_tokens": inp, "output_tokens": out}


def clean_name(c: Column) -> Column:
    """Spaces -> underscores, parentheses removed."""
    return F.translate(c, " ()", "_")


def score_cell(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, F.coalesce(std, F.lit(0.0)))


def feature_badges(features: Column) -> Column:
    """Comma list of feature names -> array of trimmed badge labels."""
    return F.transform(F.split(features, ","), lambda x: F.trim(x))


def redact_paths(text: Column) -> Column:
    """Replace absolute file paths in a message by their last component."""
    return F.regexp_replace(text, r"(/[^\s/]+)+/([^\s/]+)", "$2")
