"""Column helpers beside text: resource addresses, times, redaction, retries, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scheme of resource addresses.
SCHEME = "rag"


def resource(uri: Column, scheme: str = SCHEME) -> Column:
    """struct(kind, collection, id) of scheme://collections/{c}[/documents/{id} | /chunks/{id}], segments decoded; null for
    another form, a query or fragment, an empty segment, or one that climbs (., .., a slash, a backslash, a control)."""
    seg = "([^/?#;]+)"
    form = rf"^{scheme}://collections/{seg}(?:/(documents|chunks)/{seg})?/?$"
    part = lambda i: F.try_url_decode(F.replace(F.regexp_extract(uri, form, i), F.lit("+"), F.lit("%2B")))
    bad = lambda c: c.isin("", ".", "..") | c.rlike(r"[/\\\x00-\x1f]")
    kind = F.when(F.regexp_extract(uri, form, 2) == "documents", "document").when(F.regexp_extract(uri, form, 2) == "chunks", "chunk").otherwise("collection")
    c, i = part(1), part(3)
    ok = uri.rlike(form) & c.isNotNull() & ~bad(c) & ((kind == "collection") | (i.isNotNull() & ~bad(i)))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(kind.alias("kind"), c.alias("collection"), F.when(kind != "collection", i).alias("id")))


def zoned(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """An ISO time, UTC where it names no zone, as yyyy-MM-dd HH:mm:ss in a zone; the first 19 characters of what does not
    parse, a dash for nothing. The session's time zone must be UTC."""
    t = F.try_to_timestamp(F.regexp_replace(at, "Z$", "+00:00"))
    shown = F.date_format(F.from_utc_timestamp(t, zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(at, F.lit("")) == "", "—").otherwise(F.coalesce(shown, F.left(at, F.lit(19))))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before an attempt (from 1): base, doubled each time, at most `most`."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def batches(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size))


#: What is redacted, in order.
REDACTED = "[REDACTED]"
REDACTIONS = (
    (r"(?<!\d)(?:\d{17}[\dXx]|\d{15})(?!\d)", REDACTED),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer " + REDACTED),
    (r"(?i)(?:sk-[A-Za-z0-9_-]{12,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|AIza[A-Za-z0-9_-]{20,})", REDACTED),
    (r"(?i)(\b(?:api[_-]?key|password|passwd|secret|access[_-]?token|client[_-]?secret|token)\b\s*[:=]\s*)([^\s,;]+)", "$1" + REDACTED),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", REDACTED),
    (r"(?<!\d)(?:\+?86[\s-]?)?1[3-9]\d{9}(?!\d)|\b\+?\d{3}[- ]\d{3}[- ]\d{4}\b", REDACTED),
)
PATHS = ((r"(?i)([\\/]Users[\\/])[^\\/]+", "$1[USER]"), (r"(?i)([\\/]home[\\/])[^\\/]+", "$1[USER]"))
#: Fields of which a hash or nothing is kept.
HASHED, HIDDEN = ("user_id", "actor", "owner_id"), ("password", "secret", "token", "api_key", "authorization")


def redacted(text: Column, most: int = 256, path: bool = False) -> Column:
    """Personal data and secrets masked, then cut to `most` characters."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    for pattern, by in REDACTIONS + (PATHS if path else ()):
        t = F.regexp_replace(t, pattern, by)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("… [truncated]"))).otherwise(t)


def actor(user: Column) -> Column:
    return F.when(F.trim(F.coalesce(user, F.lit(""))) == "", "anonymous").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.trim(user), 256)))


def redacted_fields(fields: Column) -> Column:
    """A map with its values redacted: actors hashed under <name>_hash, secrets hidden, paths without their users."""
    low = lambda k: F.lower(k)
    keys = F.transform_keys(fields, lambda k, _: F.when(low(k).isin(*HASHED), F.concat(k, F.lit("_hash"))).otherwise(k))
    hashed = [f"{h}_hash" for h in HASHED]
    return F.transform_values(keys, lambda k, v: F.when(low(k).isin(*hashed), actor(v)).when(low(k).isin(*HIDDEN), F.lit(REDACTED)).when(low(k).endswith("path"), redacted(v, path=True)).otherwise(redacted(v)))


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case letters and digits joined by dashes; where nothing is left, the hash's first eight characters."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))
    return F.when(s == "", F.left(F.sha2(text, 256), F.lit(8))).otherwise(s)
