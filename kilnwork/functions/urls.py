"""URL tests and sanitisers as native columns. Each gives null (or false) for what it does not let through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNSAFE = r"(?U)[\s\x00-\x1F\x7F\x{1C}-\x{1F}]"


def has_unsafe_characters(url: Column) -> Column:
    """White space of any kind, control characters and DEL."""
    return url.rlike(_UNSAFE)


def link(url: Column) -> Column:
    """http and https with a host (and a port that is a number up to 65535), /path but not //host, and #fragment."""
    clean = url.isNotNull() & (url != "") & ~has_unsafe_characters(url) & ~F.contains(url, F.lit("\\"))
    host = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@]*)(?::([0-9]*))?(?:[/?#]|$)", 1)
    port = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#]*@)?(?:\[[^\]/?#]*\]|[^:/?#@]*):([0-9]{1,9})(?:[/?#]|$)", 1)
    absolute = (host != "") & ((port == "") | (F.try_to_number(port, F.lit("999999999")) <= 65535))
    local = (url.startswith("/") & ~url.startswith("//")) | url.startswith("#")
    return F.when(clean & (absolute | local), url)


# The form of a stored asset's name, and the extensions of pictures.
_NAME = r"^([0-9a-f]{64})\.(png|jpg|jpeg|gif|webp|bmp|pdf)$"
RASTER = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
ROUTES = {"editorial": "/editorial-assets/", "statement": "/statement-assets/"}


def asset_digest(name: Column) -> Column:
    """The digest of a content-addressed name, null for any other name."""
    digest = F.regexp_extract(name, _NAME, 1)
    return F.when(digest != "", digest)


def asset_fits(name: Column, content_kind: Column, resource: str) -> Column:
    """Whether a name is that of a picture (image), or of a statement's PDF (attachment)."""
    ext = F.regexp_extract(name, _NAME, 2)
    return F.coalesce(ext.isin(*RASTER) if resource == "image" else (ext == "pdf") & (content_kind == "statement"), F.lit(False))


def route_name(route: Column, content_kind: Column) -> Column:
    """The asset's name in a local route of a content kind, null for other routes."""
    prefix = F.when(content_kind == "editorial", ROUTES["editorial"]).when(content_kind == "statement", ROUTES["statement"])
    return F.when(F.startswith(route, prefix), F.substr(route, F.length(prefix) + 1))


def image(url: Column, content_kind: Column) -> Column:
    """A local route of a stored picture without query, fragment, dot segments or hidden separators."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    clean = url.isNotNull() & ~has_unsafe_characters(url) & ~F.contains(url, F.lit("\\")) & ~url.rlike(r"[?#]") & ~url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")
    plain = ~has_unsafe_characters(decoded) & ~F.contains(decoded, F.lit("\\")) & ~F.exists(F.split(decoded, "/"), lambda x: x.isin(".", ".."))
    return F.when(clean & F.coalesce(plain, F.lit(False)) & asset_fits(route_name(decoded, content_kind), content_kind, "image"), url)


def attachment(url: Column) -> Column:
    """A local route of a stored PDF; anything else is an error of the row, `unsafe-attachment-url`."""
    kind = F.lit("statement")
    return F.when(asset_fits(route_name(url, kind), kind, "attachment"), url)


def problem_code_parts(code: Column) -> Column:
    """(contest_id, index) of a bare code: its leading digits, and from the first letter on."""
    return F.struct(F.regexp_extract(code, r"^([0-9]+)([A-Za-z][A-Za-z0-9]*)$", 1).alias("contest_id"), F.regexp_extract(code, r"^([0-9]+)([A-Za-z][A-Za-z0-9]*)$", 2).alias("index"))


def source_identity(url: Column, hosts: tuple[str, ...]) -> Column:
    """(contest_id, index) that a source URL of an allowed host names in either of its two path shapes; null for others, and with a query or fragment."""
    hostname = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:@]+)(?::[0-9]+)?/", 1))
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+(/[^?#]*)$", 1)
    one, two = r"^/problemset/problem/([0-9]+)/([A-Za-z0-9]+)/?$", r"^/contest/([0-9]+)/problem/([A-Za-z0-9]+)/?$"
    pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(path, one, k), F.lit("")), F.nullif(F.regexp_extract(path, two, k), F.lit("")))
    return F.when(hostname.isin(*hosts) & pick(1).isNotNull(), F.struct(pick(1).alias("contest_id"), pick(2).alias("index")))


def remote_resource(url: Column) -> Column:
    """An absolute http or https URL with a host; null for others."""
    return F.when(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#]*@)?([^/?#:@]+)", 1) != "", url)


def attribute_url(url: Column, origin: str) -> Column:
    """A URL of exactly one origin, escaped for an attribute; null for others."""
    ok = F.startswith(url, F.lit(origin + "/")) | (url == origin)
    out = url
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.when(ok, out)
