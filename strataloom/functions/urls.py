"""URL parts and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that name a record.
IDENTITY_KEYS = ("id", "tid", "listid", "user_id", "userid", "url", "page", "period", "contenttype")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def port(url: Column) -> Column:
    """The port, or the default one of http and https."""
    given = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.when(given != "", given.cast("int")).when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)


def has_credentials(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")


def origin(url: Column) -> Column:
    """scheme://host:port in lower case; null for other schemes and for URLs with credentials."""
    good = scheme(url).isin("http", "https") & (host(url) != "") & ~has_credentials(url)
    return F.when(good, F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), port(url).cast("string")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def query_value(url: Column, key: str) -> Column:
    """The first value of a query key, whatever the key's case; '' if there is none."""
    return F.regexp_extract(query(url), rf"(?i)(?:^|&){key}=([^&]*)", 1)


def repeated_identity_keys(url: Column) -> Column:
    """The identity keys that a query holds more than once."""
    keys = F.transform(F.split(query(url), "&"), lambda kv: F.lower(F.substring_index(kv, "=", 1)))
    return F.filter(F.array(*[F.lit(k) for k in IDENTITY_KEYS]), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1)


def canonical(url: Column, dropped: str = "utm_[a-z]+|ref") -> Column:
    """Without fragment and tracking parameters, the others in order."""
    kept = F.array_sort(F.filter(F.split(query(url), "&"), lambda kv: (kv != "") & ~kv.rlike(f"^(?:{dropped})=")))
    base = F.regexp_replace(without_fragment(url), r"\?.*$", "")
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def record_identity(url: Column) -> Column:
    """kind:id of the record that a URL names, by the first rule that applies; '' if none does."""
    p, low = path(url), F.lower(path(url))
    qid, tid, list_id = (F.trim(query_value(url, k)) for k in ("id", "tid", "listid"))
    article = F.regexp_extract(p, r"(?i)/(?:article/(?:admin|manager|lottery)|api/proxy/admin-articles)/([^/?#]+)", 1)
    where = F.when(fragment(url) != "", fragment(url)).otherwise(p)
    user = F.regexp_extract(where, r"(?i)(?:^|/)(?:api/v1/)?users/(\d+)(?:/|$)", 1)
    topic = F.regexp_replace(F.regexp_extract(p, r"(?i)/topic/([^/?#]+)", 1), r"(?i)\.(?:html?|js)$", "")
    name = F.lower(F.regexp_extract(p, r"([^/]+)$", 1))
    board = F.regexp_extract(p, r"(?i)/bbs/(\d+)(?:\.html)?$", 1)
    zone = F.regexp_extract(p, r"(?i)/art_zhuanqu/(\d+)\.html$", 1)
    return (
        F.when(article != "", F.concat(F.lit("admin_article:"), article))
        .when(user != "", F.concat(F.lit("user:"), user))
        .when(topic != "", F.concat(F.lit("topic:"), topic))
        .when(low.endswith("/view.php") & (qid != ""), F.concat(F.lit("view:"), qid))
        .when(low.endswith("/read.php") & (tid != ""), F.concat(F.lit("read:"), tid))
        .when(low.rlike(r"/article\.aspx?$") & (qid != "") & (list_id != ""), F.concat(F.lit("article:"), list_id, F.lit(":"), qid))
        .when(low.rlike(r"/article\.aspx?$") & (qid != ""), F.concat(F.lit("article:"), qid))
        .when((low.endswith(".aspx") | low.endswith("/topic.php")) & (qid != ""), F.concat(name, F.lit(":"), qid))
        .when(board != "", F.concat(F.lit("bbs:"), board))
        .when(zone != "", F.concat(F.lit("art_zhuanqu:"), zone))
        .otherwise(""))


def redirect_allowed(requested: Column, final: Column, allowed: Column) -> Column:
    """No step down from https; the same origin, its https twin, or one on the list; the same record."""
    same_host = host(requested) == host(final)
    up = (scheme(requested) == "http") & (scheme(final) == "https") & same_host & (port(requested) == 80) & (port(final) == 443)
    reach = (origin(requested) == origin(final)) | up | F.array_contains(allowed, origin(final))
    down = (scheme(requested) == "https") & (scheme(final) == "http")
    return F.coalesce(reach, F.lit(False)) & ~down & (record_identity(requested) == record_identity(final))


def authority(url: Column) -> Column:
    """scheme://host of a URL as it is written, with port and credentials."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def resolved(base: Column, reference: Column) -> Column:
    """The URL that a reference in a document at base names."""
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), reference)
    where, rest = F.regexp_extract(joined, r"^([^?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    segments = F.split(where, "/", -1)
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    step = lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s))
    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(F.startswith(reference, F.lit("//")), F.concat(scheme(base), F.lit(":"), reference))
        .when(F.startswith(reference, F.lit("/")), F.concat(authority(base), reference))
        .when(F.startswith(reference, F.lit("?")), F.concat(plain, reference))
        .when(F.startswith(reference, F.lit("#")), F.concat(without_fragment(base), reference))
        .when(reference == "", base)
        .otherwise(F.concat(authority(base), F.array_join(last, "/"), rest)))
