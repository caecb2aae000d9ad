"""Url parts and resolution as regular expressions: no exceptions on malformed input, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions.binding import let

# The generic-syntax expression of RFC 3986, appendix B.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def site(url: Column) -> Column:
    """Host without a leading `www.`, lower case: the identity of a shop."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def _fold_dots(raw: Column) -> Column:
    """Remove `.` and `..` segments and empty inner segments."""

    def fold(parts):
        last = F.size(parts) - 1
        inner = F.filter(parts, lambda s, i: (i == 0) | (i == last) | (s != ""))
        walked = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.regexp_replace(F.array_join(F.concat(walked, tail), "/"), "^(?!/)", "/")

    return F.when(raw.rlike(r"/\.|//"), let(F.split(raw, "/"), fold)).otherwise(raw)


def resolve_url(url: Column, base: Column) -> Column:
    """An absolute url stays as it is; anything else is resolved against `base`.

    The parts of both urls are taken once and named, because the rules below use each of them several times.
    """

    def parts(u):
        names = ("scheme", "host", "path", "query", "fragment")
        fields = [F.regexp_extract(u, _PARTS, i + 1).alias(n) for i, n in enumerate(names)]
        return F.struct(u.alias("whole"), *fields)

    def resolve(pair):
        own, ctx = pair["own"], pair["ctx"]
        own_scheme, ctx_scheme = F.lower(own["scheme"]), F.lower(ctx["scheme"])
        root = F.concat(ctx_scheme, F.lit("://"), ctx["host"])
        tail = F.concat(
            F.when(own["query"] != "", F.concat(F.lit("?"), own["query"])).otherwise(F.lit("")),
            F.when(own["fragment"] != "", F.concat(F.lit("#"), own["fragment"])).otherwise(F.lit("")),
        )
        inherited = F.when((own["query"] == "") & (ctx["query"] != ""), F.concat(F.lit("?"), ctx["query"])).otherwise(F.lit(""))
        folder = F.regexp_replace(ctx["path"], "[^/]*$", "")
        merged = F.when(own["path"].startswith("/"), own["path"]).otherwise(F.concat(folder, own["path"]))
        return (
            F.when((own_scheme != "") & ((own["host"] != "") | (own_scheme != ctx_scheme)), own["whole"])
            .when(own["host"] != "", F.concat(ctx_scheme, F.lit(":"), own["whole"]))
            .when(own["path"] == "", F.concat(root, ctx["path"], inherited, tail))
            .otherwise(F.concat(root, _fold_dots(F.regexp_replace(merged, "^(?!/)", "/")), tail))
        )

    absolute = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    return F.when(url.isNull() | (url == "") | absolute, url).otherwise(
        let(F.struct(parts(url).alias("own"), parts(base).alias("ctx")), resolve)
    )
