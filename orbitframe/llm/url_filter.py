"""URL filters with redirect equivalence (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, materialize

#: (action, host/path) of the fixed rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules become one expression, so their number is bounded.
MAX_RULES = 2000


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host_col: Column, path_col: Column, rules: tuple) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; equal lengths: the smaller rule."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = None
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action}")
        name, slash, rest = rule.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def node(url: Column) -> Column:
    """The form in which spellings of one address are equal: no scheme, fragment, tracking parameters or closing slash."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&/]+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(F.regexp_replace(host(url), r"^www\.", ""), rest))


def absolute(link: Column, base: Column) -> Column:
    """A link as found in a page at address base, resolved; null if of another kind (``mailto:``)."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    full = F.when(link.startswith("/"), link).when(link.rlike(r"^[?#]"), F.concat(path(base), link)).otherwise(F.concat(folder, link))
    up = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    steps = F.aggregate(F.split(F.regexp_extract(full, r"(?s)^([^?#]*)", 1), "/"), F.array().cast("array<string>"), up)
    rooted = F.concat(scheme, F.lit("://"), host(base), F.array_join(steps, "/"), F.regexp_extract(full, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.instr(base, "://") > 0), rooted)


def declared_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: all canonical links and meta refreshes found in the html, attributes in any order."""
    tags = lambda name, sign: F.filter(F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>"), 0), lambda t: t.rlike(sign))
    canonical = F.transform(tags("link", r"(?is)\brel\s*=\s*[\"']?canonical\b"), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(tags("meta", r"(?is)http-equiv\s*=\s*[\"']?refresh\b"), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    return pages.select(F.col("url").alias("src"), F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''").select("src", absolute(F.col("link"), F.col("src")).alias("dst")).where("dst IS NOT NULL")


def judge(pages: DataFrame, rules: tuple = RULES, links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Every row of pages with host, path, rule and verdict.

    A url's own rule decides first. Urls without a rule take part in their alias class: spellings of one address, joined by
    redirects and canonical links (``links`` (src, dst), and those declared in html) into connected components. A class with
    a member under an explicit allow rule is allowed; else one with a blocked member is blocked; else ``default`` holds.
    Link targets that are not pages count as members too.

    Null urls and urls without ``://`` have empty host and path, no alias, and the default verdict. Repeated urls are judged
    alike; an empty table gives an empty result. Columns starting with ``__of_`` are reserved.
    """
    known = declared_links(pages) if "html" in pages.columns else None
    if links is not None:
        known = links.select("src", "dst") if known is None else known.unionByName(links.select("src", "dst"))
    df = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("__of_m", matched(F.col("host"), F.col("path"), rules)).withColumn("__of_node", node(F.col("url")))
    members = df.select("__of_node", F.col("__of_m.action").alias("action"))
    if known is not None:
        known = materialize(known, "links")
        ends = known.select(F.explode(F.array("src", "dst")).alias("url"))
        members = members.unionByName(ends.select(node(F.col("url")).alias("__of_node"), matched(host(F.col("url")), path(F.col("url")), rules)["action"].alias("action")))
    # one row for each spelling class; null addresses have none
    said = members.where("__of_node IS NOT NULL").groupBy("__of_node").agg(F.bool_or(F.col("action") == "allow").alias("a"), F.bool_or(F.col("action") == "block").alias("b"))
    if known is not None:
        labels = components(known.select(node(F.col("src")).alias("u"), node(F.col("dst")).alias("v"))).withColumnRenamed("node", "__of_node")
        said = said.join(labels, "__of_node", "left").withColumn("component", F.coalesce("component", "__of_node"))
        whole = said.groupBy("component").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
        said = said.select("__of_node", "component").join(whole, "component").drop("component")
    by_class = F.when(F.col("a"), "allow").when(F.col("b"), "block")
    # only classes with a decision are joined, and only to pages that have an address and no rule
    decided = said.select("__of_node", by_class.alias("__of_class")).where("__of_class IS NOT NULL")
    asks = F.col("__of_m").isNull() & F.col("__of_node").isNotNull()
    joined = df.where(asks).join(decided, "__of_node", "left")
    settled = df.where(~asks).withColumn("__of_class", F.lit(None).cast("string"))
    out = joined.unionByName(settled).withColumn("rule", F.col("__of_m.rule")).withColumn("verdict", F.coalesce(F.col("__of_m.action"), F.col("__of_class"), F.lit(default)))
    return out.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")


def op3(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).drop("url", "html")
