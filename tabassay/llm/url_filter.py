"""URL filter whose block decisions reach the aliases of a url.

Urls that redirect to each other, or name the same canonical url, are one resource. Their
equivalence classes are connected components; an explicit rule decides its own urls, and an
undecided url takes the decision of its class, where one explicit allow outweighs every block.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm._components import components
from tabassay.llm._shared import lower_ascii, within

#: More rules than this are joined on host suffixes instead of being written into the plan.
MAX_LITERAL_RULES = 64
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    """Text after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return lower_ascii(_part(url, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return _part(url, 2)


def key_of(url: Column) -> Column:
    """Url without scheme and fragment; null where it has no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), _part(url, 3)))


def canonical_key(key: Column) -> Column:
    """Key without tracking parameters and without a closing slash: aliases by their form alone."""
    query = F.array_join(F.filter(F.split(F.regexp_extract(key, r"(?s)\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)), "&")
    path = F.rtrim(F.split_part(key, F.lit("?"), F.lit(1)), F.lit("/"))
    return F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)


def _target(base: Column, href: Column) -> Column:
    """Key of the url that href names on a page at base; a fragment alone names the page itself."""
    host, path = host_of(base), path_of(base)
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    whole = (
        F.when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(F.lit("x:"), href))
        .when(href.startswith("/"), F.concat(F.lit("x://"), host, href))
        .when(href.startswith("?"), F.concat(F.lit("x://"), host, path, href))
        .otherwise(F.concat(F.lit("x://"), host, F.regexp_replace(path, r"[^/]*$", ""), href))
    )
    return F.when((href != "") & ~href.startswith("#"), key_of(whole))


def _tag(html: Column, name: str, mark: str) -> Column:
    """The first tag of a name (up to its >, without it) that holds the mark; null if none does. Parts are cut before they are searched, so the work is linear."""
    parts = F.split(html, ">")
    tags = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.regexp_extract(p, rf"(?is)<{name}\b.*", 0))
    return F.try_element_at(F.filter(tags, lambda t: t.rlike(mark)), F.lit(1))


def _refresh_url(tag: Column) -> Column:
    """What follows url= behind the first ; that ends a content's opening words."""
    parts = F.split(tag, ";")
    opens = lambda p: (F.size(F.split(p, r"(?i)\bcontent\s*=\s*")) > 1) & F.element_at(F.split(p, r"(?i)\bcontent\s*=\s*"), -1).rlike(r"^[\"']?[^\"']*$")
    named = lambda p: F.regexp_extract(p, r"(?i)^\s*url\s*=\s*[\"']?([^\"'\s]+)", 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(opens(F.element_at(parts, i)), named(F.element_at(parts, i + 1))))
    return F.when(F.size(parts) > 1, F.try_element_at(F.filter(pairs, lambda u: u != ""), F.lit(1)))


def alias_edges(pages: DataFrame, by_form: bool = False) -> DataFrame:
    """Edges (a, b) between url keys: canonical links and meta refreshes of the html; by_form adds urls that differ in tracking parameters or a closing slash only."""
    url = F.col("url")
    targets = [canonical_key(key_of(url))] if by_form else [F.lit(None).cast("string")]
    if "html" in pages.columns:
        html = F.col("html")
        found = (F.regexp_extract(_tag(html, "link", _CANONICAL), _HREF, 1), _refresh_url(_tag(html, "meta", _REFRESH)))
        targets += [_target(url, F.coalesce(t, F.lit(""))) for t in found]
    edges = pages.select(key_of(url).alias("a"), F.explode(F.array(*targets)).alias("b"))
    return edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule (host and path as one string) and action of the longest rule that fits host and path.

    rules: host, path, action ('allow' or 'block'), none of them null. A rule fits its host, that
    host's subdomains, and paths that start with its path. Equal lengths: the longer host wins,
    then allow. A null or empty host fits no rule.
    """
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("host_long"), (F.col("action") == "allow").alias("allow"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("action"),
    )
    rules = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    if within(rules, MAX_LITERAL_RULES):
        known = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("rule_host", "rule_path", "action")]) for r in rules.collect()])
        if not rules.take(1):
            return urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
        fit = F.filter(known, lambda r: _fits(F.col("host"), F.col("path"), r["rule_host"], r["rule_path"]))
        ranked = F.transform(fit, lambda r: F.struct(
            (F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("long"), F.length(r["rule_host"]).alias("host_long"), (r["action"] == "allow").alias("allow"),
            F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["action"].alias("action")))
        best = F.array_max(ranked)
        return urls.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        distinct.filter("host != ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(F.max(order).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    )
    none = {"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")}
    return urls.filter("host != ''").join(found, ["host", "path"], "left").unionByName(urls.filter("host = ''").withColumns(none))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, default: str = "allow", by_form: bool = False) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, alias_verdict.

    pages needs page_id and url (html is used if there); edges (a, b) of url keys come from the
    pages themselves unless given (by_form: urls that differ in form alone are aliases as well). A page that a rule fits has that rule's verdict. Every other
    page takes alias_verdict: allow if a member of its class is allowed by a rule, else block if
    one is blocked, else null; then default stands. Null urls and urls without :// are judged by
    default, an empty table gives an empty one; repeated rows are judged alike; urls and pages of
    any length are read whole; further columns are not read.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("_key"))
    classes = components(alias_edges(pages, by_form) if edges is None else edges)
    node = F.concat(F.lit("x://"), F.col("node"))
    ruled = match_rules(classes.select("node", "component", host_of(node).alias("host"), path_of(node).alias("path")), rules)
    decided = ruled.groupBy("component").agg(F.max((F.col("action") == "allow")).alias("allow"), F.max((F.col("action") == "block")).alias("block"))
    verdicts = decided.filter("allow OR block").select("component", F.when(F.col("allow"), "allow").otherwise("block").alias("alias_verdict"))
    aliases = classes.join(verdicts, "component").select(F.col("node").alias("_key"), "alias_verdict")
    # Urls without a host have no alias; joined, they would all wait for one task.
    ruled = match_rules(urls, rules)
    found = ruled.filter("_key IS NOT NULL").join(aliases, "_key", "left").unionByName(ruled.filter("_key IS NULL").withColumn("alias_verdict", F.lit(None).cast("string")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict")
