"""URL filters with redirect equivalence.

Rules over hosts and path prefixes decide first. Pages that redirects or
canonical links tie together are aliases: a block spreads to aliases without a
rule of their own, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import connected_components

#: Up to so many rules are one conditional expression; more are joined by host.
MAX_RULES = 200


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, of equally long ones the last by name; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.name).otherwise(out)
    return out


def _joined(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, path, rule, verdict) of places (host, path) that a rule of a long list fits: each of a host's suffixes meets the rules for it."""
    listed = places.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "suffix string, start string, rule string, verdict string")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.distinct().select("host", "path", F.explode(suffixes).alias("suffix")).join(listed, "suffix")
    best = F.struct(F.length("rule"), "rule")
    return met.where("startswith(path, start)").groupBy("host", "path").agg(F.max_by("rule", best).alias("rule"), F.max_by("verdict", best).alias("verdict"))


# ---------------------------------------------------------------- links


def _decoded(text: Column) -> Column:
    """``text`` with character references of HTML replaced, each once: numbers below 256 and the five of XML."""
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m: Column) -> Column:
        out = m
        inner = F.substr(m, F.lit(2), F.length(m) - 2)
        for name, sign in named.items():
            out = F.when(inner == name, sign).otherwise(out)
        code = F.when(inner.rlike("^#[xX]"), F.conv(F.substr(inner, F.lit(3)), 16, 10)).when(inner.startswith("#"), F.substr(inner, F.lit(2))).cast("int")
        return F.when(code.between(1, 255), F.char(code)).otherwise(out)

    parted = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t, m: F.concat(t, F.coalesce(one(m), F.lit(""))))
    return F.array_join(parted, "")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in double, single or no quotes; null if the tag has none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), _decoded(found))


def _without_dots(path: Column) -> Column:
    """``path`` without its segments ``.`` and ``..``."""
    parts = F.split(path, "/", -1)

    def step(held: Column, part: Column) -> Column:
        return F.when(part == ".", held).when(part == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(ended, "/")).otherwise(path)


#: Scheme, authority, path and query of a reference.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _named(host: Column, path: Column, query: Column) -> Column:
    return F.concat(_lower(host), F.when(path == "", "/").otherwise(_without_dots(path)), query)


def node(url: Column) -> Column:
    """What redirects and canonical links tie together: host, path without dot segments, ``/`` if empty, and query, without scheme and fragment; null without a host."""
    host, path = parts(url)
    rest = F.substr(url, F.instr(url, "://") + 3)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return F.when((F.instr(url, "://") > 0) & (host != ""), _named(host, path, query))


def resolved(target: Column, url: Column) -> Column:
    """The node that ``target`` names in a page at ``url``, by the rules of RFC 3986; null for other schemes than http and https, and without a host."""
    t = F.translate(F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "\t\n\r", "")
    scheme, host, path, query = (F.regexp_extract(t, _PARTS, i) for i in range(1, 5))
    own_host, own_path = parts(url)
    own_query = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^?#]*(\?[^#]*)", 1)
    merged = F.concat(F.when(own_path == "", "/").otherwise(F.regexp_extract(own_path, "^(.*/)", 1)), path)
    local = F.when(path == "", own_path).when(path.startswith("/"), path).otherwise(merged)
    kept = F.when((path == "") & (query == ""), own_query).otherwise(query)
    absolute = F.when(_lower(scheme).isin("http", "https") & (host != ""), _named(host, path, query))
    return F.when(scheme != "", absolute).when(host != "", _named(host, path, query)).when(t.startswith("//") | (own_host == ""), None).otherwise(_named(own_host, local, kept))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): the nodes that a page's canonical links and refresh redirects tie together.

    All tags outside comments count; targets are resolved against the page's url.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"""(?is)<(?:link|meta)\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    # Most pages hold neither word: a plain search spares them the patterns.
    likely = F.lower("html").rlike("canonical|refresh")
    found = pages.where(likely & F.col("url").contains("://")).select("url", F.explode(tags).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(F.lower(tag).startswith("<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"), _attribute(tag, "href"))
    content = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.+)$", 1)
    # Quotes around the target end it.
    content = F.regexp_replace(content, r"(?s)^([\"'])(.*?)(?:\1.*)?$", "$2")
    refresh = F.when(F.lower(tag).startswith("<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh") & (content != ""), content)
    # Taken out of arrays, targets and nodes are computed once: no filter on them is pushed into their expressions.
    named = found.select("url", F.explode(F.filter(F.array(F.coalesce(canonical, refresh)), lambda x: x.isNotNull())).alias("target"))
    ends = F.array(F.struct(node(F.col("url")).alias("a"), resolved(F.col("target"), F.col("url")).alias("b")))
    return named.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judged(pages: DataFrame, rules: list[Rule] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added; ``edges`` (a, b) of nodes tie more pages together.

    A rule's verdict holds for its page. A page without one takes its component's:
    allow if any alias is allowed by a rule, else block if any is blocked, else
    ``default``. Null urls and urls without ``://`` fit no rule and have no alias;
    null and empty html has no link, html of any length is searched whole. Of
    equally long rules the last by name wins. Repeated rows are judged alike; an
    empty table gives no row; columns named host, path, rule or verdict are replaced,
    all others kept.
    """
    host, path = parts(F.col("url"))
    out = common.packed(pages, "url", host.alias("host"), path.alias("path"), without=("host", "path", "rule", "verdict"))
    if len(rules) <= MAX_RULES:
        verdicts = F.lit(None).cast("string")
        for r in rules:
            verdicts = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdicts)
        out = out.withColumn("rule", matched(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdicts)
    else:
        out = common.hot_join(out, common.stored(_joined(out.select("host", "path"), rules), "rules"), ["host", "path"])
    given = links(pages.select("url", "html"))
    tied = common.stored(given if edges is None else given.union(edges.select("a", "b")).distinct(), "aliases")
    verdict = F.col("verdict")
    if not tied.isEmpty():
        groups = common.stored(connected_components(tied), "alias-groups")
        own = out.select(node(F.col("url")).alias("node"), "verdict").where("verdict IS NOT NULL")
        decided = (
            own.distinct().join(groups, "node").groupBy("component")
            .agg(F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("spread"))
        )
        spread = common.stored(groups.join(decided, "component").select("node", "spread"), "alias-verdicts")
        out = common.hot_join(out.withColumn("node", node(F.col("url"))), spread, ["node"])
        verdict = F.coalesce("verdict", "spread")
    return out.select("_row.*", "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_urls": op9_urls}

# Rules, and verdicts that spread over absolute canonical links; the tables at hand hold no link of any kind.
ORACLE = {
    "op9_urls": r"""
WITH RECURSIVE p AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
q AS (SELECT page_id, html, lower_ascii AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM p)),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM q, rules WHERE ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY page_id),
n AS (SELECT q.page_id, host, path, rule, v, html, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM q LEFT JOIN best USING (page_id)),
e AS (SELECT node AS a, unnest(regexp_extract_all(html, '<link rel="canonical" href="https?://([^"#?/]+/[^"#]*)', 1)) AS b FROM n),
bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT a, b FROM bi UNION SELECT x, b FROM reach JOIN bi ON y = a),
g AS (SELECT x AS node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS gv FROM reach JOIN n ON n.node = reach.y GROUP BY x)
SELECT page_id, host, path, rule, coalesce(v, gv, 'allow') AS verdict FROM n LEFT JOIN g USING (node)"""
}
