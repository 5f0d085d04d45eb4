"""URL filters: rules by host and path, and block decisions that spread over redirect and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query: fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url_col: str) -> tuple[Column, Column]:
    rest = f"CASE WHEN instr(`{url_col}`, '://') > 0 THEN substring(`{url_col}`, instr(`{url_col}`, '://') + 3) ELSE '' END"
    rest = F.coalesce(F.expr(rest), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def deciding(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; of equally long ones, that with the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    found = F.lit(None).cast("string")
    for rule, fit in reversed(list(zip(ordered, fits, strict=True))):
        found = F.when(fit, F.lit(value(rule))).otherwise(found)
    return found


def address(url: Column, host: Column) -> Column:
    """A url as a node: scheme and host in lower case, without its fragment."""
    scheme = F.translate(F.regexp_extract(url, r"^([^:/?#]*)://", 1), UPPER, LOWER)
    return F.concat(scheme, F.lit("://"), host, F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^#]*)", 1))


#: Named references that may stand in an address, ``&amp;`` last, so that nothing is decoded twice.
_ENTITIES = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("sol", "/"), ("colon", ":"), ("quest", "?"), ("equals", "="), ("num", "#"), ("period", "."), ("nbsp", "\u00a0"), ("amp", "&"))


def decoded(text: Column) -> Column:
    """A text with its numbered and the usual named character references replaced; others stay."""
    mark = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?"

    def character(ref: Column) -> Column:
        number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "([0-9A-Fa-f]+);?$", 1), 16, 10)).otherwise(F.regexp_extract(ref, "([0-9]+);?$", 1)).cast("bigint")
        wide = F.lpad(F.hex(number), 8, "0")
        return F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(wide), "UTF-32")).otherwise(ref)

    parts = F.split(text, mark, -1)
    refs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(mark), 0), character), F.array(F.lit("")))

    def plain(part: Column) -> Column:
        for name, sign in _ENTITIES:
            part = F.regexp_replace(part, f"&{name};", sign)
        return part

    return F.array_join(F.zip_with(parts, refs, lambda part, ref: F.concat(plain(part), ref)), "")


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the root stays at the root."""
    segments = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    ends_in_folder = F.element_at(F.split(path, "/", -1), -1).isin(".", "..")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.startswith("/"), F.when(ends_in_folder & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def declared_links(pages: DataFrame) -> DataFrame:
    """``a, b``: addresses of pages and of what their markup names as canonical or redirects to at once."""
    tags = F.filter(
        F.regexp_extract_all("html_", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0),
        lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"),
    )
    marked = pages.where("url_ is not null and html_ is not null").where(F.col("html_").rlike(r"(?i)canonical|http-equiv"))
    found = marked.select("url_", "node", F.explode(tags).alias("tag"))
    href = F.coalesce(
        F.nullif(F.regexp_extract("tag", r"(?is)^<link\b.*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract("tag", r"(?is)^<meta\b.*\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit("")),
    )
    found = found.select("url_", "node", F.explode(F.array(href)).alias("raw")).where("raw is not null")
    # an explode of one value, so that no later filter repeats its expression
    found = found.select("url_", "node", F.explode(F.array(decoded(F.col("raw")))).alias("href"))
    base = F.regexp_extract("url_", r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url_", r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    target = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url_", r"^([^:/?#]*:)", 1), F.col("href")))
        .when(F.col("href").startswith("/"), F.concat(base, F.col("href")))
        .when(F.col("href").startswith("?"), F.concat(F.regexp_extract("url_", r"^([^?#]*)", 1), F.col("href")))
        .when(F.col("href").startswith("#"), F.lit(None).cast("string"))
        .when(folder.endswith("/"), F.concat(folder, F.col("href")))
        .otherwise(F.concat(folder, F.lit("/"), F.col("href")))
    )
    linked = found.select("node", F.explode(F.array(target)).alias("target")).where("target is not null")
    start, after = r"^([^:/?#]*://[^/?#]*)", r"^[^:/?#]*://[^/?#]*[^?#]*(.*)$"
    dotted = F.col("target").rlike(r"^[^:/?#]*://[^/?#]*[^?#]*/\.{1,2}(?:[/?#]|$)")
    clean = F.concat(F.regexp_extract("target", start, 1), without_dots(host_and_path("target")[1]), F.regexp_extract("target", after, 1))
    linked = linked.select("node", F.explode(F.array(F.when(dotted, clean).otherwise(F.col("target")))).alias("target"))
    host, _ = host_and_path("target")
    return linked.select(F.col("node").alias("a"), address(F.col("target"), host).alias("b"))


def judge_pages(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` of every page.

    The longest fitting rule decides. A page without one takes the decision of its aliases, the addresses that
    redirects (``from_url, to_url``, if a crawl log is given) or the markup's canonical and refresh links join to
    it: block if a rule blocks one of them and none is allowed by a rule; allow wins otherwise and by default.
    Addresses without a page count as aliases as well. ``component`` is the smallest address of the aliases,
    null for a page that no link touches.

    Null urls and urls without ``://`` have an empty host and path, no rule, no aliases, and are allowed. Null
    markup holds no links. Repeated rows each get their row; an empty table gives none. A target of a third of
    all pages is a hub of partial minima and of equi-joins; decisions are combined per component before they
    are joined to the pages.
    """
    read = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url_"), pages[html_col].cast("string").alias("html_"))
    host, path = host_and_path("url_")
    read = read.withColumns({"host": host, "path": path})
    read = read.withColumn("node", F.when(F.instr("url_", "://") > 0, address(F.col("url_"), F.col("host"))))
    links = declared_links(read)
    if redirects is not None:
        ends = []
        for end in ("from_url", "to_url"):
            ends.append(address(F.col(end), host_and_path(end)[0]))
        links = links.unionByName(redirects.select(ends[0].alias("a"), ends[1].alias("b")))
    aliases = components(links)
    node_host, node_path = host_and_path("node")
    decided = aliases.withColumn("decision", deciding(rules, node_host, node_path, lambda r: r.verdict))
    spread = decided.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("decision") == "block"), F.lit(False)).alias("blocks"),
        F.coalesce(F.bool_or(F.col("decision") == "allow"), F.lit(False)).alias("allows"),
    )
    known = aliases.join(spread, "component").select("node", "component", (F.col("blocks") & ~F.col("allows")).alias("blocked"))
    return (
        read.select("page_id", "host", "path", "node")
        .join(known, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            deciding(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"),
            F.coalesce(deciding(rules, F.col("host"), F.col("path"), lambda r: r.verdict), F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
            "component",
        )
    )


def op7(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge_pages(pages).drop("component")


def _sql_decision(host: str, path: str, value) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
    cases = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{value(r)}'" for r in ordered)
    return f"CASE {cases} END"


def _sql_rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract({_sql_rest(url)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract({_sql_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _sql_node(url: str) -> str:
    return f"translate(regexp_extract({url}, '^([^:/?#]*)://', 1), '{UPPER}', '{LOWER}') || '://' || {_sql_host(url)} || regexp_extract({url}, '^[^:/?#]*://[^/?#]*([^#]*)', 1)"


#: Absolute canonical and refresh targets; the markup of the tables names no relative ones.
OP7_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'
), named AS (
  SELECT url, coalesce(
    nullif(regexp_extract(tag, '(?is)^<link\\b.*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), ''),
    nullif(regexp_extract(tag, '(?is)^<meta\\b.*\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1), '')) AS target
  FROM tags
  WHERE regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b') OR regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
), links AS (
  SELECT DISTINCT {_sql_node('url')} AS a, {_sql_node('target')} AS b FROM named WHERE target LIKE '%://%'
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), aliases AS (
  SELECT a AS node, bool_or(decision = 'block') AND NOT coalesce(bool_or(decision = 'allow'), false) AS blocked
  FROM (SELECT a, {_sql_decision(_sql_host('b'), _sql_path('b'), lambda r: r.verdict)} AS decision FROM reach) d GROUP BY a
), judged AS (
  SELECT page_id, coalesce({_sql_host('url')}, '') AS host, coalesce({_sql_path('url')}, '') AS path, {_sql_node('url')} AS node FROM pages
)
SELECT page_id, host, path, {_sql_decision('host', 'path', lambda r: r.name)} AS rule,
  coalesce({_sql_decision('host', 'path', lambda r: r.verdict)}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN aliases USING (node)
"""
