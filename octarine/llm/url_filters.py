"""URL filters: host and path rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octarine.llm.common import connected_components, cut, fresh, lower_ascii, table

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rules of the registered query: verdict, host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for a null url or one without ://."""
    got = lambda k: F.coalesce(F.regexp_extract(F.col(url), URL, k), F.lit(""))
    return pages.withColumns({"host": lower_ascii(got(1)), "path": got(2)})


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Ties: an allowing rule, then the first by its text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to rows with host and path.

    A sequence becomes one conditional expression. A DataFrame (verdict, rule), for rules by the thousand, is joined on
    the host's suffixes, shuffled like any join: nothing is broadcast by force. Both break ties alike.
    """
    if not isinstance(rules, DataFrame):
        hit = rule_of(F.col("host"), F.col("path"), rules)
        (name,) = fresh(pages, 1)
        return pages.withColumn(name, hit).withColumns({"rule": F.col(f"{name}.rule"), "rule_verdict": F.col(f"{name}.verdict")}).drop(name)
    known = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("at"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"))
    sites = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = sites.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    order = F.struct(-F.length("rule"), F.col("verdict") != "allow", F.col("rule"))
    best = ends.join(known, "at").where(F.col("path").startswith(F.col("start"))).groupBy("host", "path").agg(F.min_by(F.struct("rule", F.col("verdict").alias("rule_verdict")), order).alias("hit"))
    one, two, hit = fresh(pages, 3)
    best = cut(best.select(F.col("host").alias(one), F.col("path").alias(two), F.col("hit").alias(hit)))
    return pages.join(best, (pages.host == F.col(one)) & (pages.path == F.col(two)), "left").select(*pages.columns, f"{hit}.rule", f"{hit}.rule_verdict")


def page_key(url: Column) -> Column:
    """By which pages and links name the same place: the url without fragment, scheme and host lower-cased."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, "(?s)^.*?://[^/?#]*", 0)
    return F.when(head == "", F.lit(None)).otherwise(F.concat(lower_ascii(head), F.substr(bare, F.length(head) + 1)))


def _resolved(links: DataFrame, name: str, target: str, base: str) -> DataFrame:
    """links with name: the url of a link (target) in a page (base): whole, from //, from the root, from ? or #, or relative to the page's folder, . and .. included."""
    names = fresh(links, 5)
    host, path, inside, head, steps = map(F.col, names)
    to, page = F.col(target), F.col(base)
    got = links.withColumns({names[0]: F.regexp_extract(page, "(?s)^.*?://[^/?#]*", 0), names[1]: F.regexp_extract(page, URL, 2)})
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)?", 0))
    got = got.withColumn(names[2], F.when(to.startswith("/"), to).when(to.startswith("?") | to.startswith("#"), F.concat(path, to)).otherwise(F.concat(folder, to)))
    got = got.withColumn(names[3], F.regexp_extract(inside, "(?s)^[^?#]*", 0))
    got = got.withColumn(names[4], F.split(F.regexp_replace(head, r"/\.{1,2}$", "$0/"), "/"))
    walk = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    clean = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    whole = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.substring_index(page, "//", 1), to)).otherwise(F.concat(host, clean, F.substr(inside, F.length(head) + 1)))
    return got.withColumn(name, whole).drop(*names)


def _decoded(value: Column) -> Column:
    """An attribute's value with its ampersands."""
    return F.regexp_replace(value, "(?i)&(?:amp|#38|#x26);", "&")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls of canonical links and of meta redirects in whole pages; relative ones by the page's first base element, else by its url."""
    quoted = lambda tag, name: _decoded(F.concat(*[F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", "([^\"'\\s>]+)")]))
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    base = F.trim(quoted(F.regexp_extract(F.col(html), r"(?is)<base\b[^>]*>", 0), "href"))
    own = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(F.col(url).alias("source"), base.alias("base"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), quoted(F.col("tag"), "href"))
    moved = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*http-equiv\s*=\s*[\"']?refresh\b"), _decoded(F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)", 1)))
    found = cut(own.select("source", "base", F.trim(F.coalesce(canonical, moved)).alias("target"))).where("target != ''")
    based = _resolved(found, "whole", "base", "source").withColumn("whole", F.when(F.col("base") == "", F.col("source")).otherwise(F.col("whole")))
    return cut(_resolved(based, "to", "target", "whole").select("source", F.col("to").alias("target")))  # links are few; a filter pushed into all of this would grow with each step


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES, edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule that fits a page decides it. The pages without one take their component's word: pages that redirects
    and canonical links (edges: source, target urls; by default those in the html) join are aliases. An allowed page among
    them allows all that no rule decides, else a blocked page blocks them, else they are allowed. A component counts
    every url that an edge names, and a rule judges such urls too, even where no page has them. Pages with the same url share a component. Null urls and urls
    without :// are allowed, with an empty host and path. Repeated rows and edges change nothing; extra columns stay,
    and host, path, rule, rule_verdict and verdict are replaced. No pages give no rows. Urls are numbered, not hashed, so none are mixed up.
    """
    edges = link_edges(pages) if edges is None else edges
    made = ("host", "path", "rule", "rule_verdict", "verdict")
    judged = with_rules(with_host_and_path(pages.drop(*made)), rules)
    ends = cut(edges.select(page_key(F.col("source")).alias("s"), page_key(F.col("target")).alias("t")).where("s is not null and t is not null and s != t").distinct())
    names = cut(ends.select(F.col("s").alias("url")).union(ends.select("t")).distinct().withColumn("node", F.monotonically_increasing_id()))
    votes = with_rules(with_host_and_path(names), rules).select("node", "rule_verdict")
    numbered = ends.join(names.select(F.col("url").alias("s"), F.col("node").alias("a")), "s").join(names.select(F.col("url").alias("t"), F.col("node").alias("b")), "t")
    groups = connected_components(numbered.select("a", "b"))
    word = groups.join(votes, "node").groupBy("component").agg(F.when(F.max(F.col("rule_verdict") == "allow"), "allow").when(F.max(F.col("rule_verdict") == "block"), "block").alias("word"))
    one, two, own = fresh(judged, 3)
    spread = cut(groups.join(cut(word), "component").where("word is not null").join(names, "node").select(F.col("url").alias(one), F.col("word").alias(two)))
    lone = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))  # urls that can have no alias are spread over the tasks
    out = judged.withColumn(own, F.coalesce(page_key(F.col("url")), lone)).join(spread, F.col(own) == F.col(one), "left")
    return out.select(*[c for c in judged.columns if c not in made], "host", "path", "rule", F.coalesce("rule_verdict", two, F.lit("allow")).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
with p as (
  select page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path
  from pages),
rules(verdict, rule, h, pre) as (values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
hit as (select page_id, max_by(rule, length(rule)) rule, max_by(verdict, length(rule)) verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by page_id)
select p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') verdict from p left join hit on p.page_id = hit.page_id
"""
