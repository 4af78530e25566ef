"""URL filter: rules by host and path, then a list of canonical URLs.

A rule fits its host and all subdomains where the URL's path starts with the
rule's; the longest fitting rule decides. Where none fits, the list decides: a
blocked Bloom filter of the listed canonical URLs lets the others pass, and only
possible hits are joined with the list itself, which removes the false ones.

A null URL, or one without "://", has empty host and path, fits no rule, is on no
list and is allowed. Repeated rows are judged each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import bloom
from tidemark.llm.common import lower_ascii

#: (verdict, host and path) of the production query.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"
#: Query parameters that don't change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without "www." or "m.", path without a closing "/" or ".html", and the
    sorted query without tracking parameters; null for what is no URL."""
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(host != "", whole)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. The
    rules are a short list in the driver and become one CASE expression."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def listed_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of the production query: canonical URLs of pages that show a
    document labelled toxic. The document's number ends the path."""
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("document")).distinct()
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(\.html|/)?$", 1)
    shown = pages.select(
        canonical(F.col("url")).alias("listed"), F.when(number != "", number).cast("bigint").alias("document"),
    )
    return shown.join(toxic, "document", "left_semi").select("listed").where("listed IS NOT NULL").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``.

    ``listed``: a DataFrame with a column ``listed`` of canonical URLs, of any
    size; only its bounded filter is broadcast on the main path."""
    blocks = bloom.blocks_for(listed.count())
    plain = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("canonical"),
    )
    marked = bloom.mark(plain, "canonical", bloom.build(listed, "listed", blocks), blocks, "hit")
    exact = listed.select(F.col("listed").alias("canonical"), F.lit(True).alias("on_list")).distinct()
    hits = marked.where("hit").join(exact.hint("shuffle_hash"), "canonical", "left").withColumn(
        "on_list", F.coalesce("on_list", F.lit(False))
    )
    both = hits.unionByName(marked.where("NOT hit").withColumn("on_list", F.lit(False)))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("on_list"), "block").otherwise("allow")
    return both.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("on_list").alias("listed"),
    )
