"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

A URL that no rule fits is looked up in the list. The list's blocked Bloom filter (a block of 512 bits per
URL, one bit in each of its eight words) is a small table that is broadcast: it has at most ``MOST_BLOCKS``
rows of 72 bytes, some 19 MB, whatever the list's length. What passes it goes to an exact hash join with the
list, which removes false positives; a list too long for its filter only makes more URLs pass on. For that join
the URLs that passed are made distinct within the tasks first, and rows are joined with the listed ones
among them over ``SALTS`` salts, so a URL that a third of the rows have is spread as well.

Everything is column expressions and joins; no Python runs on rows.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is on no list, so it is
allowed; an empty path starts with no rule's path; of rules that fit, the one with the longest host and path wins
(two equal ones: block); hosts are compared letter by letter with their port and user, if they have one;
repeated rows and equal ids are rows of their own; very long URLs are read whole; an empty list blocks nothing and
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.sinks.sketch_store import stored

#: (verdict, host, path) of the production rules.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Host labels and marks by which the query's list is made up from ``pages``.
REPORTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
JUNK_MARK = r"(%%%|###|\*\*\*|\$\$\$)"
LEAST_JUNK = 10

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a query string that do not change what a URL shows.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

WORDS = 8
BITS_PER_URL = 16
MOST_BLOCKS = 1 << 18
SALTS = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """One form of URLs that show the same page; null where there is no ``://``.

    Without scheme, ``www.``, default port, fragment, slashes at the end and tracking parameters; the other
    parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING)))
    asked = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the shortest first, so that a longer one goes before it; among equals block comes out on top
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made).otherwise(found)
    return found


def _block(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def _bits(canonical: Column) -> list[Column]:
    """The bit of each word of its block that a URL sets."""
    h = F.xxhash64(canonical, F.lit(1))
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", one, place) for place in places]


def filter_blocks(listed: int) -> int:
    """The number of blocks for so many URLs: about ``BITS_PER_URL`` bits each, up to the bound."""
    wanted = listed * BITS_PER_URL // (64 * WORDS)
    return min(MOST_BLOCKS, 1 << wanted.bit_length())


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the column ``canonical``; bits are joined up within the tasks first."""
    words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("canonical")))]
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(*words)


def with_possible(urls: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``urls`` (with a column ``canonical``) with ``possible``: whether the filter holds all its bits."""
    own = [bit.alias(f"b{i}") for i, bit in enumerate(_bits(F.col("canonical")))]
    asked = urls.select("*", _block(F.col("canonical"), blocks).alias("block"), *own)
    # the bound of the broadcast side is MOST_BLOCKS rows
    met = asked.join(F.broadcast(bloom), "block", "left")
    all_set = reduce(
        lambda a, b: a & b,
        [F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0 for i in range(WORDS)],
    )
    return met.select(*urls.columns, F.coalesce(all_set, F.lit(False)).alias("possible"))


def listed_rows(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (with ``canonical``) with ``on_list``, by the filter and the exact join behind it."""
    blocks = filter_blocks(listed.count())
    bloom = stored(bloom_filter(listed, blocks), "url-filter")
    rows = stored(with_possible(urls, bloom, blocks), "url-candidates")
    asked = rows.filter("possible")
    hits = asked.select("canonical").distinct().join(listed.hint("shuffle_hash"), "canonical", "left_semi")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    spread = hits.select("canonical", salts.alias("salt"), F.lit(True).alias("on_list"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    checked = asked.withColumn("salt", salt).join(spread, ["canonical", "salt"], "left")
    found = checked.select(*urls.columns, F.coalesce("on_list", F.lit(False)).alias("on_list"))
    passed_by = rows.filter("not possible").select(*urls.columns, F.lit(False).alias("on_list"))
    return passed_by.union(found)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """key, host, path, rule, verdict, canonical, on_list of every row of ``pages``.

    ``listed`` has the URLs to block in its column ``url``, in any form. ``on_list`` is null where a rule decides.
    """
    address = F.col(url)
    parsed = pages.select(
        F.col(key),
        url_host(address).alias("host"),
        url_path(address).alias("path"),
        canonical_url(address).alias("canonical"),
    )
    rule = fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    parsed = parsed.withColumn("fit", rule)
    wanted = stored(
        listed.select(canonical_url(F.col("url")).alias("canonical")).filter("canonical is not null").distinct(),
        "listed-urls",
    )
    open_rows = listed_rows(parsed.filter("fit is null"), wanted)
    decided = parsed.filter("fit is not null").withColumn("on_list", F.lit(None).cast("boolean"))
    by_list = F.when(F.col("on_list"), "block").otherwise("allow")
    return decided.union(open_rows).select(
        key,
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_list).alias("verdict"),
        "canonical",
        "on_list",
    )


def reported_urls(pages: DataFrame) -> DataFrame:
    """The query's list: URLs of pages on a reported host or with ``LEAST_JUNK`` marks in their html."""
    host = F.concat(F.lit("."), url_host(F.col("url")), F.lit("."))
    on_host = reduce(lambda a, b: a | b, [host.contains(f".{label}.") for label in REPORTED])
    junk = F.coalesce(F.regexp_count("html", F.lit(JUNK_MARK)), F.lit(0)) >= LEAST_JUNK
    return pages.filter(on_host | junk).select("url")


def _canonical_sql(url: str) -> str:
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"""CASE WHEN contains({url}, '://') THEN
      regexp_replace(regexp_replace({host}, '^www\\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
           string_split(regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
           lambda p : p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&'), ''), '')
    END"""


def judge_sql(rules: list[tuple[str, str, str]] | None = None) -> str:
    """DuckDB SQL of the query: rules and an exact lookup in the reported URLs of ``pages``."""
    table = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in (RULES if rules is None else rules))
    labels = " OR ".join(f"contains('.' || host || '.', '.{label}.')" for label in REPORTED)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {table}), parsed AS (
  SELECT page_id, html, row_number() OVER () AS row,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    {_canonical_sql("url")} AS canonical
  FROM pages
), listed AS (
  SELECT DISTINCT canonical FROM parsed WHERE canonical IS NOT NULL AND ({labels}
    OR len(regexp_extract_all(html, '{JUNK_MARK}')) >= {LEAST_JUNK})
), fits AS (
  SELECT p.row, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}},
    length(r.host || r.path) * 2 + (r.verdict = 'block')::INTEGER) AS fit
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row
)
SELECT page_id, p.host, p.path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  p.canonical, CASE WHEN fit IS NULL THEN l.canonical IS NOT NULL END AS on_list
FROM parsed p LEFT JOIN fits USING (row) LEFT JOIN listed l ON p.canonical = l.canonical"""
