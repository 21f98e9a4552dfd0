"""URL filters: base rules on host and path, and pattern rules indexed by their rarest token.

Base rules fit a host and all its subdomains if the path starts with the rule's; the longest rule
wins. Where none fits, pattern rules decide. A pattern is text with ``*`` for any run of characters,
``^`` for a separator or the end and a leading ``||`` for the start of a host label; it stands in a
lower-cased URL if its regular expression does. Of the whole alphanumeric tokens that a pattern
demands, the one that is rarest among all URLs of the table indexes it, so that a URL's tokens fetch
the few patterns that can match and only their regular expressions run. A pattern with ``@@`` before
it makes an exception: its match allows what others block.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule, and its
pattern rules see the text as it is (null: none match), so it is allowed unless a pattern blocks it;
repeated rows get rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import LOWER, UPPER, per_row

#: (verdict, host, path) of the base rules. Fixed values of the query's contract.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What link farms, pill and betting shops, adult sites, cracked software and trackers are about.
TOPICS = (
    "casino", "poker", "roulette", "slots", "bingo", "betting", "jackpot", "viagra", "cialis", "cheap-pills", "pharmacy-online", "steroids", "payday-loans", "forex-signals", "replica-watches",
    "replica-bags", "fake-ids", "warez", "keygen", "torrent-mirror", "cracked-apps", "serialz", "xxx", "adult-cams", "escorts", "hentai", "hookups", "adserver", "doubleclick", "popunder",
    "tracker", "clicktrack", "affiliates", "spam-farm", "link-farm", "seo-links", "doorway-pages", "get-rich", "miracle-diet", "free-spins",
)
#: What such a site wants of its visitor, at the end of a path under the topic.
ACTIONS = ("bonus", "download", "signup", "buy", "order", "win", "click", "claim")
#: Where a topic stands: a host label of its own, the end of a longer label, and a path to an action.
SHAPES = ("||{topic}.", "-{topic}.", "/{topic}/*/{action}^")
#: Further patterns, and exceptions.
OTHERS = (
    "/cheap-pills/", "/free-spins/", "/payday-loan^", "/replica-watches/", "/buy-viagra^", "/no-prescription/", "/live-cams/", "/warez/", "/keygen/", "/link-farm/",
    "/xxx/*/video^", "/click/track?*affid=", "?phpsessid=", "&sessionid=", "@@||example.edu^", "@@/robots.txt^",
)


def built_patterns(topics: Sequence[str] = TOPICS, actions: Sequence[str] = ACTIONS, shapes: Sequence[str] = SHAPES, others: Sequence[str] = OTHERS) -> tuple[str, ...]:
    """Each topic in each shape with each action, and the others; each pattern once."""
    made = [s.format(topic=t, action=a) for s in shapes for t in topics for a in (actions if "{action}" in s else ("",))]
    return tuple(dict.fromkeys([*made, *others]))


#: Some hundreds of patterns.
PATTERNS = built_patterns()


def table_patterns(rules: DataFrame, column: str = "pattern", most: int = 200_000) -> tuple[str, ...]:
    """Patterns of a table of rules, which tasks hold in memory: an error if it has over ``most``."""
    rows = rules.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    return tuple(sorted(r[0] for r in rows))


TOKEN = re.compile("[a-z0-9]+")
#: A separator of tokens that a pattern gives literally.
SEPARATOR = r"[^a-z0-9]"


def lower_ascii(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def expression(pattern: str) -> str:
    """The regular expression of a pattern, without its ``@@``."""
    body, out = pattern.removeprefix("@@"), ""
    if body.startswith("||"):
        body, out = body[2:], r"^[^:/?#]*://([^/?#]*\.)?"
    for c in body:
        out += ".*" if c == "*" else f"({SEPARATOR}|$)" if c == "^" else re.escape(c)
    return out


def whole_tokens(pattern: str) -> list[str]:
    """Tokens that every URL with the pattern has: literal runs with a literal separator, ``^`` or a
    label's start on either side."""
    body = pattern.removeprefix("@@")
    anchored = body.startswith("||")
    body = body[2:] if anchored else body
    found = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else "." if anchored else "*"
        after = body[m.end()] if m.end() < len(body) else "*"
        if before != "*" and after != "*":
            found.append(m.group())
    if not found:
        raise ValueError(f"{pattern}: no whole token to index")
    return found


class Filter:
    """Base rules by host, pattern rules by their rarest token."""

    def __init__(self, base, patterns, counts: dict[str, int]):
        self.base: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in base:
            self.base.setdefault(host, []).append((path, f"{host}{path}", verdict))
        self.index: dict[str, list[tuple[re.Pattern, str, str]]] = {}
        for p in patterns:
            rarest = min(whole_tokens(p), key=lambda t: (counts.get(t, 0), t))
            verdict = "allow" if p.startswith("@@") else "block"
            self.index.setdefault(rarest, []).append((re.compile(expression(p), re.S), p, verdict))

    @staticmethod
    def parts(url: str | None) -> tuple[str, str]:
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        return lower_ascii(host), re.match("[^?#]*", rest[len(host) :]).group()

    def base_rule(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = host
        while at:
            for p, name, verdict in self.base.get(at, ()):
                if path.startswith(p) and (best is None or len(name) > len(best[0])):
                    best = (name, verdict)
            at = at.partition(".")[2]
        return best

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, rule, verdict, pattern"""
        host, path = self.parts(url)
        rule = self.base_rule(host, path)
        if rule:
            return host, path, rule[0], rule[1], None
        low = lower_ascii(url or "")
        hits = []
        for token in set(TOKEN.findall(low)):
            hits += [(v, p) for own, p, v in self.index.get(token, ()) if own.search(low)]
        if not hits:
            return host, path, None, "allow", None
        verdict, pattern = min(hits)  # an exception goes before a block
        return host, path, None, verdict, pattern


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of ``tokens`` stands (the driver sees a number per token)."""
    low = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    seen = pages.select(F.explode(F.array_distinct(F.split(low, SEPARATOR))).alias("token"))
    rows = seen.filter(F.col("token").isin(tokens)).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def report(pages: DataFrame, base=BASE_RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict and the deciding pattern of every page."""
    counts = token_counts(pages, sorted({t for p in patterns for t in whole_tokens(p)}))

    def make():
        own = Filter(base, patterns, counts)
        return lambda urls: list(zip(*[own.judge(u.decode() if u is not None else None) for u in urls], strict=True)) or [[]] * 5

    added = [(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "pattern")]
    return per_row(pages.select("page_id", F.col("url").cast("string")), ["page_id"], ["url"], added, make)


def sql(base=BASE_RULES, patterns=PATTERNS) -> str:
    """The same by trying every rule and every regular expression on every page."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [
        f"WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}) THEN {{}}"
        for _, h, p in sorted(base, key=lambda r: -len(r[1] + r[2]))
    ]
    names = [q(h + p) for _, h, p in sorted(base, key=lambda r: -len(r[1] + r[2]))]
    verdicts = [q(v) for v, h, p in sorted(base, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f.format(n) for f, n in zip(fits, names, strict=True))
    verdict = " ".join(f.format(v) for f, v in zip(fits, verdicts, strict=True))
    tried = [("allow" if p.startswith("@@") else "block", p) for p in patterns]
    hit = " ".join(f"WHEN regexp_matches(low, {q('(?s)' + expression(p))}) THEN {q(p)}" for _, p in sorted(tried))
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages
), r AS (
  SELECT page_id, low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), j AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS own, CASE {hit} END AS hit FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN own IS NOT NULL THEN own WHEN hit IS NULL OR starts_with(hit, '@@') THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN own IS NULL THEN hit END AS pattern
FROM j
"""
