"""URL judgement by rules for hosts and, where none fits, a weighted vocabulary.

One Aho-Corasick pass over the lower-cased url finds all terms; a hit counts only if neither neighbour
is a letter or digit. One strict term blocks, and so do two different soft terms.
"""

import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

STRICT = ("casino", "porn", "xxx", "adult", "viagra", "cialis", "warez", "torrent", "escort", "hentai")
SOFT = ("spam", "farm", "free", "bet", "bets", "betting", "cheap", "pill", "pills", "ads", "track", "tracker",
        "win", "winner", "poker", "slots", "loan", "loans", "dating", "click", "bonus", "crack")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
HITS = "struct<strict: int, soft: int>"
WORD = frozenset(string.ascii_letters + string.digits)


def parts(url):
    """(host, path): what follows the first `://` up to `/`, `?`, `#`, with A-Z lower-cased, and from
    there up to `?` or `#`. Both are empty for null and without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host, path, rules):
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path
    begins the path; null if none fits. Equally long rules count in the order given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def automaton(strict, soft):
    found = ahocorasick.Automaton()
    for kind, terms in ((0, strict), (1, soft)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def hits(url, search):
    """Numbers of different strict and soft terms that stand alone in the url."""
    text, terms = url.lower(), (set(), set())
    for last, (kind, term) in search.iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in WORD) and (last + 1 == len(text) or text[last + 1] not in WORD):
            terms[kind].add(term)
    return {"strict": len(terms[0]), "soft": len(terms[1])}


def vocabulary_hits(strict, soft):
    @F.arrow_udf(HITS)
    def count(urls: pa.Array) -> pa.Array:
        search = automaton(strict, soft)
        kind = pa.struct([("strict", pa.int32()), ("soft", pa.int32())])
        return pa.array([hits(u, search) if u else {"strict": 0, "soft": 0} for u in urls.to_pylist()], kind)
    return count


def judge(pages, rules=RULES, strict=STRICT, soft=SOFT, soft_limit=2):
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row of pages (page_id, url).
    Null and empty urls have no hits and are allowed."""
    found = pages.select("page_id", "url", vocabulary_hits(strict, soft)("url").alias("hits"))
    host, path = parts(F.col("url"))
    found = found.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bad = (F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_limit)
    return found.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                        F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))


def oracle(rules=RULES, strict=STRICT, soft=SOFT, soft_limit=2):
    """The same in DuckDB SQL, with one regular expression per term instead of the automaton."""
    def count(terms):
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = {r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')" for r in longest}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[1]}{r[2]}'" for r in longest) + " END"
    ruled = " ".join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in longest)
    return f"""
WITH u AS (SELECT page_id, coalesce(lower(url), '') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, low,
    translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits FROM p)
SELECT page_id, host, path, {rule} AS rule,
    CASE {ruled} WHEN strict_hits > 0 OR soft_hits >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
    strict_hits, soft_hits FROM h"""
