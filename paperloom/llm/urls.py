"""URL filters: allow and block rules, and for urls that no rule decides a logistic regression on hashed character
n-grams of host and path. Scoring uses SQL functions only; the weights come from a small labelled table of urls.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict). Fixed values of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Words of sites that are to be blocked, by kind: those that go first in a name and those that follow.
BLOCKED = {
    "gambling": ("casino lucky jackpot mega royal betting poker slots spin bonus vegas roulette free", "slots bet bets win wins casino jackpot poker spins bonus roulette club play"),
    "pharmacy": ("cheap generic online discount quick rx diet order best canada", "meds pills pill pharmacy tablets drugs viagra slim dose cure"),
    "adult": ("adult sexy hot naked xxx live erotic mature private wild", "cams cam videos chat singles dating tube girls porn x"),
    "tracking": ("ads ad track click banner pixel promo popup affiliate traffic", "server track tracker tracking clicks counter network redirect exchange pixels"),
    "farms": ("spam link backlink seo clone scrape keyword doorway bulk fake", "farm farms links factory network blast boost mill spam ranks"),
    "phishing": ("secure account verify login update signin wallet bank unlock confirm", "login verify account update alert support billing recovery wallet check"),
}
#: Words of plain sites, in the same two places.
PLAIN = {
    "press": ("morning evening daily city river north harbour village weekly open", "news post times herald gazette journal review record letter report"),
    "learning": ("history garden music physics language science art library museum school", "notes lectures archive guide courses lessons wiki books reader club"),
    "home": ("bread kitchen wood paper cloth tea stone bicycle bird tree", "shop blog forum house works pages studio letters society diary"),
    "public": ("town county health weather transport water parish forest coast road", "council service office board authority trust centre map maps union"),
}
#: Letters of which invented words are made: plain sites whose names mean nothing.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
ENDINGS = ("example.com", "example.net", "site.test", "page.test")
FRONTS = ("", "www.", "m.", "blog.", "")
BLOCKED_PATHS = ("/buy/now", "/en/{}", "/click?id={}", "/de/{}.html", "/free/{}", "/", "/fr/{}", "/login", "/offer-{}", "/es/{}")
PLAIN_PATHS = ("/world/{}.html", "/en/{}", "/de/{}.html", "/about", "/fr/{}", "/2021/{}/notes", "/", "/es/{}", "/wiki/page-{}", "/opening-hours")


def labelled(each: int = 30, invented: int = 160) -> tuple[tuple[str, int], ...]:
    """Host and path of made-up urls, and whether they are to be blocked (1): `each` of every kind, and `invented` ones of
    syllables. Names join two words by a hyphen, by nothing, or the other way round."""
    rows = []
    for label, kinds, paths in ((1, BLOCKED, BLOCKED_PATHS), (0, PLAIN, PLAIN_PATHS)):
        for k, (first, second) in enumerate(kinds.values()):
            x, y = first.split(), second.split()
            for i in range(each):
                a, b = x[(i * 7 + k) % len(x)], y[(i * 3 + i // len(y) + k) % len(y)]
                name = (f"{a}-{b}", f"{a}{b}", f"{b}-{a}", f"{a}-{b}")[i % 4]
                rows.append((FRONTS[(i + k) % 5] + f"{name}.{ENDINGS[(i + i // 4) % 4]}" + paths[(i * 3 + k) % 10].format(i * 37 + k), label))
    for i in range(invented):
        name = "".join(SYLLABLES[(i * (1 + j * j) + i // (3 + 4 * j)) % len(SYLLABLES)] for j in range(2 + i % 3))
        rows.append((FRONTS[i % 5] + f"{name}.{ENDINGS[(i + i // 4) % 4]}" + PLAIN_PATHS[(i * 3) % 10].format(i * 41), 0))
    return tuple(rows)


BUCKETS = 4096
#: Factors of the three characters of an n-gram in its bucket's number.
FACTORS = (7919, 131, 17)
#: Scores are whole numbers so that their sum doesn't depend on the order: one unit is 1/SCALE of log odds.
SCALE = 10_000


def _bucket(gram: str) -> int:
    return sum(f * ord(c) for f, c in zip(FACTORS, gram, strict=True)) % BUCKETS


@functools.lru_cache(4)
def train(rows: tuple = labelled(), steps: int = 200, rate: float = 1.0, ridge: float = 5e-4) -> tuple[int, tuple[int, ...]]:
    """(bias, weight of each bucket) in units of 1/SCALE, from a few hundred labelled urls (host and path, 0 or 1)."""
    grams = [([_bucket(u[i : i + 3]) for i in range(len(u) - 2)], y) for u, y in rows]
    used = sorted({g for gs, _ in grams for g in gs})
    w, b = dict.fromkeys(used, 0.0), -1.0
    for _ in range(steps):
        slope = {g: -ridge * x for g, x in w.items()}
        for gs, y in grams:
            z = b + sum(map(w.__getitem__, gs))
            off = (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / len(grams)
            for g in gs:
                slope[g] += off
        w = {g: x + rate * slope[g] for g, x in w.items()}
    return round(b * SCALE), tuple(round(w.get(g, 0.0) * SCALE) for g in range(BUCKETS))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
    end. Both are empty for null and for urls without `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), rest.substr(F.length(host) + 1, F.length(rest))


def log_odds(text: Column, model: tuple[int, tuple[int, ...]]) -> Column:
    """Bias and weights of all three-character n-grams of `text`, in units of 1/SCALE."""
    bias, weights = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    gram = lambda c, i: (F.get(c, i) * FACTORS[0] + F.get(c, i + 1) * FACTORS[1] + F.get(c, i + 2) * FACTORS[2]) % BUCKETS
    # Code points as an array, named by a one-element transform so that they are taken apart once.
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    total = F.get(F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 3), F.lit(bias), lambda acc, i: acc + F.get(table, gram(c, i)))), F.lit(0))
    return F.when(F.length(text) < 3, F.lit(bias)).otherwise(total)


def judge(df: DataFrame, url: str = "url", rules: tuple = RULES, model: tuple | None = None) -> DataFrame:
    """Adds host, path, rule (null if none fits), log_odds and verdict (allow or block); equal names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. Urls that no
    rule fits are blocked if their log odds are positive. Null and empty urls have an empty host and path, which no rule
    fits, and the bias alone decides. Repeated rows are judged alike.
    """
    model = model or train()
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    h, p = F.col("host"), F.col("path")
    rule = verdict = None
    for name, start, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    df = df.withColumn("rule", F.lit(None).cast("string") if rule is None else rule)
    df = df.withColumn("log_odds", log_odds(F.concat(h, p), model).cast("long") / SCALE)
    guess = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return df.withColumn("verdict", guess if verdict is None else F.coalesce(verdict, guess))


def oracle(rules: tuple = RULES) -> str:
    bias, weights = train()
    cases = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))"
    gram = " + ".join(f"{f} * ascii(substr(u, i + {k}, 1))" for k, f in enumerate(FACTORS))
    return f"""
WITH cut AS (
  SELECT page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM cut
), scored AS (
  SELECT *, {bias} + coalesce(list_sum(list_transform(range(1, greatest(length(u) - 1, 1)), lambda i: w[CAST(({gram}) % {BUCKETS} AS BIGINT) + 1])), 0) AS z
  FROM (SELECT *, host || path AS u, [{", ".join(map(str, weights))}] AS w FROM part)
)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r[0]}{r[1]}'" for r in cases)} END AS rule,
       CAST(z AS DOUBLE) / {SCALE} AS log_odds,
       CASE {" ".join(f"WHEN {fits(r)} THEN '{r[2]}'" for r in cases)} WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM scored"""
