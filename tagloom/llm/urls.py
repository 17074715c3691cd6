"""URL filters: rules on hosts and paths, and link-graph propagation for the rest.

A rule decides the urls of its host and all subdomains whose path starts with its path;
the longest rule wins. Other urls get the verdict of their host: trust spreads from
trusted seed hosts along links (personalised PageRank), distrust from blocked seed hosts
against them (what links to a bad host is suspect), and a host whose distrust outweighs
its trust is blocked. Seeds are hosts most of whose pages a rule allows or blocks.

Links are addresses with a host in ``href`` or ``src``, with a scheme or without; pages of one host share their edges,
which are counted before any shuffle. Scores are held per host, in a table per round.
Rounds go on until no further host is reached and no verdict can change. A round changes
all scores together by at most ``DAMPING`` times as much as the one before, so what all
later rounds can still change is known, the slack; a host whose trust and distrust differ
by more keeps its verdict. Where some differ by less, rounds go on until the slack is below
``TOLERANCE``, about 190 rounds whatever the size; a host whose scores are equal within it
is tied. Ties are allowed. DataFrame functions throughout.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule
and the verdict ``allow``; null pages have no links; repeated rows repeat; hosts without
a path to any seed are allowed; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..plans.shared import fresh_path, through_table

# Fixed values: (host and path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING = 0.85
TOLERANCE = 1e-12  # of the scores, which sum to one at most for each kind
SLOTS = 3  # tables of scores side by side: one is read while the next is written
SEED_SHARE = 0.5  # of a host's pages that rules must decide one way
EDGE = r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, tail = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + tail))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from host to another host, counted."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(EDGE), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, slack of personalised PageRank, after ``rounds`` or when no verdict can change.

    ``seeds``: host, trusted, blocked (0 or more). Each kind's restart sums to one. Trust
    is handed to link targets in proportion to a host's links, distrust to link sources
    in proportion to the links that reach the host.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("out")).alias("along"), (F.col("n") / F.col("into")).alias("against"))
    zero = F.lit(0.0)
    links = through_table(shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), "along", zero.alias("against")).union(
        shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("along"), "against")), "edges")
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    restart = through_table(seeds.select(
        "host", (F.col("trusted") / max(total["t"] or 0, 1)).alias("t0"),
        (F.col("blocked") / max(total["b"] or 0, 1)).alias("b0")).where("t0 > 0 OR b0 > 0"), "restart")
    state = restart.select("host", F.col("t0").alias("trust"), F.col("b0").alias("distrust"))
    hosts, n, slack, place = 0, 0, 2.0 / (1 - damping), fresh_path(edges.sparkSession, "scores")
    while rounds is None or n < rounds:
        n += 1
        moved = state.join(links, "host").select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("along")).alias("trust"),
            (damping * F.col("distrust") * F.col("against")).alias("distrust"), zero.alias("t1"), zero.alias("b1")).where("trust > 0 OR distrust > 0")
        again = restart.select("host", (1 - damping) * F.col("t0"), (1 - damping) * F.col("b0"), zero, zero)
        before = state.select("host", zero, zero, "trust", "distrust")
        sums = moved.union(again).union(before).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "t1", "b1")))
        told, slack = Observation(), slack * damping
        # Hosts never leave: each round reaches those of the one before.
        seen = sums.observe(
            told, F.sum(F.abs(F.col("trust") - F.col("t1")) + F.abs(F.col("distrust") - F.col("b1"))).alias("change"),
            F.count_if((F.abs(F.col("trust") - F.col("distrust")) <= slack) & (F.col("trust") + F.col("distrust") > 0)).alias("open"),
            F.count_if(F.col("trust") > 0).alias("t"), F.count_if(F.col("distrust") > 0).alias("b"))
        path = f"{place}/{n % SLOTS}"
        seen.select("host", "trust", "distrust").write.mode("overwrite").parquet(path)
        state = edges.sparkSession.read.schema("host string, trust double, distrust double").parquet(path)
        reached = told.get["t"] + told.get["b"]
        if rounds is None and reached == hosts and (not told.get["open"] or slack <= tolerance):
            break
        # All later rounds together change the scores by this much at most.
        hosts, slack = reached, min(slack, (told.get["change"] or 0) * damping / (1 - damping))
    return state.withColumn("slack", F.lit(max(slack, tolerance)))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, share: float = SEED_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    url = F.col("url").cast("string")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # Pages per host and outcome: combined before the shuffle, so no host is hot.
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("found.verdict") == "allow").alias("good"),
        F.count_if(F.col("found.verdict") == "block").alias("bad"))
    seeds = through_table(counts.select(
        "host", F.when(F.col("good") > share * F.col("pages"), F.col("good")).otherwise(0).alias("trusted"),
        F.when(F.col("bad") > share * F.col("pages"), F.col("bad")).otherwise(0).alias("blocked")), "seeds")
    scores = propagate(host_edges(pages), seeds)
    bad = scores.where("distrust > trust + slack").select(F.col("host").alias("bad_host"))
    return judged.join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
