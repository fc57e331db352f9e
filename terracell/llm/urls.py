"""URL filters: rules by host and path, and a judge of words for the urls that no rule fits.

Host and path are cut into tokens (runs of letters). The judge splits tokens that are no words of its
own into words by a unigram Viterbi pass (``freebets`` becomes ``free bets``) and adds up what
multinomial naive Bayes says of each word. The segmenter's unigrams are counted over a whole corpus,
to which the judge's words are added. A part that is no known word has the chance of a random word of
its length, a tenth for each letter: so a known word splits off a name (``megacasino``) if it is long
or frequent enough, and none splits off where the rest makes no sense (``essex``, ``netflix``).

The classifier learns from labelled urls (those that the rules decide, say), at most ``max_rows`` of
them, and from labelled lines of topic words; both are parameters. The urls' words count as much in
all as the lines do. Words of neither class leave the odds as they are, and the prior favours allowing.

All of it runs as joins. Distinct tokens are known by a hash; windows of a token yield its substrings,
which meet the unigrams by a sort-merge join, and what is known of a token meets it again by its hash.
A token of n letters makes 22 n pieces, none of which carries the token, and is split in time in
proportion to n. Neither the vocabulary nor the tokens are gathered anywhere; the judge's own words,
which are bounded by its lines and ``max_rows``, travel with the tasks.

Defined results: null, and a url without ``://``, have an empty host and path, fit no rule and are
judged on no words, hence allowed; of two rules of equal length the first given wins. Repeated urls have
repeated results; urls of any length are read whole (a known word has at most LONGEST letters); an empty
table gives an empty one. All columns come back as they were, but for those named like the results,
which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Letters of the shortest part and of the longest word.
LEAST, LONGEST = 3, 24
#: Letters of a token that one window of it starts pieces from.
WINDOW = 64
#: Labelled urls that a judge learns from, at most.
MAX_ROWS = 20_000
#: Count of a judge's word among a million words of the corpus, where the corpus hardly has it.
SEEDED = 20.0
#: Labelled lines to learn from: topics that a crawl leaves out, topics that it keeps, and words that
#: say nothing. They are general topic words, not taken from any table.
BLOCK_LINES = (
    "casino casinos gambling poker roulette slots jackpot bets betting wager lottery bingo",
    "adult porn xxx sex nudes cams escort erotic fetish hentai",
    "spam linkfarm seo backlinks clickbait popunder",
    "pills viagra cialis pharmacy steroids weightloss",
    "payday doubler forex binary scam",
    "warez crack cracked keygen torrent pirate nulled hack cheats malware phishing",
    "replica fake rolex",
)
ALLOW_LINES = (
    "news daily weather sport local world report press journal magazine",
    "article archive post story review author editor column",
    "wiki encyclopedia science research university school library college institute",
    "docs manual help support reference guide tutorial learning course lesson",
    "language translation dictionary grammar poem novel book books",
    "museum garden travel city map history music art film theatre",
    "recipe kitchen family health hospital clinic nature animal",
    "data code software project forum community developer source",
    "government council court law police public service transport",
)
NEUTRAL_LINES = (
    "www blog mobile example com net org html htm php index page home site web app shop store",
    "free online live best top video games download buy win farm cheap discount deals credit loan cash drugs",
)


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, as in ``example.org/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Judge:
    """Multinomial naive Bayes over words, with add-``smooth`` counts; neutral words are known, and even.

    ``learned``: words of labelled urls with their counts in the blocked and in the allowed ones.
    """

    block: tuple[str, ...] = BLOCK_LINES
    allow: tuple[str, ...] = ALLOW_LINES
    neutral: tuple[str, ...] = NEUTRAL_LINES
    learned: tuple[tuple[str, int, int], ...] = ()
    prior: float = 0.2
    margin: float = 0.0
    smooth: float = 0.1
    odds: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        sides = [Counter(w for line in lines for w in line.lower().split()) for lines in (self.block, self.allow)]
        for i, side in enumerate(sides):
            own, seen = side.total(), sum(x[1 + i] for x in self.learned)
            for w, *n in self.learned:
                side[w] += n[i] * (own or seen) / max(1, seen)
        words = sides[0].keys() | sides[1].keys()
        share = lambda c, w: (c[w] + self.smooth) / (c.total() + self.smooth * len(words))
        even = {w: 0.0 for line in self.neutral for w in line.lower().split()}
        object.__setattr__(self, "odds", even | {w: math.log(share(sides[0], w) / share(sides[1], w)) for w in sorted(words)})

    @property
    def start(self) -> float:
        return math.log(self.prior / (1 - self.prior))


def segment(token: str, cost: dict[str, float], total: float) -> list[str]:
    """The split of least cost into known words and unknown parts, each of the latter costing ln(total / 10) and ln 10 a letter."""
    first, more = math.log(total / 10), math.log(10)
    # Least costs up to each letter, with a known word last, or an unknown part; where that began.
    known, unknown, began, since = [0.0], [math.inf], [0], [0]
    for i in range(1, len(token) + 1):
        a, b = unknown[i - 1] + more, known[i - 1] + first + more
        unknown.append(min(a, b))
        since.append(since[i - 1] if a < b else i - 1)
        best, at = math.inf, 0
        for k in range(max(0, i - LONGEST), i - LEAST + 1):
            c = cost.get(token[k:i])
            if c is not None and min(known[k], unknown[k]) + c < best:
                best, at = min(known[k], unknown[k]) + c, k
        known.append(best)
        began.append(at)
    out, i = [], len(token)
    is_known = known[i] <= unknown[i]
    while i:
        k = began[i] if is_known else since[i]
        out.append(token[k:i])
        is_known = not is_known or known[k] <= unknown[k]
        i = k
    return out[::-1]


def unigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every word of LEAST to LONGEST letters in all texts, lower-cased."""
    words = F.regexp_extract_all(F.lower(texts[text]), F.lit(r"(?<!\p{L})\p{L}{%d,%d}(?!\p{L})" % (LEAST, LONGEST)), F.lit(0))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _tokens(host: Column, path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.concat(host, F.lit(" "), path)), F.lit(r"\p{L}+"), F.lit(0))


def split_tokens(tokens: DataFrame, counts: DataFrame | None, judge: Judge = Judge()) -> DataFrame:
    """(token, words, odds) of distinct tokens (``token``) that have a part the corpus or the judge knows."""
    spark = tokens.sparkSession
    seeds = spark.createDataFrame([(w, 0.0) for w in judge.odds if LEAST <= len(w) <= LONGEST], "word string, n double")
    known = seeds if counts is None else counts.select("word", F.col("n").cast("double").alias("n")).union(seeds)
    total = float((None if counts is None else counts.agg(F.sum("n")).first()[0]) or 1_000_000)
    own = seeds.select("word", F.lit(SEEDED * total / 1e6).alias("least")).distinct()
    known = known.groupBy("word").agg(F.sum("n").alias("n")).join(F.broadcast(own), "word", "left").select("word", F.greatest("n", "least").alias("n"))
    tokens = tokens.where(F.length("token") >= LEAST).select(F.xxhash64("token").alias("id"), "token")
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length("token") - 1) / WINDOW).cast("int")), lambda w: F.substring(F.col("token"), w * WINDOW + 1, F.lit(WINDOW + LONGEST - 1)))
    pieces = tokens.select("id", F.explode(windows).alias("window"))
    # Every substring that may be a word, where it starts in the window's own letters.
    starts = F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("window") - LEAST + 1))
    lengths = lambda i: F.sequence(F.lit(LEAST), F.least(F.lit(LONGEST), F.length("window") - i + 1))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.substring(F.col("window"), i, n)))))
    pieces = pieces.where(F.length("window") >= LEAST).select("id", F.explode(parts).alias("word"))
    met = pieces.join(known.hint("merge"), "word").groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    met = tokens.join(met, "id").select("token", "known")
    odds = judge.odds

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segment(t, {k["word"]: -math.log(k["n"] / total) + 1e-9 for k in ks}, total) for t, ks in zip(batch.column("token").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(words, pa.list_(pa.string())), pa.array([sum(odds.get(w, 0.0) for w in ws) for ws in words], pa.float64())], ["token", "words", "odds"])

    return map_rows(met, run, "token string, words array<string>, odds double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of what follows the first ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _ruled(df: DataFrame, rules: Iterable[Rule], url: str, kept: list[str]) -> DataFrame:
    """``row``, ``host``, ``path`` and the longest rule that fits, if any, with its verdict."""
    host, path = host_and_path(df[url])
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        ok = _fits(r, F.col("host"), F.col("path"))
        text, verdict = F.when(ok, F.lit(r.text)).otherwise(text), F.when(ok, F.lit(r.verdict)).otherwise(verdict)
    return df.select(F.struct(*(df[c] for c in kept)).alias("row") if kept else F.lit(0).alias("row"), host.alias("host"), path.alias("path")).withColumns({"rule": text, "verdict": verdict})


def learn(df: DataFrame, rules: Iterable[Rule], counts: DataFrame | None = None, base: Judge = Judge(), url: str = "url", max_rows: int = MAX_ROWS) -> Judge:
    """A judge that has learnt from the urls that a rule decides, too: from at most ``max_rows`` of their hosts and paths, drawn by hash.

    Words that stand in the rules themselves tell nothing that the rules do not, and are left out.
    """
    decided = _ruled(df, rules, url, []).where("rule is not null").select("host", "path", "verdict").distinct()
    drawn = decided.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows)
    tokens = cut(drawn.select("verdict", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).groupBy("token").pivot("verdict", ["block", "allow"]).count().na.fill(0))
    words = split_tokens(tokens.select("token"), counts, base).select("token", "words")
    said = tokens.join(words, "token", "left").select(F.explode(F.coalesce("words", F.array("token"))).alias("word"), "block", "allow")
    mine = {t for r in rules for t in re.findall(r"[^\W\d_]+", r.text.lower())}
    rows = said.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).collect()
    return replace(base, learned=tuple(sorted(tuple(r) for r in rows if len(r["word"]) >= LEAST and r["word"] not in mine)))


def judge_urls(df: DataFrame, rules: Iterable[Rule] = (), counts: DataFrame | None = None, judge: Judge = Judge(), url: str = "url") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, ``verdict`` and ``odds`` (the judge's, where no rule fits).

    ``counts``: (word, n), the unigrams of a corpus.
    """
    made = ["host", "path", "rule", "verdict", "odds"]
    kept = [c for c in df.columns if c not in made]
    rows = _ruled(df, rules, url, kept)

    # The judge's own words need no splitting, and shorter tokens have nothing to split.
    own = F.broadcast(df.sparkSession.createDataFrame(list(judge.odds.items()), "token string, odds double"))
    asked = rows.where("rule is null").select("host", "path").distinct().withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    plain = asked.join(own, "token").select("host", "path", "odds")
    other = asked.where(F.length("token") >= 2 * LEAST).join(own, "token", "left_anti")
    # Most tokens say nothing, and leave no row.
    split = split_tokens(other.select("token").distinct(), counts, judge).where("odds != 0").select("token", "odds")
    said = plain.unionByName(other.join(split, "token").select("host", "path", "odds")).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    out = rows.where("rule is null").join(said, ["host", "path"], "left").select("row", "host", "path", "rule", "verdict", (F.lit(judge.start) + F.coalesce("odds", F.lit(0.0))).alias("odds"))
    out = out.withColumn("verdict", F.when(F.col("odds") > judge.margin, "block").otherwise("allow"))
    out = rows.where("rule is not null").withColumn("odds", F.lit(None).cast("double")).unionByName(out)
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *made)
