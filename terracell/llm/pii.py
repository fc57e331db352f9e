"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

All of it is Spark SQL expressions. For each kind, ``split`` and ``regexp_extract_all`` with one
pattern give the stretches between matches and the matches; running sums of their lengths give each
match its place in code points. A match then passes its kind's test: parts of an address at most 255,
Luhn's sum for cards, the remainder 97 leaves for bank accounts, counts of digits. Kinds that are
weak by themselves have a base score that words in the 40 characters before or after a match raise,
whatever else was matched there; a span is reported from ``THRESHOLD`` on. The patterns start where the match before ended or where no longer
match could have started, and their repetitions never step back, so that a text of any length takes
time in proportion to it.

Defined results: null text is empty text; a text without a match has no spans and is unchanged;
spans of one kind never overlap, spans of two kinds may, and all of them are reported, in the order of
their starts and, where these are equal, of KINDS. Repeated rows have repeated results, and an empty table gives an
empty one. Redaction goes kind by kind, so a later kind sees what the earlier ones left. Other columns
travel in a struct and come back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Matches of a text that one inner sum takes: running sums go over blocks, then over their totals.
BLOCK = 64
#: Characters before and after a match that are its context, and matches of 10 characters or more that fill them.
NEAR, FILL = 40, 4


@dataclass(frozen=True)
class Kind:
    """``guard``: what any match holds; ``valid``: SQL of a match's test; ``context``: words that raise the score."""

    name: str
    pattern: str
    guard: str
    valid: Callable[[str], str]
    base: bool = True
    score: float = 1.0
    context: str = ""
    bonus: float = 0.0

    def worth(self, i: str) -> str:
        """SQL: a passing match's score, from what stands before and after it."""
        # Not cut out of the text by place, which would count from its start for every match.
        before = f"concat(array_join(slice(_tails, greatest(1, {i} - {FILL - 1}), least({i}, {FILL})), ''), _parts[{i}])"
        after = f"concat(_parts[{i} + 1], array_join(slice(_heads, {i} + 2, {FILL}), ''))"
        said = lambda x: f"lower({x}) rlike '{self.context}'"
        near = f" + if({said(f'right({before}, {NEAR})')} or {said(f'left({after}, {NEAR})')}, {self.bonus}D, 0D)" if self.context else ""
        return f"({self.score}D{near})"

    def accepts(self, match: str, i: str) -> str:
        return f"(({self.valid(match)}) and {self.worth(i)} >= {THRESHOLD}D)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _letters(m: str) -> str:
    return f"filter(split({m}, ''), c -> c != '')"


def _luhn(m: str) -> str:
    """From the right, every second digit doubled, less 9 if that is above 9; the sum ends in 0."""
    doubled = f"transform({_letters(f'reverse({_digits(m)})')}, (c, i) -> cast(c as int) * (1 + i % 2))"
    return f"aggregate({doubled}, 0, (s, x) -> s + if(x > 9, x - 9, x)) % 10 = 0"


def _mod97(m: str) -> str:
    """The first four characters last, letters as 10 to 35: the number leaves 1."""
    s = f"regexp_replace({m}, ' ', '')"
    value = "if(c >= 'A', ascii(c) - 55, ascii(c) - 48)"
    return f"aggregate({_letters(f'concat(substring({s}, 5), substring({s}, 1, 4))')}, 0, (r, c) -> (r * if(c >= 'A', 100, 10) + {value}) % 97) = 1"


def _byte_parts(m: str) -> str:
    return f"forall(split({m}, '[.]'), p -> length(regexp_replace(p, '^0+', '')) < 4 and cast(concat('0', right(p, 3)) as int) <= 255)"


#: Base kinds are in the order in which spans that start together are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: "true"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _byte_parts),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", lambda m: f"length({_digits(m)}) between 14 and 19 and {_luhn(m)}"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: f"length({_digits(m)}) between 10 and 15"),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "",
        lambda m: f"length(regexp_replace({m}, ' ', '')) between 15 and 34 and {_mod97(m)}",
        base=False, score=0.7, context="iban|account|konto|compte|cuenta|bank", bonus=0.3,
    ),
    Kind(
        "ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-",
        lambda m: f"substring({m}, 1, 3) not in ('000', '666') and {m} < '9' and substring({m}, 5, 2) != '00' and right({m}, 4) != '0000'",
        base=False, score=0.2, context="ssn|social security|social-security|tax id", bonus=0.5,
    ),
)
SPAN = "struct<start:bigint,at:int,end:bigint,kind:string,base:boolean,score:double>"


def _sums(array: str) -> str:
    """SQL: running sums of a short array."""
    none = "cast(array() as array<bigint>)"
    return f"aggregate({array}, named_struct('s', 0L, 'r', {none}), (acc, x) -> named_struct('s', acc.s + x, 'r', concat(acc.r, array(acc.s + x))), acc -> acc.r)"


def _proposed(df: DataFrame, kind: Kind) -> DataFrame:
    """``_hits``: the kind's matches in ``_text``; ``_parts``: what lies between them; ``_tails``, ``_heads``: each match and what is near before it, after it."""
    t = F.col("_text")
    may = t.contains(kind.guard) if kind.guard else t.rlike("[0-9]")
    hits = F.when(may, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    df = df.withColumn("_hits", hits).withColumn("_parts", F.when(F.size("_hits") > 0, F.split(t, kind.pattern, -1)).otherwise(F.array(t)))
    if not kind.context:
        return df
    near = {"_tails": f"concat(right(_parts[i], {NEAR}), m)", "_heads": f"concat(m, left(_parts[i + 1], {NEAR}))"}
    return df.withColumns({n: F.expr(f"transform(_hits, (m, i) -> {x})") for n, x in near.items()})


def _placed(df: DataFrame) -> DataFrame:
    """``_starts``: the code points before each match, as sums over blocks and then over their totals."""
    df = df.withColumn("_steps", F.expr("transform(_hits, (m, i) -> cast(length(_parts[i]) + if(i > 0, length(_hits[i - 1]), 0) as bigint))"))
    df = df.withColumn("_blocks", F.expr(f"transform(sequence(0, greatest(0, cast((size(_steps) - 1) / {BLOCK} as int))), b -> slice(_steps, b * {BLOCK} + 1, {BLOCK}))"))
    df = df.withColumn("_totals", F.expr(f"concat(array(0L), {_sums('transform(_blocks, z -> aggregate(z, 0L, (s, x) -> s + x))')})"))
    return df.withColumn("_starts", F.expr(f"flatten(transform(_blocks, (z, b) -> transform({_sums('z')}, x -> x + _totals[b])))")).drop("_steps", "_blocks", "_totals")


def _carried(df: DataFrame, kept: list[str], text: Column) -> DataFrame:
    """``_row``: the columns that come back; ``_text``: what is searched."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row") if kept else F.lit(0).alias("_row"), text.alias("_text"))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """The rows with ``out``: their spans (start, end, kind, base, score), ordered by start, then kind."""
    kept = [c for c in df.columns if c != out]
    df = _carried(df, kept, F.coalesce(df[text], F.lit("")))
    for i, kind in enumerate(KINDS):
        df = _placed(_proposed(df, kind))
        span = f"named_struct('start', _starts[i], 'at', {i}, 'end', _starts[i] + length(m), 'kind', '{kind.name}', 'base', {str(kind.base).lower()}, 'score', {kind.worth('i')})"
        found = f"filter(transform(_hits, (m, i) -> if({kind.accepts('m', 'i')}, {span}, null)), h -> h is not null)"
        df = df.withColumn(f"_{kind.name}", F.when(F.size("_hits") > 0, F.expr(found)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))).drop("_parts", "_hits", "_tails", "_heads", "_starts")
    spans = F.array_sort(F.concat(*(f"_{k.name}" for k in KINDS)))
    listed = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "base", "score"))))
    return df.select(*(F.col("_row")[c].alias(c) for c in kept), listed.alias(out))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each confirmed span of their text replaced by its kind in angle brackets.

    A null text stays null. The other columns, of whatever name, are as they were.
    """
    cols = df.columns
    df = _carried(df, [c for c in cols if c != text], df[text])
    for kind in KINDS:
        df = _proposed(df, kind)
        swapped = f"transform(_hits, (m, i) -> concat(_parts[i], if({kind.accepts('m', 'i')}, '<{kind.name.upper()}>', m)))"
        joined = f"concat(array_join({swapped}, ''), _parts[size(_hits)])"
        df = df.withColumn("_text", F.when(F.size("_hits") > 0, F.expr(joined)).otherwise(F.col("_text"))).drop("_parts", "_hits", "_tails", "_heads")
    return df.select(*((F.col("_text") if c == text else F.col("_row")[c]).alias(c) for c in cols))
