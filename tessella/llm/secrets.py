"""Secret scans by character Markov models (operator 5), in DataFrame functions only.

Base spans come from the three rules of the contract and always stay. Beside them, runs of token
characters are scored by two first-order Markov models over characters, one of random strings and
one of ordinary identifiers: the mean log-likelihood ratio of a run's transitions decides. Both
models are trained from labelled samples by counting transitions in a DataFrame; what reaches the
driver is one table of the alphabet's pairs, whatever the size of the samples.

A match's place is not among what the regular-expression functions return, so a text is split at
the matches: the lengths of the parts and of the matches add up to the starts. They are added over
blocks of BLOCK first, so a text with very many matches costs n * (BLOCK + n / BLOCK) steps.

Defined cases: null text is empty and has no span; repeated rows are searched each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: The contract's rules. The rule's group that holds the secret, and its least length.
_KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = f"{_KEYWORDS}[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]{14,}+"  # a run of the rule's class has one match; under 18 characters it fails
HEX = "[0-9a-f]{16,}+"  # likewise
LEAST_ASSIGNED = 12
#: Runs that the models judge: token characters, at least LEAST_RUN of them.
RUN = "[A-Za-z0-9+/_=-]{16,}+"
LEAST_RUN = 16
#: Mean log-likelihood ratio per transition from which a run counts as random.
THRESHOLD = 0.9
#: The same for runs without a digit or without a letter. Higher, as identifiers of words that the
#: samples lack reach 0.9 more often there. Runs of 16 digits are base spans in any case.
THRESHOLD_PLAIN = 1.3
BLOCK = 256
FIRST, SIZE = 32, 96  # characters 32 to 127

#: Words that identifiers are made of.
WORDS = "get set user name data file path list index count value key item node tree table row column page view model test main init config parse format string number array object handler manager service client server request response error message event state query result buffer stream reader writer input output total order customer account address update delete create insert select from where group filter window session token cache store block thread process task queue worker date time start stop length width height color image layer label source target parent child first last next previous default current version library module package class function method return import export public private static"


def samples(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """Labelled samples (value string, secret boolean), n of each class, made by rule from digests of
    row numbers: random hexadecimal, base64 and alphanumeric strings against identifiers in the
    usual styles, plain lower-case words and rules of one repeated sign."""
    words = F.split(F.lit(WORDS), " ")
    n_words = len(WORDS.split())
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    number = lambda k: F.conv(F.substring("d", 8 * k + 1, 7), 16, 10).cast("long")
    word = lambda k: F.element_at(words, (number(k) % n_words + 1).cast("int"))
    base = rows.withColumn("d", digest)
    b64 = F.base64(F.unhex("d"))
    length = (number(9) % 25 + 16).cast("int")
    random = F.when(F.col("id") % 4 == 0, F.substring("d", F.lit(1), length)).when(F.col("id") % 4 == 1, F.substring(b64, F.lit(1), length)).when(F.col("id") % 4 == 2, F.substring(F.regexp_replace(b64, "[+/=]", ""), F.lit(1), length)).otherwise(F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "")), F.lit(1), length))
    style = F.col("id") % 7
    sign = F.element_at(F.array(*map(F.lit, "-=_+/")), (number(6) % 5 + 1).cast("int"))
    plain = (
        F.when(style == 0, F.concat_ws("_", word(0), word(1), word(2), word(3)))
        .when(style == 1, F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))))
        .when(style == 2, F.concat_ws("-", word(0), word(1), word(2), (number(5) % 100).cast("string")))
        .when(style == 3, F.upper(F.concat_ws("_", word(0), word(1), word(2))))
        .when(style == 4, F.concat_ws("/", word(0), word(1), word(2), word(3), word(4)))
        .when(style == 5, F.concat(word(0), word(1), word(2), word(3)))
        .otherwise(F.concat(word(0), F.repeat(sign, length), word(1)))
    )
    return base.select(random.alias("value"), F.lit(True).alias("secret")).unionAll(base.select(plain.alias("value"), F.lit(False).alias("secret")))


def _codes(run: Column) -> Column:
    """Character codes of a run, with the out-of-range ones set to 0."""
    return F.transform(F.split(run, ""), lambda c: F.when(F.ascii(c).between(FIRST, FIRST + SIZE - 1), F.ascii(c) - FIRST).otherwise(0))


def _transitions(codes: Column) -> Column:
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * SIZE + b)


def train(labelled: DataFrame, add: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition: log P(b | a, random) - log P(b | a, ordinary), with
    `add` for unseen ones. SIZE * SIZE values, by first character, then second."""
    pairs = labelled.select("secret", F.explode(_transitions(_codes(F.col("value")))).alias("pair"))
    counts = {(r.secret, r.pair): r.n for r in pairs.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()}
    out = []
    letters = 66
    for a in range(SIZE):
        totals = {s: sum(counts.get((s, a * SIZE + b), 0) for b in range(SIZE)) for s in (True, False)}
        for b in range(SIZE):
            p = {s: (counts.get((s, a * SIZE + b), 0) + add) / (totals[s] + add * letters) for s in (True, False)}
            out.append(round(math.log(p[True] / p[False]), 4))
    return out


def ratio(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    values = F.array(*map(F.lit, table))
    moves = _transitions(_codes(run))
    return F.aggregate(moves, F.lit(0.0), lambda s, m: s + F.element_at(values, (m + 1).cast("int")), lambda s: s / F.greatest(F.size(moves), F.lit(1)))


def _located(text: Column, pattern: str, keep: Callable[[Column], Column], value: Column | None = None) -> Column:
    """Array of (start, end, value) of the pattern's matches that keep() takes. value: what keep()
    sees instead of the match, an array beside the matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    seen = matches if value is None else value
    sizes = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
    n_blocks = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    block = lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, BLOCK), F.lit(0), lambda s, x: s + x["gap"] + x["own"])
    sums = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(0))), block)

    def start(i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(sums, F.lit(1), whole), F.lit(0), lambda s, x: s + x)
        inside = F.aggregate(F.slice(sizes, whole * BLOCK + 1, i - whole * BLOCK), F.lit(0), lambda s, x: s + x["gap"] + x["own"])
        return before + inside + F.element_at(sizes, (i + 1).cast("int"))["gap"]

    numbered = F.filter(F.transform(seen, lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: keep(x["m"]))
    return F.transform(numbered, lambda x: F.struct(start(x["i"]).alias("start"), (start(x["i"]) + F.element_at(sizes, (x["i"] + 1).cast("int"))["own"]).alias("end")))


_EMPTY = "array<struct<start:int,end:int>>"


def scan(docs: DataFrame, table: list[float] | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and, as arrays of (start, end), assign, access, hex and random (what the models
    add: runs that overlap no base span). keep: other columns to carry along."""
    table = table or train(samples(docs.sparkSession))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct(*keep).alias("_kept")] if keep else []))
    text, none = F.col("text"), F.array().cast(_EMPTY)
    found = lambda pattern, located: F.when(text.rlike(pattern), located.cast(_EMPTY)).otherwise(none)
    assigned = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    df = df.withColumn("assign", found(ASSIGN, _located(text, ASSIGN, lambda m: F.length(m) >= LEAST_ASSIGNED, assigned)))
    df = df.withColumn("access", found(ACCESS, _located(text, ACCESS, lambda m: F.lit(True))))
    df = df.withColumn("hex", found(HEX, _located(text, HEX, lambda m: F.lit(True))))
    least = lambda m: F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), THRESHOLD).otherwise(THRESHOLD_PLAIN)
    judged = lambda m: ratio(m, table) >= least(m)
    df = df.withColumn("random", found(RUN, _located(text, RUN, judged)))
    base = F.concat("assign", "access", "hex")
    return df.withColumn("random", F.when(F.size("random") > 0, F.filter("random", lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))).otherwise(none))


def _all(kinds: tuple[str, ...]) -> Column:
    """The spans of the kinds, by start, then kind as listed, then end."""
    of = lambda k, n: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(k).alias("kind")))
    return F.array_sort(F.concat(*(of(k, n) for n, k in enumerate(kinds))))


def joined(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(_all(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


MARK = "[SECRET]"


def redacted(kinds: tuple[str, ...] = (*KINDS, "random")) -> Column:
    """The text with each run of overlapping spans replaced by MARK, in one pass over the spans."""
    text, none = F.col("text"), F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MARK)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(_all(kinds)) > 0, F.aggregate(_all(kinds), start, step, finish)).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what scan() found."""
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(KINDS), 256).alias("base_sha256"), joined((*KINDS, "random")).alias("spans"))
