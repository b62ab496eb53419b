"""Secret scans: fixed kinds by pattern, others by character Markov models.

Two first-order models of character classes, one of random strings and one of ordinary identifiers,
are counted from labelled samples. A run of at least 20 key characters with letters and digits is a
secret where the log-likelihood ratio of the models favours the random one by `least` nats for each
character; runs that overlap a span of a fixed kind aren't told again. All steps are DataFrame
functions: the ratios are one literal array, and spans come from running sums of the lengths of a text's
pieces, each of which ends with a match.

Null texts count as empty and have no spans. Offsets are code points, ends exclusive. Spans are in the
order of start, kind, end; kinds may overlap. Work grows in proportion to a text's length, however many
matches it has and however long a run is. Repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.functions.arrays import let, running
from verdigrain.llm.shared import text_or_empty

# The kinds in order, and their patterns (Java syntax).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN_CHARS, RUN_LEAST = "A-Za-z0-9+/_=-", 20
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_OTHERS = "+/_=-"
CLASSES = 2 * 26 + 1 + len(_OTHERS)

# Words that ordinary identifiers are made of.
_WORDS = """get set user name value index count list item data file path read write open close start stop begin end first last next
previous create delete update insert select find search sort filter map reduce group merge split join load save parse format print
error warning message request response server client handler manager service factory builder context session config option
parameter argument result status state event listener callback buffer stream reader writer queue stack tree node graph edge key
table column row field record schema query cursor index cache memory thread process task worker job schedule time date year month
day hour minute second size length width height color image video audio text string number integer float boolean array object
class method function module package library version release build test debug trace network socket port host address""".split()


#: The class of each key character: lower-case and upper-case letters, digits as one, others.
_CODES = {**{c: k for k, c in enumerate(_LETTERS)}, **{c.upper(): 26 + k for k, c in enumerate(_LETTERS)}, **dict.fromkeys("0123456789", 52), **{c: 53 + k for k, c in enumerate(_OTHERS)}}


def class_of(char: Column) -> Column:
    """The class of a key character, from 0."""
    return F.element_at(_literal([_CODES.get(chr(c), 0) for c in range(128)]), F.ascii(char) + 1)


def _literal(numbers: list[int]) -> Column:
    """A constant array; it is folded into one literal."""
    return F.from_json(F.lit(f"[{','.join(map(str, numbers))}]"), "array<int>")


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """label (1 random, 0 ordinary) and text: digests in several notations, and identifiers of one to four words."""
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    random = rows.select(F.lit(1).alias("label"), F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.translate(raw, "+/=", "-_")).otherwise(F.translate(raw, "+/=\r\n", "aZ")).alias("text"))
    words = F.array(*map(F.lit, _WORDS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))) + 1).cast("int"))
    own = F.array(*[word(k) for k in range(4)])
    some = F.slice(own, 1, (F.pmod(F.col("id"), F.lit(3)) + 2).cast("int"))
    camel = F.array_join(F.transform(some, lambda w: F.initcap(w)), "")
    tail = F.when(F.col("id") % 5 == 0, F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")).otherwise("")
    style = F.col("id") % 6
    plain = F.when(style == 0, F.array_join(some, "_")).when(style == 1, F.array_join(some, "-")).when(style == 2, F.upper(F.array_join(some, "_"))).when(style == 3, camel).when(style == 4, F.array_join(some, "/")).otherwise(F.array_join(some, ""))
    return random.union(rows.select(F.lit(0).alias("label"), F.concat(plain, tail).alias("text")))


def train(samples: DataFrame, *, prior: float = 0.5) -> list[int]:
    """Log-likelihood ratios of class after class, in thousandths of nats, from labelled texts.

    Counts go through partial aggregation; at most two numbers for each pair of classes reach the driver.
    """
    clean = F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]", "")
    pairs = samples.select("label", clean.alias("t")).where("length(t) > 1").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("p"))
    code = class_of(F.substring("p", 1, 1)) * CLASSES + class_of(F.substring("p", 2, 1))
    by_pair = pairs.groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).select("label", code.alias("code"), "n")
    counts = {(r.label, r.code): r["n"] for r in by_pair.groupBy("label", "code").agg(F.sum("n").alias("n")).collect()}
    out = []
    for a in range(CLASSES):
        sums = [sum(counts.get((label, a * CLASSES + b), 0) for b in range(CLASSES)) + prior * CLASSES for label in (0, 1)]
        for b in range(CLASSES):
            plain, random = ((counts.get((label, a * CLASSES + b), 0) + prior) / sums[label] for label in (0, 1))
            out.append(round(1000 * math.log(random / plain)))
    return out


def ratio(run: Column, model: list[int]) -> Column:
    """The mean log-likelihood ratio of a run's characters, in nats; the run is cut into pieces, each with the character before it."""
    codes = [_CODES.get(chr(c), 0) for c in range(128)]
    table = _literal([model[a * CLASSES + b] for a in codes for b in codes])
    pair = lambda a, b: F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1)
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), pair)
    summed = lambda c: F.aggregate(pairs(c), F.lit(0).cast("bigint"), lambda s, x: s + x)
    step = lambda got, piece: F.struct((got["sum"] + let(F.split(F.concat(got["last"], piece), ""), summed)).alias("sum"), F.right(piece, F.lit(1)).alias("last"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit("").alias("last"))
    total = F.aggregate(F.regexp_extract_all(run, F.lit("(?s).{1,1024}"), F.lit(0)), start, step)["sum"]
    return total / (F.length(run) - 1) / 1000


def _placed(pieces: Column, pattern: str, least: int) -> Column:
    """start, end and match of pieces of a text, each of which ends with a match; shorter matches are left out."""

    def of(own: Column) -> Column:
        ends = running(F.transform(own, lambda p: F.length(p).cast("bigint")), lambda a, b: a + b)
        found = lambda e: F.transform(own, lambda p, i: F.struct(F.element_at(e, i + 1).alias("end"), F.when(F.length(p) >= least, F.regexp_substr(p, F.lit(pattern))).alias("match")))
        long = F.filter(let(ends, found), lambda m: F.length(m["match"]) >= least)
        return F.transform(long, lambda m: F.struct((m["end"] - F.length(m["match"])).alias("start"), m["end"].alias("end"), m["match"].alias("match")))

    return let(pieces, of)


def clear_of(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps; both are sorted by start, and runs don't overlap each other.

    All spans in the order of start: a run is clear if the base spans before it end by its start (a running
    maximum) and those after it begin at its end or later (a running minimum from the end).
    """
    never = F.lit(1 << 62).cast("bigint")
    every = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("run"), b["end"].alias("end"), F.lit(-1).alias("at"))),
        F.transform(runs, lambda m, i: F.struct(m["start"].alias("start"), F.lit(1).alias("run"), m["end"].alias("end"), i.alias("at"))),
    ))

    def of(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: F.when(s["run"] == 0, s["end"]).otherwise(F.lit(-1).cast("bigint"))), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["run"] == 0, s["start"]).otherwise(never))), F.least))
        good = lambda r, a: F.filter(F.transform(spans, lambda s, i: F.when((s["run"] == 1) & (F.element_at(r, i + 1) <= s["start"]) & (F.element_at(a, i + 1) >= s["end"]), s["at"])), lambda k: k.isNotNull())
        return let(reach, lambda r: let(ahead, lambda a: good(r, a)))

    clear = let(every, of)
    return F.when(F.size(runs) == 0, runs).when(F.size(base) == 0, runs).otherwise(let(runs, lambda m: F.transform(clear, lambda k: F.element_at(m, k + 1))))


def matches(text: Column, pattern: str) -> Column:
    """start, end and match of all leftmost, non-overlapping matches of a pattern without looking around."""
    # the end of the text is a piece too: else each of the last places would be tried in vain
    return _placed(F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{pattern}|\z)"), F.lit(0)), pattern, 1)


def runs(text: Column, chars: str, least: int) -> Column:
    """start, end and match of the maximal runs of some characters, of at least so many; one pass without backtracking."""
    return _placed(F.regexp_extract_all(text, F.lit(rf"[^{chars}]*+(?:[{chars}]++|\z)"), F.lit(0)), rf"[{chars}]+\z", least)


def scan(df: DataFrame, *, model: list[int] | None = None, id_column: str = "doc_id", text_column: str = "text", least: float = 0.6) -> DataFrame:
    """id and spans, by start and then kind: array of start, rank of the kind, end, kind."""
    model = model or train(default_samples(df.sparkSession))
    text = F.col("text")
    low = F.lower(text)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    # cheap tests that any match must pass
    may_assign = F.greatest(*[low.contains(w) for w in ("passw", "secret", "token", "api")])
    told = lambda column, k: F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end"), F.lit(KINDS[k]).alias("kind")))
    assign = F.when(may_assign, F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 12)).otherwise(none)
    access = F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none)
    hexes = F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none)
    may_mix = text.rlike("[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]")
    told = lambda column, k: F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end"), F.lit(KINDS[k]).alias("kind")))
    assign = F.when(may_assign, F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 12)).otherwise(none)
    access = F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none)
    hexes = F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none)
    mixed = F.when(text.rlike("[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"), F.filter(runs(text, RUN_CHARS, RUN_LEAST), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]"))).otherwise(none)

    def with_others(base: Column) -> Column:
        telling = lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")
        others = F.when(may_mix, F.filter(runs(text, RUN_CHARS, RUN_LEAST), telling)).otherwise(none)
        free = let(others, lambda m: clear_of(m, base))
        return F.array_sort(F.concat(base, told(F.filter(free, lambda m: ratio(m["match"], model) >= least), 3)))

    rows = df.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    return rows.select(F.col("id").alias(id_column), let(F.array_sort(F.concat(told(assign, 0), told(access, 1), told(hexes, 2))), with_others).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
