"""Secret scan: fixed patterns, and random-looking strings by Markov models.

Native DataFrame expressions only.  Positions come from two linear regular
expression passes, which see the same matches: the pieces between matches and
the matches themselves tile the text, so running lengths give code points.  No
array grows by one element a step and no string is cut at every position, so the
work follows the length of a text, whatever it holds.

Random strings: two first-order character models, one of random strings and one
of ordinary identifiers, are counted from labelled samples.  Base spans are cut
out of each run of key characters.  In what is left, marks (anything but letters
and digits) are bounds of sub-runs, and a running sum over the log-likelihood
ratios of character pairs, less the threshold, finds the stretches of sub-runs
that score best, so a key joined to words stands alone.  A stretch of 20 or more
characters is reported where the mean of its pairs is above the threshold, and
so is a whole piece without such a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns of the contract and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.35
FIRST_MARK = 62  # of ALPHABET: + and all after it are marks
CHUNK = 256
DROP = 6.0  # a stretch ends where the running sum has lost this much since its best

# Stems of ordinary identifiers for the labelled sample.
STEMS = (
    "account active address amount array batch before block buffer build cache client column config connect content count "
    "create current data default delete document element enable entry error event field file filter first format frame from "
    "group handle header height identifier index input instance item label length level limit list load local manager map "
    "message method model module name next node number object offset option order output package page parameter parse part "
    "path point position previous process property query queue read record reference region register request response result "
    "return sample schema second select sequence server session shard shuffle size source start state status stream string "
    "table target task text thread time token total trade transform tree type update upper user value vector version view "
    "width window word write ing tion the and ness ment able ous ization enheit schlich mente ción eau elle"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n random strings and n ordinary identifiers: (sample, is_random)."""
    ids = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 512))
    bytes_ = F.unhex("h")
    random = ids.select(
        F.when(F.col("id") % 4 == 0, F.upper(F.translate(F.base64(F.substring(bytes_, 1, 24)), "+/=", "")))
        .when(F.col("id") % 4 == 1, F.substring(F.col("h"), 1, 40))
        .otherwise(F.substring(F.translate(F.base64(bytes_), "\r\n", ""), 1, 40))
        .alias("sample"),
        F.lit(True).alias("is_random"),
    )
    stems = F.array(*[F.lit(s) for s in STEMS if s.isascii()])
    pick = lambda k: F.get(stems, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len([s for s in STEMS if s.isascii()]))).cast("int"))
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))
    snake = F.concat_ws("_", pick(1), pick(2), pick(3), pick(4))
    form = F.col("id") % 16
    ordinary = ids.select(
        F.when(form.isin(0, 4), F.concat(pick(1), cap(pick(2)), cap(pick(3)), cap(pick(4))))
        .when(form.isin(1, 5), snake)
        .when(form.isin(2, 6, 10), F.concat_ws("/", pick(1), F.concat_ws("-", pick(2), pick(3)), (F.col("id") % 97).cast("string")))
        .when(form.isin(8, 9), F.upper(snake))
        .when(form == 12, F.concat(F.lit("/"), F.concat_ws("/", pick(1), pick(2), pick(3), pick(4), pick(5))))
        .when(form == 13, F.concat(F.concat_ws("_", pick(1), pick(2)), F.lit("="), F.concat_ws("-", pick(3), pick(4))))
        .when(form == 14, F.concat(F.upper(F.concat_ws("_", pick(1), pick(2))), F.lit("="), F.concat_ws("/", pick(3), pick(4))))
        .when(form == 15, F.repeat(F.get(F.array(F.lit("-"), F.lit("="), F.lit("_")), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")), F.lit(24)))
        .otherwise(F.concat(cap(pick(1)), pick(2), pick(3), pick(4), pick(5)))
        .alias("sample"),
        F.lit(False).alias("is_random"),
    )
    return random.unionByName(ordinary)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, row-major over ALPHABET.

    Counts are at most 2 x 67 x 67 rows.  Characters outside the alphabet end a
    pair; a class without samples is uniform.
    """
    size = len(ALPHABET)
    pairs = (
        samples.where(F.length("sample") > 1)
        .select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.col("sample").substr(i, F.lit(2)))).alias("p"))
        .select("is_random", F.expr(f"instr('{ALPHABET}', substring(p, 1, 1)) - 1").alias("a"), F.expr(f"instr('{ALPHABET}', substring(p, 2, 1)) - 1").alias("b"))
        .where((F.col("a") >= 0) & (F.col("b") >= 0))
        .groupBy("is_random", "a", "b")
        .count()
        .collect()
    )
    seen = {(r["is_random"], r["a"], r["b"]): r["count"] for r in pairs}
    out = []
    for a in range(size):
        totals = [sum(seen.get((k, a, b), 0) for b in range(size)) for k in (True, False)]
        for b in range(size):
            p, q = ((seen.get((k, a, b), 0) + smoothing) / (t + smoothing * size) for k, t in zip((True, False), totals))
            out.append(round(math.log(p / q), 5))
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``join``, by steps that double their reach: n log n, no growing array."""

    def double(now: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(now, lambda x, i: F.when(i >= reach, join(F.get(now, i - reach), x)).otherwise(x))

    def run(held: Column) -> Column:
        steps = F.ceil(F.log2(F.greatest(F.size(held), F.lit(1)).cast("double"))).cast("int") - 1
        return F.when(F.size(held) < 2, held).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), held, double))

    return _let(values, run)


def _spans(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<first, end, match>> of the matches of a pattern, in code points."""
    empty = F.expr("cast(array() as array<struct<first:int,end:int,match:string>>)")

    def place(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = _running(F.zip_with(matches, pieces, lambda m, p: F.length(p) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("first"), e.alias("end"), m.alias("match")))

    return F.when(possible, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(empty)


def _merged(spans: Column) -> Column:
    """Disjoint array<struct<first, end>>, in order, that covers what ``spans``, in order of first, cover."""

    def cover(held: Column, reach: Column, starts: Column) -> Column:
        last = lambda k: F.coalesce(F.get(starts, k + 1), F.size(held)) - 1
        return F.transform(starts, lambda s, k: F.struct(F.get(held, s)["first"].alias("first"), F.get(reach, last(k)).alias("end")))

    def groups(held: Column, reach: Column) -> Column:
        opens = lambda i: (i == 0) | (F.get(held, i)["first"] > F.get(reach, i - 1))
        return _let(F.filter(F.transform(held, lambda x, i: i), opens), lambda starts: cover(held, reach, starts))

    return _let(spans, lambda held: _let(_running(F.transform(held, lambda x: x["end"]), F.greatest), lambda reach: groups(held, reach)))


def _before(points: Column, queries: Column, ties: bool) -> Column:
    """For each query the points less than it (``ties``: or equal to it); both are ascending.

    In the sorted union the k-th query has its k predecessors and the points before it.
    """
    mark = lambda values, kind: F.transform(values, lambda v: F.struct(v.alias("at"), F.lit(kind).alias("kind")))
    union = F.sort_array(F.concat(mark(points, 0 if ties else 2), mark(queries, 1)))
    spots = F.filter(F.transform(union, lambda e, p: F.struct(e["kind"].alias("kind"), p.alias("p"))), lambda e: e["kind"] == 1)
    return F.transform(spots, lambda e, k: e["p"] - k)


def _outside(runs: Column, base: Column) -> Column:
    """array<struct<first, codes>> of what base spans leave of runs, LEAST characters or more each; both are in order."""
    codes = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])

    def pieces(run: Column, merged: Column, lo: Column, n: Column) -> Column:
        first = lambda k: F.when(k == 0, run["first"]).otherwise(F.greatest(run["first"], F.get(merged, lo + k - 1)["end"]))
        end = lambda k: F.when(k == n, run["end"]).otherwise(F.get(merged, lo + k)["first"])
        gaps = F.filter(
            F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(first(k).alias("first"), end(k).alias("end"))),
            lambda g: g["end"] - g["first"] >= LEAST,
        )
        text = F.transform(F.split(run["match"], ""), lambda c: F.get(codes, F.ascii(c)))
        cut = lambda held, g: F.slice(held, g["first"] - run["first"] + 1, g["end"] - g["first"])
        found = lambda g: _let(text, lambda held: F.transform(g, lambda x: F.struct(x["first"].alias("first"), cut(held, x).alias("codes"))))
        return _let(gaps, lambda g: F.when(F.size(g) > 0, found(g)).otherwise(F.expr("cast(array() as array<struct<first:int,codes:array<int>>>)")))

    def meet(held: Column, merged: Column) -> Column:
        lo = _before(F.transform(merged, lambda x: x["end"]), F.transform(held, lambda x: x["first"]), True)
        hi = _before(F.transform(merged, lambda x: x["first"]), F.transform(held, lambda x: x["end"]), False)
        range_ = F.zip_with(lo, hi, lambda a, b: F.struct(a.alias("lo"), F.greatest(b - a, F.lit(0)).alias("n")))
        return F.flatten(F.zip_with(held, range_, lambda r, x: pieces(r, merged, x["lo"], x["n"])))

    return _let(runs, lambda held: _let(_merged(base), lambda merged: meet(held, merged)))


def _random_parts(piece: Column, table: Column, threshold: float) -> Column:
    """array<struct<first, end>> of the random-looking stretches of a piece (first, codes), in order."""
    code, length = piece["codes"], F.size(piece["codes"])
    empty = F.expr("cast(array() as array<struct<first:int,end:int>>)")
    none = F.expr("cast(array() as array<array<struct<first:int,end:int>>>)")
    span = lambda first, end: F.struct(first.cast("int").alias("first"), end.cast("int").alias("end"))
    fields = ("start", "total", "best", "end", "whole", "found")
    state = lambda *values: F.struct(*[v.alias(f) for v, f in zip(values, fields)])
    zero = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0), empty)

    def step(acc: Column, i: Column) -> Column:
        # One character a step; ``total`` has the pairs from start to before i.
        pair = F.coalesce(F.get(table, F.get(code, i - 1) * len(ALPHABET) + F.get(code, i)) - threshold, F.lit(0.0))
        whole = acc["whole"] + F.when((i > 0) & (i < length), pair).otherwise(0.0)
        total = acc["total"] + F.when((i > acc["start"]) & (i < length), pair).otherwise(0.0)
        up = acc["total"] > acc["best"]
        best, end = F.greatest(acc["total"], acc["best"]), F.when(up, i).otherwise(acc["end"])
        bound = (i == length) | (F.get(code, i) >= FIRST_MARK)
        over = (i == length) | (acc["total"] <= 0) | (best - acc["total"] > DROP)
        found = F.when(end - acc["start"] >= LEAST, F.concat(acc["found"], F.array(span(acc["start"], end)))).otherwise(acc["found"])
        return (
            F.when(~bound, state(acc["start"], total, acc["best"], acc["end"], whole, acc["found"]))
            .when(over, state(i + 1, F.lit(0.0), F.lit(0.0), i + 1, whole, found))
            .otherwise(state(acc["start"], total, best, end, whole, acc["found"]))
        )

    # An aggregate copies its state at every step, so characters go by stretches of about the root
    # of their number: what is found in one is moved to ``full`` at its end.
    reach = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(length)).cast("int"))

    def stretch(acc: Column, first: Column, n: Column) -> Column:
        scan = F.aggregate(F.sequence(first, F.least(length, first + n - 1)), acc["scan"], step)
        move = lambda s: F.when(F.size(s["found"]) > 0, F.concat(acc["full"], F.array(s["found"]))).otherwise(acc["full"])
        kept = lambda s: state(*[s[f] for f in fields[:-1]], empty)
        return _let(scan, lambda s: F.struct(kept(s).alias("scan"), move(s).alias("full")))

    def scan_all(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), length, n), F.struct(zero.alias("scan"), none.alias("full")), lambda acc, first: stretch(acc, first, n), finish)

    # Padding at the end of the piece belongs to the last stretch.
    core = F.array_max(F.transform(code, lambda c, i: F.when(c == ALPHABET.index("="), 0).otherwise(i + 1)))
    place = lambda x, end: span(piece["first"] + x["first"], piece["first"] + F.when(x["end"] >= end, length).otherwise(x["end"]))

    def finish(acc: Column) -> Column:
        listed = _let(core, lambda end: F.transform(F.flatten(acc["full"]), lambda x: place(x, end)))
        whole = F.when(acc["scan"]["whole"] > 0, F.array(span(piece["first"], piece["first"] + length))).otherwise(empty)
        return F.when(F.size(acc["full"]) > 0, listed).otherwise(whole)

    return _let(reach, scan_all)


def find_secrets(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with ``spans``: array<struct<first, kind, end>>, in order.

    ``kind`` is a position in KINDS; ends are exclusive.  A null or empty text
    has no spans; every row is scanned by itself, so repeated rows and null ids
    are as any other.  ``keep`` may not have ``spans`` or a column that begins
    with ``_s_``; other columns of docs may.  ``ratios`` come from ``train``.
    Work is linear in the text but for sorting spans.
    """
    keep = keep or ["doc_id"]
    if "spans" in keep or any(c.startswith("_s_") for c in keep):
        raise ValueError("keep may not have spans or columns that begin with _s_")
    lower = F.lower("_s_text")
    named = F.lit(False)
    for key in ("passw", "secret", "token", "api"):
        named = named | lower.contains(key)
    found = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_s_text")).select(
        *keep,
        F.filter(_spans(F.col("_s_text"), ASSIGN, named), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("_s_0"),
        _spans(F.col("_s_text"), ACCESS, F.col("_s_text").contains("AKIA")).alias("_s_1"),
        _spans(F.col("_s_text"), HEX, F.col("_s_text").rlike(HEX)).alias("_s_2"),
        _spans(F.col("_s_text"), CANDIDATE, F.col("_s_text").rlike(CANDIDATE)).alias("_s_3"),
    )
    table = F.expr("cast(split('" + ",".join(map(str, ratios)) + "', ',') as array<double>)")
    tagged = lambda spans, k: F.transform(spans, lambda x: F.struct(x["first"].alias("first"), F.lit(k).alias("kind"), x["end"].alias("end")))
    base = F.sort_array(F.concat(*[tagged(F.col(f"_s_{k}"), k) for k in range(3)]))

    def whole(held: Column) -> Column:
        fresh = F.flatten(F.transform(_outside(F.col("_s_3"), held), lambda x: _random_parts(x, table, threshold)))
        return F.when(F.size("_s_3") > 0, F.sort_array(F.concat(held, tagged(fresh, 3)))).otherwise(held)

    return found.select(*keep, _let(base, whole).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["first"], x["end"])), ",")
