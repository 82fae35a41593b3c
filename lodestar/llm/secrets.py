"""Secret scans in DataFrame functions alone.

Fixed patterns give the base spans. Further candidates are long runs of key characters, cut where the
allow-list knows a word; over each piece a window slides, the counts of its characters are kept up to
date as one enters and one leaves, and with them the window's Shannon entropy. A piece whose highest
entropy reaches the threshold of its character class is a secret.

Work grows with a text's length and n log n with its matches: places come from running sums by doubling.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in their order.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so those of the least length are those of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Least entropy in bits of a window by class: hexadecimal digits, letters of one case with digits, letters of
#: both cases with digits, and letters of both cases alone. Digits alone, and letters of one case alone, are no class.
LEAST_BITS = {"hex": 3.0, "alnum": 3.7, "mixed": 3.9, "letters": 4.1}
#: Words that stand for no secret: a run is cut at them. Whole runs that are none, and words just before one that say so.
ALLOWED_WORDS = r"(?i:example|sample|dummy|placeholder|changeme|your[_-]|x{6,}|0123456789|abcdefgh)"
ALLOWED_RUN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_BEFORE = r"(?i)(sha(1|256|384|512)|md5|checksum|commit|integrity|uuid|base64)[-\"': =,]*$"
#: Code points of the blocks in which a text is cut to take stretches out of it.
BLOCK = 4_096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or whatever ``join`` makes, of an array of longs: in log n rounds each value takes in the one 1, 2, 4 ... places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    steps = F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, join(x, F.get(acc, i - step))).otherwise(x)))


def _sums(values: Column) -> Column:
    return _running(values, lambda x, y: x + y)


def _xlogx(n: Column) -> Column:
    """n * log2(n) of a count from 0 to WINDOW."""
    known = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)))
    return F.get(known, n)


def _placed(pieces: Column, matches: Column) -> Column:
    """(before, match, start) from what stands between matches and the matches; the last piece has a null match."""
    length = lambda r: (F.length(r["before"]) + F.coalesce(F.length(r["match"]), F.lit(0))).cast("long")
    return _let(
        F.arrays_zip(pieces.alias("before"), matches.alias("match")),
        lambda rows: F.zip_with(
            rows,
            _sums(F.transform(rows, length)),
            lambda r, end: F.struct(r["before"].alias("before"), r["match"].alias("match"), (end - F.coalesce(F.length(r["match"]), F.lit(0))).alias("start")),
        ),
    )


def _found(text: Column, pattern: str) -> Column:
    """Each match as (before, match, start): the text since the last match, the match, its first code point."""
    # between matches split() gives what regexp_extract_all() leaves out, so lengths add up to places
    placed = _placed(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    none = F.array().cast("array<struct<before: string, match: string, start: bigint>>")
    return F.when(text.rlike(pattern), F.filter(placed, lambda r: r["match"].isNotNull())).otherwise(none)


def _span(start: Column, kind: str, text: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), (start + F.length(text)).alias("end"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda r: _span(r["start"], kind, r["match"]))


def _highest_entropy(codes: Column) -> Column:
    """The highest entropy of a window of WINDOW codes; each is a place in ALPHABET, from 1.

    The counts are one string with a character for each place; a step rewrites the one that enters
    and the one that leaves.
    """
    zero = ord("0")

    def step(acc: Column, at: Column) -> Column:
        new, old = F.get(codes, at), F.get(codes, at - WINDOW)
        count = lambda code: F.ascii(F.substring(acc["counts"], code, F.lit(1))) - zero
        put = lambda counts, code, n: F.overlay(counts, F.char(n + zero), code, F.lit(1))
        leaves = F.when(old.isNull() | (old == new), F.lit(0.0)).otherwise(_xlogx(count(old) - 1) - _xlogx(count(old)))
        enters = F.when(old.isNotNull() & (old == new), F.lit(0.0)).otherwise(_xlogx(count(new) + 1) - _xlogx(count(new)))
        total = acc["total"] + leaves + enters
        counts = F.when(old.isNull(), put(acc["counts"], new, count(new) + 1)).when(old == new, acc["counts"])
        counts = counts.otherwise(put(put(acc["counts"], new, count(new) + 1), old, count(old) - 1))
        bits = F.when(at >= WINDOW - 1, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])


def _pieces(run: Column) -> Column:
    """(before, start, piece) of a run cut at allowed words, ``before`` being the text before the run for the piece that begins it."""
    cut = _placed(F.split(run["match"], ALLOWED_WORDS, -1), F.regexp_extract_all(run["match"], F.lit(f"({ALLOWED_WORDS})"), F.lit(1)))

    def piece(before: Column, start: Column, text: Column) -> Column:
        return F.struct(before.alias("before"), start.alias("start"), text.alias("piece"))

    several = F.transform(cut, lambda r, i: piece(F.when(i == 0, run["before"]).otherwise(F.lit("")), run["start"] + r["start"] - F.length(r["before"]), r["before"]))
    return F.when(run["match"].rlike(ALLOWED_WORDS), several).otherwise(F.array(piece(run["before"], run["start"], run["match"])))


def _entropy_spans(text: Column) -> Column:
    runs = F.filter(_found(text, CANDIDATE), lambda r: ~r["match"].rlike(ALLOWED_RUN))
    pieces = F.filter(
        F.flatten(F.transform(runs, _pieces)), lambda p: (F.length(p["piece"]) >= WINDOW) & ~F.right(p["before"], F.lit(40)).rlike(ALLOWED_BEFORE)
    )

    def least(p: Column) -> Column:
        digit, lower, upper = (p["piece"].rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
        return (
            F.when(digit & lower & p["piece"].rlike("^[0-9a-f]+$"), F.lit(LEAST_BITS["hex"]))
            .when(digit & lower & upper, F.lit(LEAST_BITS["mixed"]))
            .when(digit & (lower | upper), F.lit(LEAST_BITS["alnum"]))
            .when(lower & upper, F.lit(LEAST_BITS["letters"]))
        )

    def secret(p: Column) -> Column:
        codes = F.transform(F.split(p["piece"], ""), lambda c: F.instr(F.lit(ALPHABET), c))
        return F.coalesce(_let(codes, _highest_entropy) >= least(p) - 1e-9, F.lit(False))

    return F.transform(F.filter(pieces, lambda p: least(p).isNotNull() & secret(p)), lambda p: _span(p["start"], "entropy", p["piece"]))


def scan_secrets(docs: DataFrame, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``into``: an array of (start, order, end), sorted, ends exclusive, in code points.

    ``order`` is the kind's place in KINDS. The base kinds' spans are all there. A piece of high entropy is
    added whole unless one base span covers all of it, so what a base span leaves of it is never lost.
    Null and empty texts have an empty array, texts of any length are scanned whole, of pieces at the
    threshold all count, repeated rows are scanned each, and an empty table gives no rows. A column
    of that name is replaced: give another name to keep it. No shuffle, no Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.filter(_found(text, ASSIGN), lambda r: F.length(F.regexp_extract(r["match"], f"^{ASSIGN}$", 2)) >= ASSIGN_CHARS)
    access = F.filter(_found(text, ACCESS), lambda r: F.length(r["match"]) >= ACCESS_CHARS)
    every = F.concat(_spans(group, "assign"), _spans(access, "access"), _spans(_found(text, HEX), "hex"), _entropy_spans(text))
    n_base = KINDS.index("entropy")

    def uncovered(spans: Column) -> Column:
        base_ends = F.transform(spans, lambda s: F.when(s["order"] < n_base, s["end"]).otherwise(F.lit(0).cast("long")))
        # in order of start, base spans first, so the furthest end up to a piece's place is that of the base spans that begin before it
        return _let(_running(base_ends, F.greatest), lambda ends: F.filter(spans, lambda s, i: (s["order"] < n_base) | (F.get(ends, i) < s["end"])))

    return docs.withColumn(into, _let(F.array_sort(every), uncovered))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch that sorted spans cover replaced by the mask; null stays null."""

    def stretch(blocks: Column, low: Column, high: Column) -> Column:
        inside = lambda b: F.greatest(low - b * BLOCK, F.lit(0).cast("long"))
        part = lambda b: F.substring(F.get(blocks, b.cast("int")), (inside(b) + 1).cast("int"), (F.least(high - b * BLOCK, F.lit(BLOCK).cast("long")) - inside(b)).cast("int"))
        own = F.sequence(F.floor(low / BLOCK), F.floor((high - 1) / BLOCK))
        return F.when(low < high, F.array_join(F.transform(own, part), "")).otherwise(F.lit(""))

    def masked(blocks: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(stretch(blocks, before(i), s["start"]), F.lit(mask))).otherwise(F.lit("")))
        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(kept, ""), stretch(blocks, last, F.length(text).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = _let(blocks, lambda b: _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda ends: masked(b, ends)))
    return F.when(F.size(spans) == 0, text).otherwise(done)
