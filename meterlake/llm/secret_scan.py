"""Secret scans in built-in column functions only: patterns, and sliding-window entropy over candidate strings.

A match's place is the running length of what stands between and in the matches before it, in code points. Candidates
are long runs of a character class, less what a pattern has found already and the parts that an allow-list recognises.
A window slides over each: as one character leaves and one enters, their two counts change, and with them the sum of
c * log2(c) that gives the window's Shannon entropy. Counts and sum are the state of one fold over the characters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9+/_.=-]+"
#: kind, pattern, least characters of the match (or of its second group, for assign). As the runs are maximal, the
#: shorter ones of access and hex may be left out by the pattern itself.
ASSIGN = rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_WORD})"""
ASSIGN_CHARS = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Matches whose places are summed together; bounds the copying of lists that grow.
BLOCK = 64


#: No secrets: identifiers in UUID form, and parts of runs between PART_ENDS that hold sample values, alphabets or counting.
ALLOW_UUID = "(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
ALLOW_PART = "(?i)example|sample|placeholder|changeme|dummy|abcdefghij|0123456789|1234567890"
PART_ENDS = "+/_=-"


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    #: as a pattern's class
    characters: str
    alphabet: str
    window: int
    #: bits a character
    entropy: float
    #: what a candidate must hold besides
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", "0123456789ABCDEFabcdef", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", ascii_letters + digits + PART_ENDS, 20, 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
)
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _bound(value: Column, use) -> Column:
    """``use(value)``; a list of one binds the value, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def _placed(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``keep(match)`` holds, with the match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")

    def one(acc: Column, i: Column, found: Column, gaps: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(gaps, i))
        end = start + F.length(F.element_at(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.element_at(found, i).alias("found")))).alias("out"))

    def block(acc: Column, b: Column, found: Column, gaps: Column) -> Column:
        own = F.aggregate(
            F.sequence(b * BLOCK + 1, F.least(F.size(found), (b + 1) * BLOCK)),
            F.struct(acc["at"].alias("at"), empty.alias("out")),
            lambda a, i: one(a, i, found, gaps),
        )
        return _bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    def all_of(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, b: block(acc, b, found, gaps), lambda acc: acc["out"])

    spans = _bound(F.struct(found.alias("found"), gaps.alias("gaps")), all_of)
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: keep(s["found"]))).otherwise(empty)


def _hot_range(text: Column, c: CharacterClass) -> Column:
    """struct(first, last): places, from 0, of the first and behind the last character of the windows of high entropy; first is -1 without any."""
    w = c.window
    worth = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)))
    most = w * (math.log2(w) - c.entropy) + 1e-9
    start = F.struct(F.lit(0.0).alias("total"), F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def value(n: Column) -> Column:
        return F.element_at(worth, n + 1)

    def step(acc: Column, i: Column, chars: Column) -> Column:
        """The character at ``i`` (from 1) enters the window, and the one that stands ``w`` before it leaves."""
        moved = F.struct(F.instr(F.lit(c.alphabet), F.element_at(chars, i)).alias("new"), F.when(i > w, F.instr(F.lit(c.alphabet), F.element_at(chars, i - w))).otherwise(0).alias("out"))
        return _bound(moved, lambda m: _bound(_changed(acc, m), lambda t: marked(acc, m, t, i)))

    def _changed(acc: Column, m: Column) -> Column:
        n_new = F.element_at(acc["counts"], m["new"])
        n_out = F.when(m["out"] > 0, F.element_at(acc["counts"], F.greatest(m["out"], F.lit(1))))
        gone = F.when(m["out"] > 0, value(n_out - 1) - value(n_out)).otherwise(0.0)
        return acc["total"] + F.when(m["new"] == m["out"], 0.0).otherwise(gone + value(n_new + 1) - value(n_new))

    def marked(acc: Column, m: Column, total: Column, i: Column) -> Column:
        counts = F.transform(acc["counts"], lambda n, at: n + (at + 1 == m["new"]).cast("int") - (at + 1 == m["out"]).cast("int"))
        hot = (i >= w) & (total <= most)
        return F.struct(total.alias("total"), counts.alias("counts"), F.when(hot & (acc["first"] < 0), i - w).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"))

    def over(chars: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, lambda acc, i: step(acc, i, chars), lambda acc: F.struct(acc["first"], acc["last"]))

    return _bound(F.regexp_extract_all(text, F.lit("."), 0), over)


def _candidates(text: Column, c: CharacterClass, taken: Column) -> Column:
    """array<struct(start, end, found)>: what the ``taken`` spans and the allow-list leave of the runs of a class, if it is long enough and holds what it must."""
    stretches = "array<struct<start:int,end:int>>"

    def needed(found: Column) -> Column:
        out = F.length(found) >= c.window
        for p in c.needs:
            out = out & found.rlike(p)
        return out

    def ends(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"))

    def left(run: Column) -> Column:
        found, zero = run["found"], F.lit(0)
        met = F.transform(F.filter(taken, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])), lambda b: ends(b, zero))
        ids = F.transform(_placed(found, ALLOW_UUID, "allow", lambda m: F.lit(True)), lambda m: ends(m, run["start"]))
        parts = F.when(found.rlike(ALLOW_PART), F.transform(_placed(found, f"[^{PART_ENDS}]+", "allow", lambda m: m.rlike(ALLOW_PART)), lambda m: ends(m, run["start"]))).otherwise(F.array().cast(stretches))
        # what lies between those, in order
        cut = F.aggregate(
            F.array_sort(F.concat(met, ids, parts)),
            F.struct(run["start"].alias("at"), F.array().cast(stretches).alias("out")),
            lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), b["start"].alias("end")))).alias("out")),
            lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), run["end"].alias("end")))),
        )
        long = F.filter(cut, lambda s: s["end"] - s["start"] >= c.window)
        return F.filter(F.transform(long, lambda s: F.struct(s["start"], s["end"], F.substring(found, s["start"] - run["start"] + 1, s["end"] - s["start"]).alias("found"))), lambda s: needed(s["found"]))

    return F.flatten(F.transform(_placed(text, f"[{c.characters}]{{{c.window},}}", c.kind, needed), left))


def _entropy_spans(text: Column, c: CharacterClass, taken: Column) -> Column:
    hot = F.transform(_candidates(text, c, taken), lambda s: _bound(_hot_range(s["found"], c), lambda h: F.struct(F.lit(c.kind).alias("kind"), (s["start"] + h["first"]).alias("start"), (s["start"] + h["last"]).alias("end"), h["first"].alias("first"))))
    return _plain(F.filter(hot, lambda s: s["first"] >= 0))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPANS)


def _in_order(spans: Column) -> Column:
    """By start, then by kind as listed: assign, access, hex, and the classes."""
    kinds = F.array(*(F.lit(k) for k in ("assign", "access", "hex", *(c.kind for c in CLASSES))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, base array<struct<kind, start, end>> from the patterns, and spans, which has the entropy spans too.

    Places are in code points, ends exclusive; entropy spans lie beside the patterns' spans, never in them. Null and empty texts have no spans; repeated rows are scanned alike; an
    empty table gives none; other columns don't matter.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("_text"))
    base = F.concat(
        _plain(_placed(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS)),
        _plain(_placed(t, ACCESS, "access", lambda m: F.lit(True))),
        _plain(_placed(t, HEX, "hex", lambda m: F.lit(True))),
    )
    found = inner.withColumn("_base", base)
    hex_spans = found.withColumn("_hex", _entropy_spans(t, CLASSES[0], F.col("_base")))
    more = _entropy_spans(t, CLASSES[1], F.concat("_base", "_hex"))
    return hex_spans.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), _in_order(F.col("_base")).alias("base"), _in_order(F.concat(F.col("_base"), F.col("_hex"), more).cast(_SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each group of overlapping spans (in order of their starts) replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        between = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark; texts without secrets, null ones included, stay as they are."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("_row"), F.col(text).alias("_body"))
    scanned = scan_secrets(packed, ("_row", "_body"), "_body")
    return scanned.select(*(redacted(F.col("_body"), F.col("spans")).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
