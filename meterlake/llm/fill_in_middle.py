"""Fill-in-middle rearrangement of texts in built-in column functions.

A pattern that matches one code point at a time makes the array of units. Digits of a SHA-256 of the row's key, read as
hexadecimal numbers, give two cuts and the form; slices of the array are joined around sentinels. The text is got back by
parsing the sentinels of the output, without the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks before each section. Each begins with ``<`` and ends with ``>`` and has neither between, so that none can arise where a section meets a mark."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for mark in self.all():
            if len(mark) < 3 or mark[0] != "<" or mark[-1] != ">" or set(mark[1:-1]) & set("<>"):
                raise ValueError(f"not a sentinel: {mark}")
        if len(set(self.all())) < 3:
            raise ValueError("sentinels must differ")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def pattern(self) -> str:
        return "|".join(rf"\Q{m}\E" for m in self.all())


def units(text: Column) -> Column:
    """The code points of ``text``, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first digits of the SHA-256 of seed, colon and key. A null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _joined(cut: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(cut, first + 1, n), "")


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` was made from; null if the sentinels of its form aren't there, each once and in order."""
    parts = F.split(output, marks.pattern(), -1)
    order = {PSM: (marks.prefix, marks.suffix, marks.middle), SPM: (marks.suffix, marks.prefix, marks.middle)}
    out = F.when(form == PLAIN, output)
    for name, marked in order.items():
        section = {m: parts[i + 1] for i, m in enumerate(marked)}
        # with four parts and an empty first one, the output is the marked sections if their marks stand in this order
        again = F.concat(*(x for m in marked for x in (F.lit(m), section[m])))
        whole = (F.size(parts) == 4) & (again == output)
        out = out.when((form == name) & whole, F.concat(section[marks.prefix], section[marks.middle], section[marks.suffix]))
    return out


def fill_in_middle(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", seed: int = 1, changed: int = 90, spm: int = 20, marks: Sentinels = Sentinels()
) -> DataFrame:
    """``keep`` columns, n (code points), form, prefix_chars, middle_chars, output, restored.

    ``changed`` of 100 keys are rearranged, ``spm`` of 100 of these suffix first. Empty and null texts (as empty ones) and texts that hold
    a sentinel stay plain: output is the text, and the two lengths are null. A null key draws as an empty one.
    Repeated rows are alike; an empty table gives no rows; columns that aren't kept don't matter. ``restored`` is parsed from output and form alone.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    h1, h2, h3, h4 = draws(F.col("_key"), seed)
    kept = (body == "") | (h3 % 100 >= changed)
    for mark in marks.all():
        kept = kept | F.contains(body, F.lit(mark))
    form = F.when(kept, PLAIN).when(h4 % 100 < spm, SPM).otherwise(PSM)
    # each step is used more than once by the next, so that the optimizer leaves them apart and computes them once
    cut = inner.select("*", body.alias("_body"), form.alias("_form")).withColumn("_units", units(F.col("_body")))
    sized = cut.withColumn("_n", F.size("_units"))
    placed = sized.select("*", (h1 % (F.col("_n") + 1)).cast("int").alias("_a"), (h2 % (F.col("_n") + 1)).cast("int").alias("_b"))
    placed = placed.select("*", F.least("_a", "_b").alias("_from"), F.greatest("_a", "_b").alias("_to"))
    u, start, end = F.col("_units"), F.col("_from"), F.col("_to")
    prefix, middle, suffix = _joined(u, F.lit(0), start), _joined(u, start, end - start), _joined(u, end, F.col("_n") - end)
    p, s, m = (F.lit(x) for x in marks.all())
    output = F.when(F.col("_form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).when(F.col("_form") == SPM, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("_body"))
    made = placed.select(*(f"_k{i}" for i in range(len(keep))), "_form", "_n", "_from", "_to", output.alias("_output"))
    moved = F.col("_form") != PLAIN
    return made.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("_n").cast("long").alias("n"),
        F.col("_form").alias("form"),
        F.when(moved, F.col("_from").cast("long")).alias("prefix_chars"),
        F.when(moved, (F.col("_to") - F.col("_from")).cast("long")).alias("middle_chars"),
        F.col("_output").alias("output"),
        restored(F.col("_output"), F.col("_form"), marks).alias("restored"),
    )
