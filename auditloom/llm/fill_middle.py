"""Fill-in-the-middle: texts cut into prefix, middle and suffix at ends of lines, arranged with sentinels, and put together again, by DataFrame functions alone.

Everything about a row comes from its text and from a hash of its id, so that rows
don't meet: nothing is shuffled, and a row that is computed again is the same.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
DIGITS = 8


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no text without them can form one where it meets one: else they couldn't be read back."""
    for a, b in product(marks, repeat=2):
        inside = a != b and a in b
        if not a or inside or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {marks}: empty, within one another, or one begins as another ends")
    if len(set(marks)) < 3:
        raise ValueError(f"sentinels {marks}: two are the same")
    return marks


def numbers(doc_id: Column, seed: int, n: int = 4) -> Column:
    """The first n groups of eight hexadecimal digits of the hash of seed and id, as longs. A null id counts as the empty word."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, DIGITS * k + 1, DIGITS), 16, 10).cast("long") for k in range(n)))


def arrange(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix and output of every row.

    ``rate`` percent of the rows are arranged, ``spm_rate`` percent of those with the
    suffix first. form is plain, psm or spm. A null text counts as empty; empty texts
    and those that hold a sentinel are plain: their output is the text, and their
    parts are null. Other columns of docs, whatever their names, are left out; rows
    that repeat an id are arranged alike, and texts are never cut short.
    """
    for_prefix, for_suffix, for_middle = checked(marks)
    held = [F.col("text").contains(x) for x in marks]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (F.col("h")[2] % 100 >= rate)
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    cuts = [(F.col("h")[k] % (F.col("n") + 1)).cast("int") for k in (0, 1)]
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), numbers(F.col("doc_id"), seed).alias("h"))
        .withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)))
        .withColumn("n", F.size("units").cast("long"))
        .withColumns({"first": F.least(*cuts), "last": F.greatest(*cuts)})
        .withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm"))
        .withColumns(
            {
                "prefix": part(F.lit(1), F.col("first")),
                "middle": part(F.col("first") + 1, F.col("last") - F.col("first")),
                "suffix": part(F.col("last") + 1, F.size("units") - F.col("last")),
            }
        )
        .withColumn(
            "output",
            F.when(F.col("form") == "psm", F.concat(F.lit(for_prefix), "prefix", F.lit(for_suffix), "suffix", F.lit(for_middle), "middle"))
            .when(F.col("form") == "spm", F.concat(F.lit(for_suffix), "suffix", F.lit(for_prefix), "prefix", F.lit(for_middle), "middle"))
            .otherwise(F.col("text")),
        )
        .select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output")
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from output and form alone: each sentinel stands there once, and parts hold none."""
    pattern = "|".join(f"\\Q{x}\\E" for x in checked(marks))
    parts = F.split(output, pattern)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digest(arranged: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text restored from it."""
    return arranged.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"),
    )
