"""Fill-in-middle transformation by a sparse checkpoint index.

Where a text is cut depends on how many units it has, so it is counted before it can be cut. Counting records the byte
and code-point offset after every EVERY units; each cut then finds the last checkpoint before it by binary search and
scans on from there, over fewer than EVERY units. A text is scanned in pieces of CHUNK bytes, so that its index is all
that grows with it: two numbers for every EVERY units.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import BLANKS, sha256_text, table, text_of

#: Units between two checkpoints, and bytes scanned at a time.
EVERY, CHUNK = 256, 1 << 16

#: A unit: blanks and the word behind them, or blanks at the end.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

#: Marks of prefix, suffix and middle. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")

#: Seed of the hash, percentage of texts that are transformed, and of those that take the form spm.
SEED, RATE, SPM = 42, 50, 80

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True


class Index:
    """The number of units of a text (UTF-8), and its checkpoints: units, bytes and code points before each."""

    def __init__(self, data: bytes, every: int = EVERY, chunk: int = CHUNK) -> None:
        self.data, self.n = data, 0
        self.units, self.bytes, self.points = [0], [0], [0]
        raw, points = np.frombuffer(data, np.uint8), 0
        for at in range(0, len(data), chunk):
            part = raw[at : at + chunk + 1]  # one byte more, to see whether a word ends with the piece
            blank = _BLANK[part]
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            if at + chunk >= len(data):  # a last unit of either kind ends with the text
                ends = np.append(ends, len(part))
            part = part[:chunk]
            marked = ends[every - 1 - self.n % every :: every]
            starts = (part & 0xC0) != 0x80
            if len(marked):
                self.units.extend(range((self.n // every + 1) * every, self.n + len(ends) + 1, every))
                self.bytes.extend((marked + at).tolist())
                self.points.extend((np.cumsum(starts)[marked - 1] + points).tolist())
            self.n += len(ends)
            points += int(np.count_nonzero(starts))

    def offset(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before this unit."""
        k = bisect_right(self.units, unit) - 1
        start = end = self.bytes[k]
        for found in islice(UNIT.finditer(self.data, start), unit - self.units[k]):
            end = found.end()
        return end, self.points[k] + len(self.data[start:end].decode("utf-8", "surrogatepass"))


CUTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix_bytes", "prefix_chars", "middle_bytes", "middle_chars")])


@F.arrow_udf(CUTS)
def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Units of each text, and the length of its prefix and middle when it is cut at first and second modulo n + 1 units."""
    rows = []
    for data, h1, h2 in zip(texts.cast(pa.binary()).to_pylist(), first.to_pylist(), second.to_pylist(), strict=True):
        index = Index(data)
        a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (a, a_points), (b, b_points) = index.offset(a), index.offset(b)
        rows.append((index.n, a, a_points, b - a, b_points - a_points))
    names, columns = CUTS.names, zip(*rows, strict=True)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names) if rows else pa.array([], pa.struct([(n, pa.int64()) for n in names]))


def _hash(ids: Column, k: int, seed: int) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and id, from 1, as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text, output) for each row of docs (needs doc_id and text).

    A text of n units (a word with the blanks before it; blanks at the end are one more) is cut into prefix, middle
    and suffix after two of 0 to n units, which the hash of seed and doc_id picks. The form is psm (marks and parts in
    the order prefix, suffix, middle), spm (suffix, prefix, middle) or plain, the text unchanged: so are texts that
    are empty, that hold a mark, or that the hash leaves out. The lengths, in code points, are null in plain rows.
    A null text is the empty one; texts of blanks alone are one unit. A null doc_id hashes as the empty string, rows
    that repeat an id are cut at the same hashes. Nothing depends on the length of a text but its own task's time and
    memory. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    d = docs.select("doc_id", text_of().alias("text"))
    whole = d.select("doc_id", "text", cuts("text", _hash(F.col("doc_id"), 1, seed), _hash(F.col("doc_id"), 2, seed)).alias("c"))
    plain = (F.col("text") == "") | F.greatest(*[F.contains("text", F.lit(m)) for m in MARKS]) | (_hash(F.col("doc_id"), 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(_hash(F.col("doc_id"), 4, seed) % 100 < spm, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    piece = lambda start, size: F.substring(data, start.cast("int"), size.cast("int")).cast("string")
    a, b = F.col("c.prefix_bytes"), F.col("c.middle_bytes")
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b), piece(a + b + 1, F.octet_length("text") - a - b)
    made = whole.withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return made.select(
        "doc_id", F.col("c.n").alias("n"), "form", F.when(cut, F.col("c.prefix_chars")).alias("prefix_chars"), F.when(cut, F.col("c.middle_chars")).alias("middle_chars"),
        "text", output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha256_text(F.col("output")).alias("output_sha256"), sha256_text(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS x, coalesce(array_to_string(w[a + 1:b], ''), '') AS y, coalesce(array_to_string(w[b + 1:], ''), '') AS z
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y
                        ELSE '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
