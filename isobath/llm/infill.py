"""Fill-in-the-middle: documents cut in three and rearranged, by DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with a DuckDB connection of its task, one statement transforms it,
and its Arrow result goes back to Spark; no row passes through Python.  The cuts hang on the id
alone, so they are the same in every layout and rerun.

A text of n code points is cut at two of its n + 1 borders.  h1 to h4 are the first four groups of
eight hexadecimal digits of the SHA-256 of ``1:`` and the decimal id.  The prefix ends at the smaller
of h1 % (n + 1) and h2 % (n + 1), the middle at the larger.  A text stays ``plain`` if it is empty,
holds a sentinel, or h3 % 100 reaches ``rate``; else it is ``spm`` (suffix first) if h4 % 100 is
below ``spm``, or ``psm``.  A sentinel begins with a character that it has nowhere else, so it can't
arise where parts meet, and ``restored`` rebuilds the exact text from output and form.

Defined results: a null text is empty; bytes that are not UTF-8 become U+FFFD; a null id hashes as
``1:``; rows are independent, so repeated rows repeat their result; an empty table gives no rows;
other columns are neither looked at nor returned.  A batch is cut into slices of ``SLICE`` bytes,
so what DuckDB holds is bounded by that, or by the longest text: about 20 bytes a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from isobath.llm.common import decoded, slices, text_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rearranged, and of these, that put the suffix first.
RATE, SPM = 90, 20
SLICE = 2 << 20

#: Parts of one text as a list of code points; ``a`` and ``b`` are the cuts.
TRANSFORM = """
WITH digest AS (
  SELECT id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(id AS VARCHAR), '')) AS d FROM {source}
), unit AS (
  SELECT id, text, regexp_extract_all(text, '(?s).') AS units,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM digest
), cut AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{prefix}') OR contains(text, '{suffix}') OR contains(text, '{middle}') OR h3 % 100 >= {rate} THEN 'plain'
      WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM unit
), part AS (
  SELECT id, text, n, form, a, b, array_to_string(list_slice(units, 1, a), '') AS p, array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS s
  FROM cut
)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{prefix}' || p || '{suffix}' || s || '{middle}' || m ELSE '{suffix}' || s || '{prefix}' || p || '{middle}' || m END AS output
FROM part
"""

_PSM, _SPM = "(?s)^{prefix}(.*?){suffix}(.*?){middle}(.*)$", "(?s)^{suffix}(.*?){prefix}(.*?){middle}(.*)$"
#: The text from output and form alone, in the place of the output.
RESTORE = f"""
WITH part AS (
  SELECT *, CASE WHEN form = 'psm' AND regexp_matches(output, '{_PSM}') THEN regexp_extract(output, '{_PSM}', ['p', 's', 'm'])
    WHEN form = 'spm' AND regexp_matches(output, '{_SPM}') THEN regexp_extract(output, '{_SPM}', ['s', 'p', 'm']) END AS r
  FROM {{source}}
)
SELECT * EXCLUDE (r) REPLACE (CASE WHEN form = 'plain' THEN output ELSE r['p'] || r['m'] || r['s'] END AS output) FROM part
"""


def filled(statement: str, source: str, rate: int = RATE, spm: int = SPM) -> str:
    return statement.format(source=source, prefix=PREFIX, suffix=SUFFIX, middle=MIDDLE, rate=rate, spm=spm)


def over_batches(rows: DataFrame, statement: str, schema: T.StructType, text: int) -> DataFrame:
    """``statement``, over a table ``batch``, run on each Arrow batch of ``rows``; column ``text`` holds the long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # nothing is spilled to a disk of this machine
        own = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for part in slices(batch, text, SLICE):
                try:
                    part.column(text).validate(full=True)
                except pa.ArrowInvalid:
                    part = part.set_column(text, part.schema.field(text), pa.array(decoded(part.column(text)), part.schema.field(text).type))
                own.register("batch", pa.Table.from_batches([part]))
                yield from own.sql(statement).to_arrow_table().to_batches()
                own.unregister("batch")

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``id_col``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the rearranged ``output`` of every row."""
    rows = text_rows(docs, id_col, text_col)
    own = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", own), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return over_batches(rows, filled(TRANSFORM, "batch", rate, spm), schema, 1).withColumnRenamed("id", id_col)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the text that ``form`` and ``output`` came from, as ``text`` in the place of ``output``; null where no text gives that output."""
    rows = outputs.select(*[c for c in outputs.columns if c != "output"], "output")
    return over_batches(rows, filled(RESTORE, "batch"), rows.schema, len(rows.columns) - 1).withColumnRenamed("output", "text")
