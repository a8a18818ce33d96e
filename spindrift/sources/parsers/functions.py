"""The parsers as a table function in SQL.

``register(spark)`` makes ``parse_code`` known: ``SELECT * FROM parse_code(TABLE(files), 'symbol')``. The columns of the result follow
from the second argument; the files may be given with ``PARTITION BY`` or ``WITH SINGLE PARTITION`` as any table argument, and have
columns path, language and content.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from spindrift.sources.parsers.table import REGISTRY

#: Columns by kind of record, in the order in which parsers give them.
COLUMNS = {
    "symbol": "path string, language string, pos int, id string, name string, kind string, line_start int, line_end int, source_code string, has_docstring boolean, parameters array<string>",
    "relationship": "path string, language string, pos int, caller string, callee string, line int, rel_type string, is_resolved boolean",
    "import": "path string, language string, pos int, local string, full_path string, module string, imported string, line int",
    "error": "path string, language string, pos int, error string",
}


def _schema(columns: str) -> StructType:
    """The type of a row; DDL needs a session, which a table function has not."""
    kinds = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


class ParseCode:
    """One row for each record of a kind of each file; a language without a parser, and null files, give none."""

    @staticmethod
    def analyze(files: AnalyzeArgument, record: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("the first argument is a table of files: TABLE(files)")
        missing = {"path", "language", "content"} - {f.name for f in files.dataType.fields}
        if missing:
            raise ValueError(f"files have no column {', '.join(sorted(missing))}")
        if record.value not in COLUMNS:
            raise ValueError(f"the second argument is one of {', '.join(COLUMNS)}")
        return AnalyzeResult(schema=_schema(COLUMNS[record.value]))

    def eval(self, files: Row, record: str) -> Iterator[tuple]:
        path, language, content = files["path"], files["language"], files["content"]
        if language not in REGISTRY:
            return
        try:
            parsed = REGISTRY[language][0](path or "", content or "")
        except Exception as error:  # one bad file must not end the query
            if record == "error":
                yield path, language, 0, f"{type(error).__name__}: {error}"[:500]
            return
        rows = {"symbol": parsed.symbols, "relationship": parsed.relationships, "import": parsed.imports}.get(record, [])
        for pos, row in enumerate(rows):
            yield (path, language, pos, *row)


def register(spark: SparkSession, name: str = "parse_code") -> None:
    """Make the table function known to a session under a name."""
    spark.udtf.register(name, udtf(ParseCode))
