"""SQL dumps: files of INSERT statements, written and read in parallel.

A dump is cut into ranges of bytes. Whether a range begins inside a literal, a comment or code can't be seen from the
range itself, so reading has two passes: the first finds, for each range alone, where each lexical state at its start
leads at its end; the driver chains these small maps; then each range, whose true first state is now known, reads the
statements that follow its semicolons, beyond its end where the last one ends there. Only the maps (a few bytes a range) come to
the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 64 << 20
#: Lexical states between two bytes: code, code after one dash or slash, in a literal or name of each quote, after a
#: backslash in it, in a comment of each kind, after a star in a block comment.
CODE, DASH, SLASH, LINE, BLOCK, STAR = range(6)
QUOTES = {b"'": 6, b'"': 8, b"`": 10}
STATES = 12
_TURN = {
    CODE: re.compile(rb"['\"`;/-]"),
    LINE: re.compile(rb"\n"),
    BLOCK: re.compile(rb"\*"),
    6: re.compile(rb"['\\]"),
    8: re.compile(rb"[\"\\]"),
    10: re.compile(rb"`"),
}


def _walk(data: bytes, state: int, backslash: bool = True) -> Iterator[int]:
    """Yields the place after each semicolon that ends a statement, and last of all -1 - the state at the end."""
    at, n = 0, len(data)
    while at < n:
        if state in _TURN:  # states in which most bytes change nothing
            found = _TURN[state].search(data, at)
            if not found:
                break
            at = found.start()
        byte, at = data[at : at + 1], at + 1
        if state in (DASH, SLASH):
            if (state, byte) in ((DASH, b"-"), (SLASH, b"*")):
                state = LINE if state == DASH else BLOCK
                continue
            state = CODE  # and the byte counts as code
        if state == CODE:
            if byte == b";":
                yield at
            state = QUOTES.get(byte, {b"-": DASH, b"/": SLASH}.get(byte, CODE))
        elif state == LINE:
            state = CODE
        elif state == BLOCK:
            state = STAR
        elif state == STAR:
            state = CODE if byte == b"/" else STAR if byte == b"*" else BLOCK
        elif state in (7, 9):  # whatever follows a backslash
            state -= 1
        elif byte == b"\\":
            state += 1 if backslash else 0
        else:
            state = CODE  # a doubled quote opens the literal again
    yield -1 - state


def end_states(data: bytes, backslash: bool = True) -> list[int]:
    """The state at the end of data for each state at its start."""
    last: dict[int, int] = {}
    out = []
    for state in range(STATES):
        after = state
        if data:  # after one byte most states are the same
            for x in _walk(data[:1], state, backslash):
                after = x
            after = -1 - after
            if after not in last:
                for x in _walk(data[1:], after, backslash):
                    last[after] = -1 - x
        out.append(last[after] if data else state)
    return out


_NAME = r"(?:`[^`]*`|\"[^\"]*\"|[\w$]+)"
_HEAD = re.compile(rf"\s*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+((?:{_NAME}\s*\.\s*)?{_NAME})\s*(?:\(([^)]*)\)\s*)?VALUES\s*", re.I)
_VALUE = re.compile(r"\s*(?:[EN]?'((?:[^'\\]|\\.|'')*)'|(?:X'|0x)([0-9A-F]*)'?|([^\s,()']+))\s*([,)])", re.I | re.S)
_VALUE_QUOTES = re.compile(r"\s*(?:N?'((?:[^']|'')*)'|(?:X'|0x)([0-9A-F]*)'?|([^\s,()']+))\s*([,)])", re.I | re.S)
_OPEN = re.compile(r"\s*,?\s*\(")
_REMARK = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)
#: What a letter after a backslash stands for; any other stands for itself.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def _unquoted(name: str) -> str:
    return name.strip().strip('`"')


def rows_of(statement: str, table: str, columns: list[str], backslash: bool = True) -> Iterator[tuple[str | None, ...]]:
    """The rows of an INSERT statement into table as texts by columns, others' statements give none. Columns that the
    statement doesn't name are null; without a list of names, values are in the order of columns."""
    head = _HEAD.match(statement, _REMARK.match(statement).end())
    if not head or _unquoted(head[1].rpartition(".")[2]).lower() != table.lower():
        return
    names = [_unquoted(c).lower() for c in head[2].split(",")] if head[2] else [c.lower() for c in columns]
    places = [names.index(c.lower()) if c.lower() in names else None for c in columns]
    value, at = _VALUE if backslash else _VALUE_QUOTES, head.end()
    while found := _OPEN.match(statement, at):
        at, row = found.end(), []
        while True:
            part = value.match(statement, at)
            if not part:
                raise ValueError(f"no value at character {at} of a statement into {table}: {statement[at : at + 40]!r}")
            text, digits, bare, then = part.groups()
            if text is not None:
                text = re.sub(r"\\(.)|''", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else "'", text, flags=re.S) if backslash else text.replace("''", "'")
            elif digits is not None:
                text = bytes.fromhex(digits).decode()
            else:
                text = None if bare.upper() in ("NULL", "DEFAULT") else bare
            row.append(text)
            at = part.end()
            if then == ")":
                break
        if len(row) != len(names):
            raise ValueError(f"{len(row)} values for {len(names)} columns of {table}")
        yield tuple(None if p is None else row[p] for p in places)


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, state: int):
        self.path, self.start, self.end, self.state = path, start, end, state


class SqlDump(DataSource):
    """Options: table, columns and parts (JSON lists), backslash. read() gives them."""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return DumpReader(self.options)


class DumpReader(DataSourceReader):
    def __init__(self, options):
        self.table, self.columns = options["table"], json.loads(options["columns"])
        self.parts, self.backslash = json.loads(options["parts"]), options["backslash"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [Part(*p) for p in self.parts] or [Part("", 0, 0, CODE)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema, rows = pa.schema([(c, pa.string()) for c in self.columns]), []
        for statement in statements(partition, self.backslash):
            for row in rows_of(statement, self.table, self.columns, self.backslash):
                rows.append(row)
                if len(rows) == 1000:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


def statements(part: Part, backslash: bool = True, block: int = 1 << 20) -> Iterator[str]:
    """The statements that follow a semicolon of the part, and the file's first."""
    if part.end <= part.start:
        return
    fs, path = _open(part.path)
    with fs.open_input_file(path) as file:
        size = file.size()
        file.seek(part.start)
        state, own, at, held, begun = part.state, part.start == 0, part.start, [], part.start
        while at < size:
            data = file.read(block)
            if not data:
                break
            cut = 0
            for x in _walk(data, state, backslash):
                if x < 0:
                    state = -1 - x
                    continue
                if own:
                    yield b"".join([*held, data[cut:x]]).decode()
                held, cut, begun, own = [], x, at + x, True
                if begun > part.end:
                    return
            if own:
                held.append(data[cut:])
            elif at + len(data) >= part.end:
                return  # no statement begins here
            at += len(data)
        if own and held:
            yield b"".join(held).decode()  # a last statement without a semicolon


def read(spark: SparkSession, path: str, table: str, schema: str | StructType, split: int = SPLIT, backslash: bool = True) -> DataFrame:
    """The rows that the dump's statements insert into table, cast to schema.

    path: a file, or a folder of which each file whose name doesn't begin with _ or . is a dump. Texts are UTF-8. split:
    bytes of a range; a statement is read by one task, however long it is. backslash: whether a backslash in a literal
    escapes the next character, as in MySQL's dumps; a doubled quote always stands for one. A table that no statement
    names, and an empty file, give no rows; a statement that can't be read, and a value that can't be cast, are errors.
    Repeated rows and nulls stay as they are."""
    spark.dataSource.register(SqlDump)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fs, at = _open(path)
    found = fs.get_file_info(at)
    if found.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    sizes = sorted((f"{prefix}{f.path}", f.size) for f in files if f.is_file and f.size and (found.is_file or f.base_name[0] not in "._"))
    ranges = [(p, s, min(s + split, n)) for p, n in sizes for s in range(0, n, split)]
    states = _first_states(spark, ranges, backslash)
    parts = json.dumps([[*r, s] for r, s in zip(ranges, states)])
    options = {"table": table, "columns": json.dumps(wanted.names), "parts": parts, "backslash": str(backslash).lower()}
    rows = spark.read.format("sqldump").options(**options).load()
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def _first_states(spark: SparkSession, ranges: list[tuple[str, int, int]], backslash: bool) -> list[int]:
    """The lexical state at each range's start. Files of one range need no pass."""
    several = [r for i, r in enumerate(ranges) if any(0 <= j < len(ranges) and ranges[j][0] == r[0] for j in (i - 1, i + 1))]
    ends: dict[tuple[str, int], list[int]] = {}
    if several:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, start, end in batch.itertuples(index=False):
                    fs, at = _open(path)
                    with fs.open_input_file(at) as file:
                        file.seek(start)
                        now, left = list(range(STATES)), end - start
                        while left > 0 and (data := file.read(min(left, 1 << 20))):
                            step = end_states(data, backslash)
                            now, left = [step[s] for s in now], left - len(data)
                    yield pd.DataFrame({"path": [path], "start": [start], "ends": [now]})

        table = spark.createDataFrame(several, "path string, start long, end long").repartition(min(len(several), 4096))
        ends = {(r.path, r.start): r.ends for r in table.mapInPandas(scan, "path string, start long, ends array<int>").collect()}
    out, state = [], CODE
    for path, start, _ in ranges:
        state = CODE if start == 0 else state
        out.append(state)
        state = ends[path, start][state] if (path, start) in ends else CODE
    return out


def _literal(field) -> Column:
    """A value as SQL: numbers as they are, the rest in quotes."""
    c = F.col(f"`{field.name}`")
    text = c.cast("string")
    if field.dataType.typeName() not in ("byte", "short", "integer", "long", "decimal"):
        text = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def write(df: DataFrame, folder: str, table: str, rows: int = 200) -> None:
    """Writes df, of columns that are or can be cast to texts, as INSERT statements of at most so many rows each; a file a
    partition. read() with the same schema gives it back."""
    head = f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in df.columns)}) VALUES\n"
    values = df.select(F.concat(F.lit("("), F.concat_ws(", ", *map(_literal, df.schema)), F.lit(")")).alias("value"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.column(0).slice(at, rows).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [head + ",\n".join(part) + ";"]})

    values.mapInArrow(joined, "value string").write.text(folder)
