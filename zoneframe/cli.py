"""python -m zoneframe.cli analyze|head PATH, dump PATH COLUMN, cat OUTPUT INPUT..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources import tools
from .sources.reader import ROW_GROUP, Reader


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="zoneframe")
    todo = parser.add_subparsers(dest="todo", required=True)
    for name in ("analyze", "head"):
        todo.add_parser(name).add_argument("path")
    one = todo.add_parser("dump")
    one.add_argument("path")
    one.add_argument("column", type=int)
    several = todo.add_parser("cat")
    several.add_argument("--row-group-size", type=int, default=ROW_GROUP)
    several.add_argument("output")
    several.add_argument("inputs", nargs="+")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("zoneframe").getOrCreate()
    if given.todo == "analyze":
        for r in tools.analyze(Reader(spark, given.path)).orderBy("place").collect():
            print(*("" if v is None else v for v in r), sep="\t")
    elif given.todo == "head":
        print(tools.head_text(Reader(spark, given.path)))
    elif given.todo == "dump":
        for value in tools.dumped(Reader(spark, given.path), given.column):
            print(value)
    else:
        tools.cat(spark, given.inputs, given.output, given.row_group_size)


if __name__ == "__main__":
    main()
