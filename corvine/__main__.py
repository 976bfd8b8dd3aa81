"""python -m corvine build|search|inspect|deep --store DIR [--root DIR] [-k N] [QUERY]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import retrieve
from .plans.index import Index
from .shipping import ship
from .sources.tree import project_root


def main() -> None:
    parser = argparse.ArgumentParser(prog="corvine", description="Index a source tree and search it.")
    parser.add_argument("command", choices=("build", "search", "inspect", "deep"))
    parser.add_argument("query", nargs="?", default="", help="a question, or a path to inspect")
    parser.add_argument("--store", required=True, help="folder of the index")
    parser.add_argument("--root", help="the project; else the environment's, else found by its markers")
    parser.add_argument("-k", type=int, default=4)
    given = parser.parse_args()
    spark = SparkSession.builder.appName("corvine").getOrCreate()
    ship(spark)
    index = Index(spark, given.store)
    root = str(project_root(given.root))
    if given.command == "build":
        print(f"version {index.build(root)}")
    else:
        index.load(root)
        show = {"search": lambda: retrieve.search_markdown(index, given.query, given.k), "inspect": lambda: retrieve.inspect_markdown(index, given.query), "deep": lambda: retrieve.deep_search_markdown(index, given.query, given.k)}
        print(show[given.command]())
    spark.stop()


if __name__ == "__main__":
    main()
