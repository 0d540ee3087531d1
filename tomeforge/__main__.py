"""Command line: python -m tomeforge {build,index,extend,anchors,write,counts,prefix,phrase,link} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tomeforge.operators import linking, lookup, search
from tomeforge.plans import runs
from tomeforge.sources.settings import Settings


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tomeforge", description="Builds and asks tables of an encyclopedia dump.")
    out.add_argument("--config", default="config.toml", help="settings in TOML")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("build", help="indices, templates and anchor counts; what exists is kept")
    sub.add_parser("index", help="the search index")
    sub.add_parser("extend", help="add what the search index lacks")
    sub.add_parser("anchors", help="one line for each anchor")
    write = sub.add_parser("write", help="lines of one kind, as text")
    write.add_argument("kind", choices=[*runs.ROWS, "titles"])
    write.add_argument("path")
    for name, what in (("counts", "entities of a surface form"), ("prefix", "keys that begin with a text"), ("phrase", "number of documents with a phrase"), ("link", "entities in a text")):
        sub.add_parser(name, help=what).add_argument("query")
    return out


def main(arguments: list[str] | None = None) -> None:
    asked = parser().parse_args(arguments)
    settings = Settings.load(asked.config)
    spark = SparkSession.builder.appName("tomeforge").getOrCreate()
    if asked.command == "build":
        runs.build_counts(spark, settings)
    elif asked.command == "index":
        runs.build_index(spark, settings)
    elif asked.command == "extend":
        print(runs.extend_index(spark, settings))
    elif asked.command == "write":
        runs.write_rows(spark, settings, asked.kind, asked.path)
    elif asked.command == "anchors":
        runs.write_anchors(spark, settings)
    elif asked.command in ("counts", "prefix"):
        counts = spark.read.parquet(settings.anchor_counts)
        found = lookup.fetch_one(counts, asked.query) if asked.command == "counts" else lookup.by_prefix(counts, asked.query).select("key", "n")
        for key, n in found.toLocalIterator():
            print(key, n, sep="\t")
    elif asked.command == "phrase":
        print(search.phrase_df(spark.read.parquet(settings.search_index), asked.query).first()[0])
    else:
        text = spark.createDataFrame([(0, asked.query)], "text_id int, text string")
        found = linking.link(text, spark.read.parquet(settings.anchor_counts), spark.read.parquet(settings.search_index))
        for row in found.orderBy("pos", "surface").toLocalIterator():
            print(row["surface"], row["entity"], round(row["score"], 4), sep="\t")


if __name__ == "__main__":
    main()
