"""Programs by name, with their parameters: ``python -m tarnflow.cli NAME --parameter value ...``.

Tables are Parquet folders, lines are text files; an output that exists is an error.
``python -m tarnflow.cli query --name wordcount --data DIR --output PATH`` runs any
registered query. Without a name the programs are listed.
"""

from __future__ import annotations

import argparse
import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import sort
from tarnflow.plans import algorithms, catalog, generators
from tarnflow.sources.files import read_lines

Program = Callable[..., DataFrame]

PROGRAMS: dict[str, Program] = {}


def program(work: Program) -> Program:
    PROGRAMS[work.__name__] = work
    return work


@program
def wordcount(spark: SparkSession, input: str) -> DataFrame:
    """Words of lines with their counts."""
    return algorithms.wordcount(read_lines(spark, input), "value")


@program
def grep(spark: SparkSession, input: str, pattern: str, group: int = 0) -> DataFrame:
    """Matches of a pattern in lines with their counts, most frequent first."""
    return algorithms.grep(read_lines(spark, input), "value", pattern, group)


def _edges(spark: SparkSession, input: str) -> DataFrame:
    return algorithms.format_graph(read_lines(spark, input))


@program
def pagerank(spark: SparkSession, input: str, iterations: int = 10, threshold: float = 0.0, checkpoint_every: int = 1) -> DataFrame:
    """Ranks of the nodes of link lines ``src dst``; stops below a summed change."""
    return algorithms.pagerank(_edges(spark, input), iterations, threshold or None, checkpoint_every).state


@program
def sssp(spark: SparkSession, input: str, source: int = 0, iterations: int = 1000) -> DataFrame:
    """Distances from a node in lines ``src dst weight``."""
    parts = F.split(F.trim("value"), r"\s+")
    edges = read_lines(spark, input).select(*(parts[k].try_cast(kind).alias(name) for k, (name, kind) in enumerate((("src", "long"), ("dst", "long"), ("w", "double")))))
    return algorithms.sssp(edges.dropna(), source, iterations, until_stable=True).state


@program
def kmeans(spark: SparkSession, input: str, clusters: int = 8, iterations: int = 10, threshold: float = 0.0) -> DataFrame:
    """Centers of a table ``sk, sv`` of points, from those of lowest key on."""
    points = spark.read.parquet(input).select("sk", F.col("sv").cast("array<double>").alias("sv"))
    first = points.orderBy("sk").limit(clusters).select(F.col("sk").alias("dk"), F.col("sv").alias("dv"))
    return algorithms.kmeans(points, first, iterations, threshold or None).state


@program
def apriori(spark: SparkSession, input: str, support: int = 1) -> DataFrame:
    """Pairs of words that lines have in common, above a support."""
    return algorithms.apriori_pairs(read_lines(spark, input), "value", support)


@program
def lines_sort(spark: SparkSession, input: str, spec: str = "-k1,1") -> DataFrame:
    """Lines in order of a key spec."""
    return sort.key_sort(read_lines(spark, input), "value", spec)


@program
def teragen(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """Fixed rows of random keys."""
    return generators.tera_rows(spark, rows)


@program
def query(spark: SparkSession, name: str, data: str) -> DataFrame:
    """A registered query over a folder of tables."""
    return catalog.QUERIES[name](spark, data)


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="tarnflow", description="Programs by name.")
    chosen = whole.add_subparsers(dest="program", metavar="NAME")
    for name, work in PROGRAMS.items():
        one = chosen.add_parser(name, help=inspect.getdoc(work))
        for parameter in list(inspect.signature(work, eval_str=True).parameters.values())[1:]:
            needed = parameter.default is inspect.Parameter.empty
            one.add_argument(f"--{parameter.name.replace('_', '-')}", type=parameter.annotation, required=needed, default=None if needed else parameter.default)
        one.add_argument("--output", required=True)
        one.add_argument("--format", default="parquet")
    return whole


def main(words: list[str], spark: SparkSession | None = None) -> int:
    """Run one program; 2 where none is named."""
    told = vars(parser().parse_args(words))
    name = told.pop("program")
    if not name:
        parser().print_help()
        return 2
    output, kind = told.pop("output"), told.pop("format")
    spark = spark or SparkSession.builder.appName(name).getOrCreate()
    PROGRAMS[name](spark, **told).write.mode("errorifexists").format(kind).save(output)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
