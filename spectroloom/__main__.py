"""python -m spectroloom COMMAND ...: the pipelines from files to files.

ingest RUN OUT | features RUN_FOLDER OUT | search RUN_FOLDER FASTA OUT [PARAMETERS] | fdr TARGET DECOY OUT | align DATASETS OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spectroloom.operators import search
from spectroloom.sources import fasta, parameters, spectra, tables


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spectroloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("ingest", ["run", "out"]), ("features", ["run", "out"]), ("search", ["run", "proteins", "out"]), ("fdr", ["target", "decoy", "out"]), ("align", ["datasets", "out"])):
        sub = commands.add_parser(name)
        for p in places:
            sub.add_argument(p)
        if name == "ingest":
            sub.add_argument("--first", type=int)
            sub.add_argument("--last", type=int)
        if name == "search":
            sub.add_argument("--parameters")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("spectroloom").getOrCreate()
    if a.command == "ingest":
        search.ingest(spark, a.run, a.out, a.first, a.last)
    elif a.command == "features":
        runs = spectra.read_run(spark, a.run)
        search.find_features(runs if "run" in runs.columns else runs.withColumn("run", F.lit(a.run))).write.parquet(a.out)
    elif a.command == "search":
        options = parameters.read_parameters(spark, a.parameters) if a.parameters else None
        search.search(spectra.read_run(spark, a.run), fasta.read_fasta(spark, a.proteins), None, options).write.parquet(a.out)
    elif a.command == "fdr":
        tables.write_results(search.fdr_of_files(spark, a.target, a.decoy), a.out)
    else:
        # a list of files: one row each
        sets = tables.read_datasets(spark, a.datasets).collect()
        tables.write_crosstab(search.align({r["Label"]: tables.read_features(spark, r["FeatureFilePath"]) for r in sets}), a.out, "group_id")


if __name__ == "__main__":
    main()
