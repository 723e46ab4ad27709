"""Command line: python -m catalens CATALOG COMMAND ...

index FOLDER          walk a folder and add its entries
search [WORDS...]     a page of results; without words the files of the last five days
delete PATH...        delete paths; --prefix deletes all below them too
compact               merge everything into one generation
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalens.functions import labels as L
from catalens.model import SearchOptions
from catalens.operators.search import page
from catalens.operators.stats import files_per_second
from catalens.sources import walker
from catalens.sources.catalog import Catalog


def shown(results):
    """The columns that are displayed."""
    return results.select(
        L.kind_label(F.col("kind")).alias("kind"), L.category_label(F.col("category")).alias("category"), F.round("score", 2).alias("score"), L.score_band(F.col("score")).alias("band"),
        L.time_label(F.col("last_modified")).alias("modified"), L.time_label(F.col("last_accessed")).alias("accessed"), "volume", "path",
    )


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="catalens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("catalog")
    commands = p.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--volume", default="/")
    search = commands.add_parser("search")
    search.add_argument("words", nargs="*")
    search.add_argument("--page", type=int, default=0)
    search.add_argument("--volume")
    search.add_argument("--category", type=int)
    search.add_argument("--kind", type=int)
    delete = commands.add_parser("delete")
    delete.add_argument("paths", nargs="+")
    delete.add_argument("--prefix", action="store_true")
    commands.add_parser("compact")
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName("catalens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with Catalog(spark, a.catalog) as catalog:
        began = time.time()
        if a.command == "index":
            walker.register(spark)
            entries = spark.read.format("entries").option("path", a.folder).option("volume", a.volume).load()
            before = catalog.ops().count()
            catalog.insert_batch(entries)
            n, ms = catalog.ops().count() - before, int((time.time() - began) * 1000)
            took = spark.range(1).select(L.millis_label(F.lit(ms)), files_per_second(F.lit(n), F.lit(ms))).first()
            print(f"{n} entries in {took[0]}, {took[1]} a second")
        elif a.command == "search":
            limit, offset = page(a.page)
            options = SearchOptions(volume_name=a.volume, category=a.category, kind=a.kind)
            shown(catalog.search_or_recent(" ".join(a.words), limit, offset, options)).show(limit, truncate=False)
        elif a.command == "delete":
            for path in a.paths:
                (catalog.delete_prefix if a.prefix else catalog.delete)(path)
        else:
            catalog.force_compact_all()


if __name__ == "__main__":
    main()
