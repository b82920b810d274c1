"""Command line: python -m ivlattice COMMAND --tables DIR --out DIR

curate      quotes kept per snapshot day
surfaces    fitted surfaces per snapshot day
features    daily feature rows, their audit and the split manifest
query NAME  any registered query, written as parquet
"""

from __future__ import annotations

import argparse

from ivlattice.sources.tables import write_days


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ivlattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("curate", "surfaces", "features", "query", "list"))
    parser.add_argument("name", nargs="?")
    parser.add_argument("--tables", help="folder of the parquet tables")
    parser.add_argument("--out", help="folder to write to")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from ivlattice.operators import folds
    from ivlattice.plans import chain, features, market, problems, relational, storage
    from ivlattice.session import durable

    catalogue = {n: q for m in (problems, relational, storage, market, chain, features) for n, q in m.QUERIES.items()}
    if a.command == "list":
        print("\n".join(catalogue))
        return
    if not a.tables or not a.out:
        parser.error("--tables and --out are needed")
    spark = SparkSession.builder.appName("ivlattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "curate":
        write_days(market.curated_quotes(spark, a.tables), f"{a.out}/quotes_norm", sort=["currency", "expiry", "strike", "cp"])
    elif a.command == "surfaces":
        write_days(market.surfaces(spark, a.tables), f"{a.out}/surfaces_daily", sort=["currency", "record_kind", "tau", "moneyness"])
    elif a.command == "features":
        rows = durable(features.feature_rows(spark, a.tables))
        write_days(rows, f"{a.out}/features_daily", sort=["currency"])
        write_days(features.feature_audit(spark, a.tables), f"{a.out}/features_audit", sort=["currency"])
        days = rows.selectExpr("snap_date as day")
        folds.manifest(days, folds.folds(days)).write.mode("overwrite").parquet(f"{a.out}/splits")
    elif a.name in catalogue:
        catalogue[a.name](spark, a.tables).write.mode("overwrite").parquet(f"{a.out}/{a.name}")
    else:
        parser.error(f"unknown query {a.name}")


if __name__ == "__main__":
    main()
