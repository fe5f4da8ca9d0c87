"""Command line: ``python -m sievelake triage|compare|query ...`` (G6, K12, section 2.20). Reads landed files; there are no network clients."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievelake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("triage", help="articles (JSON lines) to decisions, saved as JSON lines; the search's counters are printed")
    t.add_argument("--articles", required=True)
    t.add_argument("--topic", required=True)
    t.add_argument("--intervention", default="")
    t.add_argument("--condition", default="")
    t.add_argument("--fetched-at", required=True)
    t.add_argument("--limit", type=int, default=10)
    t.add_argument("--save", required=True)
    c = sub.add_parser("compare", help="what changed between two snapshot files: ids and scope, then every change")
    c.add_argument("baseline")
    c.add_argument("target")
    c.add_argument("--save", help="a folder for the changes as JSON lines; else they are printed in order")
    q = sub.add_parser("query", help="one of the registered queries over a folder of tables")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--save")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "triage":
        from sievelake.operators.relevance import parse_target
        from sievelake.plans.triage import Counters, triage
        from sievelake.sources.articles import ARTICLE

        rows = spark.read.schema(f"{ARTICLE}, retrieval_pos long").json(a.articles).withColumn("topic_id", F.lit(a.topic))
        counters = Counters(a.topic, report_limit=a.limit)
        triage(rows, parse_target(a.topic, a.intervention, a.condition), a.fetched_at, a.topic, limit=a.limit, counters=counters).write.mode("errorifexists").json(a.save)
        print(json.dumps(counters.summary()))
    elif a.command == "compare":
        from sievelake.operators.compare import change_order, comparison_of
        from sievelake.operators.diff import ComparisonError
        from sievelake.operators.snapshots import check_versions, load_snapshot, require_comparable

        try:
            docs = [load_snapshot(spark, x) for x in (a.baseline, a.target)]
            check_versions(*docs)
            scope = require_comparable(*docs).first().asDict()
            changes, ids = comparison_of(*docs)
            print(json.dumps(scope | ids.first().asDict()))
            if a.save:
                changes.write.mode("errorifexists").json(a.save)
            else:
                for line in changes.orderBy(*change_order()).toJSON().toLocalIterator():
                    print(line)
        except ComparisonError as e:
            print(json.dumps({"error": e.code, "text": str(e)}))
            return 2
    else:
        from sievelake.plans.registry import queries

        found = queries()[a.name](spark, a.data)
        found.write.mode("errorifexists").parquet(a.save) if a.save else found.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
