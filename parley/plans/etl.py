"""The telemetry job: chat logs in, one analytics row per user out.

Run with ``spark-submit --jars <jdbc driver> -m parley.plans.etl --url jdbc:postgresql://... --user ...
--rejected <shared folder>``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from parley.constants import TOPIC_WORDS
from parley.operators.analytics import interaction_counts, user_analytics, with_topics
from parley.session import build_session
from parley.sources.readers import read_jdbc
from parley.sources.sinks import write_overwrite


def aggregate_logs(logs: DataFrame, topics: int | None = None) -> DataFrame:
    """The target rows: with the fixed topic list, or with each user's ``topics`` most frequent ones.

    Logs without a topic column get one from the words of their messages.
    """
    if topics is None:
        return interaction_counts(logs)
    if "topic" not in logs.columns:
        logs = with_topics(logs, logs.sparkSession.createDataFrame(TOPIC_WORDS, "word string, topic string"))
    return user_analytics(logs, topics)


def run_etl(
    read: Callable[[], DataFrame],
    target: str,
    fmt: str = "jdbc",
    options: Mapping[str, str] | None = None,
    topics: int | None = None,
    *,
    rejected: str,
) -> int:
    """Read, aggregate, overwrite ``target``; returns the number of rejected rows.

    Rejected rows are kept as a Parquet table in the folder ``rejected``.
    The target table is truncated and keeps its constraints. A failed run raises; running again is safe.
    """
    table = aggregate_logs(read(), topics)
    return write_overwrite(table, target, "user_id", rejected, ["total_interactions"], fmt, dict(options or {}))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser(description=__doc__)
    cli.add_argument("--url", required=True)
    cli.add_argument("--user", required=True)
    cli.add_argument("--password-env", default="JDBC_PASSWORD", help="variable that holds the password")
    cli.add_argument("--driver", default="org.postgresql.Driver")
    cli.add_argument("--source", default="chat_logs")
    cli.add_argument("--target", default="user_analytics")
    cli.add_argument("--partitions", type=int, default=4)
    cli.add_argument("--fetchsize", type=int, default=5000)
    cli.add_argument("--topics", type=int, help="store this many real topics instead of the fixed list")
    cli.add_argument("--rejected", required=True, help="folder that keeps the rows which the target cannot take")
    args = cli.parse_args(argv)
    login = {"user": args.user, "password": os.environ.get(args.password_env, ""), "driver": args.driver}
    session = spark or build_session("parley-telemetry")

    def read() -> DataFrame:
        return read_jdbc(
            session, args.url, args.source, "id", None, args.partitions, args.fetchsize, **login
        )

    rejected = run_etl(read, args.target, "jdbc", {"url": args.url, **login}, args.topics, rejected=args.rejected)
    print(f"rejected rows: {rejected}")
    return rejected


if __name__ == "__main__":
    main()
