"""The session the engine expects, whose own settings win over these, and the package on its executors."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "tessera") -> SparkSession:
    """The running session, or a new one: UTC, ANSI, adaptive execution with skew handling."""
    spark = (
        SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever they run: once to an application, as a zip of its sources that Spark sends out.

    A package that is itself in a zip or wheel came by --py-files, so it is there already.
    """
    app, home = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not home.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-code-"), f"{home.name}_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shipped(query: Callable[..., Any]) -> Callable[..., Any]:
    """``query(spark, ...)`` with the package on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: Any, **named: Any) -> Any:
        ship(spark)
        return query(spark, *args, **named)

    return run
