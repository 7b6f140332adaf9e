import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from churnlake.schema import BANK  # noqa: E402
from churnlake.session import get_spark, staged  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bank(spark):
    """10,000 customers whose churn depends on age, products, activity, country and gender."""

    def u(k):
        return f"(pmod(xxhash64(id, {k}), 1000003) / 1000003.0D)"

    base = spark.range(10000).selectExpr(
        "2025 AS Year",
        "15600000 + id AS CustomerId",
        "concat('Name', pmod(id, 997)) AS Surname",
        f"cast(400 + 450 * {u(1)} AS int) AS CreditScore",
        f"CASE WHEN {u(2)} < 0.5 THEN 'France' WHEN {u(2)} < 0.75 THEN 'Germany' ELSE 'Spain' END AS Geography",
        f"CASE WHEN {u(3)} < 0.45 THEN 'Female' ELSE 'Male' END AS Gender",
        f"cast(18 + 50 * ({u(4)} + {u(5)}) / 2 AS int) AS Age",
        f"cast(11 * {u(6)} AS int) AS Tenure",
        f"CASE WHEN {u(7)} < 0.36 THEN 0.0D ELSE round(60000 + 140000 * {u(8)}, 2) END AS Balance",
        f"CASE WHEN {u(9)} < 0.5 THEN 1 WHEN {u(9)} < 0.95 THEN 2 ELSE 3 END AS NumOfProducts",
        f"cast({u(10)} < 0.7 AS int) AS HasCrCard",
        f"cast({u(11)} < 0.52 AS int) AS IsActiveMember",
        f"round(200000 * {u(12)}, 2) AS EstimatedSalary",
        f"{u(13)} AS _u",
    )
    margin = (
        "-2.1 + 0.12 * (Age - 43) + 0.9 * cast(Geography = 'Germany' AS int) - 1.1 * (IsActiveMember - 0.5)"
        " + CASE NumOfProducts WHEN 1 THEN 0.5 WHEN 2 THEN -0.9 ELSE 3.0 END - 0.3 * cast(Gender = 'Male' AS int)"
    )
    table = base.selectExpr("*", f"cast(_u < 1 / (1 + exp(-({margin}))) AS int) AS Exited").drop("_u")
    return staged(table.select([table[f.name].cast(f.dataType).alias(f.name) for f in BANK.fields]), "bank")
