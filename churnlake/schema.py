"""Schemas and feature lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BANK = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("Surname", T.StringType()),
        T.StructField("CreditScore", T.IntegerType()),
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Tenure", T.IntegerType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("NumOfProducts", T.IntegerType()),
        T.StructField("HasCrCard", T.IntegerType()),
        T.StructField("IsActiveMember", T.IntegerType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("Exited", T.IntegerType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("surname", T.StringType()),
        T.StructField("geography", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("num_products", T.IntegerType()),
        T.StructField("has_urgent", T.IntegerType()),
        T.StructField("is_active_member", T.IntegerType()),
        T.StructField("est_spend", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("exited", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class CustomerTable:
    """Which column of a customer table plays which part."""

    id: str
    label: str
    identifiers: tuple[str, ...]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    balance: str
    salary: str
    products: str
    tenure: str
    active: str
    age: str | None

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.identifiers, *self.numeric, *self.categorical, self.label)


BANK_TABLE = CustomerTable(
    id="CustomerId",
    label="Exited",
    identifiers=("CustomerId", "Surname"),
    categorical=("Geography", "Gender"),
    numeric=(
        "Year",
        "CreditScore",
        "Age",
        "Tenure",
        "Balance",
        "NumOfProducts",
        "HasCrCard",
        "IsActiveMember",
        "EstimatedSalary",
    ),
    balance="Balance",
    salary="EstimatedSalary",
    products="NumOfProducts",
    tenure="Tenure",
    active="IsActiveMember",
    age="Age",
)

PROFILE_TABLE = CustomerTable(
    id="customer_id",
    label="exited",
    identifiers=("customer_id", "surname"),
    categorical=("geography", "segment"),
    numeric=(
        "balance",
        "tenure",
        "num_products",
        "has_urgent",
        "is_active_member",
        "est_spend",
        "year",
    ),
    balance="balance",
    salary="est_spend",
    products="num_products",
    tenure="tenure",
    active="is_active_member",
    age=None,
)
