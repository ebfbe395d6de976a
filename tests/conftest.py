from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from costspark.runtime import local_session  # noqa: E402

AS_OF = date(2024, 3, 31)

# Column -> type of the hand-made billing rows; a missing value is NULL.
BILL = {
    "bill_payer_account_id": "string",
    "line_item_usage_account_id": "string",
    "line_item_usage_start_date": "timestamp_ntz",
    "bill_billing_period_start_date": "timestamp_ntz",
    "line_item_unblended_cost": "double",
    "line_item_usage_amount": "double",
    "line_item_resource_id": "string",
    "line_item_line_item_type": "string",
    "line_item_usage_type": "string",
    "line_item_operation": "string",
    "line_item_product_code": "string",
    "product_servicecode": "string",
    "product_region": "string",
    "product_location": "string",
    "product_instance_type": "string",
    "product_operating_system": "string",
    "product_tenancy": "string",
    "pricing_term": "string",
    "reservation_reservation_a_r_n": "string",
    "savings_plan_savings_plan_a_r_n": "string",
    "resource_tags": "map<string,string>",
}
SHORT = {
    "payer": "bill_payer_account_id",
    "account": "line_item_usage_account_id",
    "start": "line_item_usage_start_date",
    "period": "bill_billing_period_start_date",
    "cost": "line_item_unblended_cost",
    "usage": "line_item_usage_amount",
    "resource": "line_item_resource_id",
    "kind": "line_item_line_item_type",
    "usage_type": "line_item_usage_type",
    "operation": "line_item_operation",
    "product_code": "line_item_product_code",
    "service": "product_servicecode",
    "region": "product_region",
    "location": "product_location",
    "itype": "product_instance_type",
    "os": "product_operating_system",
    "tenancy": "product_tenancy",
    "term": "pricing_term",
    "ri": "reservation_reservation_a_r_n",
    "sp": "savings_plan_savings_plan_a_r_n",
    "tags": "resource_tags",
}


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "2"})


@pytest.fixture
def bill(spark):
    """``bill(dict(cost=1.0, start="2024-03-01", ...), ...)`` -> billing rows."""

    def build(*rows: dict):
        data = []
        for r in rows:
            full = {SHORT[k]: v for k, v in r.items()}
            for c in ("line_item_usage_start_date", "bill_billing_period_start_date"):
                if isinstance(full.get(c), str):
                    full[c] = datetime.fromisoformat(full[c])
            data.append(tuple(full.get(c) for c in BILL))
        return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in BILL.items()))

    return build


def rows(df, *columns):
    """Result rows as plain tuples."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
