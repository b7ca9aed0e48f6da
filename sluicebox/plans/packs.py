"""The six bundled rule packs. Names, mappings and defaults are fixed values of the packs."""

from __future__ import annotations

from .rulepack import DuplicateRule, RulePack

_CONTACT_COLUMNS = ("customer_id", "contact_name", "email", "customer_segment", "signup_date", "phone")
_ORDER_COLUMNS = ("order_id", "customer_name", "status", "amount", "order_date", "city", "state")
_APPOINTMENT_COLUMNS = (
    "appointment_id", "customer_name", "service_line", "technician", "appointment_time", "status", "notes", "updated_at",
)
_CHURN_COLUMNS = ("customer_id", "recency_days", "frequency", "monetary", "segment", "churned", "last_purchase_date")
_FORECAST_COLUMNS = ("date", "product_id", "quantity_sold", "revenue", "category")
_RECOMMENDATION_COLUMNS = ("user_id", "item_id", "rating", "timestamp", "category")

CONTACTS = RulePack(
    name="contacts",
    source_system="crm_customer_contacts_export",
    expected_columns=_CONTACT_COLUMNS,
    required_columns=_CONTACT_COLUMNS,
    primary_key=("customer_id",),
    date_columns={"signup_date": False},
    rename_map={"full_name": "contact_name"},
    value_maps={"customer_segment": {"vip": "VIP", "wholesale": "Wholesale", "retail": "Retail", "loyalty": "Loyalty"}},
    fill_defaults={"phone": "UNKNOWN"},
    case_columns={"contact_name": "title", "email": "lower"},
    validation_rules={
        "required_fields_present": "No contact field is empty.",
        "schema_matches": "Columns are the published contact columns.",
        "dates_canonical": "Sign-up dates read YYYY-MM-DD.",
        "emails_valid": "Every email is well formed.",
    },
    export_destination="customer_contacts_warehouse_ready_json",
)

ORDERS = RulePack(
    name="orders",
    source_system="shopify_orders_export",
    expected_columns=_ORDER_COLUMNS,
    required_columns=_ORDER_COLUMNS,
    primary_key=("order_id",),
    date_columns={"order_date": False},
    value_maps={"status": {"shipped": "shipped", "pending": "pending", "cancelled": "cancelled", "canceled": "cancelled"}},
    fill_defaults={"city": "UNKNOWN", "state": "UNKNOWN"},
    cast_columns={"amount": "float"},
    validation_rules={
        "required_fields_present": "No order field is empty.",
        "schema_matches": "Columns are the published order columns.",
        "duplicates_resolved": "One row per order.",
        "amounts_numeric_non_negative": "Amounts are numbers of zero or more.",
        "dates_canonical": "Order dates read YYYY-MM-DD.",
    },
    export_destination="orders_warehouse_ready_json",
    duplicate_rule=DuplicateRule(("order_id",), _ORDER_COLUMNS[1:]),
)

APPOINTMENTS = RulePack(
    name="appointments",
    source_system="field_service_scheduler_export",
    expected_columns=_APPOINTMENT_COLUMNS,
    required_columns=_APPOINTMENT_COLUMNS,
    primary_key=("appointment_id",),
    date_columns={"appointment_time": True, "updated_at": True},
    value_maps={
        "service_line": {
            "delivery": "Delivery", "install": "Installation", "installation": "Installation",
            "return pickup": "Returns", "returns": "Returns",
        },
        "technician": {"alex cole": "Alex Cole", "sam reed": "Sam Reed", "jo park": "Jo Park"},
    },
    fill_defaults={"technician": "TBD", "notes": "UNKNOWN"},
    case_columns={"customer_name": "title"},
    validation_rules={
        "required_fields_present": "No appointment field is empty.",
        "schema_matches": "Columns are the published appointment columns.",
        "duplicates_resolved": "One row per appointment.",
        "timestamps_canonical": "Times read YYYY-MM-DDTHH:MM.",
        "technician_assignments_valid": "Every appointment names a technician or a placeholder.",
    },
    export_destination="service_schedule_ready_json",
    duplicate_rule=DuplicateRule(("appointment_id",), _APPOINTMENT_COLUMNS[1:], "updated_at"),
)

CHURN = RulePack(
    name="churn",
    source_system="crm_rfm_export",
    expected_columns=_CHURN_COLUMNS,
    required_columns=_CHURN_COLUMNS,
    primary_key=("customer_id",),
    date_columns={"last_purchase_date": False},
    fill_defaults={"frequency": "6"},
    cast_columns={"monetary": "float"},
    case_columns={"segment": "title"},
    validation_rules={
        "required_fields_present": "No field is empty.",
        "schema_matches": "Columns are the published churn columns.",
        "dates_canonical": "Purchase dates read YYYY-MM-DD.",
        "cast_columns_numeric_non_negative": "Money is a number of zero or more.",
    },
    export_destination="xgb_churn_ready_json",
)

FORECAST = RulePack(
    name="forecast",
    source_system="ecommerce_sales_export",
    expected_columns=_FORECAST_COLUMNS,
    required_columns=_FORECAST_COLUMNS,
    primary_key=("date", "product_id"),
    date_columns={"date": False},
    case_columns={"category": "title"},
    fill_forward_columns=("quantity_sold",),
    validation_rules={
        "required_fields_present": "No field is empty.",
        "schema_matches": "Columns are the published sales columns.",
        "dates_canonical": "Dates read YYYY-MM-DD.",
    },
    export_destination="lstm_timeseries_ready_json",
)

RECOMMENDATIONS = RulePack(
    name="recommendations",
    source_system="recommendation_engine_export",
    expected_columns=_RECOMMENDATION_COLUMNS,
    required_columns=_RECOMMENDATION_COLUMNS,
    primary_key=("user_id", "item_id"),
    date_columns={"timestamp": False},
    fill_defaults={"rating": "3"},
    cast_columns={"rating": "float"},
    case_columns={"user_id": "lower", "category": "title"},
    validation_rules={
        "required_fields_present": "No field is empty.",
        "schema_matches": "Columns are the published interaction columns.",
        "dates_canonical": "Timestamps read YYYY-MM-DD.",
        "cast_columns_numeric_non_negative": "Ratings are numbers of zero or more.",
    },
    export_destination="lightfm_interactions_ready_json",
)

PACKS = {p.name: p for p in (CONTACTS, ORDERS, APPOINTMENTS, CHURN, FORECAST, RECOMMENDATIONS)}
