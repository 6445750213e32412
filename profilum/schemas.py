"""Typed schemas of the source files and of the produced records."""

from pyspark.sql import types as T

CUSTOMERS = "customer_id string, email string, first_name string, last_name string, phone string, company string, industry string, customer_since timestamp, acquisition_channel string, account_status string"
PRODUCTS = "product_id string, product_name string, description string, category string, price double, stock_quantity bigint, rating double, created_at timestamp"
ORDERS = "order_id string, customer_id string, customer_email string, order_date timestamp, status string, total_amount double, num_items bigint, shipping_address string, payment_method string"
SUPPORT_TICKETS = "ticket_id string, customer_id string, customer_email string, subject string, description string, status string, priority string, created_at timestamp, updated_at timestamp, resolution_time_hours bigint, satisfaction_rating bigint, tags string"
ANALYTICS_EVENTS = "event_id string, user_id string, session_id string, event_type string, page_path string, event_timestamp timestamp, device_category string, traffic_source string"
TICKETS_EMBEDDED = "ticket_id string, customer_email string, subject string, description string, status string, priority string, created_at timestamp, updated_at timestamp, satisfaction_score double, full_text string, embedding array<double>, embedding_model string, embedded_at timestamp"
PRODUCTS_EMBEDDED = "product_id string, product_name string, description string, category string, price double, full_text string, embedding array<double>, embedding_model string, embedded_at timestamp"
INTERACTIONS = "interaction_id string, customer_id string, timestamp timestamp, channel string, sentiment_score double, content string, metadata map<string,string>"
RECOMMENDATIONS = "array<struct<product_id string, product_name string, description string, price double, category string, relevance_score double, reason string, image_url string>>"

SOURCES = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "support_tickets": SUPPORT_TICKETS,
    "analytics_events": ANALYTICS_EVENTS,
}

# Columns a table must carry before the operators accept it.
REQUIRED_COLUMNS = {
    "customer_profile": ["customer_id", "email", "customer_segment", "churn_risk"],
    "tickets_embedded": ["ticket_id", "full_text", "embedding"],
    "products_embedded": ["product_id", "full_text", "embedding"],
}


def struct(ddl: str) -> T.StructType:
    """The schema as a StructType, for readers that do not take text."""
    return T.StructType.fromDDL(ddl)
