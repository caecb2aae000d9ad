"""Column layouts of the stored tables and of a landed item."""

from __future__ import annotations

ITEM_COLUMNS = (
    "competitor_id", "item_ix", "url", "external_id", "title", "price", "currency", "stock_status", "sku", "image_url",
    "category",
)
ITEM_SCHEMA = (
    "competitor_id long, item_ix long, url string, external_id string, title string, price decimal(12,2), "
    "currency string, stock_status string, sku string, image_url string, category string"
)
STATE_COLUMNS = (
    "competitor_id", "product_id", "url", "external_id", "title", "normalized_title", "category", "image_url", "price",
    "currency", "stock_status", "sku", "first_seen_at", "last_seen_at", "last_checked_at", "active", "consecutive_misses",
)
STATE_SCHEMA = (
    "competitor_id long, product_id string, url string, external_id string, title string, normalized_title string, "
    "category string, image_url string, price decimal(12,2), currency string, stock_status string, sku string, "
    "first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp, active boolean, consecutive_misses int"
)
SCAN_SCHEMA = "competitor_id long, allow_empty boolean"
PAYLOAD_SCHEMA = (
    "struct<title:string,url:string,price:decimal(12,2),currency:string,stock_status:string,category:string,"
    "diff_amount:decimal(12,2),diff_percentage:decimal(18,2)>"
)
#: The append-only logs; in the store every row also has the `batch` it belongs to.
LOG_SCHEMAS = {
    "events": f"competitor_id long, product_id string, item_ix long, event_type string, old_value {PAYLOAD_SCHEMA}, new_value {PAYLOAD_SCHEMA}, "
              "event_message string, detected_at timestamp",
    "snapshots": "product_id string, competitor_id long, item_ix long, title string, category string, price decimal(12,2), currency string, "
                 "stock_status string, image_url string, checked_at timestamp",
    "runs": "competitor_id long, status string, products_found long, new_products_count long, price_changes_count long, error_message string, "
            "finished_at timestamp",
    "failures": "competitor_id long, event_type string, event_message string, detected_at timestamp",
}
