"""Explicit schemas, and additive evolution to them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TABLES: dict[str, str] = {
    "pages": ("rel_path string, title string, type string, tags array<string>, created string, updated string, "
                     "status string, links array<string>, body string, source_url string, asset_path string, "
                     "asset_mime string, memo boolean, pinned boolean, folder_ids array<string>"),
    "chunks": ("chunk_id string, rel_path string, title string, text string, tokens array<string>, "
                      "parent_text string, parent_id string, context_prefix string, external boolean, "
                      "asset_path string, tags array<string>, ord bigint"),
    "embeddings": ("chunk_id string, model string, text_hash string, dim int, vector array<float>"),
    "assets": ("id string, rel_path string, filename string, category string, mime string, size bigint, "
                      "extracted_path string, wiki_page string, created string, updated string, folder_ids array<string>"),
    "sessions": ("id string, created_at string, updated_at string, preview string, summary string, title string"),
    "turns": ("session_id string, turn bigint, role string, content string"),
    "qa": ("id string, question string, answer string, grounded int, sources string, session_id string, "
                  "wiki_page string, at string"),
    "audit": ("id bigint, at string, action string, object_type string, object_id string, detail string"),
    "orders": ("id string, plan string, amount decimal(18,2), status string, device_id string, pay_trade_no string, "
                      "qr_url string, activation_code string, product string, channel_code string, "
                      "created_at timestamp_ntz, paid_at timestamp_ntz"),
    "license_rows": ("id string, plan string, status string, unbind_count bigint, unbind_year bigint, note string, "
                            "last_seen_at string"),
    "golden": ("id string, type string, question string, expect_rel_contains string, expect_keyword string, "
                      "min_score double, expect_empty boolean"),
}


def with_defaults(df: DataFrame, schema: T.StructType | str, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Bring `df` to `schema`: absent columns are added, NULLs take their default, other columns stay behind.

    A plain projection, so applying it twice changes nothing and costs nothing."""
    defaults = defaults or {}
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def cell(field: T.StructField):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*[cell(f) for f in schema.fields], *extra)
