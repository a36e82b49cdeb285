"""The application tables: columns, keys, references and allowed values, as facts that checks can be run on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

from entityflow.params import STATUSES, TIERS


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


# Names, types and constraints of the stored tables.
TABLES: dict[str, Table] = {
    "users": Table(
        "id string, email string, anon_token_hash string, tier string, status string, storage_bytes_used bigint, created_at timestamp_ntz",
        ("id",), (("email",),), ("tier", "status"), {}, {"tier": ("anon", "free"), "status": ("active", "suspended")},
    ),
    "batches": Table(
        "id string, user_id string, status string, photo_count int, origin_url string, notify_on_complete boolean, "
        "notified_at timestamp_ntz, created_at timestamp_ntz, expires_at timestamp_ntz",
        ("id",), (), ("user_id", "status"), {"user_id": ("users", "id")},
        {"status": ("pending", "processing", "complete", "deferred", "failed")},
    ),
    "photos": Table(
        "id string, batch_id string, status string, storage_key string, source_type string, source_url string, bytes bigint, created_at timestamp_ntz",
        ("id",), (), ("batch_id", "status", "source_type"), {"batch_id": ("batches", "id")},
        {"status": ("pending", "fetching", "stored", "detecting", "done", "failed"), "source_type": ("upload", "imgur", "reddit")},
    ),
    "card_refs": Table(
        "id string, name string, set_id string, set_name string, number string, printed_total string, rarity string, "
        "image_url string, finishes array<string>, synced_at timestamp_ntz",
        ("id",), (), ("name", "set_id", "set_name", "number", "image_url", "finishes"),
    ),
    "cards": Table(
        "id string, photo_id string, crop_index int, crop_storage_key string, card_ref_id string, finish string, "
        "finish_needs_confirmation boolean, quantity int, confidence int, status string, accepted_stage string, rotation int, "
        "methods array<struct<method: string, ref_id: string, score: float>>, candidates array<string>, "
        "created_at timestamp_ntz, updated_at timestamp_ntz",
        ("id",), (("photo_id", "crop_index"),), ("photo_id", "crop_index", "quantity", "confidence", "status"),
        {"photo_id": ("photos", "id"), "card_ref_id": ("card_refs", "id")}, {"status": STATUSES},
    ),
    "prices": Table(
        "card_ref_id string, finish string, price_cents int, source string, fetched_at timestamp_ntz",
        ("card_ref_id", "finish"), (), ("source", "fetched_at"), {"card_ref_id": ("card_refs", "id")},
    ),
    "ref_hashes": Table(
        "id string, card_ref_id string, hash_type string, hash_bits bigint, source string, usage_count int, "
        "last_matched_at timestamp_ntz, created_at timestamp_ntz",
        ("id",), (), ("card_ref_id", "hash_type", "hash_bits", "source"), {"card_ref_id": ("card_refs", "id")},
        {"hash_type": TIERS, "source": ("reference", "augmented", "user_validated")},
    ),
    "corrections": Table(
        "id string, card_id string, crop_hash string, predicted_ref_id string, actual_ref_id string, created_at timestamp_ntz",
        ("id",), (), ("crop_hash", "actual_ref_id"), {"card_id": ("cards", "id"), "actual_ref_id": ("card_refs", "id")},
    ),
    "llm_cache": Table("crop_sha256 string, model string, response string, created_at timestamp_ntz", ("crop_sha256",), (), ("model", "response")),
    "usage": Table(
        "user_id string, day date, batches int, photos int, cards int, llm_calls int, llm_cost_cents int, fetches int",
        ("user_id", "day"), (), (), {"user_id": ("users", "id")},
    ),
    "sessions": Table(
        "id string, user_id string, token_hash string, created_at timestamp_ntz, last_seen_at timestamp_ntz, expires_at timestamp_ntz",
        ("id",), (("token_hash",),), ("user_id", "token_hash", "expires_at"), {"user_id": ("users", "id")},
    ),
    "magic_links": Table(
        "id string, email string, token_hash string, created_at timestamp_ntz, expires_at timestamp_ntz, used_at timestamp_ntz",
        ("id",), (("token_hash",),), ("email", "token_hash", "expires_at"),
    ),
    "exports": Table(
        "id string, user_id string, kind string, status string, storage_key string, card_count int, bytes bigint, last_error string, "
        "expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("id",), (), ("user_id", "kind", "status"), {"user_id": ("users", "id")},
        {"kind": ("pdf",), "status": ("queued", "rendering", "ready", "failed")},
    ),
    "jobs": Table(
        "id string, type string, payload string, status string, attempts int, max_attempts int, run_after timestamp_ntz, "
        "locked_at timestamp_ntz, locked_by string, last_error string, batch_id string, user_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("id",), (), ("type", "payload", "status"), {},
        {"status": ("queued", "running", "done", "failed"), "type": ("detect", "identify", "fetch_source", "ingest_correction", "price", "export")},
    ),
}
