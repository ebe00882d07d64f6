"""Schemas of the catalog tables and streams, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_PRICING = "struct<model: string, base_price_usd: double, currency: string, payment_methods: array<string>, rates: map<string, double>>"
_CAPABILITIES = "struct<skills: array<string>, protocols: array<string>, languages: array<string>, models: array<string>, input_types: array<string>, output_types: array<string>>"

DDL = {
    "entities": f"entity_id string, name string, owner string, entity_url string, category string, tags array<string>, summary string, capability_summary {_CAPABILITIES}, public_key string, home_registry string, schema_version string, registered_at timestamp, updated_at timestamp, ttl int, signature string, developer_id string, entity_index int, developer_proof struct<developer_public_key: string, entity_index: int, developer_signature: string>, codebase_hash string, status string, last_heartbeat timestamp, entity_type string, service_endpoint string, openapi_url string, entity_pricing {_PRICING}",
    "remote_entities": f"entity_id string, name string, category string, tags array<string>, summary string, capability_summary {_CAPABILITIES}, home_registry string, entity_url string, received_at timestamp, tombstoned boolean, tombstone_at timestamp, origin_public_key string, developer_id string, developer_public_key string, status string, entity_type string, service_endpoint string, openapi_url string, entity_pricing {_PRICING}",
    "tombstones": "entity_id string, reason string, created_at timestamp, expires_at timestamp, signature string",
    "attestations": "entity_id string, observer_registry string, period string, invocations bigint, successes bigint, failures bigint, avg_latency_ms double, avg_rating double, signature string",
    "developers": "developer_id string, name string, public_key string, profile_url string, github string, home_registry string, schema_version string, registered_at timestamp, updated_at timestamp, signature string, dev_handle string, dev_handle_verified boolean, verification_method string, verification_proof string",
    "remote_developers": "developer_id string, name string, public_key string, profile_url string, github string, home_registry string, received_at timestamp, tombstoned boolean, tombstone_at timestamp, dev_handle string, dev_handle_verified boolean, verification_method string",
    "names": "fqan string, entity_name string, developer_handle string, registry_host string, entity_id string, developer_id string, current_version string, capability_tags array<string>, registered_at timestamp, updated_at timestamp, signature string",
    "name_versions": "fqan string, version string, entity_id string, build_hash string, registered_at timestamp, signature string",
    "remote_names": "fqan string, entity_name string, developer_handle string, registry_host string, entity_id string, current_version string, capability_tags array<string>, received_at timestamp, tombstoned boolean",
    "registry_proofs": "registry_id string, domain string, ed25519_public_key string, tls_spki_fingerprint string, proof_json string, proof_signature string, verification_tier string, issued_at timestamp, expires_at timestamp, received_at timestamp",
    "peer_attestations": "attester_id string, subject_id string, verified_layers array<string>, attested_at timestamp, signature string",
    "cards": "entity_id string, schema_version string, version string, status string, last_heartbeat timestamp, capabilities array<struct<name: string, description: string, input_schema: string, output_schema: string, protocols: array<string>, languages: array<string>, latency_p95_ms: int, examples: array<struct<input: string, output: string>>>>, pricing struct<model: string, currency: string, rates: map<string, double>, payment_methods: array<string>>, trust struct<total_invocations: bigint, success_rate: double, avg_rating: double, uptime_30d: double, verifications: array<struct<issuer: string, type: string, issued: string>>>, endpoints struct<invoke: string, health: string, websocket: string>, metadata struct<framework: string, model: string, owner_contact: string, documentation: string, source_code: string>, signature string, signed_at timestamp",
    "announcements": "seq bigint, type string, action string, entity_id string, developer_id string, fqan string, domain string, attester_id string, subject_id string, name string, category string, tags array<string>, summary string, home_registry string, entity_url string, status string, timestamp timestamp, arrived_at timestamp, origin_public_key string, public_key string, signature string, hop_count int, max_hops int, verified_layers array<string>, dev_handle string, entity_name string, registry_host string, version string, capability_tags array<string>, registry_id string, proof_json string",
    "heartbeats": "entity_id string, timestamp timestamp, arrived_at timestamp, signature string",
    "activity_events": "type string, timestamp timestamp, payload string",
    "search_requests": "query_id bigint, query string, category string, tags array<string>, skills array<string>, protocols array<string>, languages array<string>, models array<string>, min_trust_score double, status string, developer_id string, developer_handle string, fqan string, entity_type string, max_results int, offset int, federated boolean, enrich boolean",
}

#: The key of each table.
KEYS = {
    "entities": ["entity_id"], "remote_entities": ["entity_id"], "tombstones": ["entity_id"], "attestations": ["entity_id", "observer_registry", "period"],
    "developers": ["developer_id"], "remote_developers": ["developer_id"], "names": ["fqan"], "name_versions": ["fqan", "version"], "remote_names": ["fqan"],
    "registry_proofs": ["registry_id"], "peer_attestations": ["attester_id", "subject_id"], "cards": ["entity_id"],
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])
