"""Explicit schemas of the document tables and of the change feeds. Nothing is inferred."""

from __future__ import annotations

DOCS = "doc_id string, path string, format string, status string, error string, n_bytes bigint, content_sha256 string"
PARTS = "doc_id string, part string, n_bytes bigint, sha256 string, is_xml boolean, error string"
NODES = (
    "doc_id string, part string, node_id int, parent_id int, depth int, ord int, tag string, attrs map<string,string>, "
    "text string, trail array<string>, ids array<int>")

# Feeds. A block change message carries the new content of some blocks, the ids removed and the whole order.
BLOCK_CHANGES = (
    "doc_id bigint, session bigint, ts timestamp, event_id bigint, changed array<struct<id:string,html:string>>, "
    "removed array<string>, `order` array<string>")
DOC_EXTRAS = "doc_id bigint, session bigint, ts timestamp, event_id bigint, kind string, id string, value string"
PRESENCE = (
    "doc_id bigint, ts timestamp, event_id bigint, "
    "carets array<struct<id:string,name:string,colour:string,block_id:string,offset:int>>")
EDITS = "doc_id bigint, session bigint, ts timestamp, event_id bigint, coalesce_key string, op string, state string"
