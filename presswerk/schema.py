"""Fields and types of the stored tables, as text, so that importing this needs no session."""

from __future__ import annotations

_SNAPSHOT = "struct<id:string,title:string,url:string,source:string,published_ts:bigint,content_hash:string,topic:string>"
_SECTION = f"struct<topic:string,`from`:bigint,`to`:bigint,sources:array<string>,sources_snapshots:array<{_SNAPSHOT}>,summary:string,meta:map<string,string>>"

ARTICLES = {"id": "string", "url": "string", "source": "string", "title": "string", "published": "string", "published_ts": "bigint", "fetched_at": "bigint", "text": "string", "content_hash": "string", "summarized": "boolean", "summarized_at": "bigint"}
JOB_EVENTS = {"job_id": "bigint", "seq": "bigint", "created_at": "bigint", "started_at": "bigint", "finished_at": "bigint", "status": "string", "message": "string", "summary_id": "string", "fields_json": "string"}
SUMMARIES = {
    "id": "string", "title": "string", "created": "bigint", "kind": "string", "llm": "map<string,string>", "prompts": "map<string,string>", "batching": "map<string,string>", "sources": "array<string>",
    "sources_snapshots": f"array<{_SNAPSHOT}>", "from": "bigint", "to": "bigint", "overview": "string", "summary": "string", "proofread_feedback": "string", "revised_summary": "string",
    "sections": f"array<{_SECTION}>", "meta": "map<string,string>", "selection": "map<string,string>", "doc_json": "string",
}
TEMP_SUMMARIES = {"job_id": "bigint", "created_at": "bigint", "summary": "string", "meta": "string"}
CHECKPOINTS = {"job_id": "bigint", "key": "string", "topic": "string", "batch_id": "int", "ids": "array<string>", "summary": "string", "trims": "int", "drops": "int"}
CORPUS = {"job_id": "bigint", "ord": "bigint", "article_id": "string", "topic": "string"}
FEEDS = {"name": "string", "url": "string", "topics": "array<string>", "category_include": "array<string>", "category_exclude": "array<string>"}
TABLES = {"articles": ARTICLES, "jobs": JOB_EVENTS, "summary_docs": SUMMARIES, "temp_summaries": TEMP_SUMMARIES, "checkpoints": CHECKPOINTS, "corpus": CORPUS}
#: Tables that are written by buckets of a key, so that an upsert rewrites only those that it touches.
BUCKETS = {"articles": ("id", 64)}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
