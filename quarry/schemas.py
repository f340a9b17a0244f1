"""Schemas of the catalogue's tables, and the keys by which rows of some are replaced."""

KEYS = {"projects": ["id"], "files": ["project_id", "file_path"], "search": ["project_id", "file_path"], "overviews": ["project_id"], "index_meta": ["project_id"], "index_batches": ["project_id", "run", "batch"], "index_plan": ["project_id", "run", "file_path"]}

SCHEMAS = {
    "projects": "id string, name string, aliases array<string>, vector_mode boolean",
    "files": "id long, project_id string, file_path string, description string, file_hash string, last_modified long, version long, to_be_cleaned long",
    "search": "id long, project_id string, file_path string, to_be_cleaned long, pad string, d int",
    "overviews": "project_id string, overview string, last_modified long, total_files long, total_tokens long",
    "token_cache": "cache_key string, token_count long, created long, expires long",
    "merge_conflicts": "id long, project_id string, file_path string, source_branch string, target_branch string, source_description string, target_description string, resolution string, created long",
    "chunks": "id string, file_id long, project_id string, chunk_type string, name string, start_line int, end_line int, content_hash string, embedding_id string, redacted boolean, metadata map<string,string>, created long, last_modified long",
    "merkle_nodes": "project_id string, path string, parent_path string, node_type string, hash string, depth int",
    "index_meta": "project_id string, total_chunks long, indexed_chunks long, total_files long, indexed_files long, last_sync long, sync_status string, error_message string, queue_depth long, processing_rate double, estimated_completion long, metadata map<string,string>, created long, last_modified long",
    "vectors": "id string, project_id string, file_path string, chunk_index int, start_line int, end_line int, content string, content_hash string, redacted boolean, vector array<double>, file_mtime double",
    "index_plan": "project_id string, run string, file_path string, mtime double, batch int",
    "index_batches": "project_id string, run string, batch int, files long, status string, attempts int, part string, error string, updated long",
    "health": "monitor long, ts timestamp_ntz, event_id long, healthy boolean, ms double",
    "operations": "operation string, ts timestamp_ntz, event_id long, ok boolean, ms double, attempts long, message string",
}
